"""Session helpers: the shared folder, written intermediate tables, sizes and partition counts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Text that one shuffle partition stands for.
PARTITION_BYTES = 16 << 20
#: A side is broadcast only if a count has shown that it has at most so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let go of what ended jobs have left. Spark frees their shuffles, broadcasts and accumulators when their handles on the driver
    are collected, which in a long chain of small jobs comes late."""
    gc.collect()
    spark._jvm.System.gc()


def prefix_for(df: DataFrame, mark: str = "__") -> str:
    """A beginning that no column of ``df`` has, for the names of helper columns."""
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def n_partitions(docs: DataFrame, column: str = "text", per: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for work in proportion to the text: the session's number, or more if the text is larger."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per), 1)


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether a written table is proven to have at most BROADCAST_BYTES."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its size allows it; else Spark joins by shuffle."""
    return F.broadcast(df) if small(df, row_bytes) else df


def bucket_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions one key that Spark's hash partitioning sends there, so that buckets are even."""
    place = F.pmod(F.hash("k"), F.lit(parts))
    keys = spark.range(24 * parts).select(F.col("id").cast("int").alias("k")).groupBy(place.alias("p")).agg(F.min("k").alias("k"))
    found = {r.p: r.k for r in keys.collect()}
    return [found.get(p, p) for p in range(parts)]
