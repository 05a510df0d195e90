"""Readers: Parquet tables by name with explicit columns, files by extension, secured views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A projected table scan; only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def point_lookup(df: DataFrame, column: str, value, required: bool = False) -> DataFrame:
    """Zero or one row by key; with ``required`` no row, or more than one, is an error."""
    hit = df.where(F.col(column) == F.lit(value)).limit(2)
    if required and hit.count() != 1:
        raise LookupError(f"not exactly one row with {column} = {value!r}")
    return hit.limit(1)


def exact_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """One page of a total order (``order`` must be unique), counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


PAGE_SCHEMA = T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_count", T.LongType())])


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    """A text file as one page (whole file = page 1)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.lit(1).alias("page_number"), F.col("value").alias("text"), F.length("value").cast("long").alias("char_count"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a given schema; blank lines give no rows."""
    return spark.read.schema(schema).json(path).where(" or ".join(f"`{f.name}` is not null" for f in schema.fields))


def read_node_payload(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Items of a JSON payload that is a list, or an object with ``nodes`` or ``results``."""
    text = spark.read.text(path, wholetext=True)
    wrapped = T.StructType([T.StructField("nodes", T.ArrayType(item)), T.StructField("results", T.ArrayType(item))])
    listed = F.from_json("value", T.ArrayType(item))
    inside = F.from_json("value", wrapped)
    items = F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(F.coalesce(inside["nodes"], inside["results"]))
    return text.select(F.explode(items).alias("item")).select("item.*")


READERS = {".txt": read_text_document, ".text": read_text_document}


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension; an unknown one is an error."""
    for suffix, reader in READERS.items():
        if path.lower().endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def html_text(html: str = "html") -> F.Column:
    """Text of an HTML column: scripts, styles and tags go, common entities are decoded, blanks collapse."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def secured(df: DataFrame, owner: str, principal, columns: Sequence[str]) -> DataFrame:
    """Rows of one owner and an allow-list of columns; hidden columns can't be asked for later."""
    return df.where(F.col(owner) == F.lit(principal)).select(*columns)
