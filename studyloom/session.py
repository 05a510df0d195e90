"""Session helpers shared by entry points, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "studyloom") -> SparkSession:
    """A local session with the settings the library expects (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once a Spark context)."""
    context = spark.sparkContext
    if getattr(context, "_studyloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="studyloom-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    context._studyloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``; where it is unset, one of our own, which only a
    local master can share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_studyloom_folder", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = spark._studyloom_folder = tempfile.mkdtemp(prefix="studyloom-")
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
