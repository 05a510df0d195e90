"""A corpus pipeline of five stages, each one of the library's training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the
documents are written as Parquet to the shared folder and read again.

1. toxicity: documents that the classifier chain calls toxic go.
2. line_dedup: repeated and near-repeated lines go but for their first occurrence, and documents whose
   every line was one of those go with them; n_chars follows the text.
3. jaccard_join: of documents linked by 5-word shingles at similarity 0.8 or more one stays, the least id.
4. decontaminate: documents that hold a window of a benchmark item go.
5. source_mix: the rest get their blocks and slots in a mixture by source and are laid out in that order.

Each stage first lets the driver drop what the one before has left.

Null texts and ids pass every stage unless a stage's operator says otherwise; empty input gives empty
output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontaminate as _decontaminate
from studyloom.llm import jaccard_join as _jaccard
from studyloom.llm import line_dedup as _lines
from studyloom.llm import source_mix as _mix
from studyloom.llm import toxicity as _toxicity
from studyloom.llm.shared import n_partitions, settle, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    columns = docs.columns
    scored = _toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(~F.col("is_toxic")).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    out = _lines.line_dedup(docs)
    emptied = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_removed_lines"))
    out = out.where(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return _jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    out = _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    mixed = _mix.mix_sources(docs)
    return mixed.repartitionByRange(n_partitions(docs), "slot", "position").sortWithinPartitions("slot", "position")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

#: A classifier and hashed orders are not SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
