"""Row-preserving Arrow maps: every column passes through and computed columns are added."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import kernels
from .kernels import buffers, slices


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches are bounded in bytes as well as rows, so that long documents don't pile up."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def with_computed(df: DataFrame, text: str, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns that ``compute`` returns for slices of rows of bounded text.

    A column of ``df`` whose name is among the new ones (in any case) gives way to the new column.
    """
    bounded_batches(df)
    new = {f.name.lower() for f in fields}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)
    arrow = to_arrow_schema(T.StructType(fields))
    limit = kernels.SLICE_BYTES
    names = df.columns

    def run(batches):
        for batch in batches:
            _, offsets = buffers(batch.column(names.index(text)))
            for a, b in slices(offsets, limit):
                part = batch.slice(a, b - a)
                got = compute(part)
                arrays = [part.column(names.index(c)) for c in kept] + [got[f.name].cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in arrow)])

    return df.mapInArrow(run, schema)
