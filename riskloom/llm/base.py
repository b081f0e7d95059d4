"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and \x09 to \x0D.
SPACES = "[ \\t-\\r]+"
#: Text bytes that a Python task handles at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of the keys, null equal to null, that still sorts and hashes."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with a bounded amount of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).nbytes / batch.num_rows
        step = max(1, int(SLICE_BYTES / max(sizes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
