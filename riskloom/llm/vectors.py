"""Shared pieces of the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def common_size(df: DataFrame, vector: str) -> int | None:
    """The length that most usable vectors have, the larger among equals; None if there are none."""
    sizes = df.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return row[0]["d"] if row else None


def matrix(column: pa.Array | pa.ChunkedArray, d: int, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)
