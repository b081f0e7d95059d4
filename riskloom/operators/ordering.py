"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.scratch import Scratch

_BITS = 33  # of a row's number within its partition, as Spark numbers rows


def numbered(df: DataFrame, keys: list[Column], scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """df with place, from 1, by the keys, which must order all rows.

    Rows are dealt to ranges of the keys and sorted there; a row's place is its number in
    its range and the rows of the ranges before. Only a count for each range goes to the
    driver. Give slim rows: join what else belongs to them afterwards.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.put(rows, "ordered").withColumn("_range", F.shiftright("_at", _BITS).cast("int"))
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(n)]
    before = F.array(*(F.lit(x).cast("long") for x in accumulate(counts, initial=0)))
    return rows.withColumn("place", before[F.col("_range")] + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).drop("_at", "_range")
