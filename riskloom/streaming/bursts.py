"""Bursts of near-line deposits on a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.scratch import Scratch
from riskloom.sources.ledger import from_tables

SCHEMA = "tx_id string, us long, src string, dst string, amount_c long, channel string, tx_pos long"


def structuring_bursts(tx: DataFrame, line_c: int = 1_000_000, least: int = 3, late: str = "1 hour") -> DataFrame:
    """Windows of 72 hours, a new one every 12, in which deposits just below the line reach it.

    Works on batches and streams; on a stream, rows later than ``late`` are dropped
    and a window comes out when it can't change any more.
    """
    at = tx.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    band = at.filter((F.col("amount_c") * 10 >= 7 * line_c) & (F.col("amount_c") < line_c))
    found = band.groupBy(F.window("at", "72 hours", "12 hours"), F.col("dst").alias("account_id")).agg(F.count("*").alias("n"), F.sum("amount_c").alias("total_c"))
    found = found.filter((F.col("n") >= least) & (F.col("total_c") >= line_c))
    return found.select("account_id", F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "n", "total_c")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts that a stream over the ledger's transactions has written when its input ends."""
    scratch = Scratch(spark, "bursts")
    source, sink = scratch.path("tx"), scratch.path("found")
    from_tables(spark, sf_dir).tx.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(source)
    stream = structuring_bursts(spark.readStream.schema(SCHEMA).parquet(source))
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch.path("state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("account_id string, start_us long, end_us long, n long, total_c long").parquet(sink)
