"""Reviewers' decisions on accounts: an append-only log whose last word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ordering import numbered
from riskloom.plans.views import ACTIONS
from riskloom.scratch import Scratch

COLUMNS = "seq long, at long, account_id string, action string, ledger string"


class DecisionLog:
    """A folder of Parquet files, one batch a commit, which any number of readers may read meanwhile.

    A row is a decision: seq (its place in the log), at (the time given), account_id, action and the
    ledger it was made on. ``append`` numbers a batch by (at, account_id, action) after all that
    are there, so batches have an order even where times tie. One writer at a time. When a ledger is made
    anew under another name, its decisions start from nothing; those on others stay in the log.
    ``compact`` writes the last decisions alone to a new folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(self.path)

    def append(self, batch: DataFrame, ledger: str) -> None:
        """batch: at, account_id, action; unknown actions are an error, and nothing is written then."""
        wrong = batch.filter(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | F.col("account_id").isNull())
        if wrong.limit(1).count():
            raise ValueError(f"actions are {', '.join(ACTIONS)}")
        last = self.rows().agg(F.max("seq")).first()[0] or 0
        rows = numbered(batch.select("at", "account_id", "action"), [F.col("at"), F.col("account_id"), F.col("action")], Scratch(self.spark, "decisions"))
        rows.select((F.col("place") + last).alias("seq"), F.col("at").cast("long"), "account_id", "action", F.lit(ledger).alias("ledger")).write.mode("append").parquet(self.path)

    def last(self, ledger: str) -> DataFrame:
        """at, account_id, action: the last decision on each account of a ledger; at is its place in the log."""
        rows = self.rows().filter(F.col("ledger") == ledger)
        best = rows.groupBy("account_id").agg(F.max(F.struct("seq", "action")).alias("d"))
        return best.select(F.col("d.seq").alias("at"), "account_id", F.col("d.action").alias("action"))

    def compact(self, path: str) -> DecisionLog:
        """A log in a new folder with the last decisions of every ledger, under their places."""
        best = self.rows().groupBy("ledger", "account_id").agg(F.max(F.struct("seq", "at", "action")).alias("d"))
        best.select("d.seq", "d.at", "account_id", "d.action", "ledger").write.parquet(path)
        return DecisionLog(self.spark, path)
