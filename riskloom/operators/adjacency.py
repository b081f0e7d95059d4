"""Transfers by the accounts that they touch, in folders that one account's views prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.scratch import Scratch

FOLDERS = 64


def folder(account: Column) -> Column:
    return F.pmod(F.hash(account), F.lit(FOLDERS))


def touching(tx: DataFrame, scratch: Scratch) -> DataFrame:
    """tx with account and folder: a row for each end, one for a transfer to oneself.

    A folder's rows are sorted by account, so its files' footers skip others. A busy
    account's rows are one run in it, over as many files as wrote it.
    """
    ends = tx.withColumn("account", F.explode(F.array_distinct(F.array("src", "dst")))).withColumn("folder", folder(F.col("account")))
    # a folder is spread by time, so that none is one task's
    ends = ends.repartition("folder", F.pmod(F.hash("tx_pos"), F.lit(4))).sortWithinPartitions("folder", "account")
    return scratch.put(ends, "touching", by="folder")


def of_account(store: DataFrame, account: str) -> DataFrame:
    """The transfers that touch an account, from its folder alone."""
    return store.filter((F.col("folder") == folder(F.lit(account))) & (F.col("account") == account)).drop("account", "folder")


def of_accounts(store: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct transfers that touch any of the accounts (a column account)."""
    keys = accounts.select("account", folder(F.col("account")).alias("folder")).distinct()
    return store.join(keys, ["folder", "account"], "left_semi").drop("account", "folder").dropDuplicates(["tx_id"])
