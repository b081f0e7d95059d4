"""Accounts that share identifiers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import at_most_one, r2

KEYS = ("device_id", "signup_ip", "email", "phone")


def device_linkage(accounts: DataFrame, least: int = 3, keep: int = 10) -> DataFrame:
    """Accounts in clusters of one identifier, with the size of the union of their clusters.

    The union is counted by inclusion and exclusion: for each set of identifiers,
    how many accounts have the same values of all of them. So a cluster of any
    size costs a count, never the pairs of its members.
    """
    rows = accounts.select("account_id", *(F.when(F.col(k) != "", F.col(k)).alias(k) for k in KEYS)).dropDuplicates(["account_id"])
    flat = rows.unpivot("account_id", list(KEYS), "key", "value").filter("value is not null")
    sizes = flat.groupBy("key", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    held = flat.join(sizes, ["key", "value"])
    # only values that form a cluster remain
    mine = held.groupBy("account_id").agg(
        *(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in KEYS),
        F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("shared"),
    )
    # each set of identifiers an account has, with the sign that it counts with
    sets = [ks for r in range(1, len(KEYS) + 1) for ks in itertools.combinations(KEYS, r)]
    value = lambda ks: F.when(F.expr(" and ".join(f"{k} is not null" for k in ks)), F.to_json(F.struct(*ks)))
    held_sets = F.array_compact(F.array(*(F.when(value(ks).isNotNull(), F.struct(value(ks).alias("s"), F.lit((-1) ** (len(ks) + 1)).alias("sign"))) for ks in sets)))
    flat_sets = mine.select("account_id", F.explode(held_sets).alias("h")).select("account_id", "h.*")
    terms = flat_sets.join(flat_sets.groupBy("s").agg(F.count("*").alias("n")), "s").groupBy("account_id").agg(F.sum(F.col("sign") * F.col("n")).alias("cluster_size"))
    counted = mine.select("account_id", "shared").join(terms, "account_id")
    rank = F.row_number().over(Window.partitionBy("key", "value").orderBy("account_id"))
    lowest = held.withColumn("rank", rank).filter(F.col("rank") <= keep + 1).groupBy("key", "value").agg(F.collect_list("account_id").alias("low"))
    near = held.join(lowest, ["key", "value"]).groupBy("account_id").agg(F.flatten(F.collect_list("low")).alias("low"))
    others = F.slice(F.array_sort(F.array_remove(F.array_distinct("low"), F.col("account_id"))), 1, keep)
    out = counted.join(near.select("account_id", others.alias("linked_accounts")), "account_id")
    return out.select("account_id", "cluster_size", "shared", "linked_accounts", r2(at_most_one(0.4 + 0.1 * F.col("cluster_size"))).alias("score"))
