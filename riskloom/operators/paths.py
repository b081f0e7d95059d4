"""Shortest directed flows between two accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.scratch import Scratch

HOPS = "hop int, src string, dst string, tx_id string, amount_c long, us long, channel string"


def trace_path(tx: DataFrame, source: str, target: str, max_hops: int = 6, accounts: DataFrame | None = None) -> DataFrame:
    """The hops (hop, src, dst, tx_id, amount_c, us, channel) of a shortest flow; none if there is none.

    Breadth first from both ends, on each pair's first transfer as given: every round grows the
    smaller frontier, until the two meet. Then the accounts where they meet are followed to the
    target through the layers found from there. An account remembers one transfer, the first as
    given among those that reach it in its round, so nothing grows with the number of paths,
    and hops are those of a search from the source alone. An account is not a flow
    to itself; with ``accounts``, both ends must be among them.
    """
    spark, scratch = tx.sparkSession, Scratch(tx.sparkSession, "paths")
    if source == target:
        raise ValueError("source and target are the same account")
    if accounts is not None and accounts.filter(F.col("account_id").isin(source, target)).select("account_id").distinct().count() < 2:
        raise ValueError("unknown account")
    first = F.min(F.struct("tx_pos", "src", "tx_id", "amount_c", "us", "channel"))
    edges = scratch.put(tx.filter("src <> dst").groupBy("src", "dst").agg(first.alias("f")), "edges")
    ends = {"src": [spark.createDataFrame([(source,)], "node string")], "dst": [spark.createDataFrame([(target,)], "node string")]}
    reached = {"src": [], "dst": []}  # layers with the transfer that reaches each node
    sizes, found = {"src": 1, "dst": 1}, False
    while not found and min(sizes.values()) and len(reached["src"]) + len(reached["dst"]) < max_hops:
        side = min(sizes, key=sizes.get)
        other = "dst" if side == "src" else "src"
        seen = reduce(DataFrame.union, [x.select("node") for x in ends[side]])
        near = edges.join(ends[side][-1].select(F.col("node").alias(side)), side, "left_semi").groupBy(F.col(other).alias("node")).agg(F.min("f").alias("f"))
        layer = scratch.put(near.join(seen, "node", "left_anti"), "layer")
        met = layer.join(ends[other][-1].select("node", F.lit(1).alias("met")), "node", "left").agg(F.count("*"), F.count("met")).first()
        sizes[side], found = met[0], met[1] > 0
        reached[side].append(layer)
        ends[side].append(layer.select("node"))
    if not found:
        return spark.createDataFrame([], HOPS)
    # from where they meet, onward through the layers around the target
    way, at = reached["src"], ends["src"][-1].join(ends["dst"][-1], "node", "left_semi")
    for layer in ends["dst"][-2::-1]:
        onward = edges.join(at.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("f")).join(layer, "node", "left_semi")
        way.append(scratch.put(onward, "onward"))
        at = way[-1].select("node")
    node, hops = target, []
    for hop in range(len(way), 0, -1):
        f = way[hop - 1].filter(F.col("node") == node).select("f.*").first()
        hops.append((hop, f["src"], node, f["tx_id"], f["amount_c"], f["us"], f["channel"]))
        node = f["src"]
    return spark.createDataFrame(hops[::-1], HOPS)  # max_hops rows at most


def flow_of(path: DataFrame) -> DataFrame:
    """One row on a path: whether there is one, its hops and what they moved in all."""
    return path.agg((F.count("*") > 0).alias("found"), F.count("*").alias("n_hops"), F.coalesce(F.sum("amount_c"), F.lit(0)).alias("total_c"))
