"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the least node reached.

    A round is a few aggregations on (node, neighbour) rows, summed before they
    are shuffled; its edges are written and reread. The number of edges never
    grows and no node's neighbours are gathered in a list. It ends when all edges
    are stars: no node has two roots or is itself a root's leaf.
    """
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u is linked to u's lowest neighbour
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: u and its smaller neighbours are linked to the lowest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, edges = edges, scratch.put(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        scratch.free(before)
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("leaf")).union(edges.select("v", F.lit(0)))
        open_ = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least")).filter("leaf > 1 or (leaf = 1 and least = 0)")
        if not open_.limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
