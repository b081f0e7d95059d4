"""Small dense communities by modularity, with moves in rounds over the whole graph, to a local optimum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskloom.functions import r2, rounded
from riskloom.scratch import Scratch

WIDE = "decimal(38,0)"  # products of two sums of cents pass a long
#: All rounds but the last ones go on while they gain one in so many of the modularity's range; the last while they gain at all.
FEW = 1_000


def payment_graph(tx: DataFrame, least_c: int = 0) -> DataFrame:
    """a, b, w: pairs of accounts in order of name, with what they paid each other; a transfer to oneself is a loop."""
    return tx.filter(F.col("amount_c") >= least_c).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("amount_c").alias("w"))


def both_ways(graph: DataFrame) -> DataFrame:
    """node, other, w without loops."""
    linked = graph.filter("a <> b")
    return linked.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").union(linked.select("b", "a", "w"))


def judge(links: DataFrame, home: DataFrame, twice: int) -> DataFrame:
    """node, degree, now, gain, to of the active nodes that gain by a move, to where they gain most, the least name among equals.

    A node of degree d in A gains 2T (w_B - w_A) - d (D_B - (D_A - d)) by going to B, where T is
    the graph's weight, D a community's degree and w the node's weight to it: half of (2T)^2
    times what the modularity gains. All terms are whole numbers, so no order of sums counts.
    """
    awake = home.filter("active").select("node", "degree", F.col("community").alias("now"), (F.col("size") - F.col("degree")).alias("rest"))
    there = home.select(F.col("node").alias("other"), "community", "size")
    near = links.join(awake, "node").join(there, "other").groupBy("node", "community", "degree", "now", "rest", "size").agg(F.sum("w").alias("w"))
    own = F.col("community") == F.col("now")
    value = (times(F.lit(twice), F.col("w")) - times(F.when(own, F.col("rest")).otherwise(F.col("size")), F.col("degree"))).cast(WIDE)
    near = near.select("node", "degree", "now", "rest", "community", own.alias("own"), value.alias("value"))
    most = F.min(F.when(~F.col("own"), F.struct((-F.col("value")).alias("m"), "community"))).alias("t")
    best = near.groupBy("node", "degree", "now", "rest").agg(F.max(F.when(F.col("own"), F.col("value"))).alias("stay"), most)
    alone = -times(F.col("rest"), F.col("degree"))  # no neighbour where it is
    gain = (-F.col("t.m") - F.coalesce("stay", alone.cast(WIDE))).cast(WIDE)
    return best.select("node", "degree", "now", gain.alias("gain"), F.col("t.community").alias("to")).filter("gain > 0")


def times(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def sure(links: DataFrame, wish: DataFrame, twice: int) -> DataFrame:
    """wish with margin: more than 0 for moves that surely gain together.

    In order of gain, a move is charged with what those before it may cost it: for the same
    source or target the product of the degrees, and, where a neighbour leaves the node's target
    or comes to its source, the link between them (2T w). All else that two moves change in
    each other is in their favour. Moves whose gain exceeds the charge go ahead, the first one
    at least. So every round raises the modularity by the margins or more, and rounds must end.
    """
    ahead = lambda by: F.coalesce(F.sum("degree").over(Window.partitionBy(by).orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.struct((-F.col("gain")).alias("g"), "node")
    a, b = wish.select("node", "now", "to", before.alias("a")), wish.select(F.col("node").alias("other"), F.col("now").alias("from"), F.col("to").alias("into"), before.alias("b"))
    met = links.join(a, "node").join(b, "other").filter("b < a")
    n = (F.col("to") == F.col("from")).cast("long") + (F.col("into") == F.col("now")).cast("long")
    met = met.groupBy("node").agg(F.sum(F.col("w") * n).alias("missed"))
    crowd = wish.withColumn("ahead", ahead("now") + ahead("to")).join(met, "node", "left")
    charge = times(F.col("ahead"), F.col("degree")) + times(F.lit(twice), F.coalesce("missed", F.lit(0)))
    return crowd.select("node", "to", (F.col("gain") - charge).cast(WIDE).alias("margin"))


def sized(home: DataFrame) -> DataFrame:
    return home.join(home.groupBy("community").agg(F.sum("degree").alias("size")), "community")


def turn(links: DataFrame, home: DataFrame, twice: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The homes after a round, how many active nodes gained by a move, and the margins' sum.

    Next to be judged are nodes that gain but stayed, those that moved and their neighbours.
    """
    seen = Observation()
    wish = scratch.put(judge(links, home, twice).observe(seen, F.count("*").alias("n")), "wish")
    if not (eager := seen.get["n"]):
        return home, 0, 0
    went, gained = F.col("margin") > 0, Observation()
    moved = scratch.put(sure(links, wish, twice).observe(gained, F.sum(F.when(went, F.col("margin"))).alias("margin")), "moved")
    woken = links.join(moved.filter(went).select(F.col("node").alias("other")), "other", "left_semi").select("node").union(moved.select("node")).distinct()
    after = home.select("node", "degree", "community").join(moved.filter(went).select("node", "to"), "node", "left").join(woken.withColumn("active", F.lit(True)), "node", "left")
    after = after.select("node", "degree", F.coalesce("to", "community").alias("community"), F.coalesce("active", F.lit(False)).alias("active"))
    out = scratch.put(sized(after), "home")
    scratch.free(wish, moved, home)
    return out, eager, int(gained.get["margin"])


def placed(graph: DataFrame, start: DataFrame | None) -> DataFrame:
    """node, degree, community, active, size: all nodes awake, alone or where ``start`` has them; a loop counts twice."""
    degree = graph.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("degree"))
    found = degree.withColumn("community", F.col("node")) if start is None else degree.join(start, "node")
    return sized(found.withColumn("active", F.lit(True)))


def rounds(graph: DataFrame, start: DataFrame | None, twice: int, scratch: Scratch, to_the_end: bool = False) -> tuple[DataFrame, bool]:
    """node, community after rounds that gain a ``FEW``th or more each, and whether there was one.

    to_the_end: rounds go on while any node gains; when no active node does, all are judged.
    """
    links, home = scratch.put(both_ways(graph), "links"), scratch.put(placed(graph, start), "home")
    moved, every = False, True
    while True:
        home, eager, margin = turn(links, home, twice, scratch)
        much = margin * FEW >= twice * twice
        if eager and (much or to_the_end):
            moved, every = True, False
        elif to_the_end and not every:
            home, every = home.withColumn("active", F.lit(True)), True
        else:
            return home.select("node", "community"), moved


def partition(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """account_id, community: a partition that no move of an account improves.

    Accounts move while a round gains a ``FEW``th of the modularity's range or more. Then
    communities move alike, as the nodes of a smaller graph, and again as nodes of one smaller
    still, until that gives no such round. At last accounts move on from there until none
    gains, which is the proof: every account is judged and stays. Modularity rises in every
    round, so this ends by itself. Nothing is gathered by community or component. Only the total
    weight, counts and sums go to the driver.
    """
    twice = 2 * int(graph.agg(F.sum("w")).first()[0] or 0)
    if not twice:
        return placed(graph, None).select(F.col("node").alias("account_id"), "community")
    of, moved = rounds(graph, None, twice, scratch)[0], True
    while moved:
        x, y = (of.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
        merged = graph.join(x, "a").join(y, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        home, moved = rounds(scratch.put(merged, "groups"), None, twice, scratch)
        joined = home.select(F.col("node").alias("community"), F.col("community").alias("joined"))
        of = scratch.put(of.join(joined, "community").select("node", F.col("joined").alias("community")), "of")
    return rounds(graph, of, twice, scratch, to_the_end=True)[0].withColumnRenamed("node", "account_id")


def evidence(home: DataFrame, graph: DataFrame, smallest: int = 3, largest: int = 12, density: float = 0.5) -> DataFrame:
    """members, size, density, score of the communities (account_id, community) of few accounts that mostly pay each other."""
    sizes = home.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n").between(smallest, largest))
    few = home.join(sizes, "community")
    members = few.groupBy("community", "n").agg(F.array_sort(F.collect_list("account_id")).alias("members"))
    x, y = (few.select(F.col("account_id").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
    inner = graph.filter("a <> b").join(x, "a").join(y, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("m"))
    share = 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))
    found = members.join(inner, "community").withColumn("share", share).filter(F.col("share") >= density)
    return found.select("members", F.col("n").alias("size"), rounded(F.col("share"), 3).alias("density"), r2(F.least(F.lit(1.0), "share")).alias("score"))


def communities(tx: DataFrame, smallest: int = 3, largest: int = 12, density: float = 0.5, least_c: int = 0) -> DataFrame:
    """Communities of few accounts that mostly pay each other, by transfers of ``least_c`` at least."""
    scratch = Scratch(tx.sparkSession, "communities")
    graph = scratch.put(payment_graph(tx, least_c), "graph")
    return evidence(scratch.put(partition(graph, scratch), "communities"), graph, smallest, largest, density)
