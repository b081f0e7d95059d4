"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' content in a tree domain - language - source. A token
budget goes down the tree by the weights of siblings. A node cannot take more
than the supply under it times ``max_epochs``, without what has a weight of 0; what it leaves is shared among its siblings
by weight, and only what all siblings together cannot take is left to the level
above. A leaf spends its budget on whole passes (epochs) over its documents and
a prefix, by tokens, of the next pass, in an order seeded by pass and document.
Tokens are words between blanks unless ``tokens`` says otherwise, so scripts without
blanks need a tokenizer's count there.

The prefix is a threshold on that order's hash. It is found from token sums of
4096 ranges of the hash and then in the one range where the budget ends, so a
leaf with a third of all rows is never sorted in one task. Leaves (``max_leaves``
at most, else an error) are the only thing that goes to the driver, and
documents are then picked by a filter, so texts aren't shuffled.

Results for odd input: a null domain, language or source is named ''; a null
text has no tokens, and rows without tokens come with the prefix they fall in;
rows of one id have one place in the order and come or go together; an empty
table gives an empty result. Picked rows come whole in a struct beside the mix's
own columns, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import words
from riskloom.scratch import Scratch

LEVELS = ("domain", "lang", "source")
RANGE_BITS = 12


def share(budget: float, weights: Sequence[float], limits: Sequence[float]) -> list[float]:
    """The budget by weight, no part over its limit; what one cannot take goes to the others."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if budget * weights[i] >= limits[i] * total]
        if not full:
            for i in open_:
                out[i] = budget * weights[i] / total
            break
        for i in full:
            out[i] = limits[i]
        budget -= sum(limits[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(supply: Mapping[tuple[str, ...], int], weights: Sequence[Mapping[str, float]], budget: float, max_epochs: int) -> dict[tuple[str, ...], float]:
    """Tokens of each leaf. weights: for each level, by name; 1 for names that aren't there."""

    def below(depth: int, leaves: list[tuple[str, ...]]) -> dict[str, list[tuple[str, ...]]]:
        out: dict[str, list[tuple[str, ...]]] = {}
        for leaf in leaves:
            out.setdefault(leaf[depth], []).append(leaf)
        return out

    def limit(depth: int, leaves: list[tuple[str, ...]]) -> float:
        """What the leaves can take: nothing of it is under a weight of 0."""
        if depth == len(weights):
            return float(max_epochs * sum(supply[x] for x in leaves))
        return sum(limit(depth + 1, some) for name, some in below(depth, leaves).items() if weights[depth].get(name, 1.0) > 0)

    def spend(prefix: tuple[str, ...], leaves: list[tuple[str, ...]], amount: float) -> dict[tuple[str, ...], float]:
        depth = len(prefix)
        if depth == len(weights):
            return {prefix: amount}
        groups = below(depth, leaves)
        names = sorted(groups)
        parts = share(amount, [weights[depth].get(n, 1.0) for n in names], [limit(depth + 1, groups[n]) for n in names])
        return {k: v for n, p in zip(names, parts, strict=True) for k, v in spend((*prefix, n), groups[n], p).items()}

    return spend((), list(supply), budget)


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("")))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Sequence[Mapping[str, float]],
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 17,
    tokens: Column | None = None,
    max_leaves: int = 100_000,
) -> DataFrame:
    """row (the picked row), domain, n_tokens and epoch; budget_share is of all tokens."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    tokens = F.size(words(F.coalesce("text", F.lit("")))) if tokens is None else tokens
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    path = F.struct(name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"))
    sized = scratch.put(docs.select("doc_id", path.alias("leaf"), tokens.cast("long").alias("tokens")), "sized")

    found = sized.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).limit(max_leaves + 1).collect()
    if len(found) > max_leaves:
        raise ValueError(f"over {max_leaves} leaves")
    supply = {tuple(r["leaf"]): r["tokens"] for r in found}
    given = budgets(supply, weights, budget_share * sum(supply.values()), max_epochs)
    plan = []
    for leaf, amount in given.items():
        whole = min(max_epochs, int(amount // supply[leaf])) if supply[leaf] else int(amount >= 0)
        plan.append((leaf, whole, int(amount - whole * supply[leaf])))
    schema = "leaf struct<domain: string, lang: string, source: string>, passes int, rest long"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # max_leaves rows at most

    at = order_hash(seed, F.col("passes"), F.col("doc_id"))
    ranged = sized.join(plan_df.filter(f"rest > 0 and passes < {max_epochs}"), "leaf").select("leaf", "rest", "tokens", at.alias("at"))
    ranged = ranged.withColumn("range", F.shiftright("at", 64 - RANGE_BITS))
    sums = ranged.groupBy("leaf", "rest", "range").agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("stop", F.sum("n").over(upto)).filter("stop > rest")
    edge = sums.groupBy("leaf").agg(F.min(F.struct("range", (F.col("stop") - F.col("n")).alias("before"))).alias("e"))
    edge = scratch.put(edge.select("leaf", F.col("e.range").alias("range"), F.col("e.before").alias("before")), "edge")
    inner = ranged.join(F.broadcast(edge), ["leaf", "range"]).groupBy("leaf", "rest", "before", "at").agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.filter("n is not null").withColumn("stop", F.col("before") + F.sum("n").over(upto)).filter("stop <= rest")
    last = inner.groupBy("leaf").agg(F.max("at").alias("last"))
    # nothing of the edge's range fits: the prefix ends where the range starts, and is empty if that is the first
    start = F.when(F.col("range") > -(1 << (RANGE_BITS - 1)), F.shiftleft(F.col("range"), 64 - RANGE_BITS) - 1)
    upper = edge.join(last, "leaf", "left").select("leaf", F.coalesce("last", start).alias("last"), F.lit(True).alias("cut"))
    final = plan_df.join(F.broadcast(scratch.put(upper, "upper")), "leaf", "left")
    # a leaf without an edge fits whole
    bound = F.when(F.col("rest") > 0, F.when(F.col("cut"), F.col("last")).otherwise(F.lit(2**63 - 1)))
    final = scratch.put(final.select("leaf", "passes", bound.alias("last")), "final")

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), path.alias("leaf"), tokens.cast("long").alias("n_tokens"))
    rows = rows.join(F.broadcast(final), "leaf")
    picked = F.coalesce(at <= F.col("last"), F.lit(False)) & (F.col("passes") < max_epochs)  # no bound: no prefix
    rows = rows.withColumn("epochs", F.col("passes") + picked.cast("int")).filter("epochs > 0")
    return rows.select("row", F.col("leaf.domain").alias("domain"), "n_tokens", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
