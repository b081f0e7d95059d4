"""Rings: strong findings grown to their counterparties and merged."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import at_most_one, r3
from riskloom.operators.components import components
from riskloom.operators.ordering import numbered
from riskloom.operators.windows import pairs as directed_pairs
from riskloom.scratch import Scratch

# Fixed values.
STRONG = ("structuring", "circular", "passthrough", "fan_in", "fan_out")
SEED_FLOOR, EDGE_C, LEAST_VOLUME_C, LEAST_SCORE, LEAST_SIZE, FLAG = 0.3, 500_000, 1_500_000, 0.45, 3, 0.5
#: Shared accounts of a group of seeds up to which its pairs of them are looked at.
PAIRS = 48
#: The first clusters of a group are bits of a number that each account has; a number has so many.
BITS = 64
FOLDED = "root string, cluster long, code int, pattern string"


def seeds(findings: DataFrame, money: DataFrame) -> DataFrame:
    """seed, detector, score, members: strong findings with a large transfer among their members; money: as by windows.pairs."""
    strong = findings.filter(F.col("detector").isin(*STRONG)).filter((F.col("subject_type") == "subgraph") | (F.col("score") >= SEED_FLOOR))
    strong = strong.select("detector", "score", "subject_type", "subject_ids", "counterparties")
    large = money.filter(F.col("total_c") >= EDGE_C).select("src", "dst")
    near = large.union(large.select("dst", "src")).groupBy(F.col("src").alias("hub")).agg(F.collect_set("dst").alias("near"))
    listed = (F.col("subject_type") == "account") & F.coalesce(F.size("counterparties") > 0, F.lit(False))
    given = strong.filter((F.col("subject_type") == "subgraph") | listed)
    given = given.withColumn("members", F.array_union("subject_ids", F.coalesce("counterparties", F.array().cast("array<string>"))))
    open_ = strong.filter((F.col("subject_type") == "account") & ~listed).withColumn("hub", F.col("subject_ids")[0]).join(near, "hub", "left")
    open_ = open_.withColumn("members", F.array_union("subject_ids", F.coalesce("near", F.array().cast("array<string>"))))
    every = given.select("detector", "score", "members").union(open_.select("detector", "score", "members"))
    every = every.withColumn("members", F.array_sort(F.array_distinct("members"))).filter(F.size("members") >= 2)
    every = every.withColumn("seed", F.sha2(F.concat_ws("|", "detector", F.col("score").cast("string"), F.concat_ws(",", "members")), 256)).dropDuplicates(["seed"])
    inside = every.select("seed", F.explode("members").alias("src")).join(large, "src")
    inside = inside.join(every.select("seed", F.explode("members").alias("dst")), ["seed", "dst"]).select("seed").distinct()
    return every.join(inside, "seed", "left_semi").select("seed", "detector", "score", "members")


def merge(group: pd.DataFrame) -> pd.DataFrame:
    """Seeds by falling score, then members; each joins the first cluster that shares two accounts. The plain form of ``Fold``."""
    clusters: list[tuple[set, set]] = []
    rows = sorted(zip(-group["score"], [tuple(sorted(m)) for m in group["members"]], group["detector"], strict=True))
    for _, members, detector in rows:
        for accounts, patterns in clusters:
            if len(accounts.intersection(members)) >= 2:
                accounts.update(members)
                patterns.add(detector)
                break
        else:
            clusters.append((set(members), {detector}))
    return pd.DataFrame({"members": [sorted(a) for a, _ in clusters], "patterns": [sorted(p) for _, p in clusters]})


class Fold:
    """Clusters of one group after another: each seed joins the first cluster that shares two accounts with it.

    Accounts are numbers below ``n``. Only what the clusters hold is kept, never the seeds: eight
    bytes an account for the first ``BITS`` clusters, an entry for each account of a later one.
    Clusters that share two accounts with a seed are found from its accounts, so none is looked through.
    """

    def __init__(self, n: int):
        self.early, self.touched = array("Q", bytes(8 * n)), array("i")
        self.late: dict[int, set[int]] = {}
        self.patterns: list[set[str]] = []

    def first(self, codes: list[int]) -> int | None:
        once = twice = 0
        for mask in map(self.early.__getitem__, codes):
            twice |= once & mask
            once |= mask
        if twice:
            return (twice & -twice).bit_length() - 1
        held = sorted((self.late[c] for c in codes if c in self.late), key=len)
        if len(held) < 2:
            return None
        # two sets that share a cluster aren't both the largest
        seen, best = set(), None
        for some in held[:-1]:
            again = min((c for c in some if c in seen or c in held[-1]), default=None)
            best = again if best is None or (again is not None and again < best) else best
            seen |= some
        return best

    def add(self, codes: list[int], pattern: str) -> None:
        cluster = self.first(codes)
        if cluster is None:
            cluster = len(self.patterns)
            self.patterns.append(set())
        self.patterns[cluster].add(pattern)
        if cluster >= BITS:
            for c in codes:
                self.late.setdefault(c, set()).add(cluster)
            return
        bit = 1 << cluster
        for c in codes:
            if not (mask := self.early[c]):
                self.touched.append(c)
            self.early[c] = mask | bit

    def end(self) -> Iterator[tuple[int, int | None, str | None]]:
        """cluster and one of its accounts or patterns; the next group starts with none."""
        for c in self.touched:
            mask, self.early[c] = self.early[c], 0
            while mask:
                yield (mask & -mask).bit_length() - 1, c, None
                mask &= mask - 1
        for c, clusters in self.late.items():
            yield from ((cluster, c, None) for cluster in clusters)
        for cluster, patterns in enumerate(self.patterns):
            yield from ((cluster, None, p) for p in patterns)
        self.touched, self.late, self.patterns = array("i"), {}, []


def folded(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (root, detector, codes) in order of root and of merging, FOLDED's rows."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        fold, at = Fold(n), None
        for batch in batches:
            roots, detectors, lists = batch.columns
            for i in range(batch.num_rows):
                if at is not None and (root := roots[i].as_py()) != at:
                    yield from ((at, *row) for row in fold.end())
                at = roots[i].as_py()
                fold.add(lists[i].values.to_pylist(), detectors[i].as_py())
        if at is not None:
            yield from ((at, *row) for row in fold.end())

    kinds = pa.schema([("root", pa.string()), ("cluster", pa.int64()), ("code", pa.int32()), ("pattern", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds.types, strict=True)], schema=kinds)

    return run


def apart(found: DataFrame, scratch: Scratch) -> DataFrame:
    """seed, root: seeds of different roots never meet in one cluster, whatever the order.

    Groups with two common accounts are joined, and their accounts put together, until no two
    groups have two in common. Each cluster of a fold stays within a group: it starts as one
    seed, and what it takes in shares two accounts with it, so with its group. So a chain
    of seeds that share one account each falls apart, however long it is.

    Only accounts that several groups hold count. A group with ``PAIRS`` of them at most is
    found by its pairs of accounts; one with more is joined to all that share one account,
    which may join too much but parts nothing that belongs together. Those go first, so that
    pairs are made only of groups that no large one takes in.
    """
    home = scratch.put(found.select("seed", F.col("seed").alias("root")), "home")
    member = scratch.put(found.select(F.col("seed").alias("root"), F.explode("members").alias("account")).distinct(), "member")
    while True:
        several = member.groupBy("account").agg(F.count("*").alias("n")).filter("n > 1").select("account")
        held = scratch.put(member.join(several, "account"), "held")
        size = held.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1")
        few, many = size.filter(F.col("size") <= PAIRS).select("root"), size.filter(F.col("size") > PAIRS).select("root")
        linked = lambda links: scratch.put(links.filter("a <> b").distinct(), "links")
        wide = held.join(many, "root").groupBy("account").agg(F.min("root").alias("b"))
        links = linked(held.join(wide, "account").select(F.col("root").alias("a"), "b"))
        if not links.limit(1).count():
            own = held.join(few, "root")
            both = own.select("root", F.col("account").alias("x")).join(own.select("root", F.col("account").alias("y")), "root").filter("x < y")
            first = both.groupBy("x", "y").agg(F.min("root").alias("first"), F.count("*").alias("n")).filter("n > 1")
            links = linked(both.join(first, ["x", "y"]).select(F.col("root").alias("a"), F.col("first").alias("b")))
            if not links.limit(1).count():
                return home
        roots = components(links, scratch).select(F.col("node").alias("root"), F.col("root").alias("joined"))
        to = F.coalesce("joined", "root").alias("root")
        home = scratch.put(home.join(roots, "root", "left").select("seed", to), "home")
        member = scratch.put(member.join(roots, "root", "left").select(to, "account").distinct(), "member")


def merged(found: DataFrame, scratch: Scratch) -> DataFrame:
    """members, patterns of merged seeds.

    The order of merging counts, so it is a fold; but only of seeds that can meet at
    all. A seed that meets no other is a cluster as it is. Spark sorts the seeds of a group
    and hands them to the fold one by one, with numbers for accounts.
    """
    home = apart(found, scratch)
    alone = home.groupBy("root").agg(F.count("*").alias("n")).filter("n = 1").select("root")
    rooted = scratch.put(found.join(home, "seed"), "rooted")
    single = rooted.join(alone, "root", "left_semi").select("members", F.array("detector").alias("patterns"))
    several = scratch.put(rooted.join(alone, "root", "left_anti"), "several")
    flat = several.select("seed", F.explode("members").alias("account"))
    names = numbered(flat.select("account").distinct(), [F.col("account")], scratch).select("account", (F.col("place") - 1).cast("int").alias("code"))
    codes = flat.join(names, "account").groupBy("seed").agg(F.collect_list("code").alias("codes"))
    order = several.join(codes, "seed").repartition("root").sortWithinPartitions("root", F.desc("score"), "members", "detector").select("root", "detector", "codes")
    rows = scratch.put(order.mapInArrow(folded(names.count()), FOLDED), "folded")
    members = rows.filter("code is not null").join(names, "code").groupBy("root", "cluster").agg(F.array_sort(F.collect_list("account")).alias("members"))
    patterns = rows.filter("code is null").groupBy("root", "cluster").agg(F.array_sort(F.collect_list("pattern")).alias("patterns"))
    return single.union(members.join(patterns, ["root", "cluster"]).select("members", "patterns"))


def measure(clusters: DataFrame, risk: DataFrame, money: DataFrame) -> DataFrame:
    """members, patterns, volume_c, max_risk, avg_risk, score of each cluster, before the filters."""
    clusters = clusters.withColumn("ring", F.sha2(F.concat_ws(",", F.concat_ws(";", "patterns"), "members"), 256)).dropDuplicates(["ring"])
    flat = clusters.select("ring", F.explode("members").alias("account_id"))
    risky = flat.join(risk.select("account_id", "risk"), "account_id", "left")
    # risks have three digits: thousandths sum exactly in any order
    mille = F.round(F.coalesce("risk", F.lit(0.0)) * 1000).cast("long")
    risks = risky.groupBy("ring").agg(F.max(mille).alias("max"), F.sum(mille).alias("sum"), F.count("*").alias("n"))
    total = money.select("src", "dst", "total_c")
    inside = flat.withColumnRenamed("account_id", "src").join(total, "src").join(flat.withColumnRenamed("account_id", "dst"), ["ring", "dst"])
    volume = inside.groupBy("ring").agg(F.sum("total_c").alias("volume_c"))
    out = clusters.join(risks, "ring").join(volume, "ring", "left").withColumn("volume_c", F.coalesce("volume_c", F.lit(0).cast("long")))
    out = out.withColumn("max_risk", F.col("max") / 1000.0).withColumn("avg_risk", F.col("sum") / F.col("n") / 1000.0)
    n = F.size("patterns")
    score = 0.5 * (0.6 * F.col("max_risk") + 0.4 * F.col("avg_risk")) + 0.2 * at_most_one(0.25 * n) + 0.3 * at_most_one(F.col("volume_c") / 5_000_000.0) + 0.12 * F.greatest(F.lit(0), n - 2)
    return out.select("ring", "members", "patterns", "volume_c", "max_risk", "avg_risk", r3(at_most_one(score)).alias("score"))


def rank(measured: DataFrame, risk: DataFrame, scratch: Scratch) -> DataFrame:
    """ring_id, place (its rank), account_ids, score, patterns, key_accounts, narrative of the rings that count.

    By falling score, then by members and patterns.
    """
    good = measured.filter((F.size("members") >= LEAST_SIZE) & (F.col("max_risk") >= FLAG) & (F.col("score") >= LEAST_SCORE) & (F.col("volume_c") >= LEAST_VOLUME_C))
    flat = good.select("ring", F.explode("members").alias("account_id")).join(risk.select("account_id", "risk"), "account_id", "left")
    key = F.array_sort(F.collect_list(F.struct((-F.coalesce("risk", F.lit(0.0))).alias("m"), "account_id")))
    keys = flat.groupBy("ring").agg(F.transform(F.slice(key, 1, 3), lambda x: x["account_id"]).alias("key_accounts"))
    slim = good.select("ring", "score", "members", "patterns")
    places = numbered(slim, [F.desc("score"), F.col("members"), F.col("patterns")], scratch).select("ring", "place")
    return good.join(keys, "ring").join(places, "ring").select(
        F.format_string("DET_%03d", "place").alias("ring_id"), "place", F.col("members").alias("account_ids"),
        "score", "patterns", "key_accounts", F.lit(None).cast("string").alias("narrative"),
    )


def transfers(heads: DataFrame, tx: DataFrame) -> DataFrame:
    """ring_id, place, src, dst, tx_pos, tx_id of the transfers between a ring's accounts, a row each."""
    member = heads.select("ring_id", "place", F.explode("account_ids").alias("src"))
    inner = tx.select("src", "dst", "tx_id", "tx_pos").join(member, "src").join(member.select("ring_id", F.col("src").alias("dst")), ["ring_id", "dst"])
    return inner.select("ring_id", "place", "src", "dst", "tx_pos", "tx_id")


def whole(heads: DataFrame, moved: DataFrame) -> DataFrame:
    """Rings with tx_ids, by pair of accounts and position; moved: as by transfers."""
    ids = moved.groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "tx_pos", "tx_id"))), lambda x: x["tx_id"]).alias("tx_ids"))
    out = heads.join(ids, "ring_id", "left").withColumn("tx_ids", F.coalesce("tx_ids", F.array().cast("array<string>")))
    return out.select("ring_id", "place", "account_ids", "tx_ids", "score", "patterns", "key_accounts", "narrative")


def build_rings(findings: DataFrame, risk: DataFrame, tx: DataFrame, money: DataFrame | None = None) -> DataFrame:
    """Ranked rings without their transfers; money: windows.pairs of the transactions, if stored."""
    scratch = Scratch(tx.sparkSession, "rings")
    money = scratch.put(directed_pairs(tx), "pairs") if money is None else money
    found = scratch.put(seeds(findings, money), "seeds")
    clusters = scratch.put(merged(found, scratch), "clusters")
    return rank(scratch.put(measure(clusters, risk, money), "measured"), risk, scratch)
