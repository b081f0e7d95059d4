"""What grows with the ledger: large rings, large groups of seeds, and parts of an analysis that a query doesn't read."""

import random
import time
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom import queries
from riskloom.plans import rings
from riskloom.plans.analysis import analyse
from riskloom.plans.evaluate import evaluate
from riskloom.sources.ledger import from_tables

SF = "/root/testdata/sf0.001"


def test_a_large_ring_is_measured_in_proportion(spark, tmp_path):
    """A ring of 40,000 accounts costs seconds: its size isn't counted once for every member."""
    n, name = 40_000, lambda c: F.concat(F.lit("a"), c)
    members = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.concat(F.lit("a"), x.cast("string")))
    spark.range(1).select(F.lit("r").alias("ring_id"), F.concat(members, members).alias("account_ids")).write.parquet(f"{tmp_path}/rings")
    mules = spark.range(n + 2).select(name("id").alias("account_id"))
    true = spark.range(n + 2).groupBy(F.floor(F.col("id") / 2).cast("string").alias("ring_id")).agg(F.collect_set(name("id")).alias("account_ids"))
    began = time.perf_counter()
    row = evaluate(mules.withColumn("risk", F.lit(0.6)), spark.read.parquet(f"{tmp_path}/rings"), mules, true).first()
    assert time.perf_counter() - began < 60
    assert (row["tp"], row["rings_matched"], row["rings_true"], row["false_positive_rings"]) == (n + 2, n // 2, n // 2 + 1, 1)


def test_a_query_makes_only_the_tables_it_reads(spark):
    """Queries that show no ring make none, those that show no ring's transfers gather none, and those that show no account's transfers don't store them by account."""
    a, made = analyse(from_tables(spark, SF), queries.SQL_DETECTORS), lambda: set(vars(a)) & {"findings", "account_risk", "ring_heads", "ring_tx", "rings", "touching"}
    for name, parts in {
        "network_association": {"findings"}, "under_review": {"account_risk"}, "account_signals": set(), "account_profile": set(), "review_queue": set(), "seed_measures": set(),
        "search": {"ring_heads"}, "rings_list": set(), "summary": set(), "evaluate": set(), "enriched_edges": {"ring_tx"}, "suspicious_edges": {"touching"}, "rings": {"rings"},
    }.items():
        before = made()
        queries.QUERIES[name].f(a).count()
        assert made() - before == parts, name
    assert a.rings is a.rings and a.findings is a.findings


def drawn(seed):
    """(score, members, detector) in order of merging."""
    r = random.Random(seed)
    accounts, rows = r.randrange(5, 150), []
    for _ in range(r.randrange(1, 150)):
        members = {min(r.randrange(accounts), r.randrange(accounts)) for _ in range(r.randrange(2, 8))}
        if len(members) > 1:
            rows.append((r.randrange(30, 100) / 100, tuple(sorted(members)), r.choice(["fan_in", "circular", "structuring"])))
    return sorted(rows, key=lambda x: (-x[0], *x[1:])), accounts


@pytest.mark.parametrize("bits", [1, 2, 5, 64])
def test_a_fold_by_accounts_is_the_plain_one(monkeypatch, bits):
    """Few bits, so that most clusters are late ones; one fold takes all groups."""
    monkeypatch.setattr(rings, "BITS", bits)
    fold = rings.Fold(150)
    for seed in range(40):
        rows, _ = drawn(seed)
        plain = rings.merge(pd.DataFrame([("s", d, s, m) for s, m, d in rows], columns=["seed", "detector", "score", "members"]))
        for _, members, detector in rows:
            fold.add(list(members), detector)
        got = {}
        for cluster, account, pattern in fold.end():
            got.setdefault(cluster, (set(), set()))[account is None].add(pattern if account is None else account)
        assert sorted((sorted(a), sorted(p)) for a, p in got.values()) == sorted(zip(plain["members"], plain["patterns"], strict=True))


def test_a_fold_keeps_clusters_not_seeds():
    """100,000 seeds of a hub's cluster: memory as for its accounts, not as for the seeds."""
    n, r = 20_000, random.Random(1)
    fold = rings.Fold(n)
    fold.add(list(range(n)), "fan_in")
    tracemalloc.start()
    for _ in range(100_000):
        fold.add(r.sample(range(n), 12), "passthrough")
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 2_000_000
    assert sum(a is not None for _, a, _ in fold.end()) == n
