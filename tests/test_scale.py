"""Detectors on busy hubs and at random against plain versions, communities, ring ranks and paths."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.functions import HOUR
from riskloom.operators import communities, paths, ranges, windows
from riskloom.plans import views
from riskloom.plans.analysis import Analysis
from riskloom.scratch import Scratch
from riskloom.sources.ledger import Ledger, of
from tests.test_detectors import ledger


def drawn(seed, n=500, accounts=6, span=240):
    r = random.Random(seed)
    name = lambda: f"n{r.randrange(accounts)}"
    return [(name(), name(), r.choice([700, 5_000, 6_000, 7_000, 8_000, 9_000, 9_900, 12_000]), r.randrange(span * 4) / 4, r.choice(["sepa", "wire", "crypto"])) for _ in range(n)]


def relay_by_force(tx, least, num, den, fiat):
    found = {}
    for i, (a, hub, v, h, c) in enumerate(tx):
        if hub in found or v < least or (fiat and c == "crypto"):
            continue
        hit = next((j for j, (s, d, w, g, k) in enumerate(tx) if s == hub and d != a and h <= g <= h + 24 and w * den >= v * num and (not fiat or k == "crypto")), None)
        if hit is not None:
            found[hub] = (v * 100, tx[hit][2] * 100, h, tx[hit][3])
    return found


@pytest.mark.parametrize("seed", range(4))
def test_relays_against_force(spark, seed):
    tx = drawn(seed, 60 + 40 * seed, 4 + seed, 400)
    at = lambda rows: {r["account_id"]: (r["in_c"], r["out_c"]) for r in rows.collect()}
    g = ledger(spark, tx)
    assert at(ranges.passthrough(g.tx)) == {k: v[:2] for k, v in relay_by_force(tx, 5_000, 8, 10, False).items()}
    assert at(ranges.fiat_to_crypto(g.tx)) == {k: v[:2] for k, v in relay_by_force(tx, 5_000, 1, 2, True).items()}


def test_windows_against_force(spark):
    tx = drawn(7, 400, 5, 300)
    want = {}
    by = defaultdict(list)
    for s, d, v, h, _ in tx:
        by[s].append((h, v))
        by[d].append((h, v))
    for who, events in by.items():
        for t, _ in events:
            inside = [(h, v) for h, v in events if t <= h <= t + 24]
            want[(who, t)] = (sum(h == t for h, _ in events), len(inside), sum(v for _, v in inside) * 100, max(h for h, _ in inside))
    g = ledger(spark, tx)
    zero = ledger(spark, [("a", "b", 1, 0)]).tx.first()["us"]
    got = windows.ahead(windows.endpoints(g.tx).select("account_id", "us", "amount_c"), 24 * HOUR).collect()
    assert {(r["account_id"], (r["us"] - zero) / HOUR): (r["here"], r["n"], r["total_c"], (r["end_us"] - zero) / HOUR) for r in got} == want
    first = {}
    for d in {d for _, d, *_ in tx}:
        band = sorted((h, v) for _, x, v, h, _ in tx if x == d and 7_000 <= v < 10_000)
        for t, _ in band:
            inside = [(h, v) for h, v in band if t <= h <= t + 72]
            if len(inside) >= 3 and sum(v for _, v in inside) >= 10_000:
                first[d] = (len(inside), sum(v for _, v in inside) * 100)
                break
    assert {r["account_id"]: (r["n"], r["total_c"]) for r in windows.structuring(g.tx).collect()} == first


def test_a_busy_hub_costs_a_sort(spark):
    """Twenty thousand transfers in and as many out in a day: seconds, and no more than in proportion."""
    took = []
    for n in (20_000, 20_000, 40_000):
        into = spark.range(n).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(900_000).alias("amount_c"), (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("tx_pos"))
        out = spark.range(n).select(F.lit("hub").alias("src"), F.concat(F.lit("s"), "id").alias("dst"), F.lit(100_000).alias("amount_c"), (F.col("id") * 1_000_000 + 1).alias("us"), (F.col("id") + n).alias("tx_pos"))
        tx = of(spark.createDataFrame([], "account_id string"), into.unionByName(out).withColumn("channel", F.lit("sepa"))).tx
        began = time.perf_counter()
        assert ranges.passthrough(tx).count() == 0
        assert windows.structuring(tx).first()["n"] == n
        assert windows.activity_spike(tx, quiet=10**9).filter("account_id = 'hub'").first()["burst_tx"] == 2 * n
        took.append(time.perf_counter() - began)
    assert took[2] < 4 * took[1] + 5


def modularity(edges, home):
    total = sum(w for *_, w in edges)
    inner, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[home[a]] += w
        degree[home[b]] += w
        inner[home[a]] += w * (home[a] == home[b])
    return sum(inner[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def louvain(edges):
    """The same two steps, one node at a time."""
    home, nodes = {n: n for a, b, _ in edges for n in (a, b)}, {n: n for a, b, _ in edges for n in (a, b)}
    while True:
        links, total = defaultdict(Counter), sum(w for *_, w in edges)
        for a, b, w in edges:
            links[a][b] += w
            links[b][a] += w
        of_, size, moved = {n: n for n in links}, {n: sum(links[n].values()) for n in links}, False
        degree, again = dict(size), True
        while again:
            again = False
            for n in sorted(links):
                near = Counter({of_[n]: 0})
                for m, w in links[n].items():
                    near[of_[m]] += w * (m != n)
                size[of_[n]] -= degree[n]
                gain = {c: w - size[c] * degree[n] / (2 * total) for c, w in near.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] > gain[of_[n]] + 1e-9:
                    of_[n], again, moved = best, True, True
                size[of_[n]] += degree[n]
        if not moved:
            return home
        home = {n: of_[h] for n, h in home.items()}
        merged = Counter()
        for a, b, w in edges:
            merged[tuple(sorted((of_[a], of_[b])))] += w
        edges = [(a, b, w) for (a, b), w in merged.items()]


def test_communities_are_as_modular_as_plain_ones(spark):
    r = random.Random(4)
    group = [f"g{i // 8}.{i % 8}" for i in range(96)]
    weights = Counter()
    for _ in range(700):
        a = r.randrange(96)
        b = (a // 8) * 8 + r.randrange(8) if r.random() < 0.75 else r.randrange(96)
        if a != b:
            weights[tuple(sorted((group[a], group[b])))] += r.randrange(1, 50) * 10**9
    edges = [(a, b, w) for (a, b), w in weights.items()]
    graph = spark.createDataFrame(edges, "a string, b string, w long")
    home = {x["account_id"]: x["community"] for x in communities.partition(graph, Scratch(spark, "t")).collect()}
    plain = modularity(edges, louvain(edges))
    print("modularity", modularity(edges, home), "plain", plain)
    assert set(home) == set(louvain(edges)) and modularity(edges, home) >= 0.95 * plain
    assert communities.partition(graph.limit(0), Scratch(spark, "t")).count() == 0


def test_ring_ranks_past_a_thousand(spark):
    rings = [(f"DET_{i:03d}", i, [f"a{i}", *(["x"] if i in (101, 1000, 1200) else []), *(["y"] if i in (999, 1000) else [])], ["t1"] if i in (101, 1000) else [], 0.5, ["fan_in"], [f"a{i}"], None) for i in range(1, 1201)]
    frame = spark.createDataFrame(rings, "ring_id string, place long, account_ids array<string>, tx_ids array<string>, score double, patterns array<string>, key_accounts array<string>, narrative string")
    g = ledger(spark, [("q", "p", 1, 0), ("x", "y", 5, 1)], [{"account_id": "x"}, {"account_id": "y"}])
    a = Analysis(Ledger(g.accounts, g.tx), spark.createDataFrame([], "detector string, subject_type string, subject_ids array<string>, score double, evidence string"), spark.createDataFrame([], "account_id string, risk double, top_signals array<struct<detector: string, score: double>>"), frame)
    assert {r["account_id"]: r["ring"] for r in views.first_ring(a).filter("account_id in ('x', 'y')").collect()} == {"x": "DET_101", "y": "DET_999"}
    assert {r["account_id"]: r["rings"] for r in views.accounts_list(a).collect()} == {"x": ["DET_101", "DET_1000", "DET_1200"], "y": ["DET_999", "DET_1000"]}
    assert views.enriched_edges(a, g.tx).filter("tx_id = 't1'").first()["ring"] == "DET_101"
    assert {(r["ring_a"], r["ring_b"]) for r in views.compare_rings(a).select("ring_a", "ring_b").collect()} <= {("DET_101", "DET_1000"), ("DET_101", "DET_1200"), ("DET_1000", "DET_1200"), ("DET_999", "DET_1000")}


def test_search_sorts_and_filters(spark):
    rows = spark.createDataFrame(
        [("a", "Ann", "business", "CY", "active", "low", 0.2, ["DET_001", "DET_002"]), ("b", "Bob", "business", "cy", "frozen", "high", 0.95, []), ("c", "Cy", "personal", "GR", "blocked", "low", 0.5, ["DET_001"])],
        "account_id string, owner_name string, account_type string, country string, status string, kyc_risk string, risk double, rings array<string>",
    )
    ids = lambda *a, **k: [r["account_id"] for r in views.search(rows, *a, **k).collect()]
    assert ids("business CY") == ["b", "a"] and ids("cy") == ["b", "c", "a"]
    assert ids("", sort="rings") == ["a", "c", "b"] and ids("", sort="owner_name", descending=False) == ["a", "b", "c"]
    assert ids("", under_review=True) == ["b", "c"] and ids("95%") == ["b"] and ids("det_002") == ["a"]


def test_path_errors(spark):
    g = ledger(spark, [("a", "b", 1, 0), ("b", "c", 2, 1)], [{"account_id": x} for x in "abc"])
    with pytest.raises(ValueError, match="same account"):
        paths.trace_path(g.tx, "a", "a")
    with pytest.raises(ValueError, match="unknown account"):
        paths.trace_path(g.tx, "a", "zz", accounts=g.accounts)
    assert tuple(paths.flow_of(paths.trace_path(g.tx, "a", "c", accounts=g.accounts)).first()) == (True, 2, 300)
    assert tuple(paths.flow_of(paths.trace_path(g.tx, "c", "a")).first()) == (False, 0, 0)
