"""Communities, cycles, fans and orders against plain versions, and on graphs that would hurt."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.functions import HOUR
from riskloom.operators import communities, cycles, windows
from riskloom.operators.ordering import numbered
from riskloom.scratch import Scratch
from riskloom.sources.ledger import of
from tests.test_detectors import circular_by_force, ledger
from tests.test_scale import louvain, modularity


def drawn_graph(seed, groups, size, n, inside):
    r = random.Random(seed)
    nodes = groups * size
    name = lambda i: f"g{i // size}.{i % size}"
    weights = Counter()
    for _ in range(n):
        a = r.randrange(nodes)
        b = (a // size) * size + r.randrange(size) if r.random() < inside else r.randrange(nodes)
        if a != b:
            weights[tuple(sorted((name(a), name(b))))] += r.randrange(1, 50) * 100
    return [(a, b, w) for (a, b), w in weights.items()]


def gains(edges, home):
    """The largest gain of a move of one account, times (2T)^2 / 2, in whole numbers."""
    twice, degree, near, size = 2 * sum(w for *_, w in edges), Counter(), defaultdict(Counter), Counter()
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        if a != b:
            near[a][home[b]] += w
            near[b][home[a]] += w
    for n, d in degree.items():
        size[home[n]] += d
    stay = lambda n: twice * near[n][home[n]] - degree[n] * (size[home[n]] - degree[n])
    return max((twice * w - degree[n] * size[c] - stay(n) for n in degree for c, w in list(near[n].items()) if c != home[n]), default=0)


@pytest.mark.parametrize(("groups", "size", "n"), [(10, 8, 500), (625, 8, 16_000)])
def test_no_account_gains_by_a_move(spark, groups, size, n):
    edges = drawn_graph(5, groups, size, n, 0.8) + [("g0.0", "g0.0", 700)]
    home = {x["account_id"]: x["community"] for x in communities.partition(spark.createDataFrame(edges, "a string, b string, w long"), Scratch(spark, "t")).collect()}
    assert set(home) == {x for a, b, _ in edges for x in (a, b)}
    assert gains(edges, home) <= 0
    plain = louvain(edges)
    print("modularity", modularity(edges, home), "plain", modularity(edges, plain))
    assert modularity(edges, home) >= 0.97 * modularity(edges, plain)


def test_communities_of_odd_graphs(spark):
    run = lambda edges: {x["account_id"]: x["community"] for x in communities.partition(spark.createDataFrame(edges, "a string, b string, w long"), Scratch(spark, "t")).collect()}
    assert run([]) == {}
    assert run([("a", "a", 5)]) == {"a": "a"}
    pair = run([("a", "b", 2**40)])
    assert pair["a"] == pair["b"]
    star = run([("hub", f"x{i:02d}", 10) for i in range(40)])
    assert len(set(star.values())) == 1
    cliques = run([(f"{k}{i}", f"{k}{j}", 100) for k in "pq" for i in range(5) for j in range(i + 1, 5)] + [("p0", "q0", 1)])
    assert len(set(cliques.values())) == 2 and len({c for x, c in cliques.items() if x[0] == "p"}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_cycles_against_force(spark, seed):
    r = random.Random(seed)
    tx = [(f"n{min(r.randrange(8), r.randrange(8))}", f"n{min(r.randrange(8), r.randrange(8))}", r.choice([500, 1000, 1200, 1500]), r.randrange(0, 160)) for _ in range(70 + 10 * seed)]
    g = ledger(spark, tx)
    want = circular_by_force(tx)
    assert want and {tuple(x["members"]) for x in cycles.circular(g.tx, g.accounts).collect()} == want


def test_a_hub_without_cycles_costs_its_payments(spark):
    """Payers times payees would be 4 * 10^8 paths; with and without payments from payees to payers."""
    n = 20_000
    hop = lambda src, dst, c, at, k: spark.range(n).select(src.alias("src"), dst.alias("dst"), F.lit(c).alias("amount_c"), (F.col("id") * 1000 + at).alias("us"), (F.col("id") + k * n).alias("tx_pos"))
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    into, out = hop(name("s", F.col("id")), F.lit("hub"), 900_000, 0, 0), hop(F.lit("hub"), name("p", F.col("id")), 800_000, n * 1000, 1)
    back = hop(name("p", F.col("id")), name("s", (F.col("id") * 7 + 3) % n), 500_000, -(10**9), 2)
    for tx in (into.union(out), into.union(out).union(back)):
        g = of(spark.createDataFrame([], "account_id string"), tx.withColumn("tx_id", name("t", F.col("tx_pos"))).withColumn("channel", F.lit("sepa")))
        began = time.perf_counter()
        assert cycles.circular(g.tx, g.accounts).count() == 0
        assert time.perf_counter() - began < 60


def plain_fan(events, span):
    best = {}
    for hub in {h for h, *_ in events}:
        own = sorted((t, p) for h, p, t in events if h == hub)
        found = [(len({p for u, p in own if t <= u <= t + span}), -t) for t, _ in own]
        n, t = max(found)
        best[hub] = (-t, n)
    return best


def test_fans_across_strips(spark):
    r = random.Random(2)
    span = 48
    events = [(f"h{r.randrange(3)}", f"p{r.randrange(9)}", r.randrange(0, 700)) for _ in range(500)] + [("edge", f"p{i}", 48 * i) for i in range(6)] + [("tie", f"p{i}", 96) for i in range(4)] + [("edge", "p1", 47), ("edge", "p1", 49)]
    frame = spark.createDataFrame([(h, p, t * HOUR) for h, p, t in events], "hub string, party string, us long")
    got = {x["hub"]: (x["us"] // HOUR, x["n"]) for x in windows.busiest_counterparties(frame, span * HOUR).collect()}
    assert got == plain_fan(events, span)


def test_a_busy_fan_is_spread(spark):
    """A hub of 200,000 payments from as many payers over a year, and one payer that pays it as often."""
    n = 200_000
    step = 365 * 24 * HOUR // n
    events = spark.range(2 * n).select(F.lit("hub").alias("hub"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), "id")).otherwise("same").alias("party"), F.floor(F.col("id") * step / 2).alias("us"))
    began = time.perf_counter()
    row = windows.busiest_counterparties(events, 48 * HOUR).first()
    assert abs(row["n"] - 48 * HOUR / step) < 3
    assert time.perf_counter() - began < 60


def test_places(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), f"n{i:04d}", [f"m{r.randrange(5)}", "x"]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "score long, name string, members array<string>").repartition(7)
    got = numbered(frame, [F.desc("score"), F.col("members"), F.col("name")], Scratch(spark, "t"), 5)
    want = {x[1]: i + 1 for i, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[2], x[1])))}
    assert {x["name"]: x["place"] for x in got.collect()} == want
    assert numbered(frame.limit(0), [F.col("name")], Scratch(spark, "t")).count() == 0
