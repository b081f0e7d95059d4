"""Hand-built ledgers: what each detector flags and what it leaves alone."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskloom.operators import communities, cycles, linkage, paths, ranges, windows
from riskloom.operators.components import components
from riskloom.plans import rings, score
from riskloom.plans.findings import find
from riskloom.schema import ACCOUNT
from riskloom.scratch import Scratch
from riskloom.sources.ledger import of

T0 = datetime(2026, 6, 1, 8, tzinfo=timezone.utc)


def ledger(spark, tx, accounts=()):
    """tx: (src, dst, euros, hours[, channel[, country]]); accounts: dicts."""
    rows = [(f"t{i}", int((T0 + timedelta(hours=x[3])).timestamp() * 1_000_000), x[0], x[1], round(x[2] * 100), x[4] if len(x) > 4 else "sepa", x[5] if len(x) > 5 else None, i) for i, x in enumerate(tx)]
    frame = spark.createDataFrame(rows, "tx_id string, us long, src string, dst string, amount_c long, channel string, tx_country string, tx_pos long")
    known = {"account_id": "none", "account_type": "personal", "country": "GR", "opened_at": "2020-01-01", "kyc_risk": "low"}
    who = spark.createDataFrame([known | a for a in accounts], ", ".join(f"{n} {t}" for n, t, _ in ACCOUNT))
    return of(who, frame)


def ids(df):
    return {r["account_id"] for r in df.collect()}


def test_structuring(spark):
    hit = [("a", "x", 9_500, 0), ("b", "x", 9_600, 10), ("c", "x", 9_700, 72)]
    assert ids(windows.structuring(ledger(spark, hit).tx)) == {"x"}
    assert not ids(windows.structuring(ledger(spark, [*hit[:2], ("c", "x", 9_700, 72.001)]).tx))
    edge = [("a", "x", 7_000, 0), ("b", "x", 7_000, 0), ("c", "x", 7_000, 0)]
    row = windows.structuring(ledger(spark, edge).tx).first()
    assert (row["n"], row["closeness"], row["span_hours"]) == (3, 0.0, 0.0)
    assert not ids(windows.structuring(ledger(spark, [(s, d, 10_000, h) for s, d, _, h in hit]).tx))
    assert not ids(windows.structuring(ledger(spark, []).tx))


def test_fiat_to_crypto(spark):
    run = lambda *tx: ids(ranges.fiat_to_crypto(ledger(spark, tx).tx))
    assert run(("a", "m", 20_000, 0, "wire"), ("m", "b", 18_000, 6, "crypto")) == {"m"}
    assert not run(("a", "m", 20_000, 0, "wire"), ("m", "b", 18_000, 6, "sepa"))
    assert not run(("a", "m", 20_000, 0, "crypto"), ("m", "b", 18_000, 6, "wire"))
    assert not run(("a", "m", 200, 0, "wire"), ("m", "b", 180, 6, "crypto"))
    assert not run(("a", "m", 20_000, 0, "wire"), ("m", "b", 18_000, 120, "crypto"))


def test_passthrough_takes_the_first_pair_as_given(spark):
    tx = [("a", "m", 9_000, 5), ("m", "b", 8_000, 6), ("a", "m", 6_000, 0), ("m", "a", 9_000, 5), ("m", "m", 6_000, 0), ("a", "n", 5_000, 0), ("n", "b", 4_000, 24), ("a", "o", 5_000, 0), ("o", "b", 4_000, 24.001)]
    rows = {r["account_id"]: r for r in ranges.passthrough(ledger(spark, tx).tx).collect()}
    assert set(rows) == {"m", "n"} and rows["m"]["in_c"] == 900_000 and rows["n"]["speed"] == 0.0


def test_dormant(spark):
    tx = [("a", "m", 40_000, 0), ("m", "b", 36_000, 6)]
    run = lambda opened: ids((lambda g: ranges.dormant_reactivation(g.tx, g.accounts))(ledger(spark, tx, [{"account_id": "m", "opened_at": opened}])))
    assert run("2019-01-01") == {"m"} and not run("2026-05-01") and not run("long ago") and not run(None)
    assert not ids(ranges.dormant_reactivation(ledger(spark, tx).tx, ledger(spark, tx).accounts))


def test_spike(spark):
    quiet = [("a", "m", 100, 24 * d) for d in (3, 9, 15)]
    assert "m" in ids(windows.activity_spike(ledger(spark, quiet + [("b", "m", 6_000, 500 + i) for i in range(8)]).tx))
    assert not ids(windows.activity_spike(ledger(spark, [("a", "m", 500, 24.1 * d) for d in range(28)]).tx))


def test_round_amounts(spark):
    row = windows.round_amounts(ledger(spark, [("m", "a", x, i) for i, x in enumerate((5_000, 10_000, 2_000, 3_000))]).tx).filter("account_id = 'm'").first()
    assert (row["round_tx_count"], row["round_share"], row["tx_ids"]) == (4, 1.0, ["t0", "t1", "t2", "t3"])
    assert not ids(windows.round_amounts(ledger(spark, [("m", "a", x + 0.01, i) for i, x in enumerate((5_000, 10_000, 2_000, 3_000))]).tx))


def test_fan_against_force(spark):
    r = random.Random(1)
    tx = [(f"s{r.randrange(12)}", f"d{r.randrange(4)}", 10, r.randrange(0, 300)) for _ in range(400)]
    g = ledger(spark, tx)
    got = {x["account_id"]: (x["n"], x["counterparties"]) for x in windows.fan(g.tx, g.accounts, True, least=1).collect()}
    for hub in {d for _, d, *_ in tx}:
        events = sorted((h, s) for s, d, _, h in tx if d == hub)
        best = max(({s for h, s in events if t <= h <= t + 48} for t, _ in events), key=len)
        first = next(c for c in ({s for h, s in events if t <= h <= t + 48} for t, _ in events) if len(c) == len(best))
        assert got[hub] == (len(first), sorted(first))


def test_hub_factor(spark):
    tx = [(f"s{i}", "hub", 10, i) for i in range(6)]
    g = ledger(spark, tx, [{"account_id": "hub", "account_type": "business"}])
    assert windows.fan(g.tx, g.accounts, True).first()["legit_hub_factor"] == 0.18
    assert windows.fan(g.tx, g.accounts.limit(0), True).first()["score"] == 0.7


def test_linkage_is_one_hop(spark):
    ks = [("a", "D1", "I1"), ("b", "D1", "I1"), ("c", "D1", None), ("d", None, "I1"), ("e", "D9", None), ("f", "", "I2"), ("g", "", "I2"), ("h", "", None)]
    g = ledger(spark, [], [{"account_id": a, "device_id": d, "signup_ip": i, "email": None, "phone": f"p{a}"} for a, d, i in ks])
    rows = {r["account_id"]: (r["cluster_size"], r["linked_accounts"]) for r in linkage.device_linkage(g.accounts).collect()}
    assert rows == {"a": (4, ["b", "c", "d"]), "b": (4, ["a", "c", "d"]), "c": (3, ["a", "b"]), "d": (3, ["a", "b"])}


def circular_by_force(tx):
    pair = {}
    for i, (s, d, v, h) in enumerate(tx):
        pair.setdefault((s, d), []).append((h, i, v))
    money = {p: sorted(x) for p, x in pair.items() if max(v for *_, v in x) >= 1000 and p[0] != p[1]}
    found = set()
    for k in (3, 4, 5):
        for nodes in itertools.permutations({n for p in money for n in p}, k):
            hops, at = [], -1e9
            for p in zip(nodes, nodes[1:] + nodes[:1]):
                nxt = next((x for x in money.get(p, []) if x[0] > at), None)
                if nxt is None:
                    break
                hops.append(nxt)
                at = nxt[0]
            if len(hops) == k and at - hops[0][0] <= 72 and 0.7 <= hops[-1][2] / hops[0][2] <= 1.25:
                found.add(tuple(sorted(nodes)))
    return found


def test_circular_against_force(spark):
    r = random.Random(3)
    tx = [(f"n{r.randrange(7)}", f"n{r.randrange(7)}", r.choice([500, 1000, 1200, 1500]), r.randrange(0, 200)) for _ in range(60)]
    g = ledger(spark, tx)
    want = circular_by_force(tx)
    assert want and {tuple(x["members"]) for x in cycles.circular(g.tx, g.accounts).collect()} == want
    loop = [("a", "b", 12_000, 0), ("b", "c", 11_800, 5), ("c", "a", 11_500, 9)]
    legit = [{"account_id": a, "account_type": "business"} for a in "abc"]
    h = ledger(spark, loop, legit)
    assert cycles.circular(h.tx, h.accounts).count() == 0 and cycles.circular(h.tx, h.accounts.filter("account_id <> 'a'")).count() == 1


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {n: n for e in links for n in e}

    def find_root(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find_root(a), find_root(b))] = min(find_root(a), find_root(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {n: find_root(n) for n in root if any(n in e and e[0] != e[1] for e in links)}


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 100, i + j) for i in range(4) for j in range(i)]
    tx = clique("a") + clique("b") + [("a0", "b0", 1, 0)] + [("hub", f"l{i}", 50, i) for i in range(30)] + [("a1", "a1", 5, 1)]
    rows = communities.communities(ledger(spark, tx).tx).collect()
    assert sorted(tuple(r["members"]) for r in rows) == [tuple(f"a{i}" for i in range(4)), tuple(f"b{i}" for i in range(4))]
    assert {(r["density"], r["score"]) for r in rows} == {(1.0, 1.0)}


def test_trace_path(spark):
    tx = ledger(spark, [("a", "b", 1, 0), ("b", "c", 2, 1), ("a", "c", 3, 2), ("c", "d", 4, 3), ("d", "e", 5, 4), ("b", "a", 1, 5)]).tx
    hop = lambda *a, **k: [(r["src"], r["dst"]) for r in paths.trace_path(tx, *a, **k).orderBy("hop").collect()]
    assert hop("a", "e") == [("a", "c"), ("c", "d"), ("d", "e")]
    assert hop("a", "e", max_hops=2) == hop("e", "a") == hop("a", "zz") == []


def risk_of(spark, tx, accounts):
    g = ledger(spark, tx, accounts)
    out = score.score_accounts(find(g, ["structuring", "passthrough", "fan_in"]), g.accounts, g.tx).collect()
    return {r["account_id"]: (r["risk"], {s["detector"]: s["score"] for s in r["top_signals"]}) for r in out}


BASE = {"sanctioned": False, "pep": False, "nominee_owner": False, "prior_fraud": False, "expected_monthly_volume": 90_000.0}


def test_profile_alone_never_flags(spark):
    risk, seen = risk_of(spark, [("x", "m", 50_000, 0, "crypto")], [BASE | {"account_id": "m", "country": "RU", "opened_at": "2026-05-20", "kyc_risk": "high", "pep": True}])["m"]
    assert risk < 0.5 and {"high_risk_country", "fresh_account", "kyc_risk", "crypto_channel", "pep"} <= set(seen)


def test_sanctions_alone_flag(spark):
    risk, seen = risk_of(spark, [("x", "m", 9_000, 0)], [BASE | {"account_id": "m", "sanctioned": True}])["m"]
    assert risk >= 0.9 and seen["sanctions_hit"] == 1.0


def test_profile_signals(spark):
    g = ledger(
        spark,
        [("m", "x", 20_000, 0, "sepa", "RU"), ("x", "m", 75_000, 1), ("p", "x", 120, 2, "crypto")],
        [BASE | {"account_id": "m", "account_type": "business", "country": "AE", "nominee_owner": True, "opened_at": "2026-05-20", "kyc_risk": "medium", "expected_monthly_volume": 2_000.0},
         BASE | {"account_id": "p"}, BASE | {"account_id": "x", "expected_monthly_volume": 90_000.0}],
    )
    seen = {(r["account_id"], r["component"]) for r in score.profile_signals(g.accounts, g.tx).collect()}
    assert {("m", "shell_company"), ("m", "geo_mismatch"), ("m", "activity_vs_profile")} <= seen
    assert not {("p", "crypto_channel"), ("x", "activity_vs_profile")} & seen


def test_merge_order():
    import pandas as pd

    seeds = pd.DataFrame({"score": [0.9, 0.8, 0.7, 0.6], "members": [["a", "b", "c"], ["d", "e", "f"], ["b", "c", "d", "e"], ["x", "y"]], "detector": ["fan_in", "fan_out", "circular", "passthrough"]})
    out = rings.merge(seeds.sample(frac=1, random_state=1))
    # the third seed joins the first cluster only, and the two clusters stay apart though they now overlap
    assert out["members"].tolist() == [["a", "b", "c", "d", "e"], ["d", "e", "f"], ["x", "y"]]
    assert out["patterns"].tolist()[0] == ["circular", "fan_in"]


@pytest.mark.parametrize("size", [0])
def test_empty_ledger(spark, size):
    g = ledger(spark, [], [])
    found = find(g)
    assert found.count() == size and score.score_accounts(found, g.accounts, g.tx).count() == 0


def test_bursts_on_a_batch(spark):
    from riskloom.streaming.bursts import structuring_bursts

    tx = ledger(spark, [("a", "x", 9_500, 0), ("b", "x", 9_600, 10), ("c", "x", 9_700, 20), ("d", "y", 9_700, 20)]).tx
    rows = structuring_bursts(tx).collect()
    assert rows and {r["account_id"] for r in rows} == {"x"} and {r["n"] for r in rows} == {3}
    assert tx.select(F.max("us")).first()[0] > 0
