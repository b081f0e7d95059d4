"""Generated ledgers with labels: guardrails of the whole analysis, and files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.plans import views
from riskloom.plans.analysis import analyse
from riskloom.plans.evaluate import evaluate, report
from riskloom.schema import ACCOUNT, TRANSACTION
from riskloom.sources import ledger
from riskloom.sources.generator import generate


@pytest.fixture(scope="module")
def made(spark):
    made = generate(spark, n_accounts=400, n_legit_tx=1500, n_rings=10)
    return made, analyse(made.ledger)


def test_guardrails(made):
    labelled, a = made
    row = evaluate(a.account_risk, a.rings, labelled.mules, labelled.rings).first()
    print(report(row))
    assert row["precision"] == 1.0 and row["recall"] >= 0.74 and row["ring_recall"] >= 0.9 and row["false_positive_rings"] == 0


def test_the_large_ring_has_most_patterns(made):
    rings = made[1].rings.collect()
    assert max(len(r["patterns"]) for r in rings) == len(max(rings, key=lambda r: r["score"])["patterns"]) >= 3


def test_decoys_stay_low(made):
    first = 10 * 6 + 8
    risk = {r["account_id"]: r["risk"] for r in made[1].account_risk.collect()}
    assert max(risk.get(f"ACC_{first + i:07d}", 0) for i in range(4 * 5)) < 0.5


def test_decoys_are_as_many_as_asked(spark):
    none, nine = (generate(spark, n_accounts=200, n_legit_tx=0, n_rings=5, n_decoys=k).ledger for k in (0, 9))
    first = 5 * 6 + 8

    def decoys(made, k):
        names = [f"ACC_{first + i:07d}" for i in range(4 * k)]
        held = made.tx.filter(F.col("src").isin(names) | F.col("dst").isin(names)).select("src", "dst").collect()
        return {names.index(n) // 4 for row in held for n in row if n in names}

    assert decoys(nine, 9) == set(range(9)) and decoys(none, 0) == set()
    assert nine.tx.count() - none.tx.count() == 3 * 8 + 2 * 4 + 2 * 6 + 2 * 3


def test_profiles_differ_by_label(made):
    labelled, a = made
    rows = a.ledger.accounts.join(labelled.mules.withColumn("bad", F.lit(True)), "account_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    flags = ("pep", "watchlist", "adverse_media", "emulator", "rooted_jailbroken", "proxy", "vpn_tor", "prior_fraud", "account_takeover", "blacklisted")
    counts = ("prior_sars", "failed_verifications", "chargeback_count", "failed_logins_30d", "ip_risk_score", "automation_score", "historical_risk_score")
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in flags + counts]
    bad, good = (r.asDict() for r in rows.groupBy("bad").agg(*means).orderBy(F.col("bad").desc()).collect())
    assert all(bad[c] > good[c] for c in flags + counts)
    # clean accounts have tails of their own, and their contacts are theirs alone
    assert rows.filter("not bad and (pep or watchlist or adverse_media or vpn_tor)").count() > 0
    clean = rows.filter("not bad")
    assert clean.select("email").distinct().count() == clean.select("phone").distinct().count() == clean.count()
    shared = rows.filter("bad").groupBy("email").count().agg(F.min("count")).first()[0]
    assert shared >= 3
    tx = a.ledger.tx
    assert tx.filter("tx_country is null or status is null or reference is null or is_international is null or risk_score not between 0 and 1").count() == 0


def test_same_on_every_run(spark):
    x, y = (generate(spark, n_accounts=200, n_legit_tx=300, n_rings=5, seed=7).ledger for _ in range(2))
    assert x.tx.exceptAll(y.tx).count() == 0 and x.accounts.exceptAll(y.accounts).count() == 0


def test_views(made):
    _, a = made
    assert views.summary(a).first()["accounts"] == 400
    queue = views.review_queue(a).collect()
    assert all(r["risk"] >= 0.9 and r["status"] == "frozen" for r in queue)
    assert all(r["text"] for r in views.verdicts(a).collect())
    ring = a.rings.orderBy("ring_id").first()["ring_id"]
    assert views.ring_detail(a, ring, "transactions").count() and views.ring_detail(a, ring, "findings").count()
    assert views.account_detail(a, a.rings.first()["account_ids"][0])["transactions"].count()


def test_files(spark, made, tmp_path):
    small = made[0].ledger
    ledger.write_parquet(small, str(tmp_path / "p"))
    back = ledger.read_parquet(spark, str(tmp_path / "p"))
    assert back.tx.exceptAll(small.tx).count() == 0
    doc = {"accounts": [{"account_id": "a", "owner_name": "A", "kyc_risk": "low"}], "transactions": [
        {"tx_id": "t1", "timestamp": "2026-06-01T08:00:00Z", "src": "a", "dst": "b", "amount": 12.34, "channel": "sepa"},
        {"tx_id": "t2", "timestamp": "2026-06-01T09:00:00Z", "src": "b", "dst": "a", "amount": 1, "channel": "wire"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    read = ledger.read_json(spark, str(tmp_path / "d.json"))
    assert [(r["tx_id"], r["amount_c"], r["tx_pos"]) for r in read.tx.orderBy("tx_pos").collect()] == [("t1", 1234, 0), ("t2", 100, 1)]
    assert read.accounts.columns == [c[0] for c in ACCOUNT] and read.tx.columns == [c[0] for c in TRANSACTION]
    assert read.accounts.first()["distinct_ips"] == 1
    ledger.write_json(read, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/transactions")).count() == 2
