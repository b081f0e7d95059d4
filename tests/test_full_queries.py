"""The full_ queries are by all detectors, communities among them."""

from collections import Counter

import __spark_entry__ as driver
from riskloom import oracle, queries
from riskloom.plans.findings import DETECTORS, find
from riskloom.plans.score import score_accounts
from riskloom.sources.ledger import from_tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_every_query_on_the_analysis_has_a_full_form():
    found = queries.queries()
    on = [n for n, q in found.items() if isinstance(q, queries.on_analysis)]
    assert {"findings", "account_risk", "rings", "summary", "review_queue", "evaluate"} <= set(on)
    assert all(f"full_{n}" in found and f"full_{n}" in oracle.oracle_sql() for n in on)


def test_full_findings_and_risk(spark):
    ledger = from_tables(spark, SF)
    want = find(ledger, queries.full_detectors()).select("detector", "subject_type", "subject_ids", "score", *queries.window(), "counterparties")
    got = queries.queries()["full_findings"](spark, SF)
    assert rows(got) == rows(queries.flat(want))
    assert set(queries.SQL_DETECTORS) == set(DETECTORS) - {"community"}
    assert got.filter("detector = 'community'").count()
    risk = {r["account_id"]: r["risk"] for r in score_accounts(find(ledger, queries.full_detectors()), ledger.accounts, ledger.tx).collect()}
    shown = driver.entry(spark).collect()
    assert {r["account_id"]: r["risk"] for r in shown} == risk
    assert Counter(map(tuple, shown)) == rows(queries.queries()["full_account_risk"](spark, SF))


def test_a_community_raises_the_risk(spark, tmp_path):
    """Four accounts that pay each other once and nothing else: only communities see them."""
    import datetime

    from riskloom.plans.analysis import analyse
    from riskloom.schema import ACCOUNT, TRANSACTION
    from riskloom.sources import ledger

    names = ["a", "b", "c", "d"]
    doc = {"accounts": [{"account_id": n, "owner_name": n, "kyc_risk": "low"} for n in names], "transactions": [
        {"tx_id": f"t{i}{j}", "timestamp": (datetime.datetime(2026, 1, 1) + datetime.timedelta(days=40 * (4 * i + j))).isoformat() + "Z", "src": names[i], "dst": names[j], "amount": 123.45, "channel": "sepa"}
        for i in range(4) for j in range(i + 1, 4)]}
    import json

    (tmp_path / "d.json").write_text(json.dumps(doc))
    g = ledger.read_json(spark, str(tmp_path / "d.json"))
    assert g.accounts.columns == [c[0] for c in ACCOUNT] and g.tx.columns == [c[0] for c in TRANSACTION]
    key = (spark.sparkContext.applicationId, "d")
    queries._known[(*key, False)], queries._known[(*key, True)] = analyse(g, queries.SQL_DETECTORS), analyse(g)
    few, full = (queries.queries()[n](spark, "d") for n in ("findings", "full_findings"))
    assert few.filter("detector = 'community'").count() == 0
    assert [r["subject_ids"] for r in full.filter("detector = 'community'").collect()] == ["a,b,c,d"]
    before, after = ({r["account_id"]: r["risk"] for r in queries.queries()[n](spark, "d").collect()} for n in ("account_risk", "full_account_risk"))
    assert all(after[n] > before.get(n, 0) for n in names)
