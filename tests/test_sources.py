"""Round trips of ledgers, positions by rule, and the log of decisions."""

import json

import pytest

from riskloom.plans import views
from riskloom.sources import ledger as sources
from riskloom.sources.decisions import DecisionLog
from tests.test_detectors import ledger


def rows(df):
    return sorted(map(str, df.collect()))


def test_lines_read_back(spark, tmp_path):
    g = ledger(spark, [("a", "b", 12.34, 0), ("b", "c", 0.05, 1, "wire", "RU"), ("c", "c", 10**7, 2.5)], [{"account_id": "a", "aliases": ["x", 'y"}'], "pep": True}, {"account_id": "b"}])
    sources.write_json(g, str(tmp_path))
    back = sources.read_lines(spark, str(tmp_path))
    assert back.tx.columns == g.tx.columns and back.accounts.columns == g.accounts.columns
    assert rows(back.tx) == rows(g.tx) and rows(back.accounts) == rows(g.accounts)
    sources.write_json(back, str(tmp_path / "again"))
    assert rows(sources.read_lines(spark, str(tmp_path / "again")).tx) == rows(g.tx)


def test_lines_with_times_and_amounts(spark, tmp_path):
    (tmp_path / "accounts").mkdir()
    (tmp_path / "transactions").mkdir()
    (tmp_path / "accounts" / "a.json").write_text(json.dumps({"account_id": "a"}))
    tx = [{"tx_id": f"t{i}", "timestamp": f"2026-01-0{1 + i % 3}T00:00:00Z", "src": "a", "dst": "b", "amount": 1.15 + i} for i in range(6)]
    for k in range(3):
        (tmp_path / "transactions" / f"{k}.json").write_text("\n".join(json.dumps(x) for x in tx[k::3]))
    got = {r["tx_id"]: (r["tx_pos"], r["amount_c"]) for r in sources.read_lines(spark, str(tmp_path)).tx.collect()}
    # by time, then by tx_id, however the files are split
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == ["t0", "t3", "t1", "t4", "t2", "t5"]
    assert sorted(p for p, _ in got.values()) == list(range(6)) and got["t0"][1] == 115


def test_decisions(spark, tmp_path):
    log = DecisionLog(spark, str(tmp_path / "log"))
    assert log.last("one").count() == 0
    batch = lambda *x: spark.createDataFrame(x, "at long, account_id string, action string")
    log.append(batch((5, "a", "freeze"), (5, "a", "block"), (1, "b", "clear")), "one")
    log.append(batch((2, "b", "ban")), "one")
    log.append(batch((9, "c", "ban")), "two")
    with pytest.raises(ValueError, match="actions are"):
        log.append(batch((1, "d", "ban"), (1, "d", "nothing")), "one")
    with pytest.raises(ValueError, match="actions are"):
        log.append(batch((1, None, "ban")), "one")
    last = {r["account_id"]: r["action"] for r in log.last("one").collect()}
    assert last == {"a": "freeze", "b": "ban"}  # at one time by action; a later batch counts whatever its time
    assert sorted(r["seq"] for r in log.rows().collect()) == [1, 2, 3, 4, 5]
    small = log.compact(str(tmp_path / "small"))
    assert rows(small.last("one")) == rows(log.last("one")) and small.rows().count() == 3
    small.append(batch((0, "a", "clear")), "one")
    assert {r["account_id"]: r["decided"] for r in views.latest_decisions(small.last("one")).collect()} == {"a": "active", "b": "banned"}
    # a ledger made anew starts without decisions
    assert small.last("three").count() == 0
