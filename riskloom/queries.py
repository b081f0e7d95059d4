"""The registered queries over the test ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import HOUR
from riskloom.operators import communities, cycles, linkage, paths, ranges, windows
from riskloom.operators.ordering import numbered
from riskloom.plans import findings, rings, score, views
from riskloom.plans.analysis import Analysis, analyse
from riskloom.plans.evaluate import evaluate
from riskloom.scratch import Scratch
from riskloom.sources.decisions import DecisionLog
from riskloom.sources.ledger import Ledger, from_tables
from riskloom.streaming.bursts import replay

Query = Callable[[SparkSession, str], DataFrame]
#: The reduced set, and the transfers that make communities in the full one: by all transfers the test ledger is one web without small communities.
SQL_DETECTORS = [d for d in findings.DETECTORS if d != "community"]
LARGE_C = 3_000_000
FOCUS, TARGET = "A7", "A900"
_known: dict[tuple[str, str, bool], Analysis] = {}
_ledgers: dict[tuple[str, str], Ledger] = {}


def forget() -> None:
    """Drop shared analyses; the next query makes its own."""
    _known.clear()


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The test tables as a stored ledger, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ledgers:
        given, scratch = from_tables(spark, sf_dir), Scratch(spark, "ledger")
        _ledgers[key] = Ledger(scratch.put(given.accounts, "accounts"), scratch.put(given.tx, "tx"))
    return _ledgers[key]


def full_detectors() -> dict[str, findings.Detector]:
    return findings.DETECTORS | {"community": lambda g: communities.communities(g.tx, least_c=LARGE_C)}


def analysis(spark: SparkSession, sf_dir: str, full: bool = False) -> Analysis:
    """The analysis of a ledger, made once in a session: views read what is stored, as a service would, and a table is written when a view first reads it.

    By SQL_DETECTORS, or, if full, by all detectors, with communities by large transfers.
    """
    key = (spark.sparkContext.applicationId, sf_dir, full)
    if key not in _known:
        _known[key] = analyse(ledger(spark, sf_dir), full_detectors() if full else SQL_DETECTORS)
    return _known[key]


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as text."""
    return df.withColumns({c: F.array_join(c, ",") for c, t in df.dtypes if t == "array<string>"})


def on_ledger(f: Callable[[Ledger], DataFrame]) -> Query:
    return lambda spark, sf_dir: flat(f(ledger(spark, sf_dir)))


class on_analysis:  # noqa: N801
    """A query on the analysis by SQL_DETECTORS; ``full`` is the same by all detectors."""

    def __init__(self, f: Callable[[Analysis], DataFrame]):
        self.f = f

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(self.f(analysis(spark, sf_dir)))

    def full(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(self.f(analysis(spark, sf_dir, full=True)))


def shown_risk(a: Analysis) -> DataFrame:
    text = F.array_join(F.transform("top_signals", lambda s: F.format_string("%s:%.2f", s["detector"], s["score"])), " ")
    return a.account_risk.select("account_id", "risk", F.coalesce(text, F.lit("")).alias("top_signals"))


def seed_measures(a: Analysis) -> DataFrame:
    seeds = rings.seeds(a.findings, a.ledger.pairs).select("members", F.array("detector").alias("patterns")).distinct()
    return rings.measure(seeds, a.account_risk, a.ledger.pairs).drop("ring")


def decisions(a: Analysis) -> DataFrame:
    """Reviewers' decisions; only an account's last one counts."""
    k = F.substring("account_id", 2, 20).cast("long")
    rows = a.ledger.accounts.select("account_id", k.alias("k")).filter(F.col("k") % 10 > 2).filter(F.col("k") % 10 < 5)
    late = rows.select(F.lit(2).alias("at"), "account_id", F.when(F.col("k") % 10 == 3, "clear").otherwise("block").alias("action"))
    return late.union(rows.select(F.lit(1), "account_id", F.lit("freeze")))


def logged(a: Analysis) -> DataFrame:
    """Statuses by a log of two batches, the later one with equal and earlier times too, and an older ledger's decisions."""
    log = DecisionLog(a.ledger.tx.sparkSession, Scratch(a.ledger.tx.sparkSession, "log").path("decisions"))
    k = F.substring("account_id", 2, 20).cast("long") % 10
    rows = a.ledger.accounts.select("account_id", k.alias("k"))
    log.append(rows.filter("k in (1, 2)").select(F.lit(9).alias("at"), "account_id", F.lit("ban").alias("action")), "before")
    log.append(rows.filter("k in (3, 4, 5)").select(F.lit(7).alias("at"), "account_id", F.lit("freeze").alias("action")), "now")
    log.append(rows.filter("k in (3, 4)").select((F.col("k") + 3).alias("at"), "account_id", F.when(F.col("k") == 3, "clear").otherwise("block").alias("action")), "now")
    log = log.compact(Scratch(a.ledger.tx.sparkSession, "log").path("compact"))
    return views.statuses(a, log.last("now"))


def risk_order(a: Analysis) -> DataFrame:
    """The order in which risks are reported."""
    return numbered(a.account_risk.select("account_id", "risk"), [F.desc("risk"), F.col("account_id")], Scratch(a.ledger.tx.sparkSession, "order"))


def table_order(a: Analysis) -> DataFrame:
    """The accounts' table by rings, then risk, and under review alone by owner."""
    scratch = Scratch(a.ledger.tx.sparkSession, "order")
    status = views.statuses(a).select("account_id", "status")
    rows = views.accounts_list(a).drop("status").join(status, "account_id").select("account_id", "owner_name", "status", "risk", F.size("rings").cast("long").alias("n_rings"))
    every = numbered(rows.filter("n_rings > 0"), [F.desc("n_rings"), F.desc("risk"), F.col("account_id")], scratch).select(F.lit("rings").alias("by"), "account_id", "place")
    held = numbered(rows.filter("status <> 'active'"), [F.desc("owner_name"), F.col("account_id")], scratch)
    return every.union(held.select(F.lit("owner"), "account_id", "place"))


def evaluation(a: Analysis) -> DataFrame:
    """Against labels by rule: every seventh account a mule, each with its neighbour a ring."""
    k = F.substring("account_id", 2, 20).cast("long")
    mules = a.ledger.accounts.select("account_id", k.alias("k")).filter(F.col("k") % 7 == 0)
    true = mules.groupBy(F.concat(F.lit("T"), F.floor(F.col("k") / 14)).alias("ring_id")).agg(F.collect_set("account_id").alias("account_ids"))
    return evaluate(a.account_risk, a.ring_heads, mules, true)


def hops(g: Ledger) -> DataFrame:
    return paths.trace_path(g.tx, FOCUS, TARGET)


def window():
    """The times of a finding, 0 where it has none."""
    return [F.coalesce(c, F.lit(0)).alias(c) for c in ("start_us", "end_us")]


def shown_findings():
    text = F.transform("findings", lambda f: F.format_string("%s:%.2f", f["detector"], f["score"]))
    return F.coalesce(F.array_join(text, " "), F.lit("")).alias("findings")


def given_communities(g: Ledger) -> DataFrame:
    """Evidence on communities by rule, five accounts in a row each, of which few hold a payment."""
    home = g.accounts.select("account_id", F.floor(F.substring("account_id", 2, 20).cast("long") / 5).cast("string").alias("community"))
    return communities.evidence(home, communities.payment_graph(g.tx), density=0.1)


def compared(a: Analysis) -> DataFrame:
    return views.compare_rings(a).select("ring_a", "ring_b", "shared_accounts", "shared_patterns", "n_shared", "amount_c_a", "amount_c_b")


def ego_nodes(a: Analysis) -> DataFrame:
    return views.ego_nodes(a, views.ego_edges(a, FOCUS), FOCUS)


CUT = ["tx_id", "src", "dst", "amount_c"]
QUERIES: dict[str, Query] = {
    "structuring": on_ledger(lambda g: windows.structuring(g.tx)),
    "circular": on_ledger(lambda g: cycles.circular(g.tx, g.accounts)),
    "circular_relaxed": on_ledger(lambda g: cycles.circular(g.tx, g.accounts, longest=3, span=720 * HOUR)),
    "passthrough": on_ledger(lambda g: ranges.passthrough(g.tx)),
    "fiat_to_crypto": on_ledger(lambda g: ranges.fiat_to_crypto(g.tx)),
    "round_amounts": on_ledger(lambda g: windows.round_amounts(g.tx)),
    "round_amounts_relaxed": on_ledger(lambda g: windows.round_amounts(g.tx, step_c=1_000)),
    "dormant_reactivation": on_ledger(lambda g: ranges.dormant_reactivation(g.tx, g.accounts)),
    "activity_spike": on_ledger(lambda g: windows.activity_spike(g.tx)),
    "activity_spike_relaxed": on_ledger(lambda g: windows.activity_spike(g.tx, 3, 12, 0)),
    "device_linkage": on_ledger(lambda g: linkage.device_linkage(g.accounts)),
    "fan_in": on_ledger(lambda g: windows.fan(g.tx, g.accounts, True)),
    "fan_out": on_ledger(lambda g: windows.fan(g.tx, g.accounts, False)),
    "community": on_ledger(lambda g: findings.DETECTORS["community"](g)),
    "community_large": on_ledger(lambda g: communities.communities(g.tx, least_c=LARGE_C)),
    "community_evidence": on_ledger(given_communities),
    "circular_long": on_ledger(lambda g: cycles.circular(g.tx, g.accounts, least_c=150_000, shortest=4, span=480 * HOUR)),
    "pair_sums": on_ledger(lambda g: windows.pairs(g.tx)),
    "money_edges": on_ledger(lambda g: windows.pairs(g.tx).filter("max_c >= 100000").select("src", "dst")),
    "findings": on_analysis(lambda a: a.findings.select("detector", "subject_type", "subject_ids", "score", *window(), "counterparties")),
    "behaviour_points": on_analysis(lambda a: score.behaviour(a.findings, a.ledger.accounts)),
    "screening_points": on_ledger(lambda g: score.screening(g.accounts)),
    "network_association": on_analysis(lambda a: score.association(a.ledger.pairs, score.behaviour(a.findings, a.ledger.accounts), a.ledger.accounts)),
    "profile_signals": on_ledger(lambda g: score.profile_signals(g.accounts, g.tx)),
    "profile_raw": on_ledger(lambda g: score.profile_raw(score.profile_signals(g.accounts, g.tx), g.accounts)),
    "account_risk": on_analysis(shown_risk),
    "ring_seeds": on_analysis(lambda a: rings.seeds(a.findings, a.ledger.pairs).drop("seed")),
    "seed_measures": on_analysis(seed_measures),
    "rings": on_analysis(lambda a: a.rings.select("ring_id", F.col("account_ids").alias("members"), "patterns", "score", "key_accounts", "tx_ids", F.size("tx_ids").cast("long").alias("n_tx"))),
    "summary": on_analysis(views.summary),
    "accounts_list": on_analysis(lambda a: views.accounts_list(a).select("account_id", "owner_name", "account_type", "country", "kyc_risk", "status", "risk", "rings", "n_findings")),
    "ego_graph_1": on_analysis(lambda a: views.ego_edges(a, FOCUS)),
    "ego_graph_2": on_analysis(lambda a: views.ego_edges(a, FOCUS, hops=2)),
    "ego_graph_2_capped": on_analysis(lambda a: views.ego_edges(a, FOCUS, hops=2, max_edges=60, max_nodes=20)),
    "ego_nodes": on_analysis(ego_nodes),
    "suspicious_edges": on_analysis(lambda a: views.ego_edges(a, FOCUS, suspicious_only=True)),
    "enriched_edges": on_analysis(lambda a: views.enriched_edges(a, a.ledger.tx)),
    "rings_list": on_analysis(lambda a: views.rings_list(a, tx_ids=False).select("ring_id", "score", "patterns", F.size("account_ids").cast("long").alias("n_accounts"))),
    "ring_accounts": on_analysis(lambda a: views.ring_detail(a, "DET_001", "accounts").select("account_id", "owner_name", "risk")),
    "ring_transactions": on_analysis(lambda a: views.ring_detail(a, "DET_001", "transactions").select(*CUT)),
    "ring_findings": on_analysis(lambda a: views.ring_detail(a, "DET_001", "findings").select("detector", "subject_ids", "score")),
    "ring_keys": on_analysis(lambda a: views.ring_keys(a).withColumn("place", F.col("place").cast("long"))),
    "account_findings": on_analysis(lambda a: views.account_detail(a, FOCUS, parts=["findings"])["findings"].select("detector", "subject_ids", "score", *window())),
    "account_signals": on_analysis(lambda a: views.account_detail(a, FOCUS, parts=["risk"])["risk"].select("account_id", "risk", F.explode("top_signals").alias("s")).select("account_id", "risk", "s.detector", "s.score")),
    "account_transactions": on_analysis(lambda a: views.account_detail(a, FOCUS, parts=["transactions"])["transactions"].select(*CUT, "us")),
    "transaction_detail": on_analysis(lambda a: views.transaction_detail(a, a.ledger.tx.filter("tx_id = 'T7'"))),
    "auto_freeze": on_analysis(lambda a: views.statuses(a).drop("auto")),
    "decided_status": on_analysis(lambda a: views.statuses(a, decisions(a))),
    "decision_log": on_analysis(logged),
    "risk_order": on_analysis(risk_order),
    "table_order": on_analysis(table_order),
    "review_queue": on_analysis(lambda a: views.review_queue(a).select("account_id", "owner_name", "account_type", "kyc_risk", "status", "risk", "summary", "patterns", "n_findings", shown_findings())),
    "under_review": on_analysis(views.under_review),
    "evaluate": on_analysis(evaluation),
    "account_profile": on_analysis(lambda a: views.account_profile(a).select("account_id", "owner_name", "risk", "risk_band", "identity.verification_level", "identity.business_category", "network.ip_country", "network.ip_risk_score",
                                                                              "device.emulator", "behaviour.automation_score", "history.prior_fraud", "contact.email", "status", shown_findings())),
    "trace_path": lambda spark, sf_dir: hops(ledger(spark, sf_dir)),
    "trace_flow": lambda spark, sf_dir: paths.flow_of(hops(ledger(spark, sf_dir))),
    "compare_rings": on_analysis(compared),
    "flow_summary": on_ledger(lambda g: views.flow_summary(g.tx)),
    "top_counterparties": on_ledger(lambda g: views.top_counterparties(g.tx)),
    "elevated_profile": on_ledger(lambda g: views.elevated(g.accounts)),
    "verdicts": on_analysis(views.verdicts),
    "search": on_analysis(lambda a: views.search(views.accounts_list(a), "business CY").select("account_id", "risk")),
    "risk_tiers": on_analysis(views.tiers),
    "signal_categories": on_analysis(views.signal_categories),
    "full_rings": lambda spark, sf_dir: flat(analysis(spark, sf_dir, full=True).rings.drop("narrative")),
    "streaming_bursts": replay,
}
#: Every query on the analysis once more, by all detectors; full_rings is there already, with other columns.
QUERIES |= {f"full_{name}": q.full for name, q in QUERIES.items() if isinstance(q, on_analysis) and f"full_{name}" not in QUERIES}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
