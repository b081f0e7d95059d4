"""All detectors' findings in one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import communities, cycles, linkage, ranges, windows
from riskloom.sources.ledger import Ledger

SCHEMA = "detector string, subject_type string, subject_ids array<string>, score double, evidence string, start_us long, end_us long, counterparties array<string>"

Detector = Callable[[Ledger], DataFrame]

#: A detector: its rows from a ledger. Those with ``members`` are about a subgraph, others about one account.
DETECTORS: dict[str, Detector] = {
    "structuring": lambda g: windows.structuring(g.tx),
    "circular": lambda g: cycles.circular(g.tx, g.accounts, money=g.pairs),
    "passthrough": lambda g: ranges.passthrough(g.tx),
    "fiat_to_crypto": lambda g: ranges.fiat_to_crypto(g.tx),
    "round_amounts": lambda g: windows.round_amounts(g.tx),
    "dormant_reactivation": lambda g: ranges.dormant_reactivation(g.tx, g.accounts),
    "activity_spike": lambda g: windows.activity_spike(g.tx),
    "device_linkage": lambda g: linkage.device_linkage(g.accounts),
    "fan_in": lambda g: windows.fan(g.tx, g.accounts, True),
    "fan_out": lambda g: windows.fan(g.tx, g.accounts, False),
    "community": lambda g: communities.communities(g.tx),
}


def register(name: str, detector: Detector) -> None:
    """Add a detector of one's own: rows with account_id or members, score and evidence columns."""
    DETECTORS[name] = detector


def as_findings(name: str, rows: DataFrame) -> DataFrame:
    graph = "members" in rows.columns
    subject = F.col("members") if graph else F.array("account_id")
    plain = [c for c in rows.columns if c not in ("members", "account_id", "score", "start_us", "end_us")]
    optional = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    return rows.select(
        F.lit(name).alias("detector"), F.lit("subgraph" if graph else "account").alias("subject_type"), subject.alias("subject_ids"), F.col("score").cast("double"),
        (F.to_json(F.struct(*plain)) if plain else F.lit("{}")).alias("evidence"), optional("start_us", "long"), optional("end_us", "long"),
        optional("counterparties", "array<string>"),
    )


def find(ledger: Ledger, detectors: Iterable[str] | Mapping[str, Detector] | None = None) -> DataFrame:
    """By all registered detectors, by some of their names, or by detectors of one's own."""
    chosen = detectors if isinstance(detectors, Mapping) else {n: DETECTORS[n] for n in detectors or DETECTORS}
    # detectors that work in rounds run their jobs at once, beside each other
    with ThreadPoolExecutor(4) as pool:
        found = pool.map(inheritable_thread_target(ledger.tx.sparkSession)(lambda x: as_findings(x[0], x[1](ledger))), chosen.items())
        return reduce(DataFrame.unionByName, found)
