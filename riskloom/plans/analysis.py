"""The whole analysis of a ledger, each table written once, when it is first read, for all views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.adjacency import touching
from riskloom.operators.windows import pairs
from riskloom.plans.findings import Detector, find
from riskloom.plans.rings import build_rings, transfers, whole
from riskloom.plans.score import score_accounts
from riskloom.scratch import Scratch
from riskloom.sources.ledger import Ledger


@dataclass(frozen=True)
class Analysis:
    ledger: Ledger
    findings: DataFrame
    account_risk: DataFrame
    rings: DataFrame
    #: Transfers by the accounts they touch, for views of one account.
    touching: DataFrame | None = None

    @property
    def ring_heads(self) -> DataFrame:
        """Rings without their transfers."""
        return self.rings.drop("tx_ids")

    @property
    def ring_tx(self) -> DataFrame:
        """ring_id, place, tx_id: a row for each transfer of a ring."""
        return self.rings.select("ring_id", "place", F.explode("tx_ids").alias("tx_id"))


class Staged(Analysis):
    """An analysis whose tables are written when they are first read, so a view pays for those that it reads."""

    def __init__(self, ledger: Ledger, detectors: Iterable[str] | Mapping[str, Detector] | None = None):
        # the fields of a frozen dataclass are set by name; so are the tables below
        self.__dict__["_scratch"] = scratch = Scratch(ledger.tx.sparkSession, "analysis")
        kept = Ledger(scratch.put(ledger.accounts, "accounts"), scratch.put(ledger.tx, "tx"))
        self.__dict__["ledger"] = replace(kept, pairs=scratch.put(pairs(kept.tx), "pairs"))
        self.__dict__["_detectors"] = detectors

    @cached_property
    def findings(self) -> DataFrame:
        return self._scratch.put(find(self.ledger, self._detectors), "findings")

    @cached_property
    def account_risk(self) -> DataFrame:
        return self._scratch.put(score_accounts(self.findings, self.ledger.accounts, self.ledger.tx, self.ledger.pairs), "risk")

    @cached_property
    def ring_heads(self) -> DataFrame:
        return self._scratch.put(build_rings(self.findings, self.account_risk, self.ledger.tx, self.ledger.pairs), "heads")

    @cached_property
    def ring_tx(self) -> DataFrame:
        return self._scratch.put(transfers(self.ring_heads, self.ledger.tx), "ring_tx")

    @cached_property
    def rings(self) -> DataFrame:
        """A ring's transfers are gathered in its row here; views that need no such row read ring_heads and ring_tx."""
        return self._scratch.put(whole(self.ring_heads, self.ring_tx), "rings")

    @cached_property
    def touching(self) -> DataFrame:
        return touching(self.ledger.tx, self._scratch)


def analyse(ledger: Ledger, detectors: Iterable[str] | Mapping[str, Detector] | None = None) -> Analysis:
    """Findings, risks and rings as tables in the shared folder, each written when it is first read."""
    return Staged(ledger, detectors if detectors is None or isinstance(detectors, Mapping) else tuple(detectors))
