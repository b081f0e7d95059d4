"""Account risk from findings, counterparties and customer profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import at_most_one, legit_profile, r2, r3
from riskloom.operators.ranges import DAY
from riskloom.operators.windows import endpoints, pairs
from riskloom.scratch import Scratch

# Weights, thresholds and reference sets.
WEIGHTS = {
    "structuring": 0.9, "circular": 0.9, "passthrough": 0.8, "fan_in": 0.8, "fan_out": 0.8, "fiat_to_crypto": 0.7, "community": 0.15,
    "round_amounts": 0.25, "dormant_reactivation": 0.3, "activity_spike": 0.3, "device_linkage": 0.6,
}
OTHER_WEIGHT, LEGIT_FACTOR, NORMALIZER, FLAG = 0.5, 0.18, 0.9, 0.5
SCREENING = {"sanctioned": 4.5, "blacklisted": 2.5, "prior_fraud": 1.8, "account_takeover": 1.4}
PROFILE = {
    "high_risk_country": 0.45, "fresh_account": 0.30, "kyc_risk": 0.30, "crypto_channel": 0.25, "pep": 0.40, "watchlist": 0.40,
    "prior_sars": 0.40, "adverse_media": 0.45, "shell_company": 0.50, "geo_mismatch": 0.35, "high_risk_mcc": 0.30, "vpn_tor": 0.30,
    "failed_verifications": 0.25, "activity_vs_profile": 0.45, "chargeback_history": 0.30, "device_integrity": 0.40, "ip_risk": 0.35,
    "automation": 0.35, "auth_anomaly": 0.30, "prior_fraud": 0.50, "account_takeover": 0.40, "blacklisted": 0.50, "unverified": 0.25,
    "historical_risk": 0.35,
}
RISKY_COUNTRIES = ("RU", "AE")
RISKY_TRADES = ("crypto_exchange", "money_services", "gambling", "precious_metals")


def _factor() -> Column:
    return F.when(legit_profile(F.col("account_type"), F.col("kyc_risk")), LEGIT_FACTOR).otherwise(1.0)


def profiles(accounts: DataFrame) -> DataFrame:
    """account_id and the factor that damps established businesses."""
    return accounts.select("account_id", _factor().alias("factor")).dropDuplicates(["account_id"])


def behaviour(findings: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, points, base: weighted findings, in points and in [0, 1]."""
    weight = F.coalesce(*(F.when(F.col("detector") == d, w) for d, w in WEIGHTS.items()), F.lit(OTHER_WEIGHT))
    # thousandths of a finding's weight are whole, so the sum has no order
    points = findings.select(F.explode("subject_ids").alias("account_id"), F.round(weight * F.col("score") * 10_000).cast("long").alias("p"))
    summed = points.groupBy("account_id").agg(F.sum("p").alias("p")).join(profiles(accounts), "account_id", "left")
    value = F.col("p") / 10_000.0 * F.coalesce("factor", F.lit(1.0))
    return summed.select("account_id", value.alias("points"), at_most_one(value / NORMALIZER).alias("base"))


def screening(accounts: DataFrame) -> DataFrame:
    """account_id, detector, points of each confirmed hit."""
    hits = F.array(*(F.struct(F.lit("sanctions_hit" if c == "sanctioned" else c).alias("detector"), F.when(F.col(c), v).alias("points")) for c, v in SCREENING.items()))
    return accounts.select("account_id", F.explode(hits).alias("h")).select("account_id", "h.*").filter("points is not null")


def association(money: DataFrame, base: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, association: share of value with risky counterparties times their mean risk; money: as by windows.pairs."""
    paid = money.select("src", "dst", F.col("total_c").alias("c"))
    # a transfer to oneself makes one its own counterparty, with the value of both directions
    both = paid.select(F.col("src").alias("a"), F.col("dst").alias("b"), "c").union(paid.select("dst", "src", "c"))
    sums = both.groupBy("a", "b").agg(F.sum("c").alias("w")).join(base.select(F.col("account_id").alias("b"), "base"), "b", "left")
    risky = F.col("base") >= FLAG
    per = sums.groupBy("a").agg(
        F.sum("w").alias("all"), F.sum(F.when(risky, F.col("w"))).alias("hot"), F.count_if(risky).alias("n"),
        F.sum(F.when(risky, F.round(F.col("base") * 1e9).cast("long"))).alias("risk"),
    )
    per = per.filter("all > 0 and n > 0").join(profiles(accounts).withColumnRenamed("account_id", "a"), "a", "left")
    raw = F.col("hot") / F.col("all") * (F.col("risk") / 1e9 / F.col("n")) * F.coalesce("factor", F.lit(1.0))
    return per.select(F.col("a").alias("account_id"), r3(raw).alias("association"))


def flows(tx: DataFrame) -> DataFrame:
    """account_id and its value: in and out, by risky channels, outward, and outward by country."""
    ends = endpoints(tx)
    total = ends.groupBy("account_id").agg(
        F.sum("amount_c").alias("all_c"),
        F.coalesce(F.sum(F.when(F.col("channel").isin("crypto", "cash_deposit"), F.col("amount_c"))), F.lit(0)).alias("risky_c"),
    )
    return total


def abroad(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, away: the share of outward value that starts in another country than the account's."""
    home = accounts.select(F.col("account_id").alias("src"), "country")
    sent = tx.groupBy("src", "tx_country").agg(F.sum("amount_c").alias("c")).join(home, "src", "left")
    away = F.when(F.col("tx_country") != F.col("country"), F.col("c")).otherwise(0)
    return sent.groupBy("src").agg(F.sum("c").alias("all"), F.sum(away).alias("away")).filter("all > 0 and away > 0").select(F.col("src").alias("account_id"), (F.col("away") / F.col("all")).alias("away"))


def profile_signals(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """account_id, component, value of every profile component that is there."""
    last = tx.agg(F.max("us").alias("ref_us"))
    opened = F.unix_micros(F.try_to_timestamp(F.substring("opened_at", 1, 10), F.lit("yyyy-MM-dd")))
    wide = accounts.join(flows(tx), "account_id", "left").join(abroad(tx, accounts), "account_id", "left").join(F.broadcast(last))  # one row
    age = F.floor((F.col("ref_us") - opened) / F.lit(DAY))
    wide = wide.withColumn("fresh", F.when(age < 90, r2(F.greatest(F.lit(0.0), (90 - age) / 90.0))))
    c = F.col
    share = c("risky_c") / F.when(c("all_c") > 0, c("all_c"))
    ratio = c("all_c") / 100.0 / F.when(c("expected_monthly_volume") > 0, c("expected_monthly_volume"))
    yes = lambda condition: F.when(condition, 1.0)
    capped = lambda n, least, most: F.when(c(n) >= least, r2(at_most_one(c(n) / float(most))))
    ip = F.greatest(c("ip_risk_score"), F.when(c("proxy"), 0.6).otherwise(0.0))
    values: dict[str, Column] = {
        "high_risk_country": yes(c("country").isin(*RISKY_COUNTRIES)),
        "fresh_account": c("fresh"),
        "kyc_risk": F.when(c("kyc_risk") == "high", 1.0).when(c("kyc_risk") == "medium", 0.5),
        "crypto_channel": F.when((share >= 0.5) & (c("risky_c") >= 1_000_000), r2(share)),
        "prior_sars": capped("prior_sars", 1, 3),
        "shell_company": yes((c("account_type") == "business") & c("nominee_owner") & (c("fresh") > 0) & c("country").isin(*RISKY_COUNTRIES)),
        "geo_mismatch": F.when(c("away") >= 0.3, r2(c("away"))),
        "high_risk_mcc": yes(c("business_category").isin(*RISKY_TRADES)),
        "failed_verifications": capped("failed_verifications", 2, 5),
        "chargeback_history": capped("chargeback_count", 1, 4),
        "device_integrity": F.when(c("emulator"), 1.0).when(c("rooted_jailbroken"), 0.6),
        "ip_risk": F.when((c("ip_risk_score") >= 0.5) | c("proxy"), r2(ip)),
        "automation": F.when(c("automation_score") >= 0.5, r2(c("automation_score"))),
        "auth_anomaly": capped("failed_logins_30d", 3, 10),
        "unverified": yes(c("verification_level") == "unverified"),
        "historical_risk": F.when(c("historical_risk_score") >= 0.5, r2(c("historical_risk_score"))),
        "activity_vs_profile": F.when((c("all_c") >= 1_000_000) & (ratio >= 4), r2(at_most_one(ratio / 20.0))),
    }
    values |= {name: yes(c(name)) for name in ("pep", "watchlist", "adverse_media", "vpn_tor", "prior_fraud", "account_takeover", "blacklisted")}
    rows = F.array(*(F.struct(F.lit(n).alias("component"), v.alias("value")) for n, v in values.items()))
    return wide.select("account_id", F.explode(rows).alias("s")).select("account_id", "s.*").filter("value > 0")


def profile_raw(signals: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, profile: the weighted sum of its components, one at most, damped."""
    weight = F.coalesce(*(F.when(F.col("component") == n, w) for n, w in PROFILE.items()))
    summed = signals.groupBy("account_id").agg(F.sum(F.round(weight * F.col("value") * 10_000).cast("long")).alias("p"))
    return summed.join(profiles(accounts), "account_id", "left").select("account_id", (at_most_one(F.col("p") / 10_000.0) * F.coalesce("factor", F.lit(1.0))).alias("profile"))


def risk_curve(points: Column, soft: Column) -> Column:
    """Flagged accounts spread over [0.5, 1), others over [0, 0.49)."""
    evidence, gate = points + soft, FLAG * NORMALIZER
    flagged = 0.5 + 0.5 * (1.0 - F.exp(-(evidence - gate) / 1.8))
    return r3(at_most_one(F.when(points >= gate, flagged).otherwise(0.49 * (1.0 - F.exp(-evidence / 0.8)))))


def score_accounts(findings: DataFrame, accounts: DataFrame, tx: DataFrame, money: DataFrame | None = None, keep: int = 12) -> DataFrame:
    """account_id, risk, top_signals (detector, score: the strongest of each, highest first).

    money: windows.pairs of the transactions, if stored. What is read twice is written once.
    """
    scratch = Scratch(tx.sparkSession, "score")
    acted = scratch.put(behaviour(findings, accounts), "acted")
    hits = screening(accounts)
    near = scratch.put(association(pairs(tx) if money is None else money, acted, accounts), "near")
    signals = scratch.put(profile_signals(accounts, tx), "signals")
    screened = hits.groupBy("account_id").agg(F.sum("points").alias("screened"))
    parts = [acted.select("account_id", "points"), screened, near, profile_raw(signals, accounts)]
    wide = reduce(lambda a, b: a.join(b, "account_id", "full"), parts)
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    risk = wide.select("account_id", risk_curve(zero("points") + zero("screened"), 0.5 * zero("association") + 0.5 * zero("profile")).alias("risk"))
    shown = findings.select(F.explode("subject_ids").alias("account_id"), "detector", r2(F.col("score")).alias("score"))
    shown = shown.union(hits.select("account_id", "detector", F.lit(1.0))).union(signals)
    shown = shown.union(near.filter("association > 0").select("account_id", F.lit("network_association"), r2(F.col("association"))))
    best = shown.groupBy("account_id", "detector").agg(F.max("score").alias("score"))
    top = best.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "detector"))).alias("s"))
    top = top.select("account_id", F.transform(F.slice("s", 1, keep), lambda x: F.struct(x["detector"].alias("detector"), (-x["m"]).alias("score"))).alias("top_signals"))
    return risk.join(top, "account_id", "left")
