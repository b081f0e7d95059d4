"""Synthetic ledgers with labels, from seeded hashes: any size, the same on every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import HOUR
from riskloom.sources.ledger import Ledger, of

KINDS = ("structuring", "circular", "mule_fanin", "mule_fanout", "layering")
#: Accounts of a ring, of the ring that does everything, and of one decoy.
SIZE, KINGPIN, DECOY = 6, 8, 4
#: Decoys: a payroll, a settlement loop, a shop that collects, a firm that pays on what it gets.
DECOY_KINDS = 4
HOMES, ABROAD = ("GR", "CY", "DE", "FR", "IT"), ("RU", "AE")
START = 1_780_272_000_000_000  # 2026-06-01


@dataclass(frozen=True)
class Labelled:
    ledger: Ledger
    mules: DataFrame
    rings: DataFrame


def _name(number: Column) -> Column:
    return F.format_string("ACC_%07d", number)


def generate(
    spark: SparkSession, n_accounts: int = 800, n_legit_tx: int = 4000, n_rings: int = 15, seed: int = 42, window_days: int = 30, n_decoys: int | None = None
) -> Labelled:
    """Legitimate payments, rings of five kinds in turn, one ring of several, a relay through a woken account, and decoys.

    Account numbers: rings first, then the large ring, then decoys of established
    businesses, the old account that wakes up and is labelled, then everybody else.
    There are n_decoys of the decoys, their kinds in turn; None takes 5 to 12 of
    them, of kinds by the seed. Profiles and transaction details follow from the
    account's number by hashes, so that no join adds them; only the expected volume
    needs what an account moved. Labelled accounts differ in every layer of the
    profile by ranges that overlap with the others' tails.
    """
    first_decoy = n_rings * SIZE + KINGPIN
    decoys = 5 + seed * 7919 % 8 if n_decoys is None else n_decoys
    woken = first_decoy + decoys * DECOY
    first_legit = woken + 1
    if n_accounts < first_legit + 20:
        raise ValueError(f"{n_rings} rings and {decoys} decoys need {first_legit + 20} accounts at least")
    span = window_days * 24 * HOUR

    def u(salt: str, *cols: str | Column) -> Column:
        """Uniform in [0, 1)."""
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1_000_003)) / 1_000_003.0

    pick = lambda salt, names, *cols: F.element_at(F.array(*map(F.lit, names)), (1 + F.floor(u(salt, *cols) * len(names))).cast("int"))
    ring_of = lambda n: F.floor(n / SIZE)
    in_ring = lambda n: n < n_rings * SIZE

    def labelled(n: Column) -> Column:
        """Whether an account is of a ring; circular rings use four of their numbers."""
        idle = in_ring(n) & (ring_of(n) % 5 == 1) & (n % SIZE > 3)
        return ((n < first_decoy) & ~idle) | n.isin(first_legit, woken, first_legit + 1)

    def country(n: Column) -> Column:
        return F.when(labelled(n) & (u("abroad", n) < 0.3), pick("risky", ABROAD, n)).otherwise(pick("home", HOMES, n))

    def device(n: Column) -> Column:
        fleet = labelled(n) & in_ring(n) & (ring_of(n) % 3 == 0)
        return F.when(fleet, F.concat(F.lit("dev-ring-"), ring_of(n))).otherwise(F.concat(F.lit("dev-"), n))

    owner = lambda n: F.concat(F.lit("Owner "), n)
    address = lambda salt, *cols: F.concat_ws(".", *(F.floor(1 + u(f"{salt}{i}", *cols) * 254).cast("string") for i in range(4)))
    n = F.col("id")
    mule = labelled(n)
    decoy = (n >= first_decoy) & (n < woken)
    age = F.when(n == woken, 900 + u("age", n) * 600).when(mule, 5 + u("age", n) * 60).when(decoy, 900 + u("age", n) * 600).otherwise(200 + u("age", n) * 2000)
    business = F.when(decoy, True).when(mule, False).otherwise(u("kind", n) < 0.25)
    day = lambda days: F.date_format(F.timestamp_micros((F.lit(START + span) - days * 24 * HOUR).cast("long")), "yyyy-MM-dd")
    # one operator's contacts for the same place of about five rings, so that they tie accounts of different devices
    group = F.least(F.floor(ring_of(n) / 5), F.lit(max(n_rings // 5 - 1, 0)))
    fleet = F.when(in_ring(n), F.concat_ws("-", group, n % SIZE)).when(n < first_decoy, "king").otherwise("relay")

    chance = lambda salt, of_mules, of_others: u(salt, n) < F.when(mule, of_mules).otherwise(of_others)

    def between(salt: str, of_mules: tuple, of_others: tuple) -> Column:
        (a, b), (c, d) = of_mules, of_others
        return F.when(mule, a + (b - a) * u(salt, n)).otherwise(c + (d - c) * u(salt, n))

    def count(salt: str, of_mules: tuple, of_others: tuple) -> Column:
        """Whole numbers, both ends included."""
        return F.floor(between(salt, (of_mules[0], of_mules[1] + 1), (of_others[0], of_others[1] + 1))).cast("int")

    share = lambda *args: F.round(between(*args), 2)
    phone_type = pick("device type", ("phone", "phone", "tablet", "desktop"), n)
    from_abroad = F.when(mule, pick("ip country", ABROAD, n)).when(u("travel", n) < 0.9, country(n)).otherwise(pick("ip country", HOMES, n))
    accounts = spark.range(n_accounts).select(
        "id",
        _name(n).alias("account_id"),
        owner(n).alias("owner_name"),
        F.when(business, "business").otherwise("personal").alias("account_type"),
        country(n).alias("country"),
        F.concat(F.lit("City "), F.floor(u("city", n) * 50)).alias("city"),
        F.concat(F.floor(1 + u("house", n) * 200), F.lit(" Street "), F.floor(u("street", n) * 300)).alias("address"),
        F.concat(F.lit("ID"), F.floor(u("national", n) * 1_000_000), F.lit("***")).alias("national_id"),
        day(365 * between("born", (19, 30), (19, 75))).alias("date_of_birth"),
        F.when(mule & (u("alias", n) < 0.25), F.array(F.concat(F.lit("Alias "), n))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        day(age).alias("opened_at"),
        F.when(mule, pick("kyc", ("high", "high", "medium"), n)).when(business, "low").otherwise(pick("kyc", ("low", "low", "low", "medium"), n)).alias("kyc_risk"),
        F.when(mule, pick("verify", ("unverified", "unverified", "basic", "basic", "full"), n)).when(u("verify", n) < 0.03, "unverified").when(u("verify", n) < 0.2, "basic").otherwise("full").alias("verification_level"),
        F.when(~business, pick("job", ("clerk", "nurse", "student", "driver", "engineer"), n)).alias("occupation"),
        F.when(business, pick("trade", ("retail", "catering", "building", "consulting"), n)).alias("business_category"),
        pick("purpose", ("salary", "savings", "trade"), n).alias("account_purpose"),
        chance("pep", 0.15, 0.01).alias("pep"),
        (mule & (u("sanctioned", n) < 0.18)).alias("sanctioned"),
        chance("watchlist", 0.3, 0.008).alias("watchlist"),
        chance("media", 0.25, 0.008).alias("adverse_media"),
        F.when(mule, F.floor(3.3 * u("sar", n) * u("sar", n)).cast("int")).otherwise((u("sar", n) < 0.008).cast("int")).alias("prior_sars"),
        count("failed", (1, 5), (0, 0)).alias("failed_verifications"),
        device(n).alias("device_id"),
        phone_type.alias("device_type"),
        F.when(phone_type == "desktop", pick("os", ("Windows", "macOS", "Linux"), n)).otherwise(pick("os", ("Android", "iOS"), n)).alias("device_os"),
        count("devices", (2, 6), (1, 2)).alias("device_count"),
        chance("emulator", 0.35, 0.0).alias("emulator"),
        chance("rooted", 0.4, 0.02).alias("rooted_jailbroken"),
        address("signup", n).alias("signup_ip"),
        from_abroad.alias("ip_country"),
        F.when(chance("isp", 0.55, 0.03), "hosting").otherwise("access").alias("ip_isp"),
        chance("proxy", 0.5, 0.03).alias("proxy"),
        chance("vpn", 0.55, 0.03).alias("vpn_tor"),
        share("ip risk", (0.55, 0.98), (0.0, 0.3)).alias("ip_risk_score"),
        count("ips", (3, 12), (1, 3)).alias("distinct_ips"),
        count("session", (20, 90), (120, 900)).alias("avg_session_seconds"),
        count("logins", (20, 120), (2, 40)).alias("logins_30d"),
        count("failed logins", (3, 25), (0, 1)).alias("failed_logins_30d"),
        F.when(mule, F.floor(1 + 6 * u("resets", n)).cast("int")).otherwise((u("resets", n) < 0.08).cast("int")).alias("password_resets_30d"),
        share("night", (0.35, 0.85), (0.0, 0.25)).alias("night_activity_ratio"),
        share("automation", (0.45, 0.95), (0.0, 0.25)).alias("automation_score"),
        F.when(mule, F.floor(5 * u("chargebacks", n) * u("chargebacks", n)).cast("int")).otherwise((u("chargebacks", n) < 0.08).cast("int")).alias("chargeback_count"),
        count("disputes", (0, 6), (0, 0)).alias("disputes_count"),
        chance("fraud", 0.3, 0.0).alias("prior_fraud"),
        chance("takeover", 0.22, 0.0).alias("account_takeover"),
        chance("blacklist", 0.25, 0.0).alias("blacklisted"),
        count("linked", (2, 9), (0, 1)).alias("linked_accounts"),
        share("history", (0.5, 0.95), (0.0, 0.3)).alias("historical_risk_score"),
        F.concat(F.when(mule, F.concat(F.lit("operator-"), fleet)).otherwise(F.concat(F.lit("user"), n)), F.lit("@example.org")).alias("email"),
        F.when(mule, F.concat(F.lit("+00 operator "), fleet)).otherwise(F.concat(F.lit("+00 "), n)).alias("phone"),
    )

    # legitimate payments among everybody else
    people = n_accounts - first_legit
    who = lambda salt: F.lit(first_legit) + F.floor(u(salt, "id") * people)
    kind = u("type", "id")
    amount = F.when(kind < 0.3, 900 + 2000 * u("amount", "id")).when(kind < 0.6, 5 + 150 * u("amount", "id")).when(kind < 0.75, 30 + 200 * u("amount", "id")).otherwise(F.exp(3.5 + 1.2 * (u("a", "id") + u("b", "id") + u("c", "id") - 1.5)))
    legit = spark.range(n_legit_tx).select(
        who("src").alias("s"), who("dst").alias("d"), amount.alias("amount"), (F.lit(START) + u("at", "id") * span).cast("long").alias("us"),
        pick("channel", ("sepa", "card", "sepa", "wire"), "id").alias("channel"),
    ).filter("s <> d")

    # rings: five or six transfers, by kind
    step = spark.range(n_rings).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("k"))
    base, form = F.col("r") * SIZE, F.col("r") % 5
    begin = F.lit(START) + u("start", "r") * (span - 80 * HOUR)
    near_line = 9_000 + 900 * u("line", "r", "k")
    spoke = F.when(F.col("k") == 0, F.lit(SIZE - 1)).otherwise(F.col("k"))
    source = F.when(form == 0, base + spoke).when(form == 1, base + F.col("k") % 4).when(form == 2, base + spoke).when(form == 3, base).otherwise(base + F.col("k"))
    target = F.when(form == 0, base).when(form == 1, base + (F.col("k") + 1) % 4).when(form == 2, base).when(form == 3, base + spoke).otherwise(base + F.col("k") + 1)
    value = F.when(form == 0, near_line).when(form == 1, 20_000 * F.pow(F.lit(0.97), "k")).when(form.isin(2, 3), 5_200 + 1_500 * u("fan", "r", "k")).otherwise(30_000 * F.pow(F.lit(0.95), "k"))
    gap = F.when(form == 4, 3).when(form == 1, 5).otherwise(4)
    rings = step.filter(~((form == 1) & (F.col("k") > 3)) & ~((form == 4) & (F.col("k") > 4))).filter(~(form.isin(0, 2, 3) & (F.col("k") == 0) & (F.lit(SIZE) < 3)))
    rings = rings.select(source.alias("s"), target.alias("d"), value.alias("amount"), (begin + F.col("k") * gap * HOUR).cast("long").alias("us"), F.lit("sepa").alias("channel"))

    planted: list[tuple] = []  # (source, target, amount, hours, channel), a fixed number of rows
    king = n_rings * SIZE
    planted += [(king + 1 + i, king, 9_300.0 + 100 * i, 100 + 3 * i, "cash_deposit") for i in range(4)]
    planted += [(king, king + 5, 36_000.0, 115, "wire"), (king + 5, king + 6, 34_500.0, 118, "wire"), (king + 6, king + 7, 33_000.0, 121, "crypto")]
    planted += [(king + 7, king + 1 + i, 6_000.0, 124 + i, "sepa") for i in range(5)]
    planted += [(first_legit, woken, 24_000.0, 400, "wire"), (woken, first_legit + 1, 22_000.0, 406, "wire")]  # wakes up
    someone = lambda i: first_legit + 2 + i % (n_accounts - first_legit - 2)
    for j in range(decoys):
        d, kind = first_decoy + j * DECOY, (j if n_decoys is not None else seed * 31 + j * 17 + seed * j % 5) % DECOY_KINDS
        if kind == 0:
            planted += [(d, someone(8 * j + i), 2_400.0 + i, 200 + 9 * j + i / 10, "sepa") for i in range(8)]
        elif kind == 1:
            planted += [(d + i, d + (i + 1) % 4, 12_000.0, 300 + 9 * j + 6 * i, "wire") for i in range(4)]
        elif kind == 2:
            planted += [(someone(6 * j + i), d, 4_000.0, 420 + 9 * j + i, "card") for i in range(6)]
        else:
            planted += [(d, d + 1, 15_000.0, 150 + 9 * j, "wire"), (d + 1, d + 2, 9_000.0, 250 + 9 * j, "wire"), (d + 1, d + 3, 5_000.0, 260 + 9 * j, "wire")]
    extra = spark.createDataFrame([(a, b, float(v), float(h), c) for a, b, v, h, c in planted], "s long, d long, amount double, h double, channel string")
    extra = extra.select("s", "d", "amount", (F.lit(START) + F.col("h") * HOUR).cast("long").alias("us"), "channel")

    every = legit.unionByName(rings).unionByName(extra).withColumn("amount_c", F.floor(F.col("amount") * 100).cast("long"))
    # the order given is not the order of time
    key = F.xxhash64(F.lit(seed), "s", "d", "us", "amount_c")
    src, dst = F.col("s").cast("long"), F.col("d").cast("long")
    bad = labelled(src) | labelled(dst)
    t = every.withColumn("key", key)
    t = t.withColumn("tx_country", F.when(labelled(src) & (u("elsewhere", "key") < 0.5), pick("where", ABROAD, "key")).otherwise(country(src)))
    card = F.col("channel") == "card"
    t = t.withColumn("tx_type", F.when(card & (u("type", "key") < 0.04), "refund").when(card & (u("type", "key") < 0.055), "chargeback").when(card, "payment").otherwise("transfer"))
    t = t.withColumn("is_international", F.col("tx_country") != country(dst))
    t = t.withColumn("status", F.when(F.col("tx_type").isin("refund", "chargeback"), "reversed").when(bad & (u("fails", "key") < 0.12), pick("how", ("failed", "reversed"), "key")).otherwise("completed"))
    points = lambda test, value: F.when(test, value).otherwise(0)
    risk = points(bad, 35) + points(F.col("amount_c") >= 900_000, 20) + points(F.col("is_international"), 15) + points(F.col("channel").isin("crypto", "cash_deposit"), 15) + points(F.col("status") != "completed", 10)
    tx = t.select(
        F.concat(F.lit("TX_"), F.hex("key")).alias("tx_id"), "us", _name(src).alias("src"), _name(dst).alias("dst"), "amount_c", "channel", "tx_type", "tx_country",
        F.when(card, pick("trade", ("retail", "catering", "building", "consulting"), "key")).alias("merchant_category"),
        device(src).alias("device_id"), address("tx", "key").alias("ip_address"), F.col("tx_country").alias("ip_country"), owner(dst).alias("recipient_name"),
        "is_international", "status",
        F.when(bad, pick("reference", ("transfer", "invoice", "loan", "urgent"), "key")).otherwise(pick("reference", ("salary", "invoice", "rent", "transfer"), "key")).alias("reference"),
        (risk / 100).alias("risk_score"), F.shiftright("key", 2).alias("tx_pos"),
    )

    # labelled accounts declare little and move much; one in eight of the others outgrows what it declared
    moved = every.select(F.explode(F.array("s", "d")).alias("id"), "amount_c").groupBy("id").agg(F.sum("amount_c").alias("moved"))
    actual = F.greatest(F.coalesce("moved", F.lit(0)) / 100, F.lit(500.0))
    declared = F.when(u("outgrown", "id") < 0.12, 0.15 + 0.3 * u("share", "id")).otherwise(0.8 + 0.6 * u("share", "id"))
    expected = F.when(labelled(F.col("id")), 1_000 + 2_000 * u("declared", "id")).otherwise(actual * declared)
    accounts = accounts.join(moved, "id", "left").withColumn("expected_monthly_volume", F.round(expected, 2)).drop("id", "moved")
    members = lambda start, size: F.transform(F.sequence(start, start + size - 1), _name)
    labels = spark.range(n_rings).select(F.format_string("RING_%03d", F.col("id") + 1).alias("ring_id"), F.col("id"))
    patterns = F.element_at(F.array(*(F.array(F.lit(k)) for k in KINDS)), (F.col("id") % 5 + 1).cast("int"))
    size = F.when(F.col("id") % 5 == 1, 4).otherwise(SIZE)
    labels = labels.select("ring_id", members(F.col("id") * SIZE, size).alias("account_ids"), patterns.alias("patterns"))
    top = spark.range(1).select(F.lit("RING_KING").alias("ring_id"), members(F.lit(king).cast("long"), F.lit(KINGPIN)).alias("account_ids"), F.array(*map(F.lit, ("structuring", "layering", "mule_fanout"))).alias("patterns"))
    relay = F.array(*(_name(F.lit(i)) for i in (first_legit, woken, first_legit + 1)))
    last = spark.range(1).select(F.lit("RING_WOKEN").alias("ring_id"), relay.alias("account_ids"), F.array(F.lit("layering")).alias("patterns"))
    labels = labels.unionByName(top).unionByName(last)
    mules = labels.select(F.explode("account_ids").alias("account_id")).distinct()
    return Labelled(of(accounts, tx), mules, labels)
