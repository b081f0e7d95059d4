"""A ledger is two DataFrames that follow riskloom.schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ordering import numbered
from riskloom.schema import ACCOUNT, TRANSACTION, conform
from riskloom.scratch import Scratch


@dataclass(frozen=True)
class Ledger:
    accounts: DataFrame
    tx: DataFrame
    #: windows.pairs of the transactions, where they are stored.
    pairs: DataFrame | None = None


def of(accounts: DataFrame, tx: DataFrame) -> Ledger:
    """From frames with ISO times and amounts in euros, or with us and amount_c.

    Without tx_pos, transactions are numbered by time and tx_id, however the files are split.
    """
    if "us" not in tx.columns:
        tx = tx.withColumn("us", F.unix_micros(F.to_timestamp("timestamp")))
    if "amount_c" not in tx.columns:
        tx = tx.withColumn("amount_c", F.round(F.col("amount") * 100).cast("long"))
    if "tx_pos" not in tx.columns:
        tx = numbered(tx, [F.col("us"), F.col("tx_id")], Scratch(tx.sparkSession, "ledger")).withColumn("tx_pos", F.col("place") - 1).drop("place")
    return Ledger(conform(accounts, ACCOUNT), conform(tx, TRANSACTION))


def read_json(spark: SparkSession, path: str) -> Ledger:
    """One document with accounts and transactions; positions are those in its lists."""
    data = spark.read.json(path, multiLine=True)
    accounts = data.select(F.explode("accounts").alias("a")).select("a.*")
    tx = data.select(F.posexplode("transactions").alias("tx_pos", "t")).select("t.*", "tx_pos")
    return of(accounts, tx)


def read_parquet(spark: SparkSession, path: str) -> Ledger:
    return of(spark.read.parquet(f"{path}/accounts"), spark.read.parquet(f"{path}/transactions"))


def read_lines(spark: SparkSession, path: str) -> Ledger:
    """Line-delimited folders as write_json writes them, read by as many tasks as they have splits.

    Rows may have times and amounts as in read_json instead of us and amount_c.
    """
    kinds = lambda columns, more: ", ".join([f"{n} {t}" for n, t, _ in columns] + more)
    accounts = spark.read.schema(kinds(ACCOUNT, [])).json(f"{path}/accounts")
    tx = spark.read.schema(kinds(TRANSACTION, ["timestamp string", "amount double"])).json(f"{path}/transactions")
    tx = tx.withColumn("us", F.coalesce("us", F.unix_micros(F.to_timestamp("timestamp")))).withColumn("amount_c", F.coalesce("amount_c", F.round(F.col("amount") * 100).cast("long")))
    return of(accounts, tx.drop("tx_pos") if tx.filter("tx_pos is null").limit(1).count() else tx)


def write_parquet(ledger: Ledger, path: str) -> None:
    ledger.accounts.write.mode("overwrite").parquet(f"{path}/accounts")
    ledger.tx.write.mode("overwrite").parquet(f"{path}/transactions")


def write_json(ledger: Ledger, path: str) -> None:
    """Line-delimited JSON, a folder for each table."""
    ledger.accounts.write.mode("overwrite").json(f"{path}/accounts")
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ledger.tx.withColumn("timestamp", iso).withColumn("amount", F.col("amount_c") / 100).write.mode("overwrite").json(f"{path}/transactions")


def from_tables(spark: SparkSession, sf_dir: str) -> Ledger:
    """The test tables as a ledger: events are transfers between customers' accounts."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    events = read("events")
    users = events.agg((F.max("user_id") + 1).alias("users"))
    k = F.get_json_object("props", "$.k").cast("long")
    src = F.col("user_id") * 10 + F.col("event_id") % 10
    dst = F.when(k < 10, k * 7).otherwise((F.col("user_id") * 7 + k * 13 + F.col("event_id") % 10) % (F.col("users") * 10))
    channel = F.create_map(*(F.lit(x) for x in ("click", "card", "view", "sepa", "purchase", "wire", "signup", "crypto")))
    country = F.when(F.col("event_id") % 3 == 0, "RU").when(F.col("event_id") % 3 == 2, "GR")
    tx = events.join(F.broadcast(users)).select(  # one row of users
        F.concat(F.lit("T"), "event_id").alias("tx_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.concat(F.lit("A"), src).alias("src"),
        F.concat(F.lit("A"), dst).alias("dst"),
        F.floor(F.col("value") * 20000).cast("long").alias("amount_c"),
        F.coalesce(channel[F.col("event_type")], F.lit("cash_deposit")).alias("channel"),
        country.alias("tx_country"),
        F.col("event_id").alias("tx_pos"),
    )
    return of(_accounts(read("customer")), tx)


def _accounts(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    named = lambda letter, n: F.concat(F.lit(letter), F.floor(k / n))
    home = F.when(every(17), "RU").when(every(19), "AE").otherwise(F.element_at(F.array(*map(F.lit, ("GR", "CY", "DE", "FR"))), (F.col("c_nationkey") % 4 + 1).cast("int")))
    columns: dict[str, Column] = {
        "account_id": F.concat(F.lit("A"), k),
        "owner_name": F.col("c_name"),
        "account_type": F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "business").otherwise("personal"),
        "country": home,
        "opened_at": F.date_add(F.lit("2018-01-01").cast("date"), (k * 37 % 2190).cast("int")).cast("string"),
        "kyc_risk": F.when(F.col("c_acctbal") < 1500, "high").when(F.col("c_acctbal") < 4000, "medium").otherwise("low"),
        "prior_sars": F.when(every(29), k % 4).otherwise(0),
        "business_category": F.when(every(41), "gambling").when(every(43), "crypto_exchange").otherwise("retail"),
        "expected_monthly_volume": F.when(~every(7), (k % 50) * 1000.0),
        "device_id": F.when(k % 20 < 4, named("D", 20)),
        "signup_ip": F.when(k % 15 < 3, named("I", 30)),
        "email": F.when(k % 50 < 3, named("E", 50)),
        "phone": F.when(every(3), "").otherwise(F.concat(F.lit("P"), k)),
        "failed_verifications": k % 6,
        "chargeback_count": F.when(every(31), k % 5).otherwise(0),
        "verification_level": F.when(every(11), "unverified").otherwise("basic"),
        "ip_country": F.when(every(9), "RU").otherwise(home),
        "ip_risk_score": (k % 100) / 100.0,
        "failed_logins_30d": k % 8,
        "automation_score": (k % 60) / 100.0,
        "historical_risk_score": (k % 80) / 100.0,
        "night_activity_ratio": (k % 90) / 100.0,
        "device_count": 1 + k % 3,
        "distinct_ips": 1 + k % 4,
        "disputes_count": k % 3,
        "linked_accounts": k % 2,
    }
    flags = {"pep": 53, "sanctioned": 211, "watchlist": 67, "adverse_media": 71, "nominee_owner": 5, "vpn_tor": 13, "emulator": 37, "rooted_jailbroken": 23, "proxy": 47, "prior_fraud": 97, "account_takeover": 101, "blacklisted": 103}
    columns |= {name: every(n) for name, n in flags.items()}
    return customer.select(*(c.alias(n) for n, c in columns.items()))
