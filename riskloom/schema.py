"""The data model: accounts, transactions and outputs, and projections onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name, type, default of each account column.
ACCOUNT = [
    ("account_id", "string", None), ("owner_name", "string", None), ("account_type", "string", None),
    ("country", "string", None), ("opened_at", "string", None), ("kyc_risk", "string", None), ("status", "string", "active"),
    ("pep", "boolean", False), ("sanctioned", "boolean", False), ("watchlist", "boolean", False), ("prior_sars", "int", 0),
    ("occupation", "string", None), ("business_category", "string", None), ("expected_monthly_volume", "double", None),
    ("account_purpose", "string", None), ("device_id", "string", None), ("signup_ip", "string", None), ("vpn_tor", "boolean", False),
    ("failed_verifications", "int", 0), ("adverse_media", "boolean", False), ("nominee_owner", "boolean", False),
    ("email", "string", None), ("phone", "string", None), ("chargeback_count", "int", 0), ("date_of_birth", "string", None),
    ("address", "string", None), ("city", "string", None), ("national_id", "string", None), ("verification_level", "string", None),
    ("aliases", "array<string>", ()), ("device_os", "string", None), ("device_type", "string", None), ("device_count", "int", 1),
    ("emulator", "boolean", False), ("rooted_jailbroken", "boolean", False), ("ip_country", "string", None), ("ip_isp", "string", None),
    ("proxy", "boolean", False), ("ip_risk_score", "double", 0.0), ("distinct_ips", "int", 1), ("avg_session_seconds", "int", None),
    ("logins_30d", "int", 0), ("failed_logins_30d", "int", 0), ("password_resets_30d", "int", 0), ("night_activity_ratio", "double", 0.0),
    ("automation_score", "double", 0.0), ("prior_fraud", "boolean", False), ("account_takeover", "boolean", False),
    ("disputes_count", "int", 0), ("blacklisted", "boolean", False), ("linked_accounts", "int", 0), ("historical_risk_score", "double", 0.0),
]
#: Of each transaction column; amount_c is the amount in cents, us the time in microseconds, tx_pos the order given.
TRANSACTION = [
    ("tx_id", "string", None), ("us", "long", None), ("src", "string", None), ("dst", "string", None), ("amount_c", "long", 0),
    ("currency", "string", "EUR"), ("channel", "string", None), ("tx_type", "string", "transfer"), ("merchant_category", "string", None),
    ("tx_country", "string", None), ("device_id", "string", None), ("ip_address", "string", None), ("ip_country", "string", None),
    ("status", "string", None), ("recipient_name", "string", None), ("reference", "string", None), ("is_international", "boolean", False),
    ("risk_score", "double", 0.0), ("tx_pos", "long", None),
]


def conform(df: DataFrame, model: list[tuple]) -> DataFrame:
    """df with the model's columns and types; nulls and missing columns take the default."""

    def column(name: str, kind: str, default):
        value = F.array().cast(kind) if default == () else F.lit(default).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value).alias(name)

    return df.select(*(column(*c) for c in model))
