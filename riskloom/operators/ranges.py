"""Joins on an account and a range of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import HOUR, at_most_one, hours, r2, rounded

DAY = 24 * HOUR
FIAT = ("sepa", "wire", "card", "cash_deposit")


def within(left: DataFrame, right: DataFrame, key: str, at: str, start: str, stop: str, width: int) -> DataFrame:
    """Rows of one key with right.at in [left.start, left.stop]; a range spans ``width`` at most.

    Time is cut in strips of that width; a range meets two. The strip is part of
    the join key, so a busy key is spread over its strips.
    """
    strip = lambda c: F.floor(F.col(c) / width)
    wide = left.withColumn("_strip", F.explode(F.sequence(strip(start), strip(stop))))
    return wide.join(right.withColumn("_strip", strip(at)), [key, "_strip"]).filter(f"{at} between {start} and {stop}").drop("_strip")


def largest_within(into: DataFrame, out: DataFrame, span: int) -> DataFrame:
    """into's rows with out_c, the largest payment that leaves in time for someone else than ``from``.

    Time is cut in strips of ``span``, so the time that a row has is the rest of its
    own strip and the start of the next one. Each gives a row, from running
    maxima in both directions: the largest payment and the largest to someone else.
    When the largest changes hands, what it was stands above all that came before,
    so the second is a running maximum too. An account is split by its strips, and a
    strip costs a sort, however many payments meet in it.
    """
    strip = F.floor(F.col("at") / span)
    none = lambda kind: F.lit(None).cast(kind)
    row = F.struct(*into.columns)
    kind = into.select(row.alias("r")).schema["r"].dataType
    paid = out.select("account_id", F.col("out_us").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("out_c").alias("c"), "to").alias("pay"), none(kind).alias("row"))
    rest = into.select("account_id", F.col("in_us").alias("at"), F.lit(1), none("struct<c: long, to: string>"), row)
    start = into.select("account_id", F.col("in_us") + span, F.lit(2), none("struct<c: long, to: string>"), row)
    points = paid.union(rest).union(start).withColumn("strip", strip)
    for side, at in (("later", F.col("at").desc()), ("earlier", F.col("at"))):
        order = Window.partitionBy("account_id", "strip").orderBy(at, "kind")
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        points = points.withColumn("top", F.max("pay").over(running)).withColumn("was", F.lag("top").over(order))
        other = F.when(F.col("pay.to") != F.col("top.to"), F.col("pay.c")).when(F.col("was.to") != F.col("top.to"), F.col("was.c"))
        points = points.withColumn("other", F.when(F.col("kind") == 0, other)).withColumn("second", F.max("other").over(running))
        points = points.withColumn(side, F.struct("top", "second")).drop("top", "was", "other", "second")
    best = F.when(F.col("kind") == 1, F.col("later")).otherwise(F.col("earlier"))
    rows = points.filter("kind > 0").select("row.*", best.alias("best"))
    return rows.withColumn("out_c", F.when(F.col("best.top.to") != F.col("from"), F.col("best.top.c")).otherwise(F.col("best.second"))).drop("best")


def relays(into: DataFrame, out: DataFrame, least_c: int, ratio: Column, span: int = DAY) -> DataFrame:
    """Each account's first (incoming, outgoing) pair, as given, of money that is passed on in time.

    ratio: a condition on in_c and out_c, in whole numbers, that a larger out_c
    never breaks. So an incoming transfer has a partner if the largest payment
    after it is one, and only each account's first such transfer meets its payments.
    """
    into = into.filter(F.col("amount_c") >= least_c).select(
        F.col("dst").alias("account_id"), F.col("src").alias("from"), F.col("us").alias("in_us"),
        F.col("amount_c").alias("in_c"), F.col("tx_pos").alias("in_pos"), F.col("channel").alias("in_channel"),
    )
    out = out.select(F.col("src").alias("account_id"), F.col("dst").alias("to"), F.col("us").alias("out_us"), F.col("amount_c").alias("out_c"), F.col("tx_pos").alias("out_pos"))
    passed = largest_within(into, out, span).filter(ratio)
    first = passed.groupBy("account_id").agg(F.min(F.struct("in_pos", "in_us", "in_c", "from", "in_channel")).alias("f")).select("account_id", "f.*")
    both = within(first.withColumn("until", F.col("in_us") + span), out, "account_id", "out_us", "in_us", "until", span).filter(ratio & (F.col("from") != F.col("to")))
    pair = both.groupBy("account_id").agg(F.min(F.struct("in_pos", "out_pos", "in_c", "out_c", "in_us", "out_us", "in_channel")).alias("f"))
    return pair.select("account_id", "f.*")


def _relay_rows(found: DataFrame, span: int = DAY) -> DataFrame:
    took = hours(F.col("out_us") - F.col("in_us"))
    complete = at_most_one(F.col("out_c") / F.col("in_c"))
    speed = F.greatest(F.lit(0.0), 1.0 - took / (span / HOUR))
    return found.select(
        "account_id", "in_c", "out_c", "in_channel", rounded(took, 1).alias("hours"), r2(complete).alias("completeness"), r2(speed).alias("speed"),
        r2(at_most_one(0.55 + 0.25 * complete + 0.20 * speed)).alias("score"), F.col("in_us").alias("start_us"), F.col("out_us").alias("end_us"),
    )


def passthrough(tx: DataFrame) -> DataFrame:
    """Money received and, four fifths of it or more, sent on within a day."""
    return _relay_rows(relays(tx, tx, 500_000, F.col("out_c") * 10 >= F.col("in_c") * 8))


def fiat_to_crypto(tx: DataFrame) -> DataFrame:
    """Money received as fiat and, half of it or more, sent on as crypto within a day."""
    fiat, crypto = tx.filter(F.col("channel").isin(*FIAT)), tx.filter("channel = 'crypto'")
    return _relay_rows(relays(fiat, crypto, 500_000, F.col("out_c") * 2 >= F.col("in_c")))


def dormant_reactivation(tx: DataFrame, accounts: DataFrame, min_age: int = 365) -> DataFrame:
    """Relays by accounts opened long before the last transaction."""
    last = tx.agg(F.max("us").alias("ref_us"))
    opened = F.unix_micros(F.try_to_timestamp(F.substring("opened_at", 1, 10), F.lit("yyyy-MM-dd")))
    aged = accounts.join(F.broadcast(last)).select("account_id", F.floor((F.col("ref_us") - opened) / F.lit(DAY)).alias("age")).filter(F.col("age") >= min_age)
    found = relays(tx, tx, 1_000_000, F.col("out_c") * 10 >= F.col("in_c") * 8).join(aged, "account_id")
    took = hours(F.col("out_us") - F.col("in_us"))
    score = 0.55 + 0.25 * F.greatest(F.lit(0.0), 1.0 - took / 24.0) + 0.2 * at_most_one(F.col("age") / 1095.0)
    return found.select(
        "account_id", F.col("age").alias("account_age_days"), "in_c", "out_c", rounded(took, 1).alias("hours"),
        r2(at_most_one(score)).alias("score"), F.col("in_us").alias("start_us"), F.col("out_us").alias("end_us"),
    )
