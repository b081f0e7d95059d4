"""Operators on sliding windows of event time: running sums, no pairs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import HOUR, at_most_one, hours, r2, rounded


def endpoints(tx: DataFrame) -> DataFrame:
    """A row for each transaction and side; a transfer to oneself has two."""
    return tx.withColumn("account_id", F.explode(F.array("src", "dst")))


def pairs(tx: DataFrame) -> DataFrame:
    """Directed pairs with the sum, largest and number of their transfers."""
    return tx.groupBy("src", "dst").agg(F.sum("amount_c").alias("total_c"), F.max("amount_c").alias("max_c"), F.count("*").alias("n"))


def ahead(events: DataFrame, span: int) -> DataFrame:
    """account_id, us, here, n, total_c, end_us: what the window of ``span`` from each time of an account on holds.

    events: account_id, us, amount_c. Time is cut in strips of the span, so a window
    is the rest of its strip and the start of the next one; both come from sums that
    run along a strip. So no window is summed row by row, and a busy account is
    spread over its strips.
    """
    strip = F.floor(F.col("at") / span)
    own = events.select("account_id", F.col("us").alias("at"), "us", "amount_c", F.lit(1).cast("long").alias("one"))
    ends = events.select("account_id", F.col("us") + span, "us", F.lit(0).cast("long"), F.lit(0).cast("long")).distinct()
    points = own.union(ends).withColumn("strip", strip)
    whole = Window.partitionBy("account_id", "strip")
    time = whole.orderBy("at")
    upto, before = time.rangeBetween(Window.unboundedPreceding, 0), time.rangeBetween(Window.unboundedPreceding, -1)
    at_event = F.when(F.col("one") == 1, F.col("at"))
    sums = lambda c: (F.sum(c).over(upto), F.sum(c).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0)))
    (n_upto, n_rest), (c_upto, c_rest) = sums("one"), sums("amount_c")
    starts = F.col("one") == 1
    parts = points.select(
        "account_id", "us", "one", F.when(starts, n_rest).alias("n_rest"), F.when(starts, c_rest).alias("c_rest"), F.when(starts, F.max(at_event).over(whole)).alias("last"),
        F.when(~starts, n_upto).alias("n_next"), F.when(~starts, c_upto).alias("c_next"), F.when(~starts, F.max(at_event).over(upto)).alias("later"),
    )
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    return parts.groupBy("account_id", "us").agg(
        F.sum("one").alias("here"), (F.max("n_rest") + zero("n_next")).alias("n"), (F.max("c_rest") + zero("c_next")).alias("total_c"),
        F.coalesce(F.max("later"), F.max("last")).alias("end_us"),
    )


def structuring(tx: DataFrame, line_c: int = 1_000_000, least: int = 3, span: int = 72 * HOUR) -> DataFrame:
    """First window of many transfers to one account, each just below the line, that together reach it."""
    band = tx.filter((F.col("amount_c") * 10 >= 7 * line_c) & (F.col("amount_c") < line_c))
    found = ahead(band.select(F.col("dst").alias("account_id"), "us", "amount_c"), span).filter((F.col("n") >= least) & (F.col("total_c") >= line_c))
    first = found.groupBy("account_id").agg(F.min(F.struct("us", "n", "total_c", "end_us")).alias("f")).select("account_id", "f.*")
    span_h = hours(F.col("end_us") - F.col("us"))
    close = F.greatest(F.lit(0.0), at_most_one((F.col("total_c") / F.col("n") / float(line_c) - 0.7) / 0.3))
    tight = 1.0 - at_most_one(span_h / (span / HOUR))
    return first.select(
        "account_id", "n", "total_c", r2(close).alias("closeness"), rounded(span_h, 1).alias("span_hours"),
        r2(at_most_one(0.6 + 0.1 * (F.col("n") - least) + 0.18 * close + 0.12 * tight)).alias("score"),
        F.col("us").alias("start_us"), "end_us",
    )


def activity_spike(tx: DataFrame, least: int = 5, quiet: int = 5, value_c: int = 2_000_000, span: int = 24 * HOUR) -> DataFrame:
    """The busiest window of an account that is quiet besides."""
    rows = ahead(endpoints(tx).select("account_id", "us", "amount_c"), span).withColumnRenamed("total_c", "value_c")
    best = rows.groupBy("account_id").agg(F.sum("here").alias("all"), F.max(F.struct("n", (-F.col("us")).alias("m"), "value_c", "end_us")).alias("b")).select("account_id", "all", "b.*")
    best = best.withColumn("outside", F.col("all") - F.col("n"))
    best = best.filter((F.col("all") >= least) & (F.col("n") >= least) & (F.col("outside") <= quiet) & (F.col("value_c") >= value_c))
    burst = F.col("n") / F.greatest(F.lit(1), "outside")
    score = 0.4 + 0.05 * (F.col("n") - least) + 0.2 * at_most_one(burst / 5.0) + 0.2 * at_most_one(F.col("value_c") / 10_000_000.0)
    return best.select(
        "account_id", F.col("n").alias("burst_tx"), F.col("outside").alias("baseline_tx"), F.col("value_c").alias("burst_value_c"),
        r2(at_most_one(score)).alias("score"), (-F.col("m")).alias("start_us"), "end_us",
    )


def round_amounts(tx: DataFrame, step_c: int = 100_000, least: int = 3, keep: int = 10) -> DataFrame:
    """Accounts with a habit of clean amounts, and their first such transactions."""
    rows = endpoints(tx).withColumn("clean", (F.col("amount_c") % step_c == 0) & (F.col("amount_c") >= step_c))
    n = F.count_if("clean")
    counts = rows.groupBy("account_id").agg(n.alias("n"), F.count("*").alias("all")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy("tx_pos"))
    first = rows.filter("clean").withColumn("rank", rank).filter(F.col("rank") <= keep)
    first = first.groupBy("account_id").agg(F.sort_array(F.collect_list(F.struct("tx_pos", "tx_id"))).alias("t"))
    share = F.col("n") / F.col("all")
    return counts.join(first, "account_id").select(
        "account_id", F.col("n").alias("round_tx_count"), r2(share).alias("round_share"), F.col("t.tx_id").alias("tx_ids"),
        r2(at_most_one(0.3 + 0.08 * (F.col("n") - least) + 0.3 * share)).alias("score"),
    )


def busiest_counterparties(events: DataFrame, span: int) -> DataFrame:
    """hub, us, n: the first start of a window with the most distinct counterparties.

    An event counts for the windows that start after its counterparty's event
    before it and reach it. So each is an interval of starts, and the largest
    number of intervals over a point is a running sum of their ends: no window's
    counterparties are gathered.

    Time is cut in strips of the span. Sums run along a strip of a hub, on top of what the
    strips before it leave open, a row a strip. A counterparty's event before is in the same strip,
    or the last one of the strip before, or too long ago to matter. So a busy hub, or a busy pair, is
    spread over its strips.
    """
    strip = lambda at: F.floor(F.col(at) / span)
    cut = events.select("hub", "party", "us").withColumn("strip", strip("us"))
    last = cut.groupBy("hub", "party", (F.col("strip") + 1).alias("strip")).agg(F.max("us").alias("last"))
    before = F.lag("us").over(Window.partitionBy("hub", "party", "strip").orderBy("us"))
    cut = cut.withColumn("before", before).join(last, ["hub", "party", "strip"], "left")
    lo = F.greatest(F.coalesce("before", "last") + 1, F.col("us") - span)  # the greatest skips nulls
    spans = cut.select("hub", "us", lo.alias("lo")).filter("lo <= us")
    edge = lambda at, step, event: F.struct(at.alias("at"), F.lit(step).alias("step"), F.lit(event).alias("event"))
    edges = spans.select("hub", F.explode(F.array(edge(F.col("lo"), 1, False), edge(F.col("us"), 0, True), edge(F.col("us") + 1, -1, False))).alias("e")).select("hub", "e.*")
    edges = edges.groupBy("hub", "at").agg(F.sum("step").alias("step"), F.max("event").alias("event")).withColumn("strip", strip("at"))
    open_ = F.sum("step").over(Window.partitionBy("hub").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    carry = edges.groupBy("hub", "strip").agg(F.sum("step").alias("step")).select("hub", "strip", F.coalesce(open_, F.lit(0)).alias("carry"))
    here = F.sum("step").over(Window.partitionBy("hub", "strip").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    starts = edges.withColumn("here", here).filter("event").join(carry, ["hub", "strip"]).withColumn("n", F.col("here") + F.col("carry"))
    return starts.groupBy("hub").agg(F.max(F.struct("n", (-F.col("at")).alias("m"))).alias("b")).select("hub", (-F.col("b.m")).alias("us"), F.col("b.n").alias("n"))


def hub_factor(kind: Column, kyc: Column) -> Column:
    """Legitimate hubs are established businesses; unknown accounts keep 1."""
    f = F.when(kind == "business", 0.35).otherwise(1.0) * F.when(kyc == "low", 0.5).when(kyc == "high", 1.1).otherwise(1.0)
    return at_most_one(f)


def fan(tx: DataFrame, accounts: DataFrame, inward: bool, least: int = 5, span: int = 48 * HOUR) -> DataFrame:
    """Hubs that many distinct counterparties pay (inward) or are paid by within a window."""
    hub, party = ("dst", "src") if inward else ("src", "dst")
    events = tx.select(F.col(hub).alias("hub"), F.col(party).alias("party"), "us")
    best = busiest_counterparties(events, span).filter(F.col("n") >= least)
    inside = events.join(best.withColumnRenamed("us", "start_us"), "hub").filter((F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("start_us") + span))
    found = inside.groupBy("hub", "n", "start_us").agg(F.array_sort(F.collect_set("party")).alias("counterparties"))
    known = accounts.select(F.col("account_id").alias("hub"), hub_factor(F.col("account_type"), F.col("kyc_risk")).alias("factor"))
    factor = F.coalesce("factor", F.lit(1.0))
    return found.join(known, "hub", "left").select(
        F.col("hub").alias("account_id"), "n", r2(factor).alias("legit_hub_factor"), "counterparties",
        r2(at_most_one(0.4 + 0.05 * F.col("n")) * factor).alias("score"), "start_us",
    )
