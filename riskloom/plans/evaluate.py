"""Measures of risks and rings against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import r3


def evaluate(risk: DataFrame, rings: DataFrame, mules: DataFrame, true_rings: DataFrame, tau: float = 0.5, overlap: float = 0.6, near: float = 0.3) -> DataFrame:
    """One row of measures. mules: account_id; true_rings: ring_id, account_ids.

    Overlaps are counted by joining members on the account, so only rings that
    share one meet.
    """
    flagged = risk.filter(F.col("risk") >= tau).select("account_id", F.lit(1).alias("p")).distinct()
    both = flagged.join(mules.select("account_id", F.lit(1).alias("t")).distinct(), "account_id", "full")
    counts = both.agg(F.count("*").alias("n"), F.count("p").alias("flagged"), F.count("t").alias("true"))
    # every row of the full join is flagged, true or both
    counts = counts.select((F.col("flagged") + F.col("true") - F.col("n")).alias("tp"), (F.col("n") - F.col("true")).alias("fp"), (F.col("n") - F.col("flagged")).alias("fn"))
    # a ring's size is counted before its members are dealt to rows: beside the explode it would be once for every member
    held = lambda r, n: r.select(F.col("ring_id").alias(n), F.array_distinct("account_ids").alias("members"), F.size(F.array_distinct("account_ids")).alias(f"{n}_size"))
    flat = lambda r, n: held(r, n).select(n, F.explode("members").alias("a"), f"{n}_size")
    shared = flat(rings, "d").join(flat(true_rings, "t"), "a").groupBy("d", "t", "d_size", "t_size").agg(F.count("*").alias("n"))
    hit = shared.agg(
        F.count_distinct(F.when(F.col("n") / F.col("t_size") >= overlap, F.col("t"))).alias("rings_matched"),
        F.count_distinct(F.when(F.col("n") / F.col("d_size") >= near, F.col("d"))).alias("rings_near"),
    )
    size = lambda r, n: r.agg(F.count("*").alias(n))
    row = counts.crossJoin(hit).crossJoin(size(true_rings, "rings_true")).crossJoin(size(rings, "rings_detected"))  # one row each
    row = row.withColumn("false_positive_rings", F.col("rings_detected") - F.col("rings_near")).drop("rings_near")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    row = row.withColumn("precision", share(c("tp"), c("tp") + c("fp"))).withColumn("recall", share(c("tp"), c("tp") + c("fn")))
    row = row.withColumn("f1", share(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    row = row.withColumn("ring_recall", share(c("rings_matched"), c("rings_true"))).withColumn("false_positive_rate", share(c("false_positive_rings"), c("rings_detected")))
    return row.withColumns({n: r3(c(n)) for n in ("precision", "recall", "f1", "ring_recall", "false_positive_rate")})


def report(row) -> str:
    """The measures as text."""
    return (
        f"Accounts: precision {row['precision']:.3f}, recall {row['recall']:.3f}, f1 {row['f1']:.3f} (tp {row['tp']}, fp {row['fp']}, fn {row['fn']})\n"
        f"Rings: recall {row['ring_recall']:.3f} ({row['rings_matched']}/{row['rings_true']} found)\n"
        f"Detected: {row['rings_detected']} rings, {row['false_positive_rings']} false positive (rate {row['false_positive_rate']:.3f})"
    )
