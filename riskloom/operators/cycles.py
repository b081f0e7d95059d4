"""Money that comes back: cycles proved by transactions in order of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import HOUR, at_most_one, hours, r2, rounded
from riskloom.operators.ranges import within
from riskloom.operators.windows import pairs
from riskloom.scratch import Scratch

SPAN = 72 * HOUR
NEVER = -(2**62)


def core(pairs_: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """src, dst of the pairs whose source is paid and whose target pays, found by dropping others again and again.

    A cycle loses nothing by it, so ``rounds`` only bounds the work that is spent on dead ends.
    """
    left = scratch.put(pairs_.select("src", "dst"), "money")
    n = left.count()
    for _ in range(rounds):
        paid, pays = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        kept = scratch.put(left.join(paid, "src", "left_semi").join(pays, "dst", "left_semi").select("src", "dst"), "core")
        scratch.free(left)
        before, n, left = n, kept.count(), kept
        if n == before:
            break
    return left


def ranked(core_: DataFrame, ahead: int, scratch: Scratch) -> DataFrame:
    """account, r, up0, up1 ...: an account's place by number of partners, and the highest place within so many payments from it."""
    ends = core_.select(F.explode(F.array("src", "dst")).alias("account"))
    up = ends.groupBy("account").agg(F.count("*").alias("n")).select("account", F.struct("n", "account").alias("r"))
    up = scratch.put(up.withColumn("up0", F.col("r")), "up")
    for h in range(1, ahead + 1):
        beyond = core_.join(up.select(F.col("account").alias("dst"), F.col(f"up{h - 1}").alias("there")), "dst").groupBy(F.col("src").alias("account")).agg(F.max("there").alias("there"))
        up = scratch.put(up.join(beyond, "account", "left").withColumn(f"up{h}", F.greatest(f"up{h - 1}", "there")).drop("there"), "up")
    return up


def circular(tx: DataFrame, accounts: DataFrame, least_c: int = 100_000, shortest: int = 3, longest: int = 5, span: int = SPAN, money: DataFrame | None = None) -> DataFrame:
    """Cycles of pairs that carry large transfers, proved by one transaction a hop.

    The first hop is its pair's first transaction; every later one is its pair's
    first after the hop before. The whole takes ``span`` at most and returns 0.7 to
    1.25 of what left. Among the proofs of one set of accounts the best score counts, then
    the one that starts earliest. Cycles of established businesses alone are left out.

    Pairs that end nowhere are dropped first. A proof is put together at its peak, the
    account on it with the most partners: the way there from its start and the way back
    are paths that pass lower accounts only, and meet by (peak, start) and time. A way
    there is followed past an account only if a higher one can still be reached. So a hub
    is an end of paths and never inside of one that has no higher peak, and its payers
    are not multiplied by its payees. money: windows.pairs of the transactions, if stored.
    """
    scratch = Scratch(tx.sparkSession, "cycles")
    money = core((pairs(tx) if money is None else money).filter((F.col("max_c") >= least_c) & (F.col("src") != F.col("dst"))), longest, scratch)
    places = ranked(money, longest - 2, scratch)
    order = Window.partitionBy("src", "dst").orderBy("us", "tx_pos")
    hops = tx.select("src", "dst", "us", "tx_pos", "tx_id", "amount_c").join(money, ["src", "dst"])
    # a pair's first transaction after t is the one with before <= t < us
    hops = hops.withColumn("before", F.coalesce(F.lag("us").over(order), F.lit(NEVER))).filter("before < us")
    hops = hops.join(places.select(F.col("account").alias("src"), F.col("r").alias("rs")), "src").join(places.withColumnRenamed("account", "dst").withColumnRenamed("r", "rd"), "dst")
    hops, ups = scratch.put(hops, "hops"), [f"up{h}" for h in range(longest - 1)]
    step = hops.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("us").alias("next_us"), F.col("before").alias("next_before"), F.col("tx_id").alias("next_id"), F.col("amount_c").alias("next_c"), F.col("rd").alias("next_r"), *ups)

    def grown(path: DataFrame) -> DataFrame:
        reach = path.withColumn("from_us", F.col("at_us") + 1).withColumn("until_us", F.col("start_us") + span)
        return within(reach, step, "node", "next_us", "from_us", "until_us", span).filter("next_before <= at_us")

    longer = [F.concat("nodes", F.array("next")).alias("nodes"), F.concat("tx_ids", F.array("next_id")).alias("tx_ids")]
    there = hops.filter(F.col("before") == NEVER).select(
        F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("nodes"), F.array("tx_id").alias("tx_ids"), F.col("us").alias("start_us"), F.col("us").alias("at_us"),
        F.col("amount_c").alias("out_c"), F.col("tx_pos").alias("start_pos"), F.col("rd").alias("r"), F.col("rs").alias("under"), *ups,
    )
    peaks = []
    for hop in range(1, longest):
        # under: the highest account before the last one
        peaks.append(there.filter("r > under").select("start", F.col("node").alias("peak"), "nodes", "tx_ids", "start_us", F.col("at_us").alias("peak_us"), "out_c", "start_pos"))
        if hop == longest - 1:
            break
        onward = there.withColumn("under", F.greatest("r", "under")).filter(F.col(f"up{longest - 1 - hop}") > F.col("under")).select(*[c for c in there.columns if not c.startswith("up")])
        onward = grown(onward).filter(~F.array_contains("nodes", F.col("next")) & (F.col(f"up{longest - 2 - hop}") >= F.col("under")))
        onward = onward.select("start", F.col("next").alias("node"), *longer, "start_us", F.col("next_us").alias("at_us"), "out_c", "start_pos", F.col("next_r").alias("r"), "under", *ups)
        there = scratch.put(onward, f"there{hop + 1}")

    back = hops.filter("rd < rs").select(
        F.col("src").alias("peak"), F.col("rs").alias("top"), F.col("dst").alias("node"), F.array("dst").alias("nodes"), F.array("tx_id").alias("tx_ids"), "before", F.col("us").alias("start_us"), F.col("us").alias("at_us"),
        F.col("amount_c").alias("out_c"), F.col("amount_c").alias("back_c"), F.col("tx_pos").alias("start_pos"),
    )
    ways, found = [], []
    for hop in range(1, longest + 1):
        if hop < longest:
            ways.append(back.select("peak", F.col("node").alias("start"), F.col("nodes").alias("lower"), F.col("tx_ids").alias("later_ids"), "before", F.col("start_us").alias("leave_us"), F.col("at_us").alias("end_us"), "back_c"))
        if hop == longest:
            break
        more = grown(back).filter("(next = peak) or (next_r < top)").filter((F.col("next") == F.col("peak")) | ~F.array_contains("nodes", F.col("next")))
        more = scratch.put(more.select("peak", "top", F.col("next").alias("node"), *longer, "before", "start_us", F.col("next_us").alias("at_us"), "out_c", F.col("next_c").alias("back_c"), "start_pos"), f"back{hop + 1}")
        if hop + 1 >= shortest:  # the peak is the start
            whole = F.concat(F.array("peak"), F.slice("nodes", F.lit(1), F.size("nodes") - 1))
            found.append(more.filter((F.col("node") == F.col("peak")) & (F.col("before") == NEVER)).select(whole.alias("nodes"), "tx_ids", F.size("nodes").cast("long").alias("length"), "start_us", F.col("at_us").alias("end_us"), "out_c", "back_c", "start_pos"))
        back = more.filter("node <> peak")
    first, rest = reduce(DataFrame.unionByName, peaks), reduce(DataFrame.unionByName, ways)
    met = first.join(rest, ["peak", "start"]).filter(f"peak_us >= before and peak_us < leave_us and end_us <= start_us + {span}")
    length = F.size("nodes") + F.size("lower") - 1
    met = met.filter(length.between(shortest, longest) & (F.size(F.array_intersect("nodes", "lower")) == 1))
    whole = F.concat("nodes", F.slice("lower", F.lit(1), F.size("lower") - 1))
    found.append(met.select(whole.alias("nodes"), F.concat("tx_ids", "later_ids").alias("tx_ids"), length.cast("long").alias("length"), "start_us", "end_us", "out_c", "back_c", "start_pos"))
    proofs = reduce(DataFrame.unionByName, found)
    proofs = proofs.filter("back_c * 10 >= out_c * 7 and back_c * 4 <= out_c * 5")
    retention = F.col("back_c") / F.col("out_c")
    took = hours(F.col("end_us") - F.col("start_us"))
    proofs = proofs.withColumn("score", r2(at_most_one(0.5 * retention + 0.5 * (1.0 - at_most_one(took / (span / HOUR))))))
    proofs = proofs.withColumn("members", F.array_sort("nodes"))
    best = proofs.groupBy("members").agg(F.min(F.struct((-F.col("score")).alias("s"), "start_us", "start_pos", "nodes", "tx_ids", "length", "end_us", "out_c", "back_c", "score")).alias("b"))
    best = best.select("members", "b.nodes", "b.tx_ids", "b.length", "b.score", "b.start_us", "b.end_us", "b.out_c", "b.back_c")
    legit = accounts.filter("account_type = 'business' and kyc_risk = 'low'").select(F.col("account_id").alias("member"))
    # only cycles with a member that isn't such a business
    other = best.select("members", F.explode("members").alias("member")).join(legit, "member", "left_anti").select("members").distinct()
    out = best.join(other, "members", "left_semi")
    return out.select(
        "members", "nodes", "tx_ids", "length", r2(F.col("back_c") / F.col("out_c")).alias("retention"),
        rounded(hours(F.col("end_us") - F.col("start_us")), 1).alias("hours"), "score", "start_us", "end_us",
    )
