"""Merging of seeds group by group against one fold of them all."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.plans import rings
from riskloom.scratch import Scratch

SCHEMA = "seed string, detector string, score double, members array<string>"


def drawn(seed, n, accounts, largest):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        members = sorted({f"a{min(r.randrange(accounts), r.randrange(accounts))}" for _ in range(r.randrange(2, largest))})
        if len(members) > 1:
            rows.append((f"s{i:03d}", r.choice(["fan_in", "circular", "structuring"]), r.randrange(30, 100) / 100, members))
    return rows


def clusters(df):
    return sorted((tuple(r["members"]), tuple(r["patterns"])) for r in df.collect())


@pytest.mark.parametrize(("seed", "n", "accounts", "largest", "pairs"), [(1, 60, 80, 5, 48), (2, 120, 300, 6, 48), (3, 120, 300, 6, 2), (4, 40, 30, 4, 3), (5, 200, 900, 9, 48)])
def test_groups_fold_as_one(spark, monkeypatch, seed, n, accounts, largest, pairs):
    monkeypatch.setattr(rings, "PAIRS", pairs)
    rows = drawn(seed, n, accounts, largest)
    found = spark.createDataFrame(rows, SCHEMA)
    whole = rings.merge(pd.DataFrame(rows, columns=["seed", "detector", "score", "members"]))
    want = sorted(zip(map(tuple, whole["members"]), map(tuple, whole["patterns"]), strict=True))
    assert clusters(rings.merged(found, Scratch(spark, "t"))) == want
    home = {r["seed"]: r["root"] for r in rings.apart(found, Scratch(spark, "t")).collect()}
    assert set(home) == {r[0] for r in rows}
    if seed in (2, 5):
        assert len(set(home.values())) > 3


def test_a_long_chain_is_not_one_group(spark):
    """A hundred thousand seeds that share one account with the next."""
    n = 100_000
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    members = F.array(name(F.col("id")), name(F.col("id") + 1), F.concat(F.lit("own"), "id"))
    found = spark.range(n).select(F.concat(F.lit("s"), "id").alias("seed"), F.lit("fan_in").alias("detector"), F.lit(0.5).alias("score"), members.alias("members"))
    began = time.perf_counter()
    home = rings.apart(found, Scratch(spark, "t"))
    assert home.groupBy("root").count().agg(F.max("count")).first()[0] == 1
    assert time.perf_counter() - began < 90


def test_no_seeds(spark):
    assert rings.merged(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
