"""Small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def rounded(x: Column, digits: int) -> Column:
    """Half up by floor: the same bits in every engine, unlike decimal rounding."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r2(x: Column) -> Column:
    return rounded(x, 2)


def r3(x: Column) -> Column:
    return rounded(x, 3)


def hours(us: Column) -> Column:
    return us / F.lit(float(HOUR))


def at_most_one(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def legit_profile(kind: Column, kyc: Column) -> Column:
    """An established business with low risk; false where unknown."""
    return F.coalesce((kind == "business") & (kyc == "low"), F.lit(False))
