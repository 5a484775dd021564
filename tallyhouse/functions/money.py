"""Money stays decimal while it is summed; ratios are doubles; rounding happens in decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

MONEY = "decimal(18,4)"
WIDE_MONEY = "decimal(28,4)"


def money(c: Column | str) -> Column:
    return _col(c).cast(MONEY)


def dbl(c: Column | str) -> Column:
    return _col(c).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division that gives null on a zero or null divisor (plain ``/`` raises under ANSI)."""
    return F.try_divide(dbl(num), dbl(den))


def share_pct(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den) * F.lit(100.0)


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding on the decimal value, so engines agree on ties."""
    return F.round(c.cast("decimal(38,8)"), digits).cast("double")


def rounded_money(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("decimal(38,8)"), digits).cast(MONEY)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    v, w = _col(value), _col(weight)
    return ratio(F.sum(v * w), F.sum(w))


def sum_if(condition: Column, value: Column | str) -> Column:
    """Conditional sum; rows that fail add zero, so a group without a hit gives zero."""
    v = _col(value)
    return F.sum(F.when(condition, v).otherwise(F.lit(0)))


def capped_change_pct(current: Column, base: Column, floor: float = 0, strict: bool = False,
                      low: float = -100, high: float = 500) -> Column:
    """Percent change clamped to [low, high]; null when the base is too small to mean anything."""
    change = rounded(ratio(current - base, base) * F.lit(100.0), 2)
    big_enough = base > F.lit(floor) if strict else base >= F.lit(floor)
    return F.when(big_enough, F.least(F.greatest(change, F.lit(float(low))), F.lit(float(high))))


def present(df: DataFrame) -> DataFrame:
    """Decimals become doubles in what a reader sees."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
