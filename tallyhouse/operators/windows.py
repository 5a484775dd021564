"""Window patterns. Per-group picks filter on row_number, which Spark turns into a
partial group limit before the shuffle, so a hot group sends at most k rows per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.money import ratio
from tallyhouse.functions.periods import month_index


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First k rows of each group; end ``order`` with a unique key."""
    return number_within(df, by, order, "_rn").where(F.col("_rn") <= k).drop("_rn")


def latest_row(df: DataFrame, key: str, modified: str, *tiebreak: Column) -> DataFrame:
    """Newest version of each key."""
    return top_per_group(df, [key], [F.col(modified).desc_nulls_last(), *tiebreak], 1)


def lag_rows(df: DataFrame, by: Sequence[str], order: str, value: str, n: int, out: str) -> DataFrame:
    """Value n rows back. Only for frames already aggregated to one row per period."""
    return df.withColumn(out, F.lag(value, n).over(Window.partitionBy(*by).orderBy(order)))


def lag_months(df: DataFrame, by: Sequence[str], period: str, value: str, n: int, out: str) -> DataFrame:
    """Value n calendar months back, whether or not the months between are there."""
    w = Window.partitionBy(*by).orderBy(month_index(period)).rangeBetween(-n, -n)
    return df.withColumn(out, F.max(value).over(w))


def trailing_mean(df: DataFrame, by: Sequence[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """Mean over the n rows before the current one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn(out, ratio(F.sum(value).over(w), F.count(value).over(w)))


def share_within(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Value over the total of its group, by aggregate and join: a hot group is never pulled into one task."""
    from tallyhouse.operators.joins import null_safe_join

    totals = df.groupBy(*by).agg(F.sum(value).alias("_group_total"))
    return null_safe_join(df, totals, by).withColumn(out, ratio(value, "_group_total")).drop("_group_total")


def share_of_all(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percent of the grand total; the total is one broadcast row, not a window over everything."""
    from tallyhouse.operators.joins import with_totals

    total = df.agg(F.sum(value).alias("_all"))
    return with_totals(df, total).withColumn(out, ratio(value, "_all") * F.lit(100.0)).drop("_all")


def newest_periods(df: DataFrame, period: str, k: int) -> DataFrame:
    """The k newest distinct periods, numbered from one (at most k rows)."""
    newest = df.select(period).distinct().orderBy(F.col(period).desc()).limit(k)
    return newest.withColumn("period_rank", F.row_number().over(Window.orderBy(F.col(period).desc())))
