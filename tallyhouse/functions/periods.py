"""Fiscal periods, all measured from the data's own as-of date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def month_start(c: Column | str) -> Column:
    return F.trunc(c, "MM")


def month_index(c: Column | str) -> Column:
    """Months since year 0: equal steps, so a RANGE frame can mean calendar months."""
    col = F.col(c) if isinstance(c, str) else c
    return F.year(col) * F.lit(12) + F.month(col)


def days_in_month(c: Column | str) -> Column:
    return F.dayofmonth(F.last_day(c))


def fiscal_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _shift_month(first: date, n: int) -> date:
    index = first.year * 12 + first.month - 1 + n
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class Periods:
    """Literal period bounds. Literals (not columns) let the scan prune files and partitions."""

    as_of: date

    def month(self, back: int) -> date:
        """First day of the month ``back`` months before the as-of month; 1 is the last complete month."""
        return _shift_month(self.as_of.replace(day=1), -back)

    def days_ago(self, n: int) -> date:
        return self.as_of - timedelta(days=n)

    def month_end(self, back: int) -> date:
        return self.month(back - 1) - timedelta(days=1)

    def quarter(self, back: int) -> date:
        """First day of the quarter ``back`` quarters before the as-of quarter."""
        first = self.as_of.replace(month=(self.as_of.month - 1) // 3 * 3 + 1, day=1)
        return _shift_month(first, -3 * back)

    def year_start(self) -> date:
        return self.as_of.replace(month=1, day=1)

    def in_month(self, c: str, back: int) -> Column:
        return self.between_months(c, back, back - 1)

    def between_months(self, c: str, first_back: int, end_back: int) -> Column:
        """``c`` in the half-open span of whole months."""
        return (F.col(c) >= F.lit(self.month(first_back))) & (F.col(c) < F.lit(self.month(end_back)))

    def last_quarter(self, c: str) -> Column:
        return (F.col(c) >= F.lit(self.quarter(1))) & (F.col(c) < F.lit(self.quarter(0)))

    def trailing_days(self, c: str, n: int) -> Column:
        """The n days up to the as-of date; a row dated after it is in no trailing figure."""
        return F.col(c).between(F.lit(self.days_ago(n)), F.lit(self.as_of))

    def since_days(self, c: str, n: int) -> Column:
        """From n days ago on, without an end: for planned dates, which may lie ahead."""
        return F.col(c) >= F.lit(self.days_ago(n))

    def prior_days(self, c: str, newer: int, older: int) -> Column:
        return F.col(c).between(F.lit(self.days_ago(older)), F.lit(self.days_ago(newer)))


def as_of_date(*facts: tuple[DataFrame, str]) -> date:
    """The newest date in any of the facts ``(table, date column)``; one value from one job, so it is safe to bring to the driver."""
    newest = None
    for df, column in facts:
        one = df.agg(F.max(F.col(column).cast("date")).alias("d"))
        newest = one if newest is None else newest.unionByName(one)
    return newest.agg(F.max("d").alias("d")).first()["d"]


def month_spine(df: DataFrame, date_column: str) -> DataFrame:
    """Every month between the first and the last date of a table, gaps included."""
    bounds = df.agg(F.min(month_start(date_column)).alias("lo"), F.max(month_start(date_column)).alias("hi"))
    month = F.explode(F.expr("sequence(lo, hi, interval 1 month)"))
    return bounds.select(month.alias("month_start")).withColumn("month_end", F.last_day("month_start"))
