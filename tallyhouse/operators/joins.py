"""Join shapes that plain equi joins do not cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.periods import month_index
from tallyhouse.functions.stable import bucket
from tallyhouse.operators.windows import number_within

OPEN_END = date(9999, 12, 31)


def rate_calendar(event_days: DataFrame, key: str, day: str, rates: Mapping[str, tuple[DataFrame, str]],
                  starts: str = "effective_date", ends: str = "end_date") -> DataFrame:
    """Rates in force for every (key, day): of each kind the newest start wins, then the later end, then the higher value.

    ``rates`` maps an output column to (rate table, value column). Works on distinct days, not
    on events, so one key can never bring more rows into the range join than there are days in
    the calendar, however many events it has. All kinds share one join and one aggregation.
    """
    days = event_days.select(key, day).distinct()
    spans = None
    for out, (table, value) in rates.items():
        part = table.select(F.col(key).alias("_key"), F.lit(out).alias("_kind"), F.col(starts).alias("_start"),
                            F.coalesce(ends, F.lit(OPEN_END)).alias("_end"), F.col(value).alias("_value"))
        spans = part if spans is None else spans.unionByName(part)
    spans = spans.groupBy("_key", "_kind", "_start", "_end").agg(F.max("_value").alias("_value"))
    hit = days.join(spans, (F.col(key) == F.col("_key")) & F.col(day).between(F.col("_start"), F.col("_end")), "left")
    best = lambda out: F.max(F.when(F.col("_kind") == out, F.struct("_start", "_end", "_value")))
    chosen = hit.groupBy(key, day).agg(*[best(out).alias(out) for out in rates])
    return chosen.select(key, day, *[F.col(out)["_value"].alias(out) for out in rates])


def interval_join(events: DataFrame, key: str, day: str, rates: Mapping[str, tuple[DataFrame, str]],
                  starts: str = "effective_date", ends: str = "end_date") -> DataFrame:
    """Attach to each event the rates in force on its day; null where none is.

    Events meet one row per key, so they are shuffled once, by key, and no day is listed or counted.
    """
    spans = rate_history(key, rates, starts, ends).withColumnRenamed(key, "_key")
    hit = events.join(spans, F.col(key) == F.col("_key"), "left")
    rest = [c for c in events.columns if c not in (key, day)]
    return hit.select(key, day, *rest, *[rate_on(out, day).alias(out) for out in rates])


def rate_history(key: str, rates: Mapping[str, tuple[DataFrame, str]], starts: str = "effective_date", ends: str = "end_date") -> DataFrame:
    """One row per key with the spans of every kind of rate, each an array (see ``rate_on``). A row grows with the history of its key, not with events."""
    spans = None
    for out, (table, value) in rates.items():
        part = table.select(key, F.lit(out).alias("_kind"), F.struct(
            F.col(starts).alias("_start"), F.coalesce(ends, F.lit(OPEN_END)).alias("_end"), F.col(value).alias("_value")).alias("_span"))
        spans = part if spans is None else spans.unionByName(part)
    return spans.groupBy(key).agg(*[F.collect_set(F.when(F.col("_kind") == out, F.col("_span"))).alias(out) for out in rates])


def rate_on(history: str, day: str) -> Column:
    """The value of an array of spans on a day: of those around it the newest start wins, then the later end, then the higher value."""
    return F.array_max(F.filter(history, lambda s: F.col(day).between(s["_start"], s["_end"])))["_value"]


def open_at_month_ends(invoices: DataFrame, first_back: int, last_back: int, as_of: date,
                       issued: str = "invoice_date", paid_on: str = "payment_date",
                       max_age: int | None = None) -> DataFrame:
    """One row per invoice and month-end at which it is open, with its age in days; ``max_age`` leaves out older ones.

    The month-ends an invoice is open at follow from its own dates, so they are generated
    on the row. No inequality join is needed and nothing is shuffled.
    """
    base = as_of.year * 12 + as_of.month
    oldest, newest = base - first_back, base - last_back
    # paid during a month means not open at its end
    last_open = F.when(F.col(paid_on).isNull(), F.lit(newest)).otherwise(month_index(paid_on) - 1)
    first = F.greatest(month_index(issued), F.lit(oldest))
    last = F.least(last_open, F.lit(newest))
    months = F.when(first <= last, F.sequence(first, last))
    exploded = invoices.withColumn("_m", F.explode(months))
    snapshot = F.last_day(F.make_date(((F.col("_m") - 1) / 12).cast("int"), (F.col("_m") - 1) % 12 + 1, F.lit(1)))
    out = (exploded.withColumn("snapshot_date", snapshot).drop("_m")
           .withColumn("days_out", F.datediff("snapshot_date", issued)))
    return out if max_age is None else out.where(F.col("days_out").between(0, max_age))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which null matches null; keeps the left keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def enrich(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, take: Mapping[str, str]) -> DataFrame:
    """Left join that brings renamed columns of one dimension; a dimension may play several roles."""
    slim = dim.select(F.col(dim_key).alias("_dim_key"), *[F.col(src).alias(dst) for dst, src in take.items()])
    return fact.join(slim, F.col(fact_key) == F.col("_dim_key"), "left").drop("_dim_key")


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join with coalesced keys."""
    return left.join(right, list(keys), "full")


def ranked_pool(members: DataFrame, by: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` members of each group, numbered from one."""
    return number_within(members, by, order, "pool_rank").where(F.col("pool_rank") <= size)


def pick_from_pool(rows: DataFrame, pool: DataFrame, by: Sequence[str], id_column: str, size: int,
                   take: Mapping[str, str]) -> DataFrame:
    """Give each row one pool member of its group, chosen by a stable bucket of its id."""
    slim = pool.select(*by, "pool_rank", *[F.col(src).alias(dst) for dst, src in take.items()])
    picked = rows.withColumn("pool_rank", bucket(id_column, size) + F.lit(1))
    return picked.join(slim, [*by, "pool_rank"], "left").drop("pool_rank")


def orphans(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose key is set but has no match."""
    keys = dim.select(F.col(dim_key).alias("_dim_key"))
    return fact.where(F.col(fact_key).isNotNull()).join(keys, F.col(fact_key) == F.col("_dim_key"), "left_anti")


def except_keys(rows: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Drop listed keys and keep rows without a key (a null never matches in an anti join)."""
    return rows.join(excluded.select(key).distinct(), [key], "left_anti")


def join_upper(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Join on names regardless of case."""
    keyed = right.withColumn("_upper", F.upper(right_key)).drop(right_key)
    return left.join(keyed, F.upper(F.col(left_key)) == F.col("_upper"), how).drop("_upper")


def beside(*singles: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side. Every input must be a keyless aggregate, so one row is certain."""
    out = singles[0]
    for other in singles[1:]:
        out = out.join(F.broadcast(other), F.lit(True), "left")
    return out


def with_totals(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a keyless aggregate (exactly one row, hence safe to broadcast) to every row."""
    return rows.join(F.broadcast(one_row), F.lit(True), "left")
