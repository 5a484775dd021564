"""The five-axis filter: optional equality filters built as columns, never as SQL text."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, functions as F

DIMS = ["region", "location", "practice_area", "industry", "customer"]
# Axes kept by the month-end snapshot table, with its column names.
SNAPSHOT_AXES = {"region": "region", "location": "location", "customer": "customer_name"}


def active_filters(filters: Mapping[str, object] | None, allowed: Collection[str] = tuple(DIMS)) -> dict[str, str]:
    """Known axes with a real value; blank and 'All' mean no filter."""
    out = {}
    for axis, value in (filters or {}).items():
        text = "" if value is None else str(value).strip()
        if axis in allowed and text and text.lower() != "all":
            out[axis] = text
    return out


def axis_filter(df: DataFrame, filters: Mapping[str, object] | None, rename: Mapping[str, str] | None = None,
                allowed: Collection[str] = tuple(DIMS)) -> DataFrame:
    """Apply the active axes that the table has; ``rename`` maps an axis to the table's own column."""
    names = rename or {}
    for axis, value in active_filters(filters, allowed).items():
        column = names.get(axis, axis)
        if column in df.columns:
            df = df.where(F.col(column) == F.lit(value))
    return df


def snapshot_filter(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Filter the snapshot table; with an axis it does not carry, stay firmwide."""
    wanted = active_filters(filters)
    if set(wanted) - set(SNAPSHOT_AXES):
        return df
    return axis_filter(df, wanted, SNAPSHOT_AXES, tuple(SNAPSHOT_AXES))


def slice_of(columns: Mapping[str, Column]) -> tuple[Column, Column]:
    """(axis, value) of the first axis, in the given order, that holds a real value; else firmwide/all."""
    axis, value = None, None
    for name, c in columns.items():
        real = c.isNotNull() & ~F.trim(c).isin("", "All", "all")
        axis = F.when(real, F.lit(name)) if axis is None else axis.when(real, F.lit(name))
        value = F.when(real, c) if value is None else value.when(real, c)
    return axis.otherwise(F.lit("firmwide")), value.otherwise(F.lit("all"))


def compound_key(columns: Mapping[str, Column]) -> Column:
    """Sorted ``axis=value`` parts joined by a pipe; blank and 'All' parts left out."""
    parts = [F.when(c.isNotNull() & ~c.isin("", "All"), F.concat(F.lit(f"{name}="), F.trim(c)))
             for name, c in columns.items()]
    return F.array_join(F.array_sort(F.filter(F.array(*parts), lambda p: p.isNotNull())), "|")
