"""Aggregations that need more than one groupBy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def pivot_sums(category: Column, members: Mapping[str, str], values: Mapping[str, str], other: str) -> list[Column]:
    """Conditional sums ``{prefix}{name}`` for each member and one for everything else, in one pass."""
    out = []
    for prefix, value in values.items():
        for name, member in members.items():
            out.append(F.sum(F.when(category == member, F.col(value)).otherwise(F.lit(0))).alias(f"{prefix}{name}"))
        rest = ~category.isin(*members.values())
        out.append(F.sum(F.when(rest, F.col(value)).otherwise(F.lit(0))).alias(f"{prefix}{other}"))
    return out


def dominant(df: DataFrame, by: Sequence[str], category: str, weight: str, out: str) -> DataFrame:
    """Category with the largest summed weight in each group; the first name wins a tie."""
    sums = df.groupBy(*by, category).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*by).agg(F.min_by(category, F.struct(-F.col("_w"), F.col(category))).alias(out))


def exact_quantiles(df: DataFrame, value: str, positions: Mapping[str, float], slack: float = 1e-4, cells: int = 1000) -> DataFrame:
    """Interpolated quantiles of any number of rows, exact: one row with a column for each position.

    Sketches whose error is ten times smaller than ``slack`` bracket all positions at once. The counted
    values inside a bracket are spread over ``cells``, and only the cells that hold the two
    neighbours of a position are ranked, on top of exact counts of everything before them.
    """
    qs, n = list(positions.values()), len(positions)
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    at = lambda sign: F.array(*[F.lit(min(max(q + sign * slack, 0.0), 1.0)) for q in qs])
    bracket = v.agg(F.percentile_approx("v", at(-1), F.lit(int(10 / slack))).alias("los"), F.percentile_approx("v", at(1), F.lit(int(10 / slack))).alias("his"))
    tagged = v.join(F.broadcast(bracket), F.lit(True), "inner")
    # an empty table has no bracket and no row below it
    below = tagged.agg(F.array(*[F.count(F.when(F.col("v") < F.col("los")[i], 1)) for i in range(n)]).alias("belows"), F.count("v").alias("n"))
    lo, hi = F.col("b.lo"), F.col("b.hi")
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)) * cells), F.lit(cells - 1)).cast("int")
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col("los")[i].alias("lo"), F.col("his")[i].alias("hi")) for i in range(n)])
    inside = (tagged.select("v", F.explode(F.filter(each, lambda b: F.col("v").between(b["lo"], b["hi"]))).alias("b"))
              .select(F.col("b.i").alias("i"), "v", place.alias("cell")).groupBy("i", "cell", "v").agg(F.count("v").alias("c")))
    # at most ``cells`` rows for each position from here on
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    position = (F.col("n") - 1).cast("double") * F.array(*map(F.lit, qs))[F.col("i")]
    marks = (inside.groupBy("i", "cell").agg(F.sum("c").alias("c")).withColumn("upto", upto).join(F.broadcast(below), F.lit(True), "inner").withColumn("below", F.col("belows")[F.col("i")])
             .select("i", "cell", (F.col("below") + F.col("upto") - F.col("c")).alias("before"), (F.col("below") + F.col("upto")).alias("after"),
                     F.floor(position).alias("low"), F.ceil(position).alias("high"), (position - F.floor(position)).alias("frac")))
    holds = lambda rank: (F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("after"))
    rows = inside.join(F.broadcast(marks.where(holds("low") | holds("high"))), ["i", "cell"])
    last = F.col("before") + F.sum("c").over(Window.partitionBy("i", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("last", last).withColumn("first", F.col("last") - F.col("c"))
    found = lambda rank, i: F.max(F.when((F.col("i") == i) & (F.col(rank) >= F.col("first")) & (F.col(rank) < F.col("last")), F.col("v")))
    ends = placed.agg(*[x for i in range(n) for x in (found("low", i).alias(f"a{i}"), found("high", i).alias(f"b{i}"), F.max(F.when(F.col("i") == i, F.col("frac"))).alias(f"f{i}"))])
    return ends.select(*[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias(name) for i, name in enumerate(positions)])


def exact_quantile(df: DataFrame, value: str, q: float, out: str, slack: float = 1e-4, cells: int = 1000) -> DataFrame:
    """One of them."""
    return exact_quantiles(df, value, {out: q}, slack, cells)


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, distinct_values) of the text columns of the schema, or of those named, from one pass.

    Values are made distinct with their column before and after the shuffle, so a column of unique keys is spread like any other.
    """
    columns = text_columns(df) if columns is None else list(columns)
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    seen = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, v)").distinct()
    # null counts for no value, but a column of nulls only is still told
    return seen.groupBy("column_name").agg(F.count("v").alias("distinct_values"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def median_of_groups(groups: DataFrame, value: str, out: str) -> DataFrame:
    """Median over an already aggregated, small set of groups."""
    return groups.agg(F.percentile(F.col(value).cast("double"), 0.5).alias(out))
