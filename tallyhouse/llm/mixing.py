"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent and normalised, is its weight: 1 keeps the
shares, 0 makes all sources equal. The weights' entropy falls and the largest number of repetitions
falls as the exponent grows from 0 to 1, so the exponent is bisected: to the largest at which the
entropy still reaches a target, and to the smallest at which no source is repeated more often than a
limit. If both are given, the limit goes first. Sources stay in a table all along; each job evaluates
the exponents that several halvings could visit, and only their sums come back.

The weights are realised within a token budget. A source's documents are laid out in permutations
(blocks) ordered by a hash of the id and the block's number. A source with budget b has whole blocks
while they fit; the last block is its permutation's beginning, up to the document in which the budget
ends, that one left out if less than half of it fits. Without a budget, the budget is the least at
which every document is used at least once. The same order mixes the sources: ``place`` is a
document's position on its source's axis from 0 to about 1 (by hash, so the last block of a source of few
documents may end a little before or after 1); sorting by it interleaves all sources evenly.

Running sums are taken in two steps (slices of the hash range, then within a slice), so a source with
most of the rows is spread over many tasks. The permutation uses no other source of chance.

Defined results: a null source is a source of its own, written as null. Null and empty texts have no
tokens: they take part at their place and cost nothing. If no text has a token, weights are the
sources' shares of rows and every document is used once. Repeated rows are documents of their own.
An empty table gives no rows. Extra columns pass through; ``block``, ``place``, ``weight`` and
``tokens`` replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import cut, whole

HALVINGS_A_JOB, JOBS = 4, 8
#: running sums are taken over slices of the hash range, 16 to this power of them
SLICE_DIGITS = 3
#: a table of at most so many sources is broadcast
DIMENSION = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs, share), pre-aggregated where the rows are read."""
    totals = cut(rows.groupBy("_source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    all_ = totals.agg(F.sum("tokens").alias("t"), F.sum("docs").alias("d")).first()
    share = F.col("tokens") / F.lit(float(all_.t)) if all_.t else F.col("docs") / F.lit(float(all_.d or 1))
    return totals.withColumn("share", share)


def _measures(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """Entropy and largest repetition at each exponent."""
    used = totals.where(F.col("share") > 0)
    power = lambda e: F.pow(F.col("share"), F.lit(e))
    got = used.agg(*[f for i, e in enumerate(exponents) for f in (
        F.sum(power(e)).alias(f"z{i}"), F.sum(power(e) * F.lit(e) * F.log("share")).alias(f"l{i}"),
        F.max(power(e) / F.col("share")).alias(f"most{i}"), F.min(power(e) / F.col("share")).alias(f"least{i}"))], F.sum("tokens").alias("tokens")).first()
    out = []
    for i in range(len(exponents)):
        z, least = got[f"z{i}"], got[f"least{i}"]
        # repetitions of a source are weight x budget / its tokens; the least budget brings the least repeated source to 1
        per = (budget / float(got["tokens"]) / z) if budget is not None and got["tokens"] else 1 / least
        out.append((math.log(z) - got[f"l{i}"] / z, got[f"most{i}"] * per))
    return out


def _bisect(totals: DataFrame, low: float, high: float, low_side, budget: float | None) -> tuple[float, float]:
    """Halve [low, high] keeping ``low_side`` true at low and false at high."""
    for _ in range(JOBS):
        steps = 1 << HALVINGS_A_JOB
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        seen = _measures(totals, grid[1:-1], budget)
        a, b = 0, steps
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if low_side(seen[mid - 1]) else (a, mid)
        low, high = grid[a], grid[b]
    return low, high


def find_exponent(totals: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1]; ``entropy`` is a share of the largest possible."""
    n = totals.where(F.col("share") > 0).count()
    if n < 2:
        return 1.0
    e0, e1 = _measures(totals, [0.0, 1.0], budget)
    exponent = 1.0
    if entropy is not None:
        target = entropy * math.log(n)
        exponent = 1.0 if e1[0] >= target else 0.0 if e0[0] <= target else _bisect(totals, 0.0, 1.0, lambda m: m[0] >= target, budget)[0]
    if repeats is not None:
        floor = 0.0 if e0[1] <= repeats else 1.0 if e1[1] > repeats else _bisect(totals, 0.0, 1.0, lambda m: m[1] > repeats, budget)[1]
        exponent = max(exponent, floor) if entropy is not None else floor
    return exponent


def with_dimension(rows: DataFrame, dim: DataFrame, key: str, n: int, most: int = DIMENSION) -> DataFrame:
    """Rows with the columns of ``dim`` (n rows, one for each value of ``key``, with its ``share`` of the rows).

    A dimension of at most ``most`` rows is broadcast. Of a larger one, the values with a share of
    1 / ``most`` or more are (there cannot be more than ``most``); the rows of all others are shuffled.
    """
    def joined(r: DataFrame, d: DataFrame) -> DataFrame:
        return r.join(d.withColumnRenamed(key, "_d"), F.col(key).eqNullSafe(F.col("_d"))).drop("_d")

    if n <= most:
        return joined(rows, F.broadcast(dim))
    hot = dim.where(F.col("share") >= 1 / most)
    cold = rows.join(F.broadcast(hot.select(F.col(key).alias("_d"))), F.col(key).eqNullSafe(F.col("_d")), "left_anti")
    return joined(rows, F.broadcast(hot)).unionByName(joined(cold, dim))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None,
        source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each use of a document: all columns with ``tokens``, ``weight``, ``block`` (from 0) and ``place``."""
    given = [c for c in docs.columns if c not in ("tokens", "weight", "block", "place")]
    rows = docs.select(*given, F.regexp_count(whole(text_col), F.lit(WORDS)).cast("bigint").alias("tokens"), F.col(source_col).alias("_source"), F.col(id_col).alias("_id"))
    totals = source_totals(rows)
    exponent = find_exponent(totals, entropy, repeats, budget)
    power = F.when(F.col("share") > 0, F.pow(F.col("share"), F.lit(exponent))).otherwise(0.0)
    z = totals.agg(F.count(F.lit(1)).alias("n"), F.sum(power).alias("z"), F.max(F.when(F.col("share") > 0, F.col("share") / power)).alias("cover"), F.sum("tokens").alias("t")).first()
    # weight x budget = tokens for the source that is repeated least
    spend = float(budget) if budget is not None else (z.cover or 0.0) * (z.z or 0.0) * float(z.t or 0)
    own = F.round(F.col("weight") * F.lit(spend)).cast("bigint")
    least = F.col("all_tokens") if budget is None else F.lit(0)
    weights = totals.select("_source", F.col("tokens").alias("all_tokens"), "share", (power / F.lit(z.z or 1.0)).alias("weight")).withColumn("budget", F.greatest(own, least))
    weights = weights.withColumn("blocks", F.when(F.col("all_tokens") == 0, 1).otherwise(F.ceil(F.col("budget") / F.col("all_tokens"))).cast("int"))
    weights = cut(weights.withColumn("partial", (F.col("all_tokens") > 0) & (F.col("budget") < F.col("blocks") * F.col("all_tokens"))))

    order = lambda block: F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), block.cast("string")).cast("binary"))
    last = F.col("blocks") - 1
    tail = (with_dimension(rows.select("_source", "_id", "tokens"), weights, "_source", z.n).where("partial")
            .select("_source", "tokens", order(last).alias("order"), (F.col("budget") - last * F.col("all_tokens")).alias("left")))
    ends = weights.join(_last_orders(tail).withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")

    used = with_dimension(rows, cut(ends), "_source", z.n).where(F.col("blocks") > 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    used = used.withColumn("_order", order(F.col("block"))).where(~F.col("partial") | (F.col("block") < last) | (F.col("_order") < F.col("stop")))
    within = F.conv(F.substring("_order", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    turns = F.when(F.col("partial"), F.col("budget") / F.col("all_tokens")).otherwise(F.col("blocks").cast("double"))
    return used.select(*given, "tokens", "weight", "block", ((F.col("block") + within) / turns).alias("place"))


def _last_orders(tail: DataFrame) -> DataFrame:
    """(_source, stop): documents of the last block ordered before ``stop`` fit into what is left.

    Sums are taken by slice (the first hex digits of the order), then only within the slice in which the budget ends.
    """
    piece = F.substring("order", 1, SLICE_DIGITS)
    slices = tail.groupBy("_source", piece.alias("slice")).agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
    running = slices.withColumn("before", F.sum("n").over(Window.partitionBy("_source").orderBy("slice")) - F.col("n"))
    edge = running.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n"))).select(
        F.col("_source").alias("_s"), F.col("slice").alias("at"), "before")
    near = tail.join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (piece == F.col("at")))
    middle = F.col("before") + F.sum("tokens").over(Window.partitionBy("_source").orderBy("order")) - F.col("tokens") / 2
    # 'g' follows every hex digit: if all of the slice fits, the next one is where it stops
    return near.select("_source", "at", "order", "left", middle.alias("middle")).groupBy("_source").agg(
        F.coalesce(F.min(F.when(F.col("middle") > F.col("left"), F.col("order"))), F.concat(F.first("at"), F.lit("g"))).alias("stop"))
