"""Exact deduplication by heavy-hitter split.

A Misra-Gries sketch over 64-bit keys of the digests finds the frequent ones. Their winners are then
counted exactly, and as there are at most ``winners`` of them, broadcast: every losing copy of a
frequent text is decided where it is read. All other rows, whose groups the sketch bounds to a small
share of the table, are shuffled by digest.

Defined results: a null text is the empty text, and all empty texts are one group. Of equal texts the
one with the most code points stays, then the smallest id (a null id after all others), then the
smallest text key; of identical repeated rows exactly one stays. An empty table gives an empty
result. Extra columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import BLANKS, whole

#: items a sketch tracks: a group that it misses is smaller than this share of the rows
TRACKED = 16384
#: at most so many frequent digests are broadcast
WINNERS = 1024
#: a text with fewer copies than this is not worth a broadcast row
FREQUENT = 32
#: sketches are merged in so many tasks; their leading counts are then added
MERGES = 64


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``text_sha256`` of the text without blanks, its 64-bit key, the length and a key of the text as it is."""
    text = whole(text_col)
    return docs.withColumn("text_sha256", F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)).withColumns({
        "_key": F.xxhash64("text_sha256"), "_length": F.char_length(text), "_text_key": F.xxhash64(text)})


def frequent_keys(keys: DataFrame, tracked: int = TRACKED, most: int = WINNERS, least: int = FREQUENT) -> DataFrame:
    """At most ``most`` values of ``_key`` that a Misra-Gries sketch finds at least ``least`` times."""
    parts = keys.groupBy((F.spark_partition_id() % MERGES).alias("_part")).agg(F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("sketch"))
    tops = parts.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("top"))
    counts = tops.groupBy(F.col("top.item").alias("_key")).agg(F.sum("top.count").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "_key").limit(most).select("_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``."""
    given = [c for c in docs.columns if c not in ("text_sha256", "keep_id", "group_size", "kept")]
    rows = with_digest(docs.select(given), text_col)
    order = F.struct((-F.col("_length")).alias("l"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_text_key").alias("t"))

    top = frequent_keys(rows.select("_key"))
    best = (rows.join(F.broadcast(top), "_key", "left_semi")
            .groupBy("text_sha256").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_size")))
    marked = rows.join(F.broadcast(best), "text_sha256", "left").withColumn("_order", order)

    loses = F.col("_best").isNotNull() & ~F.col("_best").eqNullSafe(F.col("_order"))
    out = [*given, "text_sha256"]
    lost = marked.where(loses).select(*out, F.col("_best.i").alias("keep_id"), F.col("_size").alias("group_size"), F.lit(False).alias("kept"))
    by = Window.partitionBy("text_sha256")
    ranked = marked.where(~loses).withColumns({
        "_rank": F.row_number().over(by.orderBy("_order")),
        "keep_id": F.first(id_col).over(by.orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "group_size": F.coalesce(F.col("_size"), F.count(F.lit(1)).over(by))})
    return lost.unionByName(ranked.select(*out, "keep_id", "group_size", (F.col("_rank") == 1).alias("kept")))
