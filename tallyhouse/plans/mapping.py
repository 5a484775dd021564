"""Matching required columns to source columns, decisions on them, and the views compiled from the decisions.

Matching scores every pair. Both sides are packed into blocks of rows where they lie, block meets block
in one join, and each meeting hands on only the k best of its targets; lists are merged by rank.
Neither side is counted, collected or read twice, and a block meeting has a fixed size.

Decisions and reviews are tables. A view is compiled from the rows of one required table: what is
resolved is read from its source, everything else is a null of the declared type, and the gate
names each open column with the reason.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.money import ratio

NAME_WEIGHT = 0.4
#: rows of one side that are scored together
BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def name_similarity(a: Column, b: Column) -> Column:
    """One for the same name, else shared words over all words of the two names."""
    x, y = F.split(F.lower(a), "_"), F.split(F.lower(b), "_")
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(ratio(shared, every))


def _pack(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, vector) rows -> one row of lists for each block; rows are in the order of their keys."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            part = part.take(pc.sort_indices(part.column(0)))
            one = lambda values, offsets=None: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            vectors = part.column(2)
            yield pa.RecordBatch.from_arrays([one(part.column(0)), one(part.column(1)), one(vectors.flatten().cast(pa.float64())), one(pa.array(pc.fill_null(pc.list_value_length(vectors), 0)))],
                                             ["keys", "names", "values", "widths"])


def blocks(side: DataFrame, key: str, prefix: str, rows: int) -> DataFrame:
    """One side packed where it lies: lists of keys, names, vector values and vector lengths."""
    kind = side.schema[key].dataType.simpleString()
    packed = side.select(key, F.col("name"), F.col("vector")).mapInArrow(lambda b: _pack(rows, b), f"keys array<{kind}>, names array<string>, values array<double>, widths array<int>")
    return packed.select(*[F.col(c).alias(prefix + c) for c in packed.columns])


def _unit_rows(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Vectors of length one, row by row; a null or zero vector is zero, shorter ones are filled up with zeros."""
    m = np.zeros((len(widths), int(widths.max(initial=0))))
    m[np.arange(m.shape[1]) < widths[:, None]] = values
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-9, None)


def _name_scores(names: list[str | None], others: list[str | None]) -> np.ndarray:
    """Similarity of every name with every other name, through the words that they share."""
    lowered = [(n or "").lower() for n in others]
    words = [set(n.split("_")) for n in lowered]
    holders: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for x in w:
            holders.setdefault(x, []).append(i)
    sizes = np.array([len(w) for w in words], dtype="float64")
    out = np.zeros((len(names), len(others)))
    lowered = np.array(lowered, dtype=object)
    for r, n in enumerate(names):
        n = (n or "").lower()
        mine = set(n.split("_"))
        for x in mine:
            out[r, holders.get(x, [])] += 1
        out[r] /= len(mine) + sizes - out[r]
        out[r, lowered == n] = 1.0
    return out


def _score(k: int | None, weight: float, names: list[str], types: list[pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks a row -> every pair, or the k best candidates of each target."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda c: batch.column(c)[i].values
            unit = {p: _unit_rows(cell(f"{p}_values").to_numpy(), cell(f"{p}_widths").to_numpy()) for p in "tc"}
            width = max(u.shape[1] for u in unit.values())
            t, c = (np.pad(unit[p], ((0, 0), (0, width - unit[p].shape[1]))) for p in "tc")
            cosines = t @ c.T
            alike = _name_scores(cell("t_names").to_pylist(), cell("c_names").to_pylist())
            blended = cosines + weight * alike
            # keys are in order, so a stable sort leaves the smaller key first among equals
            best = np.argsort(-blended, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(best)), best.shape[1])
            best = best.ravel()
            yield pa.RecordBatch.from_arrays([cell("t_keys").take(pa.array(rows)).cast(types[0]), cell("c_keys").take(pa.array(best)).cast(types[1]),
                                              *(pa.array(m[rows, best]) for m in (cosines, alike, blended))], names)


def pair_scores(targets: DataFrame, candidates: DataFrame, k: int | None = None, weight: float = NAME_WEIGHT, block: int = BLOCK) -> DataFrame:
    """(target, candidate, score, similarity, blended) of every pair of ``(target, name, vector)`` and ``(candidate, name, vector)``;
    with ``k``, of each two blocks only the k best candidates of each target."""
    t, c = blocks(targets, "target", "t_", block), blocks(candidates, "candidate", "c_", block)
    fields = {f.name: f.dataType.simpleString() for f in (*targets.schema.fields, *candidates.schema.fields)}
    names = ["target", "candidate", "score", "similarity", "blended"]
    schema = f"target {fields['target']}, candidate {fields['candidate']}, score double, similarity double, blended double"
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(targets.schema["target"].dataType), to_arrow_type(candidates.schema["candidate"].dataType)]
    return c.crossJoin(t).mapInArrow(lambda b: _score(k, weight, names, types, b), schema)


def best_candidates(targets: DataFrame, candidates: DataFrame, k: int = 5, weight: float = NAME_WEIGHT, block: int = BLOCK) -> DataFrame:
    """For each target the k best candidates by cosine plus weighted name similarity, ranked; ties go to the smaller candidate."""
    found = pair_scores(targets, candidates, k, weight, block)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.col("blended").desc(), "candidate"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "candidate", "score", "blended", "rank")


CONFIDENCE = ("low", "medium", "high")
MAPPED, REVIEWED = "mapped", "reviewed"


def decide(matches: DataFrame, high: float, medium: float) -> DataFrame:
    """Review state of each target column from its candidates.

    ``matches`` has table_name, target, rank, source_table, source_column and blended. The table's
    main source is the source table of its first target.
    """
    best = matches.where(F.col("rank") == 1)
    main = best.groupBy("table_name").agg(F.min_by("source_table", "target").alias("main_source"))
    twins = matches.where(F.col("rank") > 1).select("target", F.col("source_column").alias("_c"), F.col("source_table").alias("_t"))
    ambiguous = best.join(twins, ["target"]).where((F.col("_c") == F.col("source_column")) & (F.col("_t") != F.col("source_table"))).select("target").distinct().withColumn("ambiguous", F.lit(True))
    level = F.when(F.col("blended") >= high, 2).when(F.col("blended") >= medium, 1).otherwise(0)
    d = best.join(main, ["table_name"]).join(ambiguous, ["target"], "left").withColumn("level", level)
    none = F.col("source_column").isNull()
    status = (F.when(none, "no source found").when(F.col("source_table") != F.col("main_source"), "review: different table")
              .when(F.col("ambiguous"), "confirm source").when(F.col("level") < 2, "review: low confidence").otherwise(MAPPED))
    d = d.withColumn("status", status)
    worst = d.groupBy("table_name").agg(F.min("level").alias("table_level"))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col(c) + 1)
    return d.join(worst, ["table_name"]).select("table_name", "target", "main_source", "source_table", "source_column", name("level").alias("confidence"), name("table_level").alias("table_confidence"), "status")


def mapping_rows(required: DataFrame, decisions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row for each required column ``(table_name, target, position, column_name, type)`` with what it is read from.

    ``reviews`` (table_name, target, source_table, source_column, expression) are answers of people: a
    review replaces the decision on its column and closes it, whatever the decision's state. A required
    column without decision or review has no source.
    """
    keys = ["table_name", "target"]
    rows = required.join(decisions.select(*keys, "source_table", "source_column", "status"), keys, "left")
    main = decisions.groupBy("table_name").agg(F.first("main_source", ignorenulls=True).alias("main_source"))
    rows = rows.join(main, ["table_name"], "left").withColumn("expression", F.lit(None).cast("string"))
    if reviews is not None:
        told = reviews.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("source_table", "source_column", "expression")], F.lit(True).alias("_told"))
        rows = rows.join(told, keys, "left")
        pick = lambda c: F.when(F.col("_told"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        rows = rows.select(*keys, "position", "column_name", "type", "main_source", pick("source_table"), pick("source_column"), pick("expression"), F.when(F.col("_told"), REVIEWED).otherwise(F.col("status")).alias("status"))
    return rows.select(*keys, "position", "column_name", "type", "main_source", "source_table", "source_column", "expression", F.coalesce("status", F.lit("no source found")).alias("status"))


def gated(rows: DataFrame, joins: DataFrame) -> DataFrame:
    """The mapping rows with ``reason``: null where the column is resolved, else why it is not.

    ``joins`` (table_name, alias, source_table, on, how) names the sources that a required table may also be read from.
    """
    reach = joins.select("table_name", "source_table").distinct().withColumn("_joined", F.lit(True))
    rows = rows.join(reach, ["table_name", "source_table"], "left")
    none = F.col("source_column").isNull() & F.col("expression").isNull()
    far = F.col("expression").isNull() & (F.col("source_table") != F.col("main_source")) & F.col("_joined").isNull()
    reason = F.when(none, "no source").when(~F.col("status").isin(MAPPED, REVIEWED), F.concat(F.lit("open: "), "status")).when(far, "source is not joined")
    return rows.withColumn("reason", reason).drop("_joined")


def refused(rows: DataFrame, joins: DataFrame) -> DataFrame:
    """Columns that are not resolved, with the reason."""
    return gated(rows, joins).where(F.col("reason").isNotNull()).select("table_name", "column_name", "status", "reason")


def compiled(table, rows: DataFrame, joins: DataFrame, sources: Mapping[str, DataFrame], allow_gaps: bool = False) -> DataFrame:
    """The view of one required table, built from its mapping rows (a row for each of its columns, read while the plan is made).

    Sources go by ``main`` and by the aliases of the joins. Refuses unresolved columns unless gaps are allowed; then they are null.
    """
    columns = gated(rows.where(F.col("table_name") == table), joins).orderBy("position").collect()
    if not columns:
        raise ValueError(f"no mapping for {table}")
    open_ones = [c.column_name for c in columns if c.reason is not None]
    if open_ones and not allow_gaps:
        raise ValueError(f"{len(open_ones)} columns of {table} are not resolved: {', '.join(open_ones)}")
    main = columns[0].main_source
    if main not in sources:
        raise ValueError(f"{table} has no main source")
    df, alias = sources[main].alias("main"), {main: "main"}
    for j in joins.where((F.col("table_name") == table) & (F.col("source_table") != main)).orderBy("alias").collect():
        df = df.join(sources[j.source_table].alias(j.alias), F.expr(j.on), j.how)
        alias[j.source_table] = j.alias

    def read(c) -> Column:
        if c.reason is not None:
            return F.lit(None).cast(c.type)
        return (F.expr(c.expression) if c.expression is not None else F.col(f"{alias[c.source_table]}.{c.source_column}")).try_cast(c.type)

    return df.select(*[read(c).alias(c.column_name) for c in columns])
