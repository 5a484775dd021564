"""Nearest neighbours by multi-index hashing.

Unit vectors are turned by a learned rotation (principal axes, then iterative quantisation) and coded
by their signs. A code is split into substrings, and every distinct vector is indexed once under each
(substring, value). Two codes within a Hamming radius r differ by at most r // m in one of their m
substrings, so a query that probes all values that near in every substring meets each code within
the radius; a pair is taken up at the first substring where it meets only. What is within the radius
is ranked by the cosine of the original vectors.

The rotation is fitted on a bounded sample (``SAMPLE`` vectors, least by a hash of their id); every
vector is indexed. A query with fewer than ``k`` found is searched again over all codes. Equal
vectors are one entry of the index with their k + 1 smallest ids, and buckets are cut into blocks of
bounded size, so neither a common vector nor a full bucket ends in one task.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component takes no
part, nor does a row without id, nor a vector of another length than the most common one (the
smaller of equally common lengths). Repeated rows count once; two vectors under one id are both
candidates, but never of a query with that id. Ties go to the smaller id. An empty table gives no
rows. Only the id and vector columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import cut

#: vectors that the rotation is fitted on, at most
SAMPLE = 20_000
BITS = 64
WIDTH = 8
RADIUS = 31
#: a block of a bucket holds about so many index entries, and so many queries
ENTRIES, ASKING = 4096, 1024
TURNS = 50

ENTRY = "rep bigint, ids array<bigint>, code binary, vector binary"
MET = "asked bigint, ids array<bigint>, score double"
COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v) that take part."""
    inf = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row for each vector with its k + 1 smallest ids."""
    first = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def rotation(sample: np.ndarray, bits: int = BITS, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code: principal axes, turned until signs fit best."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((unit - mean).T).reshape(unit.shape[1], unit.shape[1])) if len(unit) > 1 else (None, np.eye(unit.shape[1]))
    axes = axes[:, ::-1][:, :min(bits, unit.shape[1])]
    v = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(v.shape[1],) * 2))[0]
    for _ in range(turns):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((unit - mean) @ projection >= 0, axis=1)


def _encode(mean: np.ndarray, projection: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1).astype(np.float64)
        # scaled first, so that very large components do not overflow
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        code = codes(unit, mean, projection)
        ids = batch.column("ids")
        rep = pa.array([i[0].as_py() for i in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([rep, ids, pa.array([c.tobytes() for c in code], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], ["rep", "ids", "code", "vector"])


def near_values(radius: int, width: int = WIDTH) -> list[int]:
    """Masks that turn a substring into each one at most ``radius`` bits away."""
    return [sum(1 << b for b in bits) for n in range(min(radius, width) + 1) for bits in combinations(range(width), n)]


def met_first(a: np.ndarray, b: np.ndarray, j: int, reach: int) -> np.ndarray:
    """Pairs (row of a, row of b) that no earlier substring brings together."""
    new = np.ones((len(a), len(b)), bool)
    for i in range(j):
        new &= COUNT[a[:, i, None] ^ b[None, :, i]] > reach
    return new


def _rank(radius: int, reach: int, k: int, entries: pa.Table, asking: pa.Table) -> pa.Table:
    """For each query of a block, the nearest entries within the radius."""
    types = [pa.int64(), pa.list_(pa.int64()), pa.float64()]
    out: list[list] = [[], [], []]
    if entries.num_rows and asking.num_rows:
        j = entries.column("j")[0].as_py()
        load = lambda t, c, d: np.frombuffer(b"".join(t.column(c).to_pylist()), d).reshape(t.num_rows, -1)
        ec, qc, ev, qv = load(entries, "code", np.uint8), load(asking, "asked_code", np.uint8), load(entries, "vector", np.float64), load(asking, "asked_vector", np.float64)
        rep, ids, asked = entries.column("rep").to_numpy(), entries.column("ids").to_pylist(), asking.column("asked").to_pylist()
        far = np.zeros((len(qc), len(ec)), np.int16)
        for i in range(ec.shape[1]):
            far += COUNT[qc[:, i, None] ^ ec[None, :, i]]
        scale = lambda v: v / np.abs(v).max(axis=1, keepdims=True)
        eu, qu = scale(ev), scale(qv)
        norms = np.sqrt((eu * eu).sum(axis=1)), np.sqrt((qu * qu).sum(axis=1))
        near = np.where((far <= radius) & met_first(qc, ec, j, reach), (qu @ eu.T) / norms[1][:, None] / norms[0][None, :], -np.inf)
        for q, row in enumerate(near):
            hits = np.flatnonzero(row > -np.inf)
            if len(hits) > 4 * (k + 1):
                # equal cosines may differ in the last digits here, so a few more than needed go on
                hits = hits[row[hits] >= np.partition(row[hits], -(k + 1))[-(k + 1)] - 1e-12]
            score = (eu[hits] * qu[q]).sum(axis=1) / (norms[0][hits] * norms[1][q])
            for h in np.lexsort((rep[hits], -score))[:k + 1]:
                for column, value in zip(out, (asked[q], ids[hits[h]], score[h])):
                    column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["asked", "ids", "score"])


def _search(entries: DataFrame, asking: DataFrame, substrings: list[int], radius: int, reach: int, k: int) -> DataFrame:
    """Ids found for each query, all within the radius, at most k + 1 of them: (asked, id, score, place)."""
    byte = lambda code, j: F.conv(F.hex(F.substring(code, j + 1, 1)), 16, 10).cast("int")
    at = lambda code: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), byte(code, j).alias("value")) for j in substrings]))
    masks = F.array(*[F.lit(m) for m in near_values(reach)])
    index = entries.select("*", at("code").alias("at")).select("rep", "ids", "code", "vector", "at.j", "at.value")
    probes = (asking.select("*", at("asked_code").alias("at")).select("asked", "asked_code", "asked_vector", "at.j", F.col("at.value").alias("own"), F.explode(masks).alias("mask"))
              .select("asked", "asked_code", "asked_vector", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
    # at most substrings x 256 buckets, so their sizes can be broadcast
    blocks = lambda rows, size, name: rows.groupBy("j", "value").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(index, ENTRIES, "e").join(blocks(probes, ASKING, "q"), ["j", "value"]))
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["j", "value", "eb", "qb"]
    left = index.join(sizes, ["j", "value"]).withColumn("eb", part("rep", "e")).withColumn("qb", every("q")).select(*key, "rep", "ids", "code", "vector")
    right = probes.join(sizes, ["j", "value"]).withColumn("qb", part("asked", "q")).withColumn("eb", every("e")).select(*key, "asked", "asked_code", "asked_vector")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _rank(radius, reach, k, a, b), MET)
    ranked = met.select("asked", F.explode("ids").alias("id"), "score")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)


def search(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           bits: int = BITS, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """``k`` nearest of each row whose id is divisible by ``every``: (query_id, rank, <id_col>, score)."""
    rows = usable(vectors, id_col, vec_col)
    unique = distinct_vectors(rows, k)
    fit = np.array([r[0] for r in unique.select("v", F.xxhash64(F.element_at("ids", 1), F.lit(3)).alias("h")).orderBy("h", F.element_at("ids", 1)).limit(sample).select("v").collect()], np.float64)
    if not len(fit):
        return vectors.sparkSession.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    mean, projection = rotation(fit, bits)
    width = (projection.shape[1] + WIDTH - 1) // WIDTH
    entries = cut(unique.mapInArrow(lambda b: _encode(mean, projection, b), ENTRY))
    members = rows.where(F.col("id") % every == 0).distinct()
    # queries of one vector share their search, known by the vector's smallest id
    asked_by = cut(members.join(unique.select("v", F.element_at("ids", 1).alias("rep")), "v").select("id", "rep"))
    asking = entries.join(asked_by.select("rep").distinct(), "rep", "left_semi").select(
        F.col("rep").alias("asked"), F.col("code").alias("asked_code"), F.col("vector").alias("asked_vector"))
    reach = radius // width
    found = cut(_search(entries, asking, list(range(width)), min(radius, width * (reach + 1) - 1), reach, k))
    short = asking.join(found.groupBy("asked").count().where(F.col("count") > k), "asked", "left_anti")
    if not short.isEmpty():
        again = _search(entries, short, [0], projection.shape[1], WIDTH, k)
        found = found.join(short.select("asked"), "asked", "left_anti").unionByName(again)
    # a common vector's queries are many: its answer is laid out for each of several parts
    parts = 16
    answers = found.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked_by = asked_by.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    own = asked_by.join(answers, (asked_by.rep == answers.asked) & (asked_by.part == answers.part)).select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))
