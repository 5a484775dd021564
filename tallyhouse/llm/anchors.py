"""Winnowed anchors of texts, over words or bytes, computed for many texts at once.

A text is a row of units. Every window of ``threshold`` units has one anchor: the least hash of the
``gram``-unit sequences inside it. Equal windows have equal anchors, so an anchor that occurs once
in the corpus rules out a repeat for all of its windows.

How anchors are dealt out: a task works on chunks of texts and sends one row for each anchor of a
chunk, whatever its number of occurrences there. So no group holds more rows than there are chunks,
however common a passage is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import KEPT, whole

#: an anchor met by more chunks than this is told apart by a second one
COMMON = 10_000

U = np.uint64
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, 260, dtype=np.uint64) * U(2) + U(1)
BYTE = _SEEDS[:256]
BASES = tuple(int(x) for x in _SEEDS[256:258])
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT["powers"] = _POWERS.clear


@dataclass(frozen=True)
class Rule:
    """What a unit is, the length of a repeat in units, the length of an anchor's gram, and characters or bytes in a chunk."""

    words: bool
    threshold: int
    gram: int
    chunk: int

    @property
    def grams(self) -> int:
        return self.threshold - self.gram + 1


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, U)
        down = np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    up, down = _POWERS[base]
    return up[:n], down[:n]


class Hasher:
    """Hashes of any stretch [a, b) of a row of values."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return scrambled((self.sums[b] - self.sums[a]) * self.down[a])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return scrambled((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    return f(x[:len(x) - rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


class Chunk:
    """Units of several texts in a row: ``row`` and ``at`` give the text and the place of each unit."""

    def __init__(self, texts: list[bytes], rule: Rule):
        self.rule, self.texts = rule, texts
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if rule.words:
            solid = ~SPACE[raw]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
            starts, ends = edge[::2], edge[1::2]
            values = Hasher(BYTE[raw], BASES[0]).of(starts, ends) + (ends - starts).astype(U)
            self.row = np.searchsorted(first, starts, side="right") - 1
        else:
            inside = np.ones(len(raw), bool)
            inside[first[1:] - 1] = False
            values = BYTE[raw[inside]]
            self.row = np.repeat(np.arange(len(texts)), sizes - 1)
        begin = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.begin = begin
        self.at = np.arange(len(values)) - np.repeat(begin[:-1], np.diff(begin))
        self.hashes = Hasher(values, BASES[1])
        n, t = len(values), rule.threshold
        self.gram = self.hashes.all(rule.gram)
        # a window is one text's own if its last unit belongs to the same text
        self.whole = self.row[:n - t + 1] == self.row[t - 1:] if n >= t else np.zeros(0, bool)
        self.least = sliding(self.gram, rule.grams, np.minimum)[:len(self.whole)]

    def windows(self) -> np.ndarray:
        return self.hashes.all(self.rule.threshold)

    def repeated(self, anchors: pa.Array, common: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose anchor is among their text's ``anchors``, and what to group each of them by.

        That is the anchor; for one in ``common`` (lists as well), the anchor with the least other gram of the
        window, so that the many texts which share only a common anchor part ways. Equal windows stay together.
        """
        at = np.flatnonzero(self.whole)
        row, group = self.row[at], self.least[at].view(np.int64).copy()
        known = np.zeros(len(at), bool)
        edges = np.searchsorted(row, np.arange(len(self.texts) + 1))
        for i in range(len(self.texts)):
            a, b = edges[i], edges[i + 1]
            if a < b:
                known[a:b] = np.isin(group[a:b], anchors[i].values.to_numpy())
                many = common[i].values.to_numpy()
                if len(many) and (hot := np.flatnonzero(np.isin(group[a:b], many))).size:
                    for first, end in zip(*runs(hot)):
                        for value in np.unique(group[a + first:a + end + 1]):
                            part = self.gram[at[a + first]:at[a + end] + self.rule.grams]
                            other = sliding(np.where(part == value.view(U), ~U(0), part), self.rule.grams, np.minimum)
                            here = np.flatnonzero(group[a + first:a + end + 1] == value)
                            group[a + first + here] = scrambled(other[here] + value.view(U)).view(np.int64)
        return at[known], group[known]

    def anchored(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and text of each place whose gram is the anchor of some window."""
        n = len(self.whole)
        if not n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        low = np.where(self.whole, self.least, U(0))
        width = self.rule.grams
        padded = np.concatenate([np.zeros(width - 1, U), low, np.zeros(width - 1, U)])
        top = sliding(padded, width, np.maximum)  # over the windows that hold each place
        # hash 0 stands for no window; a gram that hashes to 0 would be missed, so it is taken always
        chosen = np.flatnonzero((self.gram[:len(top)] == top[:len(self.gram)]) & (top[:len(self.gram)] > 0) | (self.gram[:len(top)] == 0))
        return self.gram[chosen], self.row[chosen]


def chunks(batches: Iterator[pa.RecordBatch], rule: Rule, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts together have about ``rule.chunk`` bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = min(int(np.searchsorted(sizes, done + rule.chunk)) + 1, batch.num_rows)
            part = batch.slice(at, end - at)
            yield part, [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(column)]
            at = end


SEEN = "anchor bigint, key bigint, keys array<bigint>"


def _anchors(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key) -> one row for each anchor of a chunk: the key of a text that has it, or all keys if it was met several times."""
    for part, texts in chunks(batches, rule, 0):
        keys, own = np.unique(part.column(1).to_numpy(), return_index=True)  # one of each group of copies
        value, row = Chunk([texts[i] for i in own], rule).anchored()
        order = np.lexsort((row, value))
        value, row = value[order], row[order]
        start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
        many = np.diff(np.append(start, len(value))) > 1
        told = np.repeat(many, np.diff(np.append(start, len(value))))
        told &= np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(value) else told
        # a null list where the anchor was met once
        ends = np.cumsum(np.bincount(np.searchsorted(start, np.flatnonzero(told), side="right") - 1, minlength=len(start))) if len(start) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(keys[row[told]]), mask=pa.array(~many))
        columns = [pa.array(value[start].view(np.int64)), pa.array(keys[row[start]] if len(start) else np.zeros(0, np.int64)), lists]
        for i in range(0, len(start), 100_000):
            yield pa.RecordBatch.from_arrays([x.slice(i, 100_000) for x in columns], ["anchor", "key", "keys"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key, digest): the text's 64-bit key for dealing out, and its digest for telling texts apart."""
    text = whole(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def repeated_anchors(rows: DataFrame, rule: Rule) -> DataFrame:
    """(key, anchors, common): for each text, its anchors that occur twice in the corpus, and those met in very many chunks; copies of a text count once."""
    seen = rows.select("text", "key").mapInArrow(lambda b: _anchors(rule, b), SEEN)
    by = Window.partitionBy("anchor")
    found = seen.select("*", F.min("key").over(by).alias("a"), F.max("key").over(by).alias("z"), F.max(F.col("keys").isNotNull()).over(by).alias("k"), F.count(F.lit(1)).over(by).alias("n"))
    hits = found.where((F.col("a") < F.col("z")) | F.col("k")).select("anchor", "n", F.explode(F.coalesce("keys", F.array("key"))).alias("key"))
    return hits.groupBy("key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("n") > COMMON, F.col("anchor"))).alias("common"))


def firsts(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, key, copies): each different text with its smallest id; a null id is smaller than others."""
    one = rows.groupBy("digest", "key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("n"), F.col("doc_id").alias("i"))).alias("least"), F.count(F.lit(1)).alias("copies"))
    return one.select("digest", "key", F.col("least.i").alias("doc_id"), "copies")


def with_anchors(rows: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, key, text, anchors, common) of the first copy of each text that has repeated anchors."""
    known = first.join(repeated_anchors(rows, rule), "key").select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "anchors", "common")
    both = F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))
    return rows.join(known, both).select("doc_id", "key", "text", "anchors", "common")


def copies_of(rows: DataFrame, first: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, key, first_id) of every row whose text has several copies. Texts with 1 / ``most`` of all rows are broadcast, there are not more than ``most``."""
    light = rows.select("doc_id", "key", "digest")
    total = first.agg(F.sum("copies")).first()[0] or 0
    many = first.where(F.col("copies") > 1).select(F.col("digest").alias("d"), F.col("doc_id").alias("first_id"), (F.col("copies") * most >= total).alias("hot"))
    hot = F.broadcast(many.where("hot"))
    same = F.col("digest") == F.col("d")
    cold = light.join(hot, same, "left_anti").join(many.where("not hot"), same)
    return light.join(hot, same).unionByName(cold).select("doc_id", "key", "first_id").distinct()


def covered(spans: list, size: int) -> np.ndarray:
    """Which of ``size`` units the spans (first, end) cover."""
    change = np.zeros(size + 1, np.int64)
    if len(spans):
        ab = np.asarray(spans, np.int64).reshape(-1, 2)
        np.add.at(change, np.minimum(ab[:, 0], size), 1)
        np.add.at(change, np.minimum(ab[:, 1], size), -1)
    return np.cumsum(change[:-1]) > 0


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cutoff = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], cutoff + 1))], places[np.append(cutoff, len(places) - 1)]


def spans_by_text(spans: DataFrame) -> DataFrame:
    """(doc_id, key, spans): all spans of a text, first and end by turns."""
    return spans.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
