"""Substring deduplication by seed and extend.

Texts are joined on winnowed anchors: grams of ``RULE.gram`` words, one for every window of
``RULE.threshold``. Every place whose anchor occurs twice is a seed. It is extended both ways as far as a
window that still has this anchor can reach, and extensions are compared by the hash of each full
window; those that agree chain up into maximal repeats. All but the earliest occurrence of a repeat
go. Occurrences are never paired: each window only asks whether it has been there before, first among
the texts of its chunk, then among all chunks, so a passage in a third of all texts costs each chunk
one row.

Defined results: a null text is empty. Texts under the threshold lose nothing. Ids order occurrences,
a null id before others; of one id's different texts, the smaller text key is earlier; rows with the
same id and text count as one document and get the same result. Of copies with other ids, all but
the smallest id lose every word (given enough words). An empty table gives no rows. Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.anchors import Chunk, Rule, chunks, copies_of, covered, firsts, keyed, runs, spans_by_text, with_anchors
from tallyhouse.llm.common import cut

#: words of a repeat, words of an anchor, bytes of text worked on at once
RULE = Rule(words=True, threshold=20, gram=5, chunk=1_000_000)
WORD = re.compile(r"[^ \t-\r]+")
LEAST = -(1 << 63)

SEEDS = "deal bigint, anchor bigint, place bigint, key bigint, starts array<int>, windows array<bigint>"


def _lists(groups: np.ndarray, n: int, *values: np.ndarray) -> list[pa.ListArray]:
    """Values as lists, by sorted group number."""
    offsets = pa.array(np.searchsorted(groups, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _seeds(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, key, text, anchors, common) -> the windows behind each seed, and those already known to repeat (no windows given)."""
    for part, texts in chunks(batches, rule, 2):
        place, key, hits = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
        c = Chunk(texts, rule)
        at, least = c.repeated(hits, part.column(4))
        if not len(at):
            continue
        row = c.row[at]
        window, start = c.windows()[at].view(np.int64), c.at[at].astype(np.int32)
        order = np.lexsort((start, key[row], place[row], window))
        w, p, k, s = window[order], place[row][order], key[row][order], start[order]
        again = np.concatenate(([False], w[1:] == w[:-1]))
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(w))))
        again &= (p != p[head]) | (k != k[head]) | (s != s[head])  # a repeated row is not a repeat of itself
        gone = np.zeros(len(at), bool)
        gone[order] = again
        # one row for each run of windows with one anchor, and one for each text's known repeats
        new = np.flatnonzero(~gone)
        if len(new):
            group = np.cumsum(np.concatenate(([True], (least[new][1:] != least[new][:-1]) | (row[new][1:] != row[new][:-1]) | (np.diff(start[new]) > 1)))) - 1
            head = np.searchsorted(group, np.arange(group[-1] + 1))
            starts, windows = _lists(group, len(head), start[new], window[new])
            anchor = least[new][head]
            yield from _rows(anchor, anchor, place[row[new][head]], key[row[new][head]], starts, windows)
        old = np.flatnonzero(gone)
        if len(old):
            which, head = np.unique(row[old], return_index=True)
            starts = _lists(np.searchsorted(which, row[old]), len(which), start[old])[0]
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(which) + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
            yield from _rows(key[which] ^ place[which], key[which], place[which], key[which], starts, empty)


def _rows(*columns) -> Iterator[pa.RecordBatch]:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    for i in range(0, len(arrays[0]), 50_000):
        yield pa.RecordBatch.from_arrays([a.slice(i, 50_000) for a in arrays], ["deal", "anchor", "place", "key", "starts", "windows"])


def _extend(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds sorted by anchor and place -> (place, key, spans): windows that were there before, chained."""
    last, seen = None, np.zeros((0,), np.int64)  # windows met of the anchor at which the previous batch ended
    owner = np.zeros((0, 3), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = lambda a: (a.flatten().to_numpy(zero_copy_only=False), np.asarray(a.value_lengths()))
        start, n_start = flat(batch.column("starts"))
        window, n_window = flat(batch.column("windows"))
        deal, anchor, place, key = (batch.column(c).to_numpy() for c in ("deal", "anchor", "place", "key"))
        fresh = np.repeat(np.arange(batch.num_rows), n_window)
        known = np.repeat(n_window == 0, n_start)
        row_of_start = np.repeat(np.arange(batch.num_rows), n_start)
        fresh_start = start[~known].astype(np.int64)
        carry = len(seen) if last is not None and len(fresh) and last in (anchor[n_window > 0][0],) else 0
        w = np.concatenate([seen[:carry], window])
        a = np.concatenate([np.full(carry, last if carry else 0, np.int64), anchor[fresh]])
        who = np.concatenate([owner[:carry], np.stack([place[fresh], key[fresh], fresh_start], axis=1).reshape(-1, 3)])
        order = np.lexsort((np.arange(len(w)), w, a))
        same = np.concatenate(([False], (w[order][1:] == w[order][:-1]) & (a[order][1:] == a[order][:-1]))) if len(w) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(w)))) if len(w) else np.zeros(0, np.int64)
        gone = np.zeros(len(w), bool)
        gone[order] = same & (who[order] != who[order][head]).any(axis=1)
        if len(fresh):
            last = anchor[fresh[-1]]
            mine = np.flatnonzero((a == last) & ~gone)
            seen, owner = w[mine], who[mine]
        rows = np.concatenate([row_of_start[known], fresh[gone[carry:]]])
        starts = np.concatenate([start[known], fresh_start[gone[carry:]]]).astype(np.int64)
        if len(rows):
            order = np.lexsort((starts, rows))
            rows, starts = rows[order], starts[order]
            # chained: neighbouring windows of one seed are one span
            cutoff = np.concatenate(([True], (rows[1:] != rows[:-1]) | (np.diff(starts) > 1)))
            heads = np.flatnonzero(cutoff)
            ends = starts[np.append(heads[1:] - 1, len(starts) - 1)] + rule.threshold
            which, first = np.unique(rows[heads], return_index=True)
            flatten = np.stack([starts[heads], ends], axis=1).astype(np.int32).ravel()
            offsets = pa.array(2 * np.append(first, len(heads)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(place[which]), pa.array(key[which]), pa.ListArray.from_arrays(offsets, pa.array(flatten))], ["place", "key", "spans"])


def repeated_spans(docs: DataFrame, rule: Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans): word ranges of each text (not of its copies) that occur earlier in the corpus."""
    rows = keyed(docs, id_col, text_col)
    first = cut(firsts(rows))
    return _spans(rows, first, rule)


def _spans(rows: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    # the place of a text among all is its id, a null id before all others
    texts = with_anchors(rows, first, rule).select(F.coalesce("doc_id", F.lit(LEAST)).alias("place"), "key", "text", "anchors", "common")
    seeds = texts.mapInArrow(lambda b: _seeds(rule, b), SEEDS)
    # a row of windows known to repeat is dealt out by its text
    dealt = seeds.repartition("deal").sortWithinPartitions("anchor", "place", "key", F.element_at("starts", 1))
    return spans_by_text(dealt.mapInArrow(lambda b: _extend(rule, b), "place bigint, key bigint, spans array<int>").withColumnRenamed("place", "doc_id"))


def _kept(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            words = WORD.findall(text.as_py())
            gone = np.ones(len(words), bool) if copy and len(words) >= threshold else covered(spans.values.to_numpy() if spans.is_valid else [], len(words))
            kept = " ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else " ".join(words)
            for column, value in zip(out, (len(words), int(gone.sum()), kept, [x for a, b in zip(*runs(np.flatnonzero(gone))) for x in (int(a), int(b) + 1)] if gone.any() else [])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64()))],
                                         ["doc_id", "n_words", "n_removed", "kept", "spans"])


def deduplicate(docs: DataFrame, rule: Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the words that stay, joined by one space, and the word ranges that went."""
    rows = keyed(docs, id_col, text_col)
    first = cut(firsts(rows))
    spans = _spans(rows, first, rule)
    copies = copies_of(rows, first).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "key", F.lit(True).alias("copy"))
    told = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("spans", F.array().cast("array<int>"))).groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.max("copy").alias("copy")).select(F.col("doc_id").alias("p"), F.col("key").alias("k"), "spans", "copy")
    joined = rows.join(told, (F.coalesce("doc_id", F.lit(LEAST)) == F.col("p")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        lambda b: _kept(rule.threshold, b), "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<bigint>")
