"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period q, at least ``RULE.least`` words and
``RULE.times`` periods long, that no neighbouring word extends. On the diagonal q (words i and i + q
compared) it is a stretch of ``overlap(q)`` equal pairs or more. Periods of one octave, 2^j to
2^(j+1) - 1, are found together: the guaranteed overlap of the smallest of them is the length k of
the grams that are indexed, and it is longer than any period of the octave. Inside a run the gram at
a place therefore comes back first after exactly one period, and it is enough to look at pairs of
neighbouring occurrences in a text: their number grows with the words, whatever the repetition.
For the same reason a stretch around such a pair has no smaller period. Pairs are taken by lag and
place; a table holds how far each lag has been extended, so a stretch is extended only once.

Grams are told apart by exact numbers, built by doubling and only where both halves recur, not by
hashes. Work is O(n log n) steps of whole arrays for a text of n words, with a few numbers a word.

Defined results: a null or empty text, or one of blanks, has no words, no runs and an empty collapsed text. A
null id passes through. Repeated rows are found each. Ties of the strongest run go to the smallest
start, then the smallest period. An empty table gives no rows. Only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.grams import Words, by_size, pairs, singles


@dataclass(frozen=True)
class Rule:
    """Least length of a run in words and in periods; at three periods and more, an octave's grams are longer than its periods."""

    least: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 3:
            raise ValueError("a run has to have three periods at least")

    def overlap(self, q: int) -> int:
        """Equal pairs on diagonal q that a run of period q guarantees."""
        return max(self.least, self.times * q) - q


RULE = Rule()
#: words compared at once at the start of an extension
STEP = 64
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def octaves(ids: np.ndarray, rule: Rule) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Octave's smallest period, gram length, and pairs of neighbouring occurrences whose lag is in the octave: first place, lag."""
    halves, length, low = singles(ids), 1, 1
    while True:
        k = rule.overlap(low)
        while 2 * length <= k:
            halves = pairs(halves, halves, length)[0]
            length *= 2
        if halves.max(initial=-1) < 0:
            return
        _, at, new = pairs(halves, halves, k - length) if k > length else ranked_again(halves)
        lag = np.diff(at)
        here = np.flatnonzero(~new[1:] & (lag >= low) & (lag < 2 * low))
        yield low, k, at[:-1][here], lag[here]
        low *= 2


def ranked_again(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(halves >= 0)
    at = at[np.argsort(halves[at], kind="stable")]
    return halves, at, np.concatenate(([True], np.diff(halves[at]) != 0)) if len(at) else np.zeros(0, bool)


def extended(ids: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """First and end of the equal pairs on the diagonal around place i."""
    end, step = i, STEP
    while end + lag < len(ids):
        same = ids[end:len(ids) - lag][:step] == ids[end + lag:][:step]
        if not same.all():
            end += int(same.argmin())
            break
        end += len(same)
        step *= 2
    first, step = i, STEP
    while first > 0:
        low = max(0, first - step)
        same = ids[low:first] == ids[low + lag:first + lag]
        if not same.all():
            first -= int(same[::-1].argmin())
            break
        first = low
        step *= 2
    return first, end


def runs_in(ids: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; ids of different texts have to differ."""
    found = []
    for _, _, places, lags in octaves(ids, rule):
        covered: dict[int, int] = {}
        # neighbouring places on one diagonal lie in one stretch
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        head = np.concatenate(([True], (np.diff(places) != 1) | (np.diff(lags) != 0))) if len(places) else np.zeros(0, bool)
        for i, lag in zip(places[head].tolist(), lags[head].tolist()):
            if i < covered.get(lag, 0):
                continue
            first, end = extended(ids, i, lag)
            covered[lag] = end
            if end - first >= rule.overlap(lag):
                found.append((first, end - first + lag, lag))
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return out


def _find(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in by_size(batches, 1):
        words = Words(texts)
        found = runs_in(words.ids, rule)
        gone = np.zeros(len(words.ids) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        begin = words.begin
        edges = np.searchsorted(found[:, 0], begin)
        text_of = np.searchsorted(begin, found[:, 0], side="right") - 1
        starts = found[:, 0] - begin[text_of]
        runs = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]))
        collapsed = [words.joined(words.ids[a:b][kept[a:b]]) for a, b in zip(begin[:-1], begin[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(begin)), runs.cast(RUNS), pa.array(collapsed, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, rule: Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs by start and period, and the words that stay when each run keeps its first period, joined by one space."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(lambda b: _find(rule, b), FOUND)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; null if there is none."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs come by start and period, so the first of equal ones stays
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
