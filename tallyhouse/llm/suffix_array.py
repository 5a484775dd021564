"""Substring deduplication by suffix arrays, built shard by shard by induced sorting.

A byte goes if a string of ``RULE.threshold`` bytes that covers it also starts anywhere else. Strings
that are equal have the same winnowed anchor, so the stretches behind the anchors that occur twice
are dealt out by anchor, and everything that can match meets in one shard. A stretch that occurs
twice as a whole repeats all over. Different stretches of one anchor, and a lone one, are laid end to
end with separators that match nothing (those that can share no window with another are left out); the shard's suffixes are classified, its leftmost-smaller
substrings sorted recursively, all others induced from them, a letter's bucket at a time in whole arrays, and the permuted common
prefixes tell which suffixes share enough with a neighbour. A shard holds about ``SHARD`` bytes.

Equal stretches are first put together within a chunk of texts, so a passage in a third of all texts
costs each chunk one stretch; stretches behind a very common anchor are parted by a second one.

Defined results: a null text is empty. Texts under the threshold lose nothing. Rows with the same id
and text, like other copies, repeat each other. Kept bytes need not be valid UTF-8, so they are
returned as binary. An empty table gives no rows. Only the id and text columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.anchors import Chunk, Rule, chunks, copies_of, covered, firsts, keyed, runs, spans_by_text, with_anchors
from tallyhouse.llm.common import cut

#: bytes of a repeat, bytes of an anchor, bytes of text worked on at once
RULE = Rule(words=False, threshold=200, gram=32, chunk=1_000_000)
#: bytes in a suffix array; one anchor's stretches are never parted
SHARD = 1 << 19
#: windows that begin within so many bytes of each other, seen from the anchor's gram, are told apart by sorting only
CELL = 16
LEAST = -(1 << 63)

STRETCH = "deal bigint, anchor bigint, hash bigint, place bigint, key bigint, start int, copies int, pivot int, stretch binary, spans array<int>"
NAMES = ["deal", "anchor", "hash", "place", "key", "start", "copies", "pivot", "stretch", "spans"]


#: alphabets of up to so many letters are induced a bucket at a time, others a suffix at a time
BUCKETS = 1024


def classified(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and where the leftmost smaller ones start."""
    # a suffix is smaller than the next one if its first change of letter goes up
    step = np.sign(np.diff(s.astype(np.int64)))
    change = np.flatnonzero(step)
    nxt = np.searchsorted(change, np.arange(len(s) - 1))
    small = np.append(step[change[np.minimum(nxt, len(change) - 1)]] > 0, True)
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def by_bucket(s: np.ndarray, letters: int, single: int, small: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffix array induced from the order of the leftmost smaller suffixes, a letter's bucket at a time.

    Suffixes of a bucket go in generations: those that others have put there, then those that these put into the same bucket.
    The ``single`` smallest letters occur once each, so their suffixes are in order already.
    """
    first = np.flatnonzero(s < single)
    first = first[np.argsort(s[first])]
    seeds = _dealt(s, order[s[order] >= single], letters)
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]

    def put(into: list[list[np.ndarray]], come: np.ndarray) -> None:
        if len(come):
            for c, part in _dealt(s, come, letters).items():
                into[c].append(part)

    def before(those: np.ndarray, wanted: bool) -> np.ndarray:
        """Suffixes one letter longer that are (not) smaller than the next."""
        p = those[those > 0] - 1
        return p[small[p] == wanted]

    put(larger, before(first, False))
    none = np.zeros(0, np.int64)
    tops: list[np.ndarray] = [none] * letters
    for c in range(single, letters):
        found = []
        now = np.concatenate(larger[c]) if larger[c] else none
        while len(now):
            found.append(now)
            come = before(now, False)
            same = s[come] == c
            put(larger, come[~same])
            now = come[same]
        tops[c] = np.concatenate(found) if found else none
        if c in seeds:
            put(larger, before(seeds[c], False))
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    out: list[np.ndarray] = []
    for c in range(letters - 1, single - 1, -1):
        found = []
        now = np.concatenate(smaller[c]) if smaller[c] else none
        while len(now):
            found.append(now)
            come = before(now, True)
            same = s[come] == c
            put(smaller, come[~same])
            now = come[same]
        put(smaller, before(tops[c][::-1], True))
        out.extend((*found, tops[c][::-1]))
    out.append(first[::-1])
    return np.concatenate(out)[::-1]


def _dealt(s: np.ndarray, places: np.ndarray, letters: int) -> dict[int, np.ndarray]:
    """Places by their letter, in the order given."""
    by = s[places]
    order = np.argsort(by.astype(np.uint16) if letters <= 1 << 16 else by, kind="stable")
    places, by = places[order], by[order]
    head = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
    return dict(zip(by[head].tolist(), np.split(places, head[1:])))


def by_suffix(s: np.ndarray, letters: int, small: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same, a suffix at a time."""
    n = len(s)
    count = np.bincount(s, minlength=letters)
    ends = np.cumsum(count)
    word, is_small = s.tolist(), small.tolist()
    sa, tails = [-1] * n, ends.tolist()
    for i in reversed(order.tolist()):
        c = word[i]
        tails[c] -= 1
        sa[tails[c]] = i
    heads = (ends - count).tolist()
    for i in sa:  # grows ahead of the loop: larger suffixes fall behind their letter's head
        if i > 0 and not is_small[i - 1]:
            c = word[i - 1]
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0 and is_small[i - 1]:
            c = word[i - 1]
            tails[c] -= 1
            sa[tails[c]] = i - 1
    return np.array(sa)


def induced_sort(s: np.ndarray, letters: int, single: int = 0) -> np.ndarray:
    """Suffix array of whole numbers below ``letters`` that end in a 0 found nowhere else; the ``single`` smallest occur once each."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = np.asarray(s, np.int64)
    small, left = classified(s)
    induce = (lambda order: by_bucket(s, letters, max(single, 1), small, order)) if letters - single <= BUCKETS else (lambda order: by_suffix(s, letters, small, order))
    is_left = np.zeros(n, bool)
    is_left[left] = True
    rough = induce(left)
    rough = rough[is_left[rough]]
    # pieces from one leftmost smaller suffix to the next get numbers by their order; equal ones the same
    size = np.zeros(n, np.int64)
    size[left] = np.append(left[1:], n - 1) - left + 1
    same = np.concatenate(([False], _equal(s, rough[:-1], rough[1:], size)))
    names = np.zeros(n, np.int64)
    names[rough] = np.cumsum(~same) - 1
    if same.any():
        rough = left[induced_sort(names[left], int(names[rough[-1]]) + 1)]
    return induce(rough)


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces that start at a and at b are the same."""
    out = size[a] == size[b]
    at = np.flatnonzero(out)
    if len(at):
        length = size[a[at]]
        starts = np.cumsum(length) - length
        step = np.arange(length.sum()) - np.repeat(starts, length)
        differs = s[np.repeat(a[at], length) + step] != s[np.repeat(b[at], length) + step]
        out[at] = ~np.logical_or.reduceat(differs, starts)
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in text order, how much its suffix shares with the one before it in the array.

    Where the letters in front of both agree as well, it is one less than at the place in front. All
    other places are compared letter by letter, all at once; those that disagree leave.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    led = (at > 0) & (before > 0)
    led[led] = s[at[led] - 1] == s[before[led] - 1]
    length = np.zeros(n, np.int64)
    live, k = np.flatnonzero(~led & (before >= 0)), 0
    while len(live):
        live = live[s[live + k] == s[before[live] + k]]  # ends differ, so none runs out of the text
        k += 1
        length[live] = k
    head = np.maximum.accumulate(np.where(led, 0, at))
    return length[head] - (at - head)


def repeats(stretches: list[bytes], threshold: int) -> list[np.ndarray]:
    """For each stretch, which of its places start a string of ``threshold`` bytes found twice among all."""
    sizes = [len(x) for x in stretches]
    text = np.zeros(sum(sizes) + len(sizes), np.int64)
    at, begins = 0, []
    for i, x in enumerate(stretches):
        begins.append(at)
        text[at:at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + len(stretches)
        # separators differ, and the last one is the 0 that ends the text
        text[at + len(x)] = len(stretches) - 1 - i
        at += len(x) + 1
    sa = induced_sort(text, 256 + len(stretches), len(stretches))
    shares = common_prefixes(text, sa) >= threshold
    long = shares[sa]
    found = np.zeros(len(text), bool)
    found[sa[long]] = True
    found[sa[np.flatnonzero(long) - 1]] = True
    return [found[b:b + n] for b, n in zip(begins, sizes)]


def may_share(group: list[list], rule: Rule) -> list[list]:
    """Those stretches of one anchor that can share a full window with another one; the rest need no sorting.

    Windows hold the anchor's gram, so in two stretches that share one the grams lie at the same place of it. By how
    far the window begins before the gram, it falls into one of a few cells, and all windows of a cell have a core in common,
    which both stretches must have. A stretch that holds the gram more than once is not judged, nor are its partners.
    """
    if any(e[3] < 0 for e in group):
        return group
    seen: dict[tuple[int, bytes], list[int]] = {}
    for i, (stretch, _, _, pivot) in enumerate(group):
        for before in range(0, rule.grams, CELL):
            first, end = pivot - before, pivot + rule.threshold - min(before + CELL - 1, rule.grams - 1)
            if first >= 0 and end <= len(stretch):
                seen.setdefault((before, stretch[first:end]), []).append(i)
    shared = {i for those in seen.values() if len(those) > 1 for i in those}
    return [group[i] for i in sorted(shared)]


def _stretches(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, key, text, anchors, common) -> stretches behind repeated anchors, and spans already known to repeat."""
    for part, texts in chunks(batches, rule, 2):
        place, key = part.column(0).to_numpy(), part.column(1).to_numpy()
        c = Chunk(texts, rule)
        at, group = c.repeated(part.column(3), part.column(4))
        if not len(at):
            continue
        row = c.row[at]
        head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (row[1:] != row[:-1]) | (np.diff(at) != 1))))
        last = np.append(head[1:], len(at)) - 1
        size = at[last] - at[head] + rule.threshold
        whole = c.hashes.of(at[head], at[head] + size).view(np.int64)
        anchor, row, start = group[head], row[head], c.at[at[head]].astype(np.int32)
        order = np.lexsort((start, key[row], place[row], size, whole, anchor))
        same = np.concatenate(([False], *[(np.diff(np.stack([x[order] for x in (anchor, whole, size)]), axis=1) == 0).all(axis=0)]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        p, k, s = place[row][order], key[row][order], start[order]
        other = same & ((p != p[first]) | (k != k[first]) | (s != s[first]))  # a repeated row is not a repeat of itself
        twice = np.zeros(len(order), bool)
        np.logical_or.at(twice, first, other)
        twice = twice[first]
        out: list[list] = [[] for _ in NAMES]
        held = 0
        for i, o in enumerate(order.tolist()):
            r, a, n = int(row[o]), int(start[o]), int(size[o])
            if i == first[i]:
                stretch = texts[r][a:a + n]
                held += n
                here = np.flatnonzero(c.gram[at[head[o]]:at[head[o]] + n - rule.gram + 1] == c.least[at[head[o]]])
                pivot = int(here[0]) if len(here) == 1 else -1
                for column, value in zip(out, (anchor[o], anchor[o], whole[o], place[r], key[r], a, 2 if twice[i] else 1, pivot, stretch, None)):
                    column.append(value)
            if twice[i]:
                for column, value in zip(out, (key[r] ^ place[r], key[r], 0, place[r], key[r], a, 0, None, None, [a, a + n])):
                    column.append(value)
            if held > 8_000_000 or i + 1 == len(order):
                yield _batch(out)
                out, held = [[] for _ in NAMES], 0


def _batch(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], NAMES)


def _shards(rule: Rule, shard: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor and hash -> (place, key, spans)."""
    out: list[list] = [[], [], []]
    waiting: list[list] = []  # different stretches of several anchors: [stretch, occurrences]
    group: list[list] = []
    size, anchor, before = 0, None, None

    def tell(place, key, spans) -> None:
        if spans:
            for column, value in zip(out, (place, key, spans)):
                column.append(value)

    def close_group() -> None:
        """A stretch met twice repeats all over and needs no sorting unless others of its anchor may share a part of it."""
        nonlocal group, size
        for entry in group:
            if entry[2] > 1:
                for place, key, start in entry[1]:
                    tell(place, key, [start, start + len(entry[0])])
        if len(group) > 1:
            group = may_share(group, rule)
        if len(group) > 1 or group and group[0][2] == 1 and group[0][3] < 0:
            waiting.extend(group)
            size += sum(len(e[0]) for e in group)
        group = []

    def sort_shard() -> None:
        nonlocal waiting, size
        for (_, occurrences, copies, _), found in zip(waiting, repeats([e[0] for e in waiting], rule.threshold) if waiting else []):
            places = np.flatnonzero(found)
            if copies == 1 and len(places):
                a, b = runs(places)
                for place, key, start in occurrences:
                    tell(place, key, np.stack([a + start, b + start + rule.threshold], axis=1).ravel().tolist())
        waiting, size = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal out
        rows, out = out, [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["place", "key", "spans"])

    for batch in batches:
        for a, h, place, key, start, copies, pivot, stretch, spans in zip(*[batch.column(n).to_pylist() for n in NAMES[1:]]):
            if spans is not None:
                tell(place, key, spans)
                continue
            if a != anchor:
                close_group()
                if size >= shard:
                    sort_shard()
                anchor, before = a, None
            if before == (h, len(stretch)):
                entry = group[-1]
                if (place, key, start) != entry[1][-1]:
                    entry[1].append((place, key, start))
                    entry[2] += copies
                elif copies > entry[2]:
                    entry[2] = copies
            else:
                group.append([stretch, [(place, key, start)], copies, pivot])
                before = (h, len(stretch))
        if len(out[0]) > 10_000:
            yield flush()
    close_group()
    sort_shard()
    yield flush()


def _spans(rows: DataFrame, first: DataFrame, rule: Rule, shard: int) -> DataFrame:
    texts = with_anchors(rows, first, rule).select(F.coalesce("doc_id", F.lit(LEAST)).alias("place"), "key", "text", "anchors", "common")
    dealt = texts.mapInArrow(lambda b: _stretches(rule, b), STRETCH).repartition("deal").sortWithinPartitions("anchor", "hash", F.length("stretch"), "place", "key", "start")
    return spans_by_text(dealt.mapInArrow(lambda b: _shards(rule, shard, b), "place bigint, key bigint, spans array<int>").withColumnRenamed("place", "doc_id"))


def _kept(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            out: list[list] = [[], [], [], []]
            for text, spans, copy in zip(part.column(1).cast(pa.large_binary()), part.column(2), part.column(3).to_pylist()):
                raw = text.as_py()
                gone = np.ones(len(raw), bool) if copy and len(raw) >= threshold else covered(spans.values.to_numpy() if spans.is_valid else [], len(raw))
                a, b = runs(np.flatnonzero(gone)) if gone.any() else ((), ())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(a) else raw
                for column, value in zip(out, (len(raw), len(raw) - len(kept), kept, [int(x) for s, e in zip(a, b) for x in (s, e + 1)])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))],
                                             ["doc_id", "n_bytes", "n_removed", "kept", "spans"])


def deduplicate(docs: DataFrame, rule: Rule = RULE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): the bytes that stay, and the byte ranges that went (first and end by turns)."""
    rows = keyed(docs, id_col, text_col)
    first = cut(firsts(rows))
    spans = _spans(rows, first, rule, shard)
    copies = copies_of(rows, first).select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "key", F.lit(True).alias("copy"))
    told = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("spans", F.array().cast("array<int>"))).groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.max("copy").alias("copy")).select(F.col("doc_id").alias("p"), F.col("key").alias("k"), "spans", "copy")
    joined = rows.join(told, (F.coalesce("doc_id", F.lit(LEAST)) == F.col("p")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        lambda b: _kept(rule.threshold, b), "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, spans array<bigint>")
