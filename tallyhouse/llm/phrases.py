"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into ``SHARDS`` shards that are scanned in a cycle, one a step. Words are counted
from the first step on. A longer phrase becomes active as soon as both phrases that it holds of one
word less have reached the threshold, and is then counted in the scans that run anyway, beside words
and other phrases, until it has seen each shard once. So lengths interleave, and the scans end when
no phrase has a shard left to see.

Which phrases have reached the threshold is told to the tasks by a bitmap, one bit for
the hash of a phrase. It has a bit for every ``WORDS_A_BIT`` words of the corpus, but never more than 2^``BITS`` (128 MB). Bits are only ever set, so the step at which a phrase becomes
active is well defined, also where a hash collision activates it early: it is counted where the
bitmap of this step admits it and that of one cycle ago did not. A collision costs a count and changes
none. Counts themselves are kept by the phrase's text and are exact.

Each step sends the counts of a block of texts, not occurrences, and adds them to the stored counts of
phrases that are not complete; complete ones under the threshold are dropped.

The scores of a phrase are looked up by its parts. Parts with a thousandth of all words (there are not more than a
thousand of each length) are broadcast, all others shuffled; a part has at most a tenth of its count as many phrases.

Defined results: a null text is empty, a null language is ``und``, an empty language one of its own. Repeated rows count each. The id and
other columns are not read. Texts without words add nothing; a language without a phrase that reaches the threshold gives no row. An empty
table gives no rows. Ties of cuts go to the smallest number of words before the cut, ties of
phrases to the greater count, then the smaller phrase by UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyhouse.llm.common import checkpoint_dir, remove, stored_in, tidy, whole

#: occurrences of a phrase, words of the longest phrase, shards of a cycle
LEAST, LONGEST, SHARDS = 10, 3, 2
#: bits of the bitmap as powers of two, at least and at most; words of the corpus for each bit in between
FEWEST, BITS, WORDS_A_BIT = 16, 30, 8
#: a phrase goes if a longer one that holds it has so many percent of its occurrences; phrases of a language that are reported
COVERED, TOP = 50, 2000
#: bytes of text counted together
BLOCK = 1 << 22
#: parts with 1 / HOT of all words are broadcast
HOT = 1000
#: parts of a language that are ranked by themselves
PARTS = 16
#: ends a piece: a byte that no UTF-8 text holds
END = b"\xff"
PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
#: a phrase's key is its language and its words behind a line end, which no word holds
BREAK = "\n"
COUNTS = "key string, f bigint"
U = np.uint64


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of what comes before its last word and of that word."""
    h = (left * U(0x9E3779B97F4A7C15) + (right ^ (right >> U(29)))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Bitmap:
    """Hashes that have reached the threshold; may hold others, which collide."""

    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.bits, self.cells = bits, np.zeros(1 << max(bits - 6, 0), U) if cells is None else cells

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = h >> U(64 - self.bits)
        return (at >> U(6)).astype(np.int64), U(1) << (at & U(63))

    def holds(self, h: np.ndarray) -> np.ndarray:
        cell, bit = self.places(h)
        return (self.cells[cell] & bit) != 0

    def with_cells(self, cell: np.ndarray, bits: np.ndarray) -> Bitmap:
        cells = self.cells.copy()
        np.bitwise_or.at(cells, cell, bits)
        return Bitmap(self.bits, cells)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.cells, other.cells)


def blocks(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of the text, cut where a piece ends."""
    at = 0
    while at < len(text):
        end = text.find(END, at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def phrases_in(block: bytes, lang: str, now: Bitmap, before: Bitmap, singly: bool, longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of the block that are to be counted, with their counts; '' stands for all words."""
    known: dict[bytes, int] = {}
    ids = np.array([-1 if w == END else known.setdefault(w, len(known)) for w in block.replace(END, b" " + END + b" ").split()], np.int64)
    if not known:
        return
    spelled = pa.array(list(known), pa.binary())
    each, size = word_hashes(list(known), lang), len(known)
    if singly:
        count = np.bincount(ids[ids >= 0], minlength=size)
        yield pa.array([b""], pa.binary()), count.sum(keepdims=True)
        yield spelled, count
    new, old = now.holds(each), before.holds(each)
    # places of phrases that have reached the threshold, their hashes, and whether they had done so a cycle ago
    places = np.flatnonzero((ids >= 0) & new[ids])
    hashes, long_ago = each[ids[places]], old[ids[places]]
    for words in range(2, longest + 1):
        # a phrase starts where the one of a word less does and the next place starts one too
        first = np.flatnonzero(np.diff(places) == 1)
        if not len(first):
            return
        start, was_active = places[first], long_ago[first] & long_ago[first + 1]
        fresh = start[~was_active]
        if len(fresh):
            columns, count = counted(ids, fresh, words, size)
            yield pc.binary_join_element_wise(*(spelled.take(pa.array(c)) for c in columns), pa.scalar(b" ", pa.binary())), count
        if words < longest:
            h = joined_hash(hashes[first], each[ids[start + words - 1]])
            go = now.holds(h)
            places, hashes = start[go], h[go]
            # a hash that collides may be held without the phrase's parts, so parts count as well
            long_ago = before.holds(hashes) & was_active[go]


def counted(ids: np.ndarray, start: np.ndarray, words: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different sequences of ``words`` numbers below ``size`` that begin at the places, a column for each word, and how often they do."""
    if size ** words < 1 << 63:
        key = ids[start]
        for k in range(1, words):
            key = key * size + ids[start + k]
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        distinct, count, columns = key[new], np.diff(np.append(new, len(key))), []
        for _ in range(words):
            columns.append(distinct % size)
            distinct = distinct // size
        return columns[::-1], count
    rows, count = np.unique(ids[start[:, None] + np.arange(words)], axis=0, return_counts=True)
    return list(rows.T), count


def _count(sent, singly: bool, longest: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of a block's phrases."""
    now, before = sent.value
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            by_lang.setdefault(lang, []).append(text.as_buffer().to_pybytes())
        for lang, texts in by_lang.items():
            for part in blocks(END.join(texts).translate(PIECES), block):
                for phrase, count in phrases_in(part, lang, now, before, singly, longest):
                    key = pc.binary_join_element_wise(pa.scalar((lang + BREAK).encode(), pa.binary()), phrase, pa.scalar(b"", pa.binary()))
                    yield pa.RecordBatch.from_arrays([key.view(pa.string()), pa.array(count.astype(np.int64))], ["key", "f"])


def _cells(bits: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of frequent phrases -> cells of the bitmap; the longest ones make no other active."""
    bitmap = Bitmap(bits, np.zeros(1, U))
    for batch in batches:
        hashes = []
        for key in batch.column(0).to_pylist():
            lang, phrase = key.rsplit(BREAK, 1)
            words = phrase.encode().split(b" ")
            if phrase and len(words) < longest:
                each = word_hashes(words, lang)
                hashes.append(reduce(joined_hash, (each[k:k + 1] for k in range(len(each)))))
        cell, bit = bitmap.places(np.concatenate([np.zeros(0, U), *hashes]))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bit.view(np.int64))], ["cell", "bit"])


def grown(bitmap: Bitmap, frequent: DataFrame, longest: int) -> Bitmap:
    """The bitmap with the phrases in ``frequent``; at most its own cells come back."""
    got = frequent.select("key").mapInArrow(lambda b: tidy(_cells(bitmap.bits, longest, b)), "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    return bitmap.with_cells(got.column("cell").to_numpy(), got.column("bits").to_numpy().view(U)) if got.num_rows else bitmap


def bits_for(words: int) -> int:
    return max(FEWEST, min(BITS, max(1, words // WORDS_A_BIT).bit_length()))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int | None = None, block: int = BLOCK,
                  lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f): every phrase that occurs ``least`` times or more, of up to ``longest`` words; in the row '' with 0 words all words of the language."""
    spark: SparkSession = docs.sparkSession
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4().hex}"
    given = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), whole(text_col).alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    texts = stored_in(given, f"{base}/texts", "shard")
    every_word = F.col("key").endswith(BREAK)
    # the bitmap of this step, those of the steps before it for one cycle, and the counts that are not complete
    none, bitmaps, counting, done, t = Bitmap(FEWEST), {}, None, [], 0
    while t < shards or bitmaps[t] != bitmaps[t - shards]:
        now, before = bitmaps.get(t, none), bitmaps.pop(t - shards, none)
        sent = spark.sparkContext.broadcast((now, before if before.bits == now.bits else Bitmap(now.bits)))
        new = texts.where(F.col("shard") == t % shards).select("lang", "text").mapInArrow(lambda b, s=sent, one=t < shards: tidy(_count(s, one, longest, block, b)), COUNTS).withColumn("born", F.lit(t))
        added = (new if counting is None else new.unionByName(counting)).groupBy("key").agg(F.sum("f").alias("f"), F.min("born").alias("born"))
        # whoever was first seen a cycle ago has been active for one at least
        complete = F.col("born") <= t - shards + 1
        step = stored_in(added.withColumn("complete", complete).where(~F.col("complete") | (F.col("f") >= least) | every_word), f"{base}/step={t}", "complete")
        sent.destroy()
        if t:
            remove(spark, f"{base}/step={t - 1}/complete=false")
        else:
            all_words = step.where(every_word).agg(F.sum("f")).first()[0] or 0
            none = Bitmap(bits or bits_for(all_words * shards))
            bitmaps[0] = none
        counting = step.where("not complete").drop("complete")
        done.append(step.where("complete").select("key", "f"))
        bitmaps[t + 1] = grown(bitmaps[t], step.where(F.col("f") >= least), longest)
        t += 1
    remove(spark, f"{base}/texts")
    # no phrase has a shard left to see, so the last ones that are marked as open are complete too
    found = reduce(DataFrame.unionByName, done).unionByName(counting.where((F.col("f") >= least) | every_word).select("key", "f"))
    phrase = F.substring_index("key", BREAK, -1)
    lang = F.substring(F.col("key"), F.lit(1), F.char_length("key") - F.char_length(phrase) - 1)
    told = found.select(lang.alias("lang"), phrase.alias("phrase"), "f")
    out = stored_in(told.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))), f"{base}/found", "words")
    for k in range(t):
        remove(spark, f"{base}/step={k}")
    return out.select("lang", "phrase", "words", "f")


def with_counts(rows: DataFrame, part: str, counts: DataFrame, name: str, most: float) -> DataFrame:
    """Rows with the count of their phrase ``part`` as ``name``."""
    known = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    hot, same = F.broadcast(known.where(F.col(name) >= most)), (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p"))
    joined = lambda r, k: r.join(k, same).drop("_l", "_p")
    return joined(rows, hot).unionByName(joined(rows.join(hot, same, "left_anti"), known.where(F.col(name) < most)))


def collocations(counts: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two words or more."""
    total = counts.where("words = 0").agg(F.sum("f")).first()[0] or 0
    most, words = total / HOT, F.split("phrase", " ")
    text = lambda array: F.array_join(array, " ")
    found = counts.where("words > 1")

    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("f"), F.lit(True)))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", text(F.slice(words, F.lit(1), F.col("k"))).alias("left"), text(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k"))).alias("right"))
    cuts = with_counts(with_counts(cuts, "left", counts, "l", most), "right", counts, "r", most)
    # counts are under 10^15 and no count is above that of its parts, so all products have under 38 digits and the score under 8
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"over": (exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), "under": (exact("l") * exact("r")).cast("decimal(38,0)")})
    scored = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the best of each part of a language first, so the last step reads PARTS x top phrases of a language however many there are
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    best = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    langs = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))
