"""Quality rules: counts over a text's words and lines, then compression bands.

A text that the rules on its words pass is compressed with zstandard, as a whole and in fixed chunks
of ``CHUNK`` bytes. The ratio of its bytes to the compressed ones has to lie in a band: above it text
repeats itself, below it nothing in it recurs (keys, encoded data, noise). Ratios of sound text rise
with its length, so the band depends on the length: limits are given at powers of two and drawn
straight in between, over the logarithm of the length. A text goes if it is out of the band as a whole, or
if chunks out of their band hold more than ``SHARE`` of its bytes.

Defined results: a null, empty or blank text has zero counts and fails the base rule (it has fewer
than ``LEAST_WORDS`` words). A null id passes through, repeated rows are judged each, an empty
table gives no rows. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.grams import Words, by_size, pairs, singles

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """Bytes, lowest and highest ratio at that length (the first and last hold beyond), zstandard level, chunk bytes, share of bytes."""

    lengths: tuple[int, ...] = (256, 1024, 4096, 16384, 65536, 1048576)
    low: tuple[float, ...] = (0.9, 1.3, 1.4, 1.5, 1.5, 1.5)
    high: tuple[float, ...] = (2.4, 3.0, 3.6, 4.2, 4.8, 5.5)
    level: int = 3
    chunk: int = 4096
    share: float = 0.25

    def sound(self, size: int, packed: int) -> bool:
        at, ratio = np.log2(max(size, 1)), size / packed
        x = np.log2(self.lengths)
        return bool(np.interp(at, x, self.low) <= ratio <= np.interp(at, x, self.high))


BANDS = Bands()
JUDGED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, bad_bytes bigint, kept boolean"
NAMES = [c.split()[0] for c in JUDGED.split(", ")]


def repeated_words(words: Words) -> np.ndarray:
    """Which words lie in a 3-word window that its text holds twice or more."""
    one = singles(words.ids)
    at = pairs(pairs(one, one, 1)[0], one, 2)[1]
    inside = np.zeros(len(words.ids), bool)
    for k in range(3):
        inside[at + k] = True
    return inside


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def chunks_of(raw: bytes, size: int) -> list[bytes]:
    """Chunks of ``size`` bytes; the last one takes a rest of under a quarter of it."""
    n = max(1, (len(raw) + size * 3 // 4) // size)
    return [raw[i * size:(i + 1) * size if i + 1 < n else len(raw)] for i in range(n)]


def compressed(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole, bytes in chunks out of their band, verdict."""
    size = len(packer.compress(raw))
    bad = sum(len(c) for c in chunks_of(raw, bands.chunk) if not bands.sound(len(c), len(packer.compress(c))))
    return len(raw) / size, bad, bands.sound(len(raw), size) and bad <= bands.share * len(raw)


def _judge(bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=bands.level)
    for part, texts in by_size(batches, 1):
        words = Words(texts)
        total = np.concatenate(([0], np.cumsum(repeated_words(words))))
        n_words, n_repeat = np.diff(words.begin), np.diff(total[words.begin])
        failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
        # code points are the bytes that continue no other one
        chars = [len(raw) - sum(map(raw.count, (bytes([b]) for b in BLANKS))) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)) for raw in texts]
        symbols = [sum(raw.count(s) for s in SYMBOLS) for raw in texts]
        verdict = [(None, None, False) if f else compressed(raw, bands, packer) for raw, f in zip(texts, failed)]
        ratio, bad, kept = zip(*verdict)
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.array(n_words), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array([repeated_lines(raw) for raw in texts], pa.int64()),
            pa.array(n_repeat), pa.array(failed), pa.array(ratio, pa.float64()), pa.array(bad, pa.int64()), pa.array(kept, pa.bool_())], NAMES)


def judge(docs: DataFrame, bands: Bands = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, ratio, bad_bytes, kept); ratio and bad_bytes are null where the base rule has decided."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(lambda b: _judge(bands, b), JUDGED)
