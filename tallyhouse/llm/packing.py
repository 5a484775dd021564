"""Packing by power-of-two decomposition.

A document's ids are cut into whole sequences and then into pieces whose lengths are the binary
digits of what is left, longest first. Every piece is a sequence of its own, of a power-of-two
length, so no sequence crosses documents and nothing is padded; pieces of equal length form a bucket.

Ids come from the ``tokenizers`` library. Words repeat, so a worker keeps the ids of words it has
met (a bounded table); a text that is not plain Latin-1, or that holds the string of a special
token, is encoded as a whole instead, in spans that end where a word starts anyway.

Defined results: a null or empty text is the end id alone. Repeated rows are packed once each.
An empty table gives no pieces. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import KEPT, small_batches, tidy

LONGEST = 2048
END = 1
#: entries of a worker's table of words; later words are encoded each time
WORDS = 200_000
#: texts encoded as a whole go in spans of about so many characters
SPAN = 1 << 16
SAFE = re.compile(r"(?<=[a-z]) (?=[a-z])")

# Character classes of the tokenizer's word pattern within Latin-1, and the pattern itself.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r "
WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNUSUAL = re.compile("[^\t-\r -~\xa1-\xff]")

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


class Words(dict):
    """Ids of a word as little-endian 32-bit numbers, filled as words are met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < WORDS:
            self[word] = ids
        return ids


class Letters(dict):
    """What the tokenizer's model reads for a character (a sign for each of its bytes), by code point, filled as characters are met."""

    def __init__(self, spell):
        super().__init__()
        self.spell = spell

    def __missing__(self, code: int) -> str:
        self[code] = out = self.spell(chr(code))[0][0]
        return out


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer, its special strings, and the table of words; one of each in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_file(path)
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    letters, tokenize = Letters(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str), t.model.tokenize

    def encode(word: str) -> list[int]:
        return [k.id for k in tokenize(word.translate(letters))]

    return t, special, Words(encode)


KEPT["tokenizer"] = encoder.cache_clear


def spans(text: str) -> list[str]:
    """The text in pieces that encode to the same ids as the whole: cut at a space between two letters."""
    out, at = [], 0
    while len(text) - at > SPAN:
        m = SAFE.search(text, at + SPAN)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


def token_ids(path: str, text: str) -> bytes:
    """Ids of a text and the end id."""
    t, special, words = encoder(path)
    end = np.array([END], "<u4").tobytes()
    if UNUSUAL.search(text) is None and not any(s in text for s in special):
        return b"".join(map(words.__getitem__, WORD.findall(text))) + end
    parts = [text] if any(s in text for s in special) else spans(text)
    return b"".join(np.asarray(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in parts if s) + end


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Whole sequences, then the binary digits of the rest from the highest down."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(path: str, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]
    for batch in batches:
        columns, held = [[], [], [], [], []], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids, at = token_ids(path, text.as_py() or ""), 0
            for n in piece_lengths(len(ids) // 4, longest):
                for column, value in zip(columns, (doc_id.as_py(), at, n, len(ids) // 4, ids[4 * at:4 * (at + n)])):
                    column.append(value)
                at += n
            held += len(ids)
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                columns, held = [[], [], [], [], []], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), sequence, offset and ``bucket`` (the length's power of two)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence has to be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(lambda b: tidy(_cut(tokenizer_path, longest, b), "tokenizer"), SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """One folder per length; a reader takes batches of equal length from each."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(folder)
