"""Words of texts as numbers, and sequences of them that occur more than once in their own text.

Several texts are worked on in one row of numbers. A number belongs to one text, so what two texts
have in common is never mistaken for a repeat, and a sequence across a border occurs only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text worked on together; a longer text is worked on alone, read in blocks of this size
CHUNK = 1 << 20


def blocks(raw: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in parts that end at a space, so that no word is cut."""
    at = 0
    while len(raw) - at > size:
        end = raw.find(b" ", at + size)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


class Words:
    """``ids`` of the words `[^\\x20\\x09-\\x0D]+` of several texts; text i has ids[begin[i]:begin[i + 1]], and ``spelled`` turns an id into its word."""

    def __init__(self, texts: list[bytes]):
        self.spelled: list[bytes] = []
        parts, begin = [], [0]
        for raw in texts:
            known: dict[bytes, int] = {}
            first, n = len(self.spelled), 0
            for block in blocks(raw):
                ids = np.array([known.setdefault(w, len(known)) for w in block.split()], np.int64)
                parts.append(ids + first)
                n += len(ids)
            self.spelled.extend(known)
            begin.append(begin[-1] + n)
        self.ids, self.begin = np.concatenate([np.zeros(0, np.int64), *parts]), np.array(begin)

    def joined(self, ids: np.ndarray) -> bytes:
        """The words joined by one space."""
        return b" ".join(b" ".join(map(self.spelled.__getitem__, ids[i:i + CHUNK].tolist())) for i in range(0, len(ids), CHUNK))


def ranked(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for keys that occur twice or more, by place (-1 elsewhere); those places by key, in order; and where a key starts among them."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, at = keys[order], places[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(keys) else np.zeros(0, bool)
    at, new = at[often], new[often]
    out = np.full(n, -1, np.int64)
    out[at] = np.cumsum(new) - 1
    return out, at, new


def singles(ids: np.ndarray) -> np.ndarray:
    """Numbers of the words that occur twice or more in their text, -1 for others."""
    return np.where(np.bincount(ids)[ids] > 1, ids, -1) if len(ids) else ids


def pairs(left: np.ndarray, right: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences made of the one at a place and the one ``shift`` places on, as of ``ranked``; what occurs once cannot be part of a repeat."""
    n = len(left)
    places = np.flatnonzero((left[:max(n - shift, 0)] >= 0) & (right[shift:] >= 0)) if shift < n else np.zeros(0, np.int64)
    return ranked(left[places] * (right.max(initial=0) + 1) + right[places + shift], places, n)


def by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes, together about ``size``; null counts as empty."""
    for batch in batches:
        texts, held, first = [], 0, 0
        for i, text in enumerate(batch.column(column)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(raw)
            held += len(raw)
            if held >= size or i + 1 == batch.num_rows:
                yield batch.slice(first, len(texts)), texts
                texts, held, first = [], 0, i + 1
