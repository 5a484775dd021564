"""Hash buckets that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_hash(c: Column | str) -> Column:
    """The first seven hex digits of the md5 of the text form, as a number."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def bucket(c: Column | str, n: int) -> Column:
    """A stable value in ``0..n-1``. Where one row needs several buckets, store the hash once and use slot()."""
    return slot(stable_hash(c), n)


def slot(hashed: Column | str, n: int) -> Column:
    return ((F.col(hashed) if isinstance(hashed, str) else hashed) % F.lit(n)).cast("int")
