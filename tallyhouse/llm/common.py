"""Helpers shared by the operators: reading, lineage cuts, folds, free names."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: deletes every blank of [\x20\x09-\x0D]
BLANKS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; a local one only where none is set and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyhouse-llm-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared checkpoint folder; a lost executor then costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared checkpoint folder and read again; removed when the session's process ends."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in(df: DataFrame, path: str, *by: str) -> DataFrame:
    """The frame written to a folder, parted by the columns ``by``, and read again; removed when the session's process ends."""
    spark = df.sparkSession
    df.write.partitionBy(*by).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a store has written, wherever it lies."""
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: bytes of rows that Spark hands to a worker at once
BATCH = "8m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULTS: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker gets at once by bytes: 10,000 long texts would be held several times over. A session that has set its own bound keeps it."""
    if spark.conf.get(BATCH_CONF) == _DEFAULTS.setdefault("batch", spark.newSession().conf.get(BATCH_CONF)):
        spark.conf.set(BATCH_CONF, BATCH)


#: what a worker keeps from task to task, by name: calls that drop it
KEPT: dict[str, Callable[[], None]] = {}


def give_back(keeps: str = "") -> None:
    """Drop what the worker has kept, but for ``keeps``, and return freed memory to the system."""
    for name, drop in KEPT.items():
        if name != keeps:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(out: Iterator[pa.RecordBatch], keeps: str = "") -> Iterator[pa.RecordBatch]:
    """The batches of a task, which starts without what other operators' tasks have kept in the worker and at its end gives back memory."""
    give_back(keeps)
    try:
        yield from out
    finally:
        give_back(keeps)


def whole(text: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the frame's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(labels: DataFrame, label_col: str, trains: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y): at most ``per_class`` labelled ids of each class, least by a hash of the id; ``trains`` says which ids may be used.

    A row whose label is null or neither 0 nor 1 is not labelled; an id with both labels has label 1.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & trains).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    least = [one.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    return least[0].unionByName(least[1])
