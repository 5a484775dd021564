"""Writing tables. Plain parquet has no MERGE, UPDATE or DELETE, so row changes are
expressed as a new version of the affected rows or partitions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType


#: Spark's switch for removing a query's shuffle files when the query ends
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Java compiles no method of more bytes and interprets it row by row, several times slower; Spark runs a stage that holds one operator by operator, in compiled pieces
LONGEST_METHOD, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
#: shuffled bytes that one task takes where every task writes a file for each month
TASK_SIZE, DEALT_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 64 << 20


@contextmanager
def session_set(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold in here only."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def byte_count(text: str) -> int:
    """Bytes of a size as Spark's settings hold it, such as 8m, 64MB or 1048576b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that end in here leave no shuffle files; by default these stay until the driver happens to collect the plan."""
    return session_set(spark, {DROP_SHUFFLES: "true"})


def writing(spark: SparkSession, rebalance: bool) -> AbstractContextManager[None]:
    """Settings for storing a table: shuffles go when it is written, no stage runs uncompiled, and rows written as they lie come in
    tasks of ``DEALT_BYTES`` at least, so that files grow with the rows and not with the number of shuffle partitions."""
    settings = {DROP_SHUFFLES: "true", LONGEST_METHOD: str(min(COMPILED_BYTES, int(spark.conf.get(LONGEST_METHOD))))}
    if not rebalance:
        settings[TASK_SIZE] = f"{max(DEALT_BYTES, byte_count(spark.conf.get(TASK_SIZE)))}b"
    return session_set(spark, settings)


def rebuild(df: DataFrame, path: str, partition_by: str | None = None, rebalance: bool = True) -> None:
    """Replace a table by the rows of a query.

    With a partition column the rows are rebalanced on it first: adaptive execution merges
    small partitions and splits a hot one, so no single task writes a whole hot month.
    ``rebalance=False`` saves that shuffle for rows that the query itself has dealt out evenly
    just before (or reads by the same partitions): each task then writes a file for each of its months (see ``writing``).
    Files are packed by zstd: stored tables are full of long keys and texts. The shuffles of the query go when the table is written,
    so a chain of tables takes the disk of its largest step and of the tables, not of all steps.
    """
    with writing(df.sparkSession, rebalance or not partition_by):
        if partition_by:
            (df.hint("rebalance", partition_by) if rebalance else df).write.mode("overwrite").option(
                "partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(partition_by).parquet(path)
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Save as a catalog table, or append to one; also registers nothing else."""
    writer = df.write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def merge_update(target: DataFrame, source: DataFrame, key: str, when: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Matched-update merge: rows with a partner in ``source`` that pass ``when`` take the new values.

    ``changes`` may use target columns by name and source columns as ``src_<name>``; ``source``
    holds one row per key.
    """
    renamed = source.select(F.col(key), *[F.col(c).alias(f"src_{c}") for c in source.columns if c != key],
                            F.lit(True).alias("_matched"))
    joined = target.join(renamed, [key], "left")
    hit = F.coalesce(F.col("_matched") & when, F.lit(False))
    return joined.select(*[
        F.when(hit, changes[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in target.columns])


def replace_slices(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Swap only the partitions present in ``df``; other slices stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def backfill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(defaults))


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` replace the target rows with the same key."""
    kept = target.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def update_by_key(target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set columns on every target row whose key has an update (one update per key)."""
    return merge_update(target, updates, key, F.lit(True), {c: F.col(f"src_{c}") for c in columns})


def _touched(target: DataFrame, keys: DataFrame, on: Sequence[str], partition_by: str) -> list:
    """Partitions that hold a row with one of the keys; only these columns are read, and as many values come back as partitions are rewritten."""
    return [r[0] for r in target.select(*on, partition_by).join(keys, list(on), "left_semi").select(partition_by).distinct().collect()]


def _rewrite(rows: DataFrame, path: str, partition_by: str) -> None:
    """Replace the partitions that ``rows`` hold. The new files are staged beside the old ones and take their place when all are
    written, so a failed write leaves the table as it was, and who has opened it before reads the old rows. A hot partition is written by many tasks."""
    rows.hint("rebalance", partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def _within(values: list, column: str) -> Column:
    known = [v for v in values if v is not None]
    return F.col(column).isin(*known) | (F.col(column).isNull() if None in values else F.lit(False))


def merge_into(spark: SparkSession, path: str, schema: StructType, source: DataFrame, key: str, when: Column, changes: Mapping[str, Column], partition_by: str) -> int:
    """Matched-update merge into a stored table (see ``merge_update``); the number of partitions rewritten.

    Partitions without a matching row are neither read in full nor written. Changes must not touch the partition column.
    """
    if partition_by in changes:
        raise ValueError(f"{partition_by} is the partition column")
    target = spark.read.schema(schema).parquet(path)
    touched = _touched(target, source.select(key).distinct(), [key], partition_by)
    if touched:
        _rewrite(merge_update(target.where(_within(touched, partition_by)), source, key, when, changes), path, partition_by)
    return len(touched)


def upsert_into(spark: SparkSession, path: str, schema: StructType, updates: DataFrame, keys: Sequence[str], partition_by: str) -> int:
    """Write-through update of a stored table: rows of ``updates`` replace those with the same key, wherever these lie, or are added.

    Rewrites the partitions that held such a key and those that take the new rows, no others.
    """
    names = [f.name for f in schema.fields]
    target, updates = spark.read.schema(schema).parquet(path).select(names), updates.select(names)
    touched = set(_touched(target, updates.select(*keys).distinct(), keys, partition_by)) | {r[0] for r in updates.select(partition_by).distinct().collect()}
    if touched:
        rows = upsert_by_key(target.where(_within(list(touched), partition_by)), updates, keys)
        left = {r[0] for r in rows.select(partition_by).distinct().collect()}
        _rewrite(rows, path, partition_by)
        for value in touched - left:  # every row has moved elsewhere
            drop_partition(spark, path, partition_by, value)
    return len(touched)


def drop_partition(spark: SparkSession, path: str, partition_by: str, value) -> None:
    """Remove one folder of a partitioned table."""
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_by}={name}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def add_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows that may carry more columns than the table had."""
    return old.unionByName(new, allowMissingColumns=True)


def empty_shell(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Carry column comments in the schema, from where the writer stores them."""
    return df.select(*[
        F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns])


def describe_columns(df: DataFrame, table: str) -> list[tuple[str, str, str, str]]:
    return [(table, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for f in df.schema.fields]


def stored_comments(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(table_name, column_name, type, comment) as the files of each table hold them; columns without a comment have ''."""
    rows = [r for table, path in tables.items() for r in describe_columns(spark.read.parquet(path), table)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, comment string")


#: what an evolving table holds beside its data: its columns in order, and what older files are read with
RECORD = "_columns"


def record_columns(spark: SparkSession, path: str, schema: StructType, defaults: Mapping[str, object] | None = None) -> None:
    record = json.dumps({"schema": json.loads(nullable(schema).json()), "defaults": dict(defaults or {})})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{RECORD}")


def recorded_columns(spark: SparkSession, path: str) -> tuple[StructType, dict]:
    record = json.loads(spark.read.text(f"{path}/{RECORD}").first()[0])
    return StructType.fromJson(record["schema"]), record["defaults"]


def append_evolving(df: DataFrame, path: str, defaults: Mapping[str, object] | None = None) -> StructType:
    """Add rows that may carry more columns than the stored table, or fewer. Files that are there stay as they are.

    A column keeps the type that it was recorded with; a new one is recorded behind the others, before its rows are
    written. ``defaults`` says what older rows have in new columns (null where it says nothing).
    """
    spark = df.sparkSession
    try:
        known, told = recorded_columns(spark, path)
    except AnalysisException:  # no table yet
        known, told = StructType([]), {}
    types = {f.name: f.dataType for f in known.fields}
    wrong = [f"{f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in df.schema.fields if types.get(f.name, f.dataType) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    old = [c for c in defaults or {} if c in types]
    if old:
        raise ValueError(f"not new: {', '.join(old)}")
    schema = StructType([*known.fields, *[f for f in nullable(df.schema).fields if f.name not in types]])
    if schema != known:
        record_columns(spark, path, schema, {**told, **(defaults or {})})
    df.write.mode("append").parquet(path)
    return schema


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All rows with the recorded columns; what a file does not hold is null, or the default of its column."""
    schema, defaults = recorded_columns(spark, path)
    return spark.read.schema(schema).parquet(path).fillna(defaults) if defaults else spark.read.schema(schema).parquet(path)


def record_failures(results: DataFrame, path: str) -> DataFrame:
    """Keep the failing checks as a table; a clean run leaves it empty."""
    failures = results.where(~F.col("passed"))
    failures.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.schema(failures.schema).parquet(path)


def nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
