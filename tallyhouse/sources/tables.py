"""Reading tables, typed rows and small lookups."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def scan_named(spark: SparkSession, *parts: str) -> DataFrame:
    """A catalog table by its qualified name."""
    return spark.table(".".join(p for p in parts if p))


def typed_rows(spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """Rows with a declared schema, for small reference lists such as bounds and mappings."""
    return spark.createDataFrame(list(rows), schema)


def inventory(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) of tables by their folder; -1 for one that is not there or cannot be read.

    A count without columns is taken from the row counts in the files' footers, so no column is read. Each
    table is counted by itself, so a broken one does not keep the others from being told.
    """
    return spark.createDataFrame([(name, row_count(spark, path)) for name, path in paths.items()], "table_name string, row_count bigint")


def row_count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except (PySparkException, Py4JJavaError) as e:  # not there; not a table
        log.warning("%s cannot be counted: %s", path, str(e).split("\n")[0])
        return -1
