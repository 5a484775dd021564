"""From raw documents to packed sequences, one operator a stage.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.llm import toxicity
from tallyhouse.llm.common import stored, table
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.mixing import mix
from tallyhouse.llm.packing import pack
from tallyhouse.llm.partenum import similar_components

#: a document goes if its toxicity score reaches this
REJECT = 0.5
#: no source is repeated more often; every document is used at least once
REPEATS = 1.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from all labels, stays under ``REJECT``; a text without words stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model).where(F.col("score") < REJECT).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, empty and null ones being equal."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones: the least id, of one id's texts the least by their hash.

    A document is known by its id and its text, so of two texts under one id only the one that goes is removed, and of
    similar texts without an id one stays.
    """
    gone = similar_components(docs).where("not first").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    mine = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (mine == gone["gone_key"]), "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, sources as even as ``REPEATS`` allows."""
    return mix(docs, repeats=REPEATS).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids, one sequence each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: the first and the last stage are a trained model and a tokenizer, which SQL cannot express; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
