"""The corpus pipeline: what quality and duplicates leave of the documents, mixed and packed.

Each stage works on all that its predecessor kept and calls one operator with production parameters. Rows are judged, not
ids: null and repeated ids, repeated rows, null and empty texts and columns of any names go through, as each stage says.
An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import exact_dedup, mixing, packing, quality_knn, simhash
from siftwell.llm.common import discard, scratch, stored, table
from siftwell.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; rows with the same text have the same score."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the smallest doc_id; one without an id only if no equal text has one."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (shingles of five words, similarity 0.8 or more) one row, chosen likewise. All
    texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture of their sources. Null and empty sources are one."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; sequences follow the mixture. A written table has no
    order, so the places are worked out again."""
    places = mixing.mix(docs.select("doc_id", "text", "source"), with_row=True).select("position", "row.doc_id", "row.text")
    return packing.pack_documents(places, VOCABULARY, position="position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL can't express the classifier, the fingerprints or the packing; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage leaves is written to the shared folder, and deleted when the next one's
    stands; only the last stage's input stays, since the result is read from it."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = stage(spark, docs, sf_dir), path
        path = scratch(spark)
        docs = stored(docs, path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
