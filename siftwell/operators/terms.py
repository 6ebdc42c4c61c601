"""Which terms a query means: wildcards over the vocabulary, similar terms by edit distance, candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DISTANCE = 2


def wildcard_regex(pattern: str) -> str:
    """Anchored; * is any run of characters, ? is one, everything else stands for itself."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.sub(r"([^\w\s])", r"\\\1", c)) for c in pattern) + "$"


def fits(pattern: str, term: Column) -> Column:
    """Whether a pattern fits a term. What stands before its first wildcard is a prefix that a scan can push down."""
    if not pattern:
        return F.lit(False)
    prefix = re.split(r"[*?]", pattern, maxsplit=1)[0]
    if prefix == pattern:
        return term == pattern
    begins = term.startswith(prefix) if prefix else F.lit(True)
    return begins if pattern == prefix + "*" else begins & term.rlike("(?s)" + wildcard_regex(pattern))


def wildcard_terms(vocabulary: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """The terms that a pattern fits."""
    return vocabulary.where(fits(pattern.lower() if ignore_case else pattern, F.col("term")))


def similar_terms(vocabulary: DataFrame, queries: DataFrame, max_distance: int = MAX_DISTANCE, limit: int = 10) -> DataFrame:
    """queries: query_term. query_term, term, distance, rank of the nearest terms, ties by greater length, then term.

    Terms within the distance differ in length by no more, so the join is on the length."""
    wanted = queries.select("query_term").distinct()
    reach = F.explode(F.sequence(F.length("query_term") - max_distance, F.length("query_term") + max_distance))
    wanted = wanted.select("query_term", reach.alias("size"))
    sized = vocabulary.select("term", F.length("term").alias("size"))
    near = sized.join(wanted, "size").withColumn("distance", F.levenshtein("query_term", "term", max_distance)).where("distance >= 0")
    order = Window.partitionBy("query_term").orderBy("distance", F.desc("size"), "term")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_term", "term", "distance", "rank")


def expand(vocabulary: DataFrame, terms: DataFrame, max_distance: int = MAX_DISTANCE, each: int = 5) -> DataFrame:
    """terms: position, query_term. The terms themselves, then each one's nearest, each once: term, ordinal."""
    own = terms.select(F.col("query_term").alias("term"), F.struct(F.lit(0).alias("kind"), F.col("position").alias("position"), F.lit(0).alias("rank")).alias("at"))
    near = similar_terms(vocabulary, terms, max_distance, each)
    near = near.join(terms, "query_term").select("term", F.struct(F.lit(1).alias("kind"), F.col("position").alias("position"), F.col("rank")).alias("at"))
    first = own.union(near).groupBy("term").agg(F.min("at").alias("at"))
    return first.select("term", F.row_number().over(Window.orderBy("at", "term")).alias("ordinal"))  # a few terms of one query


def match_score(query: Column, target: Column) -> Column:
    """1 for equal words whatever their case, less with their distance, 0 if either is empty."""
    a, b = F.lower(query), F.lower(target)
    share = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(query, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(share)


def candidates(postings: DataFrame, terms: DataFrame, every: bool) -> DataFrame:
    """terms: query_id, term. query_id, doc_id of the documents with any of a query's terms, or with each of those
    that the index has at all."""
    wanted = terms.select("query_id", "term").distinct()
    hits = postings.select("term", "doc_id").join(wanted, "term").select("query_id", "doc_id", "term").distinct()
    if not every:
        return hits.select("query_id", "doc_id").distinct()
    needed = hits.select("query_id", "term").distinct().groupBy("query_id").agg(F.count("*").alias("needed"))
    met = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("met"))
    return met.join(needed, "query_id").where("met = needed").select("query_id", "doc_id")
