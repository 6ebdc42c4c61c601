"""Search suggestions: from the log, from titles, and frequent phrases of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import quoted

COLUMNS = ("text", "type", "score", "ordinal")
TITLE_CHARS, TITLE_SCORE, PHRASE_FACTOR = 30, 0.5, 0.7
PHRASE_SIZES = range(2, 8)


def top(rows: DataFrame, order: list[Column], limit: int, factor: float, kind: str) -> DataFrame:
    """rows: text, cnt. The first in the order, scored against the largest count among them."""
    best = rows.orderBy(*order).limit(limit)
    ordinal = F.row_number().over(Window.orderBy(*order))  # over `limit` rows
    best = best.select("text", "cnt", ordinal.alias("ordinal"), F.max("cnt").over(Window.partitionBy()).alias("most"))
    return best.select("text", F.lit(kind).alias("type"), (F.col("cnt") / F.col("most") * factor).alias("score"), "ordinal")


def from_history(logs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    rows = logs.where(F.lower("query").startswith(prefix.lower())).groupBy(F.col("query").alias("text")).agg(F.count("*").alias("cnt"), F.max("search_time").alias("last"))
    return top(rows, [F.desc("cnt"), F.desc("last"), F.asc("text")], limit, 1.0, "history")


def popular(logs: DataFrame, limit: int = 10) -> DataFrame:
    rows = logs.groupBy(F.col("query").alias("text")).agg(F.count("*").alias("cnt"))
    return top(rows, [F.desc("cnt"), F.asc("text")], limit, 1.0, "hot")


def from_titles(docs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Titles from where they contain the prefix on, whatever its case; the first in the order of doc_id."""
    at = F.locate(prefix.lower(), F.lower("title"))
    found = docs.where(at > 0).select("doc_id", F.trim(F.substr(F.col("title"), at, F.lit(TITLE_CHARS))).alias("text")).where("text <> ''")
    first = found.groupBy("text").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id", "text").limit(limit)
    ordinal = F.row_number().over(Window.orderBy("doc_id", "text"))  # over `limit` rows
    return first.select("text", F.lit("title").alias("type"), F.lit(TITLE_SCORE).alias("score"), ordinal.alias("ordinal"))


def phrases(titles: DataFrame, prefix: str) -> DataFrame:
    """text and n of all pieces of 2 to 7 characters of the titles that begin with the prefix, overlaps included; a text may
    come in several rows."""
    longest, sizes = max(PHRASE_SIZES), [n for n in PHRASE_SIZES if n >= len(prefix)]
    if not sizes:
        return titles.select(F.col("title").alias("text"), F.lit(0).cast("long").alias("n")).limit(0)
    # every place where the prefix stands, with what follows it
    places = F.regexp_extract_all("title", F.lit(f"(?s)(?=({quoted(prefix)}.{{0,{longest - len(prefix)}}}))"), F.lit(1))
    found = titles.where(F.col("title").contains(prefix)).select(F.explode(places).alias("place"))
    counted = found.groupBy("place").agg(F.count("*").alias("n"))
    pieces = F.filter(F.array(*(F.when(F.length("place") >= n, F.substring("place", 1, n)) for n in sizes)), lambda x: x.isNotNull())
    return counted.select(F.explode(pieces).alias("text"), "n")


def from_phrases(docs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    counts = phrases(docs.select("title"), prefix).groupBy("text").agg(F.sum("n").alias("cnt"))
    return top(counts, [F.desc("cnt"), F.asc("text")], limit, PHRASE_FACTOR, "hot")


def suggestions(docs: DataFrame, logs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """text, type, score. History, titles and phrases in this order, each text once, cut to the limit, then by score."""
    if not prefix:
        return popular(logs, limit).orderBy("ordinal").select("text", "type", "score")
    parts = (from_history(logs, prefix, limit), from_titles(docs, prefix, limit), from_phrases(docs, prefix, limit))
    rows = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.union(p.withColumn("part", F.lit(k)))
    at = F.struct("part", "ordinal")
    first = rows.groupBy("text").agg(F.min_by(F.struct("type", "score"), at).alias("x"), F.min(at).alias("at")).orderBy("at").limit(limit)
    return first.orderBy(F.desc("x.score"), "at").select("text", "x.type", "x.score")
