"""Quality rules: counts with fixed limits, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Single words and pairs of adjacent words fall into buckets by hash. Their multinomials are counted over all documents
(the raw corpus) and over all documents that a label calls good (the trusted target). A text's score
is the mean log ratio of its n-grams, target against raw; a fixed threshold decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import ids_and_texts

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 8192
#: Documents whose n-grams are on average this much likelier raw than trusted are dropped.
THRESHOLD = -0.5
MIN_WORDS = 50
WINDOW = 3
#: Up to so many distinct repeated windows are looked up one by one; more are found by sorting. The result is the same.
LOOKED_UP = 48


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_hashes(docs: DataFrame) -> DataFrame:
    rows = ids_and_texts(docs).withColumn("words", words_of(F.col("text")))
    return rows.select("doc_id", "text", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def pair_hashes(h: Column) -> Column:
    """One less than the words; empty for fewer than two."""
    pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0)))


def bucket_counts(h: Column) -> Column:
    return F.concat(h, pair_hashes(h))


def bucket(x: Column, buckets: int) -> Column:
    return F.pmod(x, F.lit(buckets).cast("long")).cast("int")


def counts_by_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    grams = word_hashes(docs).select(F.explode(bucket_counts(F.col("h"))).alias("x"))
    return grams.groupBy(bucket(F.col("x"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket's smoothed share among trusted to that among all documents; one
    number per bucket. Labels are joined to the plain texts, which are shuffled once at most, and not their words."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    texts = ids_and_texts(docs)
    of_good = texts.where("doc_id IS NOT NULL").join(good.hint("shuffle_hash"), "doc_id", "left_semi")
    sides = counts_by_bucket(texts, buckets).withColumn("side", F.lit("raw")).union(counts_by_bucket(of_good, buckets).withColumn("side", F.lit("trusted")))
    counts = sides.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("side") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("raw", "trusted"))).collect()
    raw, trusted = [1.0] * buckets, [1.0] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        trusted[r["bucket"]] += r["trusted"]
    if sum(trusted) == buckets:  # nothing is trusted
        return [0.0] * buckets
    of_raw, of_trusted = sum(raw), sum(trusted)
    return [math.log(t / of_trusted) - math.log(r / of_raw) for t, r in zip(trusted, raw)]


def repeated_places(windows: Column, twice: Column, ordered: Column) -> Column:
    """Positions, ascending, of the windows that occur twice or more. twice: their distinct values. ordered: windows
    and positions, sorted; read only where there are more than LOOKED_UP values."""
    at = lambda k: F.get(ordered, k)["w"]
    looked_up = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))
    by_sorting = F.array_sort(F.transform(F.filter(ordered, lambda x, k: (x["w"] == at(k + 1)) | (x["w"] == at(k - 1))), lambda x: x["i"]))
    return F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= LOOKED_UP, looked_up).otherwise(by_sorting)


def covered_words(places: Column, size: int = WINDOW) -> Column:
    """How many words the windows at these positions cover."""
    new = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
    return F.aggregate(new, F.lit(0), lambda a, x: a + x)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. kept is false if
    base_failed, else whether llr (the mean log ratio, 0 without n-grams) reaches the threshold.

    Null and empty texts have no words and fail. Repeated rows and null ids each give a row; a null id is never
    trusted. An empty table gives no rows; without trusted documents every llr is 0."""
    ratios = log_ratios(docs, labels, buckets)
    table = F.split(F.lit(",".join(f"{x:.9f}" for x in ratios)), ",").cast("array<double>")
    text, h, windows = F.col("text"), F.col("h"), F.col("windows")
    rows = word_hashes(docs)
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, BLANK_CHARS) != "")
    raw_windows = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    rows = rows.select(
        "doc_id",
        "h",
        F.length(without(text, BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.slice(raw_windows, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))).alias("windows"),
    )
    rows = rows.withColumn("sorted", F.sort_array("windows"))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: x == F.get("sorted", i + 1))))
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size("twice") > LOOKED_UP, ordered))
    rows = rows.withColumn("places", repeated_places(windows, F.col("twice"), F.col("ordered")))
    grams = bucket_counts(h)
    llr = F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.get(table, bucket(x, buckets))) / F.greatest(2 * F.size(h) - 1, F.lit(1))
    n_words, n_repeat = F.size("h").cast("long"), covered_words(F.col("places")).cast("long")
    rows = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        llr.alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
