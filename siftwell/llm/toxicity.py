"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of the lower-cased text; its value is the log ratio of its smoothed
frequencies among toxic and other training texts. A logistic regression on these values is trained with both classes
weighing the same. The training rows are a bounded sample of the labelled ones; every text is scored whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import crc_fold, cut, ids_and_texts, sliced

GRAMS = range(2, 7)
HASH_BITS = 20
#: Characters that are looked at together.
WINDOW = 1 << 19
#: At most so many training rows of each label, by the order of a hash of their ids.
SAMPLE = {1: 1200, 0: 2400}
#: Features that stay: those whose log ratio, weighed by how often it decides, is the largest.
KEPT = 3_000
LEAST_TEXTS = 3
STEPS, RATE, RIDGE = 200, 0.05, 1e-3
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    """weights: by hashed n-gram, 0 for those that don't count."""

    weights: np.ndarray
    bias: float

    def score(self, batch_texts: list[str]) -> np.ndarray:
        docs, grams = present(batch_texts, self.weights != 0)
        z = np.bincount(docs, self.weights[grams], len(batch_texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def present(batch_texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text number and hashed n-gram. Blanks count as one space, and a text is read as if between two.
    Windows of bounded size are gone through, whatever the length of a text."""
    spaced = [" " + " ".join(t.lower().split()) + " " for t in batch_texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
    most, pairs = max(GRAMS), [np.zeros(0, np.int64)]
    for a in range(0, len(points), WINDOW):
        part = points[a : a + WINDOW + most - 1]
        text = np.searchsorted(ends, np.arange(a, a + len(part)), "right")
        mixed = part * np.uint32(2654435761)
        found = []
        for n in range(2, min(most, len(part)) + 1):
            mixed = mixed[: len(part) - n + 1] * np.uint32(0x9E3779B1) + part[n - 1 :] * np.uint32(0x85EBCA6B)
            if n not in GRAMS:
                continue
            m = min(len(mixed), WINDOW)
            gram = ((mixed[:m] ^ (mixed[:m] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASH_BITS)
            keep = text[:m] == text[n - 1 : n - 1 + m]
            if wanted is not None:
                keep &= wanted[gram]
            found.append(np.unique(text[:m][keep] << HASH_BITS | gram[keep]))
        pairs.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))
    joint = np.unique(np.concatenate(pairs))
    return joint >> HASH_BITS, joint & ((1 << HASH_BITS) - 1)


def blocks(n: int, size: int = 200) -> Iterator[slice]:
    return (slice(k, k + size) for k in range(0, n, size))


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias. rows: which features each training text has; ratio: their log ratios."""
    ones = int(labels.sum())
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    value = ratio[col]
    weight, bias = np.zeros(len(ratio)), 0.0
    share_of = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones))
    first, second = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for k in range(1, STEPS + 1):  # Adam
        z = np.bincount(row, value * weight[col], len(labels)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * share_of
        slope = np.append(np.bincount(col, value * error[row], len(ratio)) + RIDGE * weight, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def gram_counts(sample: DataFrame) -> DataFrame:
    """gram, zeros, ones: in how many texts of each label of the sample an n-gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in sliced(batches, 1):
            labels, found = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in blocks(len(found)):
                docs, grams = present(found[part])
                for label in (0, 1):
                    counts[label] += np.bincount(grams[labels[part][docs] == label], minlength=1 << HASH_BITS)
        there = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[0, there]), pa.array(counts[1, there])], ["gram", "zeros", "ones"])

    found = sample.select("label", "text").mapInArrow(run, "gram long, zeros long, ones long")
    return found.groupBy("gram").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def kept_grams(counts: DataFrame, zeros: int, ones: int) -> list:
    """gram, ratio of the KEPT n-grams whose log ratio, weighed by the difference of their shares, is the largest; ties by gram."""
    ratio = F.log(((F.col("ones") + 1) / (ones + 2)) / ((F.col("zeros") + 1) / (zeros + 2)))
    gain = F.abs(ratio * (F.col("ones") / ones - F.col("zeros") / zeros))
    rows = counts.where(F.col("zeros") + F.col("ones") >= LEAST_TEXTS).select("gram", ratio.alias("ratio"), F.round(gain, 12).alias("gain"))
    return rows.where("gain > 0").orderBy(F.desc("gain"), "gram").limit(KEPT).collect()


def train(sample: DataFrame) -> Model:
    """sample: doc_id, label, text. Texts stay in the executors: what comes to the driver is the kept n-grams, KEPT at
    most, and which of them each text of the sample has. Without texts of both labels every score is the smoothed share
    of label 1."""
    sample = cut(sample)
    of_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zeros, ones = of_label.get(0, 0), of_label.get(1, 0)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if not ones or not zeros:
        return Model(weights, float(np.log((ones + 1) / (zeros + 1))))
    kept = kept_grams(gram_counts(sample), zeros, ones)
    grams, ratio = np.array([r["gram"] for r in kept], np.int64), np.array([r["ratio"] for r in kept])
    column = np.full(1 << HASH_BITS, -1, np.int32)
    column[grams] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found, rows = batch.column(2).to_pylist(), []
            for part in blocks(len(found)):
                docs, own = present(found[part], column >= 0)
                rows += [column[own[docs == k]].astype("<i4").tobytes() for k in range(len(found[part]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    rows = sorted(sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features binary").collect())
    weight, bias = fit([np.frombuffer(r["features"], "<i4") for r in rows], np.array([r["label"] for r in rows]), ratio)
    weights[grams] = ratio * weight
    return Model(weights, bias)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: dict[int, int]) -> DataFrame:
    """doc_id, label, text of a bounded sample of labelled documents outside the held-out fold, in the order of a hash of
    doc_id. A document with several labels counts with the largest, one with several texts with the least; labels other
    than 0 and 1, null ones included, are left out."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(crc_fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(n) for k, n in sample.items()]
    chosen = parts[0].union(parts[1])
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by the sample's parameter
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no n-grams and get the score of the bias. A null doc_id isn't held out. Repeated rows
    each get the score of their text. Other columns play no part. An empty table gives no rows; without labels of both
    kinds scores are constant."""
    model = train(training_sample(docs, labels, "toxic", folds, held_out, SAMPLE))
    used = np.flatnonzero(model.weights)
    sparse, bias = (used, model.weights[used]), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << HASH_BITS, np.float32)
        weights[sparse[0]] = sparse[1]
        own = Model(weights, bias)
        for batch in sliced(batches, 1):
            found = batch.column(1).to_pylist()
            scores = np.concatenate([own.score(found[part]) for part in blocks(len(found))]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = ids_and_texts(docs).mapInArrow(run, SCHEMA)
    return scored.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
