"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by hashed terms: its words, the trigrams of its bytes, and two terms for repeats (a word that
follows itself, a line that was there before), all counted, damped by a logarithm and weighted by their rarity. A
truncated singular value decomposition of a bounded sample of labelled texts gives the latent space; the sample's
vectors there are sent to all executors. Every text's cosine with each of them is computed exactly, in blocks, and the
nearest vote with their labels, weighted by similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import crc_fold, ids_and_texts, sliced, text_of, texts
from siftwell.llm.toxicity import training_sample

WORD_TERMS, GRAM_TERMS, REPEAT_TERMS = 4096, 4096, 2
TERMS = WORD_TERMS + REPEAT_TERMS + GRAM_TERMS
#: How much a repeat weighs against a word of the same rarity.
REPEAT_WEIGHT = 6.0
LATENT = 64
#: Passes of the randomised decomposition, and vectors that it carries besides those that are kept.
PASSES, SPARE = 4, 16
NEIGHBOURS = 15
SHARPNESS = 8
#: At most so many labelled texts of each label, by the order of a hash of their ids: vectors of 1.3 MB.
SAMPLE = {1: 3500, 0: 1500}
FOLDS, HELD_OUT = 4, 2
BLOCK = 256
#: Cosines count with so many decimals, so that what is equal stays equal in every block.
DECIMALS = 5


def term_counts(batch_texts: list[bytes]) -> np.ndarray:
    """Counts of hashed terms, a row for each text: words, repeats, trigrams."""
    out = np.zeros((len(batch_texts), TERMS), np.float32)
    for k, text in enumerate(batch_texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[k, :WORD_TERMS] = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_TERMS, minlength=WORD_TERMS)
        out[k, WORD_TERMS] = sum(a == b for a, b in zip(words, words[1:]))
        out[k, WORD_TERMS + 1] = len(lines) - len({*lines})
        raw = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(raw) > 2:
            gram = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
            out[k, WORD_TERMS + REPEAT_TERMS :] = np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=GRAM_TERMS)
    return out


@dataclass
class Space:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms by components
    vectors: np.ndarray  # labelled texts by components, of length 1
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = weighted(counts, self.weights) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, v: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by a power of the cosine; of equal cosines the first texts."""
        near = min(NEIGHBOURS, len(self.labels))
        out = np.zeros(len(v))
        for a in range(0, len(v), BLOCK):
            cosine = np.round(v[a : a + BLOCK] @ self.vectors.T, DECIMALS)
            at = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            last = np.take_along_axis(cosine, at, 1).min(1)
            for k in np.flatnonzero((cosine >= last[:, None]).sum(1) > near):  # a tie for the last place
                at[k] = np.argsort(-cosine[k], kind="stable")[:near]
            weight = np.maximum(np.take_along_axis(cosine, at, 1).astype(np.float64), 0) ** SHARPNESS + 1e-9
            out[a : a + BLOCK] = (weight * self.labels[at]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * weights
    for part in (v[:, : WORD_TERMS + REPEAT_TERMS], v[:, WORD_TERMS + REPEAT_TERMS :]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return v


#: The counts of a text in the sample: which terms, and how often.
Sparse = tuple[np.ndarray, np.ndarray]


def dense(rows: list[Sparse]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for k, (terms, counts) in enumerate(rows):
        out[k, terms] = counts
    return out


def fit(sample: list[Sparse], labels: np.ndarray) -> Space:
    """The sample is gone through in blocks, PASSES + 2 times; no more than a block of it is ever written out."""
    blocks = [sample[k : k + BLOCK] for k in range(0, len(sample), BLOCK)]
    found = sum((np.bincount(terms, minlength=TERMS) for terms, _ in sample), np.zeros(TERMS, np.int64))
    weights = (np.log((1 + len(sample)) / (1 + found)) + 0.1).astype(np.float32)
    weights[WORD_TERMS : WORD_TERMS + REPEAT_TERMS] *= REPEAT_WEIGHT
    carried = np.random.default_rng(7).normal(size=(TERMS, LATENT + SPARE)).astype(np.float32)
    for _ in range(PASSES):
        grown = np.zeros_like(carried)
        for rows in blocks:
            part = weighted(dense(rows), weights)
            grown += part.T @ (part @ carried)
        carried = np.linalg.qr(grown)[0].astype(np.float32)
    image = np.concatenate([weighted(dense(rows), weights) @ carried for rows in blocks])
    basis = np.ascontiguousarray(carried @ np.linalg.svd(image, full_matrices=False)[2].T[:, :LATENT]).astype(np.float32)
    space = Space(weights, basis, np.zeros((0, LATENT), np.float32), labels.astype(np.float32))
    space.vectors = np.concatenate([space.project(dense(rows)) for rows in blocks])
    return space


def sample_counts(sample: DataFrame) -> tuple[list[int], np.ndarray, list[Sparse]]:
    """Ids, labels and counts of the sample, by id. Texts stay in the executors; what comes, as bytes, has at most TERMS
    numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found = texts(batch.column(2))
            rows = [(np.flatnonzero(x).astype("<i4").tobytes(), x[x > 0].astype("<f4").tobytes()) for k in range(0, len(found), BLOCK) for x in term_counts(found[k : k + BLOCK])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t for t, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())], ["doc_id", "label", "terms", "counts"])

    found = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, terms binary, counts binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    return [r["doc_id"] for r in found], np.array([r["label"] for r in found]), [(np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in found]


def with_scores(rows: DataFrame, docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """The columns of rows with a score, a double, in the place of the last, a text. Nothing is shuffled."""
    _, known, counts = sample_counts(training_sample(docs, labels, "quality", folds, held_out, SAMPLE))
    space = fit(counts, known) if counts else None
    sent = rows.sparkSession.sparkContext.broadcast(space)  # bounded by the sample's parameter
    last = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(rows.columns[-1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches, last):
            found = texts(batch.column(last))
            parts = [found[k : k + BLOCK] for k in range(0, len(found), BLOCK)]
            scores = [own.vote(own.project(term_counts(p))) if own else np.ones(len(p)) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no terms: their cosines are 0, and they get the share of label 1 among the first of the
    sample. A null doc_id isn't held out. Repeated rows each get the score of their text. Other columns play no part. An
    empty table gives no rows; without labelled rows every score is 1."""
    scored = with_scores(ids_and_texts(docs), docs, labels, folds, held_out).withColumnRenamed("text", "score")
    return scored.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that aren't rejected, with all columns, whatever their names. Nulls, empty texts, repeated rows
    and empty tables as in score_quality()."""
    rows = docs.select(F.struct("*").alias("row"), text_of(docs).alias("score"))
    return with_scores(rows, docs, labels, FOLDS, HELD_OUT).where(F.col("score") >= threshold).select("row.*")
