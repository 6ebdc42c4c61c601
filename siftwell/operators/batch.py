"""The best documents of many queries at once: a document's hits meet all queries in its row, and only the best go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftwell.operators.ranking import B, K1, saturated

#: Queries that one pass over the hits answers, and numbers (hits times queries) that a Python worker holds at once.
QUERIES_AT_ONCE = 256
NUMBERS = 1 << 21
#: As ranking.rounded(): digits of the sum as a decimal, and of the score.
DECIMAL, DIGITS = 10**9, 10**4


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores times DIGITS, rounded half up as a decimal."""
    step = DECIMAL // DIGITS
    return (np.floor(scores * DECIMAL + 0.5).astype(np.int64) + step // 2) // step


def best(documents: DataFrame, gains: list, needed: dict[int, int], k: int) -> DataFrame:
    """documents: doc_id, hits (array of field, term, tf, size). gains: rows of query_id (0, 1, ...), term, field, gain,
    mean. needed: of queries that want every term, how many. query_id, doc_id, score: of each task the k best of each query,
    ties by doc_id; the k best of all are among them."""
    count = 1 + max((g["query_id"] for g in gains), default=-1)
    fields = ("title", "content")
    terms = sorted({g["term"] for g in gains})
    at = {t: n for n, t in enumerate(terms)}
    gain, asked, mean = np.zeros((len(terms) * 2, count)), np.zeros((len(terms), count), np.int32), np.ones(2)
    for g in gains:
        field = fields.index(g["field"])
        gain[at[g["term"]] * 2 + field, g["query_id"]] = g["gain"]
        asked[at[g["term"]], g["query_id"]] = 1
        mean[field] = g["mean"] if g["mean"] > 0 else 1.0
    least = np.array([needed.get(q, 1) for q in range(count)], np.int32)
    sent = documents.sparkSession.sparkContext.broadcast((terms, gain, asked, mean, least))
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, gain, asked, mean, least = sent.value
        known, count = pa.array(terms, pa.string()), len(least)
        # what is best so far: query, score, document
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        limit = np.full(count, -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            hits, ends = pc.list_flatten(lists), np.cumsum(sizes)
            term = np.array(pc.index_in(pc.struct_field(hits, "term"), known), np.int64)
            field = np.where(np.array(pc.equal(pc.struct_field(hits, "field"), "title"), bool), 0, 1)
            tf, size = (np.array(pc.struct_field(hits, n), np.float64) for n in ("tf", "size"))
            part = np.where(size > 0, saturated(tf, size, mean[field], K1, B), 0.0)
            first = 0
            while first < len(sizes):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + max(1, NUMBERS // max(1, count)), "right")))
                some = first + np.flatnonzero(sizes[first:last])
                begins, here = ends[some] - sizes[some] - before, slice(before, ends[last - 1])
                first = last
                if not len(some):
                    continue
                scores = np.add.reduceat(part[here, None] * gain[term[here] * 2 + field[here]], begins)
                # a term counts once for a document, in whichever field it stands
                owner = np.repeat(np.arange(len(some)), sizes[some])
                each = np.unique(owner * len(terms) + term[here])
                met = np.add.reduceat(asked[each % len(terms)], np.searchsorted(each // len(terms), np.arange(len(some))))
                score = rounded(scores)
                row, query = np.nonzero((met >= least) & (score >= limit))
                found = ids.take(pa.array(some[row]))
                both = found if top[2] is None else pa.concat_arrays([top[2], found])
                queries, score = np.concatenate([top[0], query]), np.concatenate([top[1], score[row, query]])
                order = np.lexsort((np.array(pc.rank(both, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")), -score, queries))
                ordered = queries[order]
                place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
                order, ordered, place = order[place < k], ordered[place < k], place[place < k]
                top = (ordered, score[order], both.take(pa.array(order)))
                full = place == k - 1
                limit[ordered[full]] = top[1][full]
        if top[2] is not None and len(top[0]):
            yield pa.RecordBatch.from_arrays([pa.array(top[0], pa.int32()), top[2], pa.array(top[1] / DIGITS)], names=["query_id", "doc_id", "score"])

    return documents.select("doc_id", "hits").mapInArrow(run, schema)
