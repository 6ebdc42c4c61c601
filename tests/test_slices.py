"""Python workers treat pages and files in slices of bounded size."""

import pyarrow as pa

from siftwell.functions import batches


def test_slices():
    sizes = [10, 0, batches.BYTES, 5, None, *[batches.BYTES // 4] * 9, *[1] * 1200]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else "x" * n for n in sizes])], names=["n", "t"])
    parts = list(batches.sliced(iter([whole.slice(0, 0), whole, whole.slice(3, 4)]), 1))
    assert [n for p in parts for n in p.column(0).to_pylist()] == [*range(len(sizes)), 3, 4, 5, 6]
    assert all(p.num_rows <= batches.ROWS and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= batches.BYTES) for p in parts)


def test_rows_keep_their_values(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (None, "")], "n long, t string").coalesce(1)
    found = batches.mapped(rows, "t", lambda n, t: (n, [{"x": t}]), "n long, a array<struct<x:string>>")
    assert [(r["n"], r["a"][0]["x"]) for r in found.collect()] == [(1, "ab"), (2, None), (None, "")]
