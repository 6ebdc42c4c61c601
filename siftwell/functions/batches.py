"""Python over Arrow batches in slices of bounded size, so that a worker holds a few MB beside what Spark sends at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bounds of a slice.
ROWS, BYTES = 500, 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], sized: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of the bounds above, one row at least. sized: the number of the column that has the bytes."""
    for batch in batches:
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(sized)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
            stop = min(max(most, at + 1), at + ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def mapped(rows: DataFrame, sized: str, row: Callable[..., Iterable], schema: str) -> DataFrame:
    """row(*values of rows' columns) for each row: the values of the schema's columns. sized: the column that has the bytes."""
    number, types = rows.columns.index(sized), T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, number):
            out = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, types)
