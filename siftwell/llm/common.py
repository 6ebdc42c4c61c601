"""What the operators share: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of what a Python worker treats at once, so that it holds a few MB of text whatever the rows are like.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: A key is hot if it has more than this share's inverse of all rows: there are so many hot keys at most.
HOT_KEYS = 1000
#: Rows (of a few numbers each) that a table may have to be sent to all executors without looking at its keys.
SENT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, by the bounds above; text: the number of the text column. The session's own
    settings bound what Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right"))
            stop = min(max(most, at + 1), at + BATCH_ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as empty: other columns, whatever their names, go no further."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint in the shared folder of the cluster.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a temporary one is made, which is
    right for one machine only, so anything but a local master is refused."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the path, or to the shared folder, and read again."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame) -> DataFrame:
    """file and at, which are different for every row and the same whenever the result is read, and row, a struct of all columns.

    They come from where a row stands in its Parquet file. What isn't read from such files is written first."""
    for rows in (docs, None):
        if rows is None:
            rows = stored(docs)
        elif rows._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":  # may repeat or mix rows
            continue
        try:
            place = rows.metadataColumn("_metadata")
            return rows.select(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"), F.struct("*").alias("row"))
        except AnalysisException:  # files of another format
            if rows is not docs:
                raise
    raise AssertionError


def in_row(name: str) -> Column:
    """doc_id or text of the struct that keyed() makes; null text as empty."""
    column = F.col("row")[name]
    return F.coalesce(column.cast("string"), F.lit("")) if name == "text" else column.cast("long")


def join_sized(rows: DataFrame, table: DataFrame, on: list[str], how: str, size: str, total: int) -> DataFrame:
    """rows joined (inner, left or left_semi) with a table that has one row per key and, in the column `size`, how many
    of the `total` rows have the key. Hot keys, HOT_KEYS at most, are sent to all executors, and their rows stay where
    they are; only keys of few rows are shuffled together. A table of SENT_ROWS at most, which it is if there are no more
    rows, is sent as a whole."""
    if total <= SENT_ROWS:
        return rows.join(F.broadcast(table), on, how)
    is_hot = F.col(size) > total / HOT_KEYS
    hot = F.broadcast(table.where(is_hot))  # HOT_KEYS rows at most
    cold = rows.join(F.broadcast(table.where(is_hot).select(*on)), on, "left_anti").join(table.where(~is_hot), on, how)
    return rows.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(cold)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column in a row, and where each begins (one more entry for the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    raw, at = utf8(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall in fold null."""
    return F.crc32(doc_id.cast("string")) % folds
