"""Structured Streaming: log counts by window, first occurrences, and an index that grows by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators import index


def log_counts(stream: DataFrame, time: str = "search_time", by: str = "query", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each value in tumbling windows; rows later than the watermark allows are dropped by Spark."""
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), by, "n")


def first_seen(stream: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def grow_index(stream: DataFrame, path: str, checkpoint: str, stop_words: tuple[str, ...] = ()) -> StreamingQuery:
    """Add every micro-batch of documents to the saved index. A restart that runs a batch again replaces it."""

    def add(batch: DataFrame, number: int) -> None:
        index.append(batch.sparkSession, path, batch, number + 1, stop_words)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and read its result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(path)
    return then(out) if then else out
