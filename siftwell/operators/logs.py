"""Search and click logs as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.schema import CLICK_LOG, SEARCH_LOG


def create(spark: SparkSession, path: str) -> None:
    """Empty tables, unless they are there."""
    for name, schema in (("search_logs", SEARCH_LOG), ("click_logs", CLICK_LOG)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")


def log_search(spark: SparkSession, path: str, user_id: str, query: str, search_type: str, filters: str = "", result_count: int = 0, at: str | None = None) -> None:
    row = spark.range(1).select(
        F.unix_micros(F.current_timestamp()).alias("id"), F.lit(user_id).alias("user_id"), F.lit(query).alias("query"), F.lit(search_type).alias("search_type"),
        F.lit(filters).alias("filters"), F.lit(result_count).alias("result_count"), F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
    )
    row.toDF(*SEARCH_LOG.names).write.mode("append").parquet(f"{path}/search_logs")


def log_click(spark: SparkSession, path: str, user_id: str, query: str, doc_id: str, title: str = "", url: str = "", at: str | None = None) -> None:
    row = spark.range(1).select(
        F.unix_micros(F.current_timestamp()).alias("id"), *(F.lit(x) for x in (user_id, query, doc_id, title, url)), F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
    )
    row.toDF(*CLICK_LOG.names).write.mode("append").parquet(f"{path}/click_logs")


def page(logs: DataFrame, time: str, user_id=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The latest rows, of one user or all, ties by id."""
    rows = logs if user_id is None else logs.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc(time), F.desc("id")).offset(offset).limit(limit)


def popular_queries(logs: DataFrame, limit: int = 10) -> DataFrame:
    return logs.groupBy("query").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "query").limit(limit)


def search_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"))
