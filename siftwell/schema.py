"""The records of the engine as Spark types. Every field may be null; readers put the defaults in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


DOCUMENT = T.StructType(
    [
        *strings("doc_id", "url", "title", "content"),
        T.StructField("content_length", T.IntegerType()),
        *strings("content_quality", "summary", "source_site", "category", "publish_time", "file_type", "page_role"),
        *strings("local_path", "download_path", "snapshot_path", "content_hash", "crawl_time", "parse_status", "parse_error"),
        *strings("parent_url", "parent_title"),
    ]
)
SEARCH_LOG = T.StructType(
    [T.StructField("id", T.LongType()), *strings("user_id", "query", "search_type", "filters"), T.StructField("result_count", T.IntegerType()), *strings("search_time")]
)
CLICK_LOG = T.StructType([T.StructField("id", T.LongType()), *strings("user_id", "query", "doc_id", "title", "url", "click_time")])
SEEDS = T.StructType(
    [
        T.StructField("allowed_domains", T.ArrayType(T.StringType())),
        T.StructField(
            "sources",
            T.ArrayType(
                T.StructType(
                    [
                        *strings("name", "site_tag", "base_url"),
                        T.StructField("seed_urls", T.ArrayType(T.StructType(strings("url", "category", "page_role")))),
                    ]
                )
            ),
        ),
    ]
)
FRONTIER = T.StructType(
    [*strings("url", "anchor_text", "source_site", "category", "parent_url"), T.StructField("priority", T.IntegerType()), T.StructField("seq", T.LongType())]
)

#: What a missing field counts as.
DEFAULTS = {"title": "", "content": "", "url": "", "source_site": "", "publish_time": "", "file_type": "html", "content_quality": "", "summary": ""}


def with_defaults(docs: DataFrame) -> DataFrame:
    """docs with every column of DEFAULTS, nulls replaced."""
    for name, value in DEFAULTS.items():
        docs = docs.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in docs.columns else F.lit(value))
    return docs
