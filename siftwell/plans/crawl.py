"""A crawl in micro-batches: schedule, fetch, parse, keep what is new, enqueue what was found, save the state.

Under the crawl's path lie tables by batch: docs (the corpus), raw (HTML by doc_id), files (attachments as they came),
snapshots, errors, progress, and the state from which the next batch goes on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import dom, text, urls
from siftwell.operators import frontier, quality
from siftwell.schema import DOCUMENT
from siftwell.sources import tables

Fetch = Callable[[DataFrame], DataFrame]
STATE = ["norm_url", "url", "source_site", "category", "anchor_text", "parent_url", "priority", "seq"]
SNAPSHOTS = 50


def table(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """All batches of a table (before a given one), None if there are none yet."""
    try:
        rows = spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def written(rows: DataFrame, path: str, name: str, batch: int) -> DataFrame:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    return rows.sparkSession.read.parquet(f"{path}/{name}/batch={batch}")


def crawl(
    spark: SparkSession, path: str, seeds: DataFrame | None, fetch: Fetch, domains: Iterable[str], batch_size: int = 1000, batches: int = 10, balanced: bool = True,
    fetch_files: Fetch | None = None, sites: Iterable[tuple[str, str]] = (), total: int | None = None, ratio: float = 0.3,
) -> DataFrame:
    """Runs up to `batches` batches and returns the corpus so far.

    seeds: as frontier.seeds() gives them, or None to go on from the state under path. fetch: url to url, html, error;
    fetch_files: url to url, content, error; without it attachments are errors. sites: base URL and name, for pages whose
    source isn't known. total, ratio: how many documents are wanted, and a source's share before others come first.
    A batch that was broken off is run again from the state before it."""
    domains, sites = list(domains), list(sites)
    number = 0
    if total is not None and seeds is None and spark.read.parquet(f"{path}/docs").count() >= total:
        return spark.read.parquet(f"{path}/docs").drop("batch")
    if seeds is None:
        number = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()[0] + 1
        queue, visited, depleted = tables.load_checkpoint(spark, f"{path}/state/{number - 1}")
    else:
        known = [F.col(c) if c in seeds.columns else F.lit("").alias(c) for c in ("category", "anchor_text", "parent_url")]
        seeds.select("url", "source_site", "priority", "seq", *known).write.mode("overwrite").parquet(f"{path}/seeds")
        queue = frontier.enqueue(spark.read.parquet(f"{path}/seeds")).select(*STATE)
        visited, depleted = queue.select("norm_url").limit(0), queue.select("source_site").limit(0)
    seeds = spark.read.parquet(f"{path}/seeds")
    for number in range(number, number + batches):
        began = time.time()
        earlier = table(spark, path, "docs", number) if number else None
        crawled = earlier.groupBy("source_site").agg(F.count("*").alias("crawled")) if earlier is not None else None
        order = frontier.round_robin(queue, depleted, crawled, total, ratio) if balanced else frontier.by_priority(queue)
        chosen = written(order.where(F.col("position") <= batch_size).select(*STATE, "position"), path, "chosen", number)
        if not chosen.take(1):
            break
        inside = frontier.seed_info(chosen.where(urls.allowed(F.col("url"), domains)), seeds, sites)
        pages, failed_pages = fetched_pages(inside.where(~urls.is_attachment(F.col("url"))), fetch, path, number)
        files, failed_files = fetched_files(inside.where(urls.is_attachment(F.col("url"))), fetch_files, path, number)
        new = pages.join(pages.groupBy("content_hash").agg(F.min("position").alias("position")), ["content_hash", "position"], "left_semi")
        if earlier is not None:
            new = new.join(earlier.where("file_type = 'html'").select("content_hash"), "content_hash", "left_anti")
        new = written(new, path, "new", number)
        docs = documents(new, files, path, number, earlier.count() if earlier is not None else 0)
        errors = written(failed_pages.union(failed_files), path, "errors", number)
        seen = visited.union(chosen.select("norm_url")).distinct()
        rest = queue.join(chosen.select("norm_url"), "norm_url", "left_anti")
        grown = rest.unionByName(frontier.enqueue(found_links(new, domains, number), rest, seen).select(*STATE))
        # sources of which a page was read and nothing is left
        out = docs.select("source_site").distinct().join(grown.select("source_site").distinct(), "source_site", "left_anti")
        tables.save_checkpoint(f"{path}/state/{number}", grown, seen, depleted.union(out).distinct())
        progress = docs.agg(F.count("*").alias("documents")).join(pages.agg((F.count("*") - F.lit(new.count())).alias("duplicate_urls"))).join(errors.where("kind = 'fetch'").agg(F.count("*").alias("failed_urls")))  # one row each
        written(progress.withColumn("seconds", F.lit(time.time() - began)), path, "progress", number)
        spark.range(1).select(F.lit(number).alias("batch")).write.mode("append").parquet(f"{path}/done")
        queue, visited, depleted = tables.load_checkpoint(spark, f"{path}/state/{number}")
    return spark.read.parquet(f"{path}/docs").drop("batch")


def fetched_pages(asked: DataFrame, fetch: Fetch, path: str, number: int) -> tuple[DataFrame, DataFrame]:
    """Parsed pages, with what is known of them and their HTML; and the errors."""
    answers = written(fetch(asked.select("url")), path, "fetched", number).join(asked, "url")
    known = answers.where("html IS NOT NULL")
    parsed = dom.parse_pages(known.withColumnRenamed("position", "page_id")).withColumnRenamed("page_id", "position")
    parsed = parsed.join(known.select("position", "html", "source_site", "category", "parent_url"), "position")
    rows = parsed.withColumns({"content_hash": text.content_hash(F.col("title"), F.col("content")), "content_length": F.length("content"), "summary": text.summary(F.col("content"))})
    return written(rows, path, "parsed", number), answers.where("html IS NULL").select("url", "source_site", F.lit("fetch").alias("kind"), "error")


def fetched_files(asked: DataFrame, fetch_files: Fetch | None, path: str, number: int) -> tuple[DataFrame, DataFrame]:
    """Attachments with their text, and the errors, those of reading included."""
    if fetch_files is None:
        answers = asked.select("*", F.lit(None).cast("binary").alias("bytes"), F.lit("attachments aren't fetched").alias("error"))
    else:
        answers = written(fetch_files(asked.select("url")), path, "answers", number).withColumnRenamed("content", "bytes").join(asked, "url")
    kept = answers.where("bytes IS NOT NULL").withColumns({"name": urls.download_name(F.col("url")), "file_type": urls.file_type(F.col("url"))})
    texts = tables.parse_files(kept.select(F.col("url").alias("path"), "file_type", F.col("bytes").alias("content"))).drop("file_type")
    rows = kept.join(texts, kept["url"] == texts["path"]).drop("path")
    hashed = text.content_hash(F.col("name"), F.col("whole"))
    rows = written(tables.attachment_documents(rows.withColumn("whole", F.col("content"))).withColumn("content_hash", hashed).drop("whole"), path, "files", number)
    errors = answers.where("bytes IS NULL").select("url", "source_site", F.lit("fetch").alias("kind"), "error")
    return rows, errors.union(rows.where("parse_status = 'failed'").select("url", "source_site", F.lit("parse").alias("kind"), F.col("parse_error").alias("error")))


def documents(pages: DataFrame, files: DataFrame, path: str, number: int, before: int) -> DataFrame:
    """Writes the batch's documents, numbered in the order of the schedule after the `before` that are there, their raw
    HTML, and snapshots of the first SNAPSHOTS pages of the crawl. A batch has a bounded number of rows."""
    spark, none = pages.sparkSession, F.lit("")
    fields = [f.name for f in DOCUMENT.fields]

    def shaped(rows: DataFrame, **more: Column) -> DataFrame:
        rows = rows.withColumns(more)
        return rows.select("position", *(F.col(c) if c in rows.columns else none.cast(DOCUMENT[c].dataType).alias(c) for c in fields if c != "doc_id"))

    both = shaped(pages, file_type=F.lit("html"), parse_status=F.lit("ok"), parent_url=none).unionByName(shaped(files, page_role=F.lit("document")))
    both = both.withColumn("number", F.row_number().over(Window.orderBy("position")) + before)  # one batch
    both = both.withColumn("doc_id", text.document_id(F.col("number"), F.col("file_type")))
    is_page = F.col("file_type") == "html"
    earlier = table(spark, path, "snapshots", number)
    free = max(0, SNAPSHOTS - (earlier.count() if earlier is not None else 0))
    chosen = written(frontier.snapshots(both.where(is_page).join(pages.select("position", "html"), "position"), free, "position"), path, "snapshots", number)
    saved = chosen.select("doc_id", F.concat(F.lit("snapshots/"), F.col("doc_id"), F.lit(".html")).alias("saved"))
    both = both.join(saved, "doc_id", "left")
    name = urls.download_name(F.col("url"))
    both = both.withColumns(
        {
            "local_path": F.when(is_page, F.concat(F.lit("raw/"), F.col("doc_id"), F.lit(".html"))).otherwise(F.concat(F.lit("files/"), name)),
            "download_path": F.when(is_page, "").otherwise(F.concat(F.lit("files/"), name)),
            "snapshot_path": F.coalesce("saved", none),
            "crawl_time": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
        }
    )
    docs = written(both.select(*fields, "position"), path, "docs", number)
    written(docs.select("doc_id", "position").join(pages.select("position", "html"), "position").select("doc_id", "html"), path, "raw", number)
    return docs


def found_links(pages: DataFrame, domains: list[str], number: int) -> DataFrame:
    """What pages link to, in the order in which it was found: details 1, attachments 0, other links and next pages 2."""
    entry = lambda url, anchor, priority: F.struct(url.alias("url"), anchor.alias("anchor_text"), priority.alias("priority"))
    kinds = F.concat(
        F.transform("links", lambda x: entry(x["url"], x["anchor_text"], F.when(x["is_detail"], 1).when(urls.is_attachment(x["url"]), 0).otherwise(2))),
        F.transform("pagination", lambda u: entry(u, F.lit(""), F.lit(2))),
        F.transform("attachments", lambda x: entry(x["url"], x["anchor_text"], F.lit(0))),
    )
    found = pages.select("position", "source_site", "category", F.col("url").alias("parent_url"), F.posexplode(kinds).alias("k", "x"))
    arrival = (F.lit(number + 1).cast("long") * (1 << 42)) + F.col("position") * (1 << 16) + F.col("k")
    return found.select("x.*", "source_site", "category", "parent_url", arrival.alias("seq")).where(urls.allowed(F.col("url"), domains))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: the counts of files, failed_urls, duplicate_urls, crawl_elapsed, crawl_speed."""
    progress = table(spark, path, "progress").agg(F.sum("failed_urls").alias("failed_urls"), F.sum("duplicate_urls").alias("duplicate_urls"), F.round(F.sum("seconds"), 1).alias("crawl_elapsed"))
    rows = quality.file_counts(table(spark, path, "docs")).join(progress)  # one row each
    return rows.withColumn("crawl_speed", F.round(F.col("total_docs") / F.greatest(F.col("crawl_elapsed"), F.lit(0.1)), 2))


def sources(spark: SparkSession, path: str, total: int | None = None, ratio: float = 0.3) -> DataFrame:
    """Per source: crawled, queue_size, quota_max, depleted, pct, after the last batch."""
    last = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()[0]
    queue, _, depleted = tables.load_checkpoint(spark, f"{path}/state/{last}")
    return frontier.quota_report(queue, table(spark, path, "docs"), total, ratio, depleted)


def raw_html(spark: SparkSession, path: str, doc_id: str) -> str | None:
    row = table(spark, path, "raw").where(F.col("doc_id") == doc_id).first()
    return row["html"] if row else None
