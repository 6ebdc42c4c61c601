"""Corpus statistics and the data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that speak for navigation.
NOISE_WORDS = (
    "信息公开", "图书馆", "服务指南", "登录邮箱", "办公网", "新闻中心", "最新动态", "学院公告", "学生工作通知", "首 页", "学校概况", "学校简介",
    "上一条", "下一条", "打印", "关闭", "设为首页", "加入收藏", "联系我们", "版权所有", "津ICP备", "津公网安备",
)
#: Titles of columns; the report knows only these.
COLUMN_TITLES = (
    "最新动态", "学院公告", "学生之窗", "科研信息", "本科生教学", "研究生教学", "研究生招生", "党团园地",
    "就业信息", "国际交流", "境外交流", "学生工作通知", "新闻中心", "通知公告", "学术活动", "校园生活",
)
#: What a missing value counts as, by distribution.
DIMENSIONS = {"source_site": "未知", "page_role": "unknown", "file_type": "html", "content_quality": "unknown", "parse_status": "ok"}


def column(docs: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(docs[name], F.lit(default)) if name in docs.columns else F.lit(default)


def distributions(docs: DataFrame) -> DataFrame:
    """dimension, value, n, pct for every dimension in one pass over the documents."""
    rows = docs.select(*(column(docs, d, default).alias(d) for d, default in DIMENSIONS.items()))
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("dimension")), 1))


def file_counts(docs: DataFrame) -> DataFrame:
    """One row: total_docs and a count for each kind of file."""
    kind, n = column(docs, "file_type", "html"), F.count_if
    known = ("html", "pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "ppt", "pptx")
    return docs.agg(
        F.count("*").alias("total_docs"),
        n(kind == "html").alias("html_pages"),
        *(n(kind == k).alias(f"{k}_files") for k in ("pdf", "doc", "docx", "xls", "xlsx")),
        n(kind.isin("zip", "rar")).alias("zip_files"),
        n(kind.isin("ppt", "pptx")).alias("ppt_files"),
        n(~kind.isin(*known)).alias("other_files"),
    )


def crawl_summary(fetches: DataFrame, elapsed: float) -> DataFrame:
    """fetches: status (ok, failed, duplicate). crawled, failed_urls, duplicate_urls, crawl_speed."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return fetches.agg(is_("ok").alias("crawled"), is_("failed").alias("failed_urls"), is_("duplicate").alias("duplicate_urls")).withColumn(
        "crawl_speed", F.round(F.col("crawled") / F.lit(max(elapsed, 0.1)), 2)
    )


def noise_score(title: Column, content: Column, words=NOISE_WORDS) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(title, w) | F.contains(content, w)))


def noise_documents(docs: DataFrame, words=NOISE_WORDS, least: int = 5) -> DataFrame:
    score = noise_score(column(docs, "title"), column(docs, "content"), words)
    return docs.select("doc_id", score.alias("noise_score")).where(F.col("noise_score") >= least)


def misclassified(docs: DataFrame, titles=COLUMN_TITLES) -> DataFrame:
    return docs.where((column(docs, "page_role") == "detail") & column(docs, "title").isin(*titles)).select("doc_id", "url", "title", "source_site")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, 1)).otherwise(0.0)


def duplicate_counts(docs: DataFrame) -> DataFrame:
    """Rows less distinct URLs; rows less distinct non-empty hashes, so that every empty hash counts."""
    url, key = column(docs, "url"), column(docs, "content_hash")
    return docs.agg(
        (F.count("*") - F.countDistinct(url)).alias("duplicate_urls"),
        (F.count("*") - F.countDistinct(F.when(key != "", key))).alias("duplicate_content_hashes"),
    )


def validation(docs: DataFrame, noise_words=NOISE_WORDS, titles=COLUMN_TITLES) -> DataFrame:
    """The report's figures in one row, from one aggregation and the distribution of sources."""
    title, content = column(docs, "title"), column(docs, "content")
    n, total = F.count_if, F.count("*")
    quality, role = column(docs, "content_quality", "unknown"), column(docs, "page_role", "unknown")
    short = (F.length(content) > 0) & (F.length(content) < 100)
    figures = docs.agg(
        total.alias("total_docs"),
        n((title == "") | (title == "无标题")).alias("no_title_count"),
        n(F.trim(F.regexp_replace(content, r"(?U)\s+", "")) == "").alias("empty_content_count"),
        n(short).alias("short_content_count"),
        F.coalesce(F.floor(F.sum(F.length(content)) / F.greatest(total, F.lit(1))), F.lit(0)).alias("avg_content_length"),
        n(noise_score(title, content, noise_words) >= 5).alias("suspected_noise_docs"),
        n(role == "document").alias("document_count"),
        n((role == "detail") & title.isin(*titles)).alias("list_misclassify_count"),
        n(quality == "nav_noise").alias("nav_noise_count"),
        n(quality == "failed").alias("failed_count"),
    )
    sites = docs.groupBy(column(docs, "source_site", "未知").alias("site")).agg(F.count("*").alias("k"))
    largest = sites.agg(F.max_by("site", F.struct("k", "site")).alias("max_source_site"), F.max("k").alias("largest"))
    rows = figures.join(F.broadcast(largest)).join(F.broadcast(duplicate_counts(docs)))  # one row each
    t = F.col("total_docs")
    for part, name in (("no_title_count", "no_title_ratio"), ("empty_content_count", "empty_content_ratio"), ("short_content_count", "short_content_ratio"), ("document_count", "document_pct"), ("failed_count", "failed_pct"), ("largest", "max_source_site_pct")):
        rows = rows.withColumn(name, share(F.col(part), t))
    return rows.drop("largest").withColumn("warnings", warnings())


def warnings() -> Column:
    c = F.col
    found = F.array(
        F.when(c("max_source_site_pct") > 50, F.concat(F.lit("最大 source_site ["), c("max_source_site"), F.lit("] 占比 "), c("max_source_site_pct").cast("string"), F.lit("% > 50%"))),
        F.when(c("document_count") == 0, "document 数量为 0，无法支撑文档查询与下载功能"),
        F.when(c("short_content_count") * 2 > c("total_docs"), F.concat(F.lit("短正文比例 "), c("short_content_ratio").cast("string"), F.lit("% > 50%"))),
        F.when(c("nav_noise_count") * 5 > c("total_docs"), F.concat(F.lit("nav_noise 样本过多: "), c("nav_noise_count").cast("string"), F.lit(" 条"))),
        F.when(c("list_misclassify_count") > 0, F.concat(F.lit("疑似 list 误判为 detail: "), c("list_misclassify_count").cast("string"), F.lit(" 条"))),
    )
    return F.filter(found, lambda w: w.isNotNull())


def verdicts(report: DataFrame) -> DataFrame:
    """report with title_check and content_check: FAIL beyond 5 % without title and 10 % without text."""
    check = lambda c, most: F.when(F.col(c) > most, "FAIL").otherwise("PASS")
    return report.withColumn("title_check", check("no_title_ratio", 5)).withColumn("content_check", check("empty_content_ratio", 10))


def url_pattern(url: Column) -> Column:
    found = F.regexp_extract(url, r"https?://[^/]+(/[^/]+/[^/]+/?)", 1)
    return F.when(found == "", "other").otherwise(found)


def breakdown(docs: DataFrame) -> DataFrame:
    """kind, value, n: failed texts by source (10 most), type and URL pattern (15 most); short ones by role and source."""
    content = column(docs, "content")
    failed = column(docs, "content_quality") == "failed"
    short = (F.length(content) > 0) & (F.length(content) < 100)
    pair = lambda on, kind, value: F.when(on, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    source = column(docs, "source_site", "未知")
    pairs = F.array(
        pair(failed, "failed_by_source", source),
        pair(failed, "failed_by_type", column(docs, "file_type", "html")),
        pair(failed, "failed_by_pattern", url_pattern(column(docs, "url"))),
        pair(short, "short_by_role", column(docs, "page_role", "unknown")),
        pair(short, "short_by_source", source),
    )
    counts = docs.select(F.explode(pairs).alias("p")).where("p IS NOT NULL").groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    limit = F.when(F.col("kind") == "failed_by_source", 10).when(F.col("kind") == "failed_by_pattern", 15).otherwise(1 << 30)
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def samples(docs: DataFrame, where: Column, limit: int, preview: int = 150) -> DataFrame:
    """The first documents by doc_id that meet a condition, with previews."""
    content = column(docs, "content")
    return docs.where(where).orderBy("doc_id").limit(limit).select(
        "doc_id", column(docs, "url").alias("url"), F.substring(column(docs, "title"), 1, 100).alias("title"), F.length(content).alias("content_length"),
        F.substring(content, 1, preview).alias("content_preview"), column(docs, "page_role", "unknown").alias("page_role"), column(docs, "source_site", "未知").alias("source_site"),
    )


def random_sample(docs: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """n documents, by the order of a hash of the seed and their ids."""
    return docs.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id")).cast("binary")), "doc_id").limit(n)


def service_statistics(docs: DataFrame, index, searches: DataFrame) -> DataFrame:
    """One row of what a running service tells of itself: counts of files, index_docs, index_terms (of texts),
    index_title_terms, search_count. index: an operators.index.Index."""
    of_index = index.statistics().select(F.col("doc_count").alias("index_docs"), F.col("term_count").alias("index_terms"), F.col("title_term_count").alias("index_title_terms"))
    return file_counts(docs).join(of_index).join(searches.agg(F.count("*").alias("search_count")))  # one row each
