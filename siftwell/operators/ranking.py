"""Scores, boosts, penalties, filters and the final order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
FIELD_WEIGHTS = {"title": 3.0, "content": 1.0}
#: The first name that a source contains.
SOURCE_BOOSTS = (("南开大学主站", 0.3), ("南开大学教务部", 0.3), ("南开大学研究生招生网", 0.3), ("南开新闻网", 0.2))
RECENCY = ((7, 0.3), (30, 0.2), (90, 0.1), (365, 0.05))
QUALITY_ORDER = {"good": 0, "short": 1, "failed": 2, "nav_noise": 3}

#: User profiles with their name, keyword weights and source weights.
PROFILES: dict[str, tuple[str, dict[str, float], dict[str, float]]] = {
    "default": ("默认用户", {}, {}),
    "study_user": (
        "学习型用户",
        {"教务": 2.0, "课程": 1.8, "考试": 1.8, "奖学金": 1.6, "本科生教学": 1.6, "学生工作": 1.4, "教学": 1.4, "选课": 1.4, "成绩": 1.3, "培养": 1.2, "本科": 1.3, "学籍": 1.3, "毕业": 1.3, "学位": 1.3},
        {"南开大学教务部": 2.0, "计算机学院": 1.3},
    ),
    "research_user": (
        "科研型用户",
        {"科研": 2.0, "项目": 1.8, "实验室": 1.8, "论文": 1.6, "学术": 1.5, "科学研究": 1.5, "研究": 1.5, "创新": 1.3, "基金": 1.3, "课题": 1.4, "成果": 1.3, "技术": 1.2, "学科": 1.3, "导师": 1.2, "博士后": 1.2, "博士": 1.3, "硕士": 1.2, "研究生培养": 1.4},
        {"计算机学院": 1.4, "人工智能学院": 1.4},
    ),
    "admission_user": (
        "招生型用户",
        {"招生": 2.0, "研究生招生": 2.0, "推免": 1.8, "复试": 1.8, "调剂": 1.6, "博士招生": 1.5, "硕士": 1.4, "录取": 1.5, "报名": 1.3, "考试": 1.3, "面试": 1.3, "夏令营": 1.4, "申请": 1.2},
        {"南开大学研究生招生网": 2.0, "计算机学院": 1.3, "人工智能学院": 1.3},
    ),
    "news_user": (
        "新闻型用户",
        {"新闻": 2.0, "南开要闻": 1.8, "综合新闻": 1.6, "媒体南开": 1.5, "活动": 1.4, "动态": 1.3, "通知": 1.2, "公告": 1.2, "报道": 1.3, "校园": 1.2, "讲座": 1.2, "会议": 1.1},
        {"南开新闻网": 2.0, "南开大学主站": 1.5},
    ),
}


def profile(user_id: str) -> tuple[str, dict[str, float], dict[str, float]]:
    return PROFILES.get(user_id, PROFILES["default"])


def profile_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v[0]) for k, v in PROFILES.items()], "user_id string, name string")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return saturated(tf, length, F.when(mean > 0, mean).otherwise(F.lit(1.0)), k1, b)


def saturated(tf, length, mean, k1: float, b: float):
    """Of columns or of arrays of numbers."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25(postings: DataFrame, term_stats: DataFrame, corpus_stats: DataFrame, terms: DataFrame, weights: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """terms: query_id, term (repeats count). query_id, doc_id, bm25: fields' scores, weighed and summed over the terms.

    The terms meet their statistics first; what is left joins the postings, which have all that the score needs."""
    hits = postings.join(gains(term_stats, corpus_stats, terms, weights), ["field", "term"])
    part = F.when(F.col("size") > 0, F.col("gain") * saturation(F.col("tf"), F.col("size"), F.col("mean"), k1, b)).otherwise(F.lit(0.0))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("bm25"))


def gains(term_stats: DataFrame, corpus_stats: DataFrame, terms: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """terms as in bm25(). query_id, term, field, gain, mean, of the terms that the index has: all but a document's share."""
    weights = weights or FIELD_WEIGHTS
    wanted = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    stats = corpus_stats.select(F.col("n_docs").cast("double").alias("n_docs"), "avg_title_len", "avg_content_len")
    wanted = wanted.join(term_stats.where(F.col("df") > 0), "term").join(F.broadcast(stats))  # one row
    in_title = F.col("field") == "title"
    weight = F.when(in_title, F.lit(weights["title"])).otherwise(F.lit(weights["content"]))
    return wanted.select("query_id", "term", "field", (weight * F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("gain"), F.when(in_title, F.col("avg_title_len")).otherwise(F.col("avg_content_len")).alias("mean"))


def rounded(score: Column, digits: int) -> Column:
    """A sum of scores, rounded half up as a decimal, so that what lies on a half doesn't hang on a double's last bit."""
    return F.round(score.cast("decimal(30,9)"), digits).cast("double")


def recency_boost(publish_time: Column, as_of: Column) -> Column:
    age, out = F.datediff(as_of, F.try_to_date(publish_time, "y-M-d")), F.lit(0.0)
    for days, boost in reversed(RECENCY):
        out = F.when(age <= days, boost).otherwise(out)
    return out


def source_boost(source: Column, boosts=SOURCE_BOOSTS) -> Column:
    out = F.lit(0.0)
    for name, boost in reversed(boosts):
        out = F.when(source.contains(name), boost).otherwise(out)
    return out


def exact_boost(query: str | Column, title: Column, url: Column, source: Column) -> Column:
    q = F.trim(F.lower(F.lit(query) if isinstance(query, str) else query))
    title, url, source = F.lower(title), F.lower(url), F.lower(source)
    return F.when(title == q, 5.0).when(F.contains(title, q), 2.0).otherwise(0.0) + F.when(F.contains(url, q), 1.0).otherwise(0.0) + F.when(F.contains(source, q), 0.5).otherwise(0.0)


def profile_boost(title: Column, content: Column, source: Column, keywords: dict[str, float], sources: dict[str, float]) -> Column:
    text = F.concat(title, F.lit(" "), F.substring(content, 1, 500))
    parts = [F.when(text.contains(k), w).otherwise(0.0) for k, w in keywords.items()] + [F.when(source.contains(k), w).otherwise(0.0) for k, w in sources.items()]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def penalized(score: Column, quality: Column) -> Column:
    return F.when(quality == "nav_noise", F.greatest(F.lit(0.0), score - 5.0)).when(quality == "failed", F.greatest(F.lit(0.0), score * 0.3)).otherwise(score)


def quality_order(quality: Column) -> Column:
    out = F.lit(5)
    for name, k in QUALITY_ORDER.items():
        out = F.when(quality == name, k).otherwise(out)
    return out


def filtered(docs: DataFrame, source: str = "", file_type: str = "", date_from: str = "", date_to: str = "", doc_only: bool = False) -> DataFrame:
    """Dates compare as text, both ends included; documents without a date pass."""
    if source:
        docs = docs.where(F.col("source_site").contains(source))
    if file_type:
        docs = docs.where(F.col("file_type") == file_type)
    if doc_only:
        docs = docs.where(F.col("file_type") != "html")
    if date_from:
        docs = docs.where((F.col("publish_time") == "") | (F.col("publish_time") >= date_from))
    if date_to:
        docs = docs.where((F.col("publish_time") == "") | (F.col("publish_time") <= date_to))
    return docs


def scored(docs: DataFrame, as_of: Column, query: str | Column | None, user_id: str = "default", source_boosts=SOURCE_BOOSTS, keywords: dict[str, float] | None = None, sources: dict[str, float] | None = None) -> DataFrame:
    """docs with bm25: adds bm25_score, recency_boost, source_boost, (exact_boost,) personalization_score, final_score,
    pre_score, score (penalised), quality_rank. query: for exact and multi-word searches, else null."""
    _, kw, src = profile(user_id)
    kw, src = kw if keywords is None else keywords, src if sources is None else sources
    recency, source = recency_boost(F.col("publish_time"), as_of), source_boost(F.col("source_site"), source_boosts)
    docs = docs.select("*", recency.alias("recency_boost"), source.alias("source_boost"))
    pre = rounded(F.col("bm25") + F.col("recency_boost") + F.col("source_boost"), 4)
    if query is not None:
        docs = docs.withColumn("exact_boost", exact_boost(query, F.col("title"), F.col("url"), F.col("source_site")))
        pre = pre + F.col("exact_boost")
    personal = profile_boost(F.col("title"), F.col("content"), F.col("source_site"), kw, src)
    docs = docs.select("*", rounded(F.col("bm25"), 4).alias("bm25_score"), pre.alias("pre_score"), personal.alias("personalization_score"))
    return docs.select(
        "*",
        rounded(F.col("pre_score") + F.col("personalization_score"), 3).alias("final_score"),
        penalized(F.col("pre_score"), F.col("content_quality")).alias("score"),
        quality_order(F.col("content_quality")).alias("quality_rank"),
    )


def final_order(rank_by: str = "score") -> list[Column]:
    """The whole chain of stable sorts as one key. rank_by: score, final_score, or date."""
    tail = [F.desc("score"), F.desc("quality_rank"), F.desc("final_score"), F.desc("pre_score"), F.asc("doc_id")]
    return {"score": tail, "final_score": [F.desc("final_score"), *tail], "date": [F.desc("publish_time"), *tail]}[rank_by]


def page_of(ranked: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    if page < 1 or page_size < 1:
        raise ValueError("pages and their sizes begin at 1")
    return ranked.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
