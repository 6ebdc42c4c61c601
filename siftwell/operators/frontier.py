"""The crawl frontier as a table: url, source_site, category, anchor_text, parent_url, priority, seq (arrival).

The order of a static frontier is exact; what a running crawl adds comes in the next micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import urls

UNKNOWN_SOURCE = "其他"


def seeds(config: DataFrame) -> DataFrame:
    """From the nested seed file: url, source_site, category, page_role, priority, seq."""
    rows = config.select(F.posexplode("sources").alias("s", "source")).select("s", F.col("source.name").alias("source_site"), F.posexplode("source.seed_urls").alias("u", "seed"))
    role = F.coalesce("seed.page_role", F.lit("list"))
    rows = rows.select("s", "u", F.col("seed.url").alias("url"), "source_site", F.coalesce("seed.category", F.lit("")).alias("category"), role.alias("page_role"))
    ranked = rows.withColumn("priority", urls.priority(F.col("url"), F.col("page_role"), F.lit(False)))
    return ranked.withColumn("seq", F.col("s").cast("long") * (1 << 20) + F.col("u")).drop("s", "u")


def enqueue(found: DataFrame, queued: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """found: url, source_site, priority, seq. Adds norm_url; each once, the first to arrive, unless queued or visited (norm_url) already."""
    source = F.when(F.coalesce("source_site", F.lit("")) == "", UNKNOWN_SOURCE).otherwise(F.col("source_site"))
    rows = found.withColumn("norm_url", urls.normalize(F.col("url"))).where("norm_url <> ''").withColumn("source_site", source)
    rows = rows.withColumn("priority", F.greatest(F.lit(0), F.least(F.lit(3), F.col("priority"))))
    for seen in (queued, visited):
        if seen is not None:
            rows = rows.join(seen.select("norm_url"), "norm_url", "left_anti")
    names = [c for c in rows.columns if c != "norm_url"]
    first = rows.groupBy("norm_url").agg(F.min_by(F.struct(*names), F.struct("seq", "url")).alias("r"))
    return first.select("norm_url", "r.*")


def source_order(rows: DataFrame) -> DataFrame:
    """source_site, source_ordinal: the order in which sources first arrived. One row per source."""
    first = rows.groupBy("source_site").agg(F.min("seq").alias("first_seq"))
    return first.select("source_site", F.row_number().over(Window.orderBy("first_seq", "source_site")).alias("source_ordinal"))


#: Orders are counted in stretches of about so many URLs, so that a source with most of the queue is dealt out.
STRETCH = 100_000
#: With more active sources than this each has a quota.
QUOTA_FROM = 3


def numbered(rows: DataFrame, name: str, stretches: list[Column], order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds name: 1, 2, ... in the order of the stretches and, in each, of the columns `order`; for each value of the
    columns `within` anew. Stretches are numbered one by one and added up: only their sizes are ordered together."""
    within = within or []
    marks = [f"_s{k}" for k in range(len(stretches))]
    rows = rows.select("*", *(s.alias(m) for s, m in zip(stretches, marks)))
    sizes = rows.groupBy(*within, *marks).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*within).orderBy(*marks)) - F.col("_n")
    place = F.row_number().over(Window.partitionBy(*within, *marks).orderBy(*order))
    placed = rows.withColumn("_k", place).join(sizes.select(*within, *marks, so_far.alias("_before")), [*within, *marks])
    return placed.withColumn(name, F.col("_before") + F.col("_k")).drop("_k", "_before", *marks)


def quota_left(sources: DataFrame, crawled: DataFrame | None, total: int | None, ratio: float) -> DataFrame:
    """sources: source_site, source_ordinal of those that have URLs. Adds turns_left, how many more each may get before
    the others, null without a limit: one is set where more than three sources are active. crawled: source_site, crawled."""
    if crawled is None or not total or ratio <= 0:
        return sources.withColumn("turns_left", F.lit(None).cast("long"))
    active = F.count("*").over(Window.partitionBy())  # a row per source
    limit = F.greatest(F.lit(int(total * ratio)).cast("long"), F.lit(1).cast("long"), F.floor(F.lit(total) / active).cast("long"))
    rows = sources.withColumn("limit", F.when(active > QUOTA_FROM, limit)).join(crawled.groupBy("source_site").agg(F.sum("crawled").alias("crawled")), "source_site", "left")
    left = F.greatest(F.lit(0).cast("long"), F.col("limit") - F.coalesce("crawled", F.lit(0)))
    return rows.withColumn("turns_left", F.when(F.col("limit").isNotNull(), left)).drop("limit", "crawled")


def round_robin(rows: DataFrame, depleted: DataFrame | None = None, crawled: DataFrame | None = None, total: int | None = None, ratio: float = 0.3) -> DataFrame:
    """Adds source_ordinal, turn, turns_left, and position of the balanced schedule: one of each source in turn, by
    priority and arrival within it. What is beyond a source's quota comes behind everything else, source by source.
    Sources that are depleted don't take part. The quota is that of the moment; a crawl asks again for every batch."""
    if depleted is not None:
        rows = rows.join(depleted.select("source_site"), "source_site", "left_anti")
    arrivals = F.floor(F.col("seq") / STRETCH)
    rows = numbered(rows, "turn", [F.col("priority"), arrivals], ["seq", "norm_url"], ["source_site"])
    sources = quota_left(source_order(rows), crawled, total, ratio)
    sources = sources.withColumn("_sources", F.count("*").over(Window.partitionBy()))  # a row per source
    rows = rows.join(sources, "source_site")
    over = F.coalesce(F.col("turn") > F.col("turns_left"), F.lit(False))
    major, minor = F.when(over, F.col("source_ordinal")).otherwise(F.col("turn")), F.when(over, F.col("turn")).otherwise(F.col("source_ordinal"))
    rows = rows.select("*", over.alias("_over"), major.cast("long").alias("_major"), minor.cast("long").alias("_minor"))
    # a stretch is some turns of all sources, or some of the sources of one turn, or some turns of one source
    wide = F.col("_over") | (F.col("_sources") > STRETCH)
    first = F.when(wide, F.col("_major")).otherwise(F.expr(f"_major DIV ({STRETCH} DIV _sources)"))
    second = F.when(wide, F.expr(f"_minor DIV {STRETCH}")).otherwise(F.lit(0))
    return numbered(rows.withColumns({"_first": first, "_second": second}), "position", [F.col("_over"), F.col("_first"), F.col("_second")], ["_major", "_minor"]).drop("_over", "_major", "_minor", "_first", "_second", "_sources")


def by_priority(rows: DataFrame) -> DataFrame:
    """Adds source_ordinal and position of the unbalanced schedule: priority, then the order of sources, then arrival."""
    rows = rows.join(source_order(rows), "source_site")
    return numbered(rows, "position", [F.col("priority"), F.col("source_ordinal"), F.floor(F.col("seq") / STRETCH)], ["seq", "norm_url"])


def quota(total: int | None, ratio: float, active: int) -> int | None:
    return max(int(total * ratio), max(1, int(total / max(1, active)))) if total and ratio > 0 else None


def quota_report(queue: DataFrame, crawled: DataFrame, total: int | None = None, ratio: float = 0.3, depleted: DataFrame | None = None) -> DataFrame:
    """queue: source_site; crawled: source_site. Per source: crawled, queue_size, quota_max, depleted, pct."""
    counts = lambda d, c: d.groupBy("source_site").agg(F.count("*").alias(c))
    rows = counts(queue, "queue_size").join(counts(crawled, "crawled"), "source_site", "full").na.fill(0)
    marked = depleted.select("source_site", F.lit(True).alias("marked")).distinct() if depleted is not None else None
    rows = rows.join(marked, "source_site", "left") if marked is not None else rows.withColumn("marked", F.lit(None).cast("boolean"))
    rows = rows.withColumn("marked", F.coalesce("marked", F.lit(False)))
    all_of = Window.partitionBy()  # one row per source
    active = F.count_if(~F.col("marked") & (F.col("queue_size") > 0)).over(all_of)
    fair = F.greatest(F.lit(1), F.floor(F.lit(total or 0) / F.greatest(F.lit(1), active))).cast("long")
    limit = F.greatest(F.lit(int((total or 0) * ratio)).cast("long"), fair) if total and ratio > 0 else F.lit(None).cast("long")
    done = F.sum("crawled").over(all_of)
    return rows.select(
        "source_site",
        "crawled",
        "queue_size",
        limit.alias("quota_max"),
        (F.col("marked") | ((F.col("queue_size") == 0) & (F.col("crawled") > 0))).alias("depleted"),
        F.when(done > 0, F.round(F.col("crawled") * 100 / done, 1)).otherwise(0.0).alias("pct"),
    )


def sizes(rows: DataFrame) -> DataFrame:
    """Queue sizes by source and priority, with totals (null source or priority)."""
    return rows.rollup("source_site", "priority").agg(F.count("*").alias("queue_size"))


def first_of_hash(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """HTML documents whose content hash arrived first; other types all stay."""
    pages, others = docs.where("file_type = 'html'"), docs.where("file_type <> 'html'")
    first = pages.groupBy("content_hash").agg(F.min(order).alias(order))
    return pages.join(first, ["content_hash", order], "left_semi").unionByName(others)


def snapshots(pages: DataFrame, cap: int = 50, order: str = "doc_id") -> DataFrame:
    """doc_id and html, with base address, of the first `cap` pages that are HTML or details."""
    chosen = pages.where("file_type = 'html' OR page_role = 'detail'").orderBy(order).limit(cap)
    return chosen.select("doc_id", urls.with_base_href(F.col("html"), F.col("url")).alias("html"))


def seed_info(rows: DataFrame, seeds_of: DataFrame, sites: list[tuple[str, str]] = ()) -> DataFrame:
    """rows: norm_url, url, source_site, category. A page's own source and category, else those of the seed with its URL;
    a source still, else, by the sites' base URLs (base URL, name). seeds_of: as seeds() gives them."""
    own = F.nullif(F.nullif(F.col("source_site"), F.lit("")), F.lit(UNKNOWN_SOURCE))
    named = seeds_of.withColumn("norm_url", urls.normalize(F.col("url"))).groupBy("norm_url").agg(F.max_by(F.struct("source_site", "category"), "seq").alias("_seed"))
    rows = rows.join(named, "norm_url", "left")
    source = F.coalesce(own, F.nullif(F.col("_seed.source_site"), F.lit("")), urls.site_name(F.col("url"), sites))
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("_seed.category"), F.lit(""))
    return rows.withColumns({"source_site": source, "category": category}).drop("_seed")
