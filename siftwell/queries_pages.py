"""Registered queries over pages: parsing, URLs, the frontier, and a whole crawl of the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import dom, text, urls
from siftwell.operators import frontier
from siftwell.plans import crawl as crawling
from siftwell.queries import CORPUS, LIST, PATH, QUEUE, ROLES, corpus, folder, page_queue, pick_sql, query, read
from siftwell.sources import tables

# --- DOM. All pages of the table have one template: title, nav, div.ad, article with h1 and p, footer.

UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"
TITLE_TAG = UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")
STRIP = "'-–—|_•·'"
CLEAN = rf"trim(trim(regexp_replace({{}}, '\s+', ' ', 'g')), {STRIP})"
SHORT = rf"CASE WHEN length(trim(string_split_regex({TITLE_TAG}, '\s*[-–—|_]\s*')[1])) < 3 THEN {TITLE_TAG} ELSE trim(string_split_regex({TITLE_TAG}, '\s*[-–—|_]\s*')[1]) END"
H1 = f"trim({UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")})"
LAST = r"regexp_replace(regexp_replace(string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/')[-1], '\.(htm|html|shtml|php|jsp|aspx?)$', ''), '[-_]', ' ', 'g')"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    f"""SELECT page_id, substr({CLEAN.format(SHORT)}, 1, 200) AS title_tag, CASE WHEN length({H1}) BETWEEN 2 AND 200 THEN substr({CLEAN.format(H1)}, 1, 200) ELSE '' END AS h1,
  '' AS h2, '' AS meta_title, '' AS placed_title, CASE WHEN length({LAST}) >= 2 THEN substr({LAST}, 1, 200) ELSE {HOST} END AS url_title FROM pages"""
)
def page_title(spark, sf_dir):
    return dom.parts_of_pages(read(spark, sf_dir, "pages")).drop("links")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Open graph ' || page_id || ' ' WHEN 1 THEN 'Named ' || page_id WHEN 2 THEN 'Short card' ELSE '' END AS meta_title,
  'Placed title ' || page_id AS placed_title, 'Second ' || page_id AS h2 FROM pages"""
)
def page_meta_title(spark, sf_dir):
    meta = F.expr(
        """CASE page_id % 4 WHEN 0 THEN concat('<meta property="og:title" content=" Open graph ', page_id, ' - "><meta name="title" content="no">') WHEN 1 THEN concat('<meta property="og:title" content="x"><meta name="title" content="Named  ', page_id, '">')
        WHEN 2 THEN '<meta name="twitter:title" content="Short card">' ELSE '' END"""
    )
    more = F.concat(F.lit("<h2>Second "), "page_id", F.lit('</h2><div class="x article-title">Placed title '), "page_id", F.lit('</div><p id="title">Short</p><article>'))
    html = F.replace(F.replace(F.col("html"), F.lit("</head>"), F.concat(meta, F.lit("</head>"))), F.lit("<article>"), more)
    return dom.parts_of_pages(read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).select("page_id", "meta_title", "placed_title", "h2")


DETAIL_LINK = rf"""CASE WHEN {LIST} THEN false WHEN regexp_matches(lower(url), '/\d{{4}}/\d{{2,4}}/c\d+a\d+/page\.htm|[?&]p=\d+|[?&]page_id=\d+') THEN true WHEN regexp_matches(lower(url), '[?&]cat=\d+') THEN false
  WHEN regexp_matches(lower(url), '/(content|detail|info|article|read|view|page|show|display)/') THEN true
  WHEN len(s) < 2 THEN false ELSE regexp_matches(s[-1], '\d{{4}}') OR (regexp_matches(s[-1], '\.(htm|html|shtml)$') AND NOT regexp_matches(s[-1], '^(index|list)')) OR regexp_matches(s[1], '^\d{{4}}$') END"""
SEGMENTS = f"list_filter(string_split(lower({PATH}), '/'), lambda x: x <> '')"


@query(
    rf"""WITH found AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t FROM pages),
  whole AS (SELECT page_id, regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || trim(href) AS url, substr(trim(t), 1, 200) AS anchor_text FROM found), cut AS (SELECT *, {SEGMENTS} AS s FROM whole)
SELECT page_id, url, anchor_text, {DETAIL_LINK} AS is_detail, count(*) AS n FROM cut GROUP BY ALL"""
)
def page_links(spark, sf_dir):
    found = dom.parts_of_pages(read(spark, sf_dir, "pages")).select("page_id", F.explode("links").alias("l"))
    return found.select("page_id", "l.*").groupBy("page_id", "url", "anchor_text", "is_detail").agg(F.count("*").alias("n"))


#: URLs of many kinds, made of the page's.
VARIANTS = ("", "/info/1", "?p=12", "/2024/05/c1a2/page.htm", "?cat=3", "/index.html", "/2024-05.htm", "/list2.htm", "/content/x", "/system/a.shtml", "/news/list.html", "/d.html")


def varied(spark, sf_dir):
    kinds = f"array({', '.join(map(repr, VARIANTS))})[cast(page_id % {len(VARIANTS)} as int)]"
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.expr(kinds)).alias("url"))


VARIED = f"SELECT page_id, regexp_replace(url, '[?#].*$', '') || [{', '.join(map(repr, VARIANTS))}][page_id % {len(VARIANTS)} + 1] AS url FROM pages"


@query(f"WITH v AS ({VARIED}), cut AS (SELECT *, {SEGMENTS} AS s FROM v) SELECT page_id, {DETAIL_LINK} AS by_columns, {DETAIL_LINK} AS by_dom FROM cut")
def detail_link(spark, sf_dir):
    """The rules as column expressions and in the parser: both are held against the SQL."""
    by_dom = F.pandas_udf(lambda u: u.map(dom.detail_link), "boolean")
    return varied(spark, sf_dir).select("page_id", urls.is_detail_link(F.col("url")).alias("by_columns"), by_dom("url").alias("by_dom"))


DETAIL_PAGE = r"""contains(u, '/info/') OR (contains(u, '/system/') AND u LIKE '%.shtml') OR contains(u, '/content/') OR contains(u, '/article/') OR regexp_matches(u, '/c\d+a\d+/page\.htm')
  OR (u LIKE '%.htm' AND NOT contains(u, '/list') AND regexp_matches(u, '/\d{4}/\d{2,4}/')) OR regexp_matches(u, '[?&]p=\d+')"""


@query(f"WITH v AS (SELECT *, lower(url) AS u FROM ({VARIED})) SELECT page_id, {DETAIL_PAGE} AS by_columns, {DETAIL_PAGE} AS by_dom FROM v")
def detail_page_url(spark, sf_dir):
    by_dom = F.pandas_udf(lambda u: u.str.lower().map(dom.detail_url), "boolean")
    return varied(spark, sf_dir).select("page_id", urls.is_detail_url(F.col("url")).alias("by_columns"), by_dom("url").alias("by_dom"))


DATES = ("<p>发布时间：2024-1-{}</p>", "<p>2023年12月{}日</p>", "<p>2022.3.{}</p>", '<meta name="pubdate" content="2021/11/{} 10:00">', "<p>no date</p>")


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-01-' WHEN 1 THEN '2023-12-' WHEN 2 THEN '2022-03-' WHEN 3 THEN '2021-11-' ELSE '' END
  || CASE WHEN page_id % 5 < 4 THEN lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS publish_time FROM pages"""
)
def page_publish_time(spark, sf_dir):
    """Dates of several forms, put into every page's text or head; the first that is found counts."""
    dates = F.replace(F.expr("array({})[cast(page_id % 5 as int)]".format(", ".join(map(repr, DATES)))), F.lit("{}"), (F.col("page_id") % 28 + 1).cast("string"))
    html = F.concat(dates, F.lit("<div class='content'>"), F.lit("A long sentence that stands here to be read. " * 5), F.lit("</div>"))
    return dom.parse_pages(read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).select("page_id", "publish_time")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-05-07' WHEN 1 THEN '1999-12-31' WHEN 2 THEN '2001-02-03' ELSE 'on ' || page_id END AS parsed FROM pages"""
)
def date_parse(spark, sf_dir):
    given = F.expr("CASE page_id % 4 WHEN 0 THEN 'at 2024/5/7 12:00' WHEN 1 THEN '1999年12月31日' WHEN 2 THEN '2001.2.3' ELSE concat('  on ', page_id, ' ') END")
    return read(spark, sf_dir, "pages").select("page_id", F.pandas_udf(lambda t: t.map(dom.parse_date), "string")(given).alias("parsed"))


# what is left of a page without script, style, nav and footer, as lines of five characters or more
BODY = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*$', '')"


def lines_sql(inner: str) -> str:
    parts = rf"list_filter(list_transform(string_split(regexp_replace({inner}, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim({UNESCAPE.format('x')})), lambda x: length(x) >= 5)"
    return rf"trim(regexp_replace(array_to_string({parts}, ' '), '\s+', ' ', 'g'))"


ARTICLE = lines_sql("regexp_extract(b, '(?s)<article>(.*?)</article>', 1)")
AD = lines_sql("regexp_extract(b, '(?s)<div class=\"ad\">(.*?)</div>', 1)")
WHOLE = lines_sql("regexp_extract(b, '(?s)<body>(.*)$', 1)")
CONTENT = f"CASE WHEN length(article) > 100 THEN article WHEN length(ad) > 80 THEN ad ELSE whole END"


@query(
    rf"""WITH bare AS (SELECT page_id, url, lower(url) AS u, html, {BODY} AS b FROM pages), parts AS (SELECT *, {ARTICLE} AS article, {AD} AS ad, {WHOLE} AS whole FROM bare),
  role AS (SELECT *, {CONTENT} AS content, CASE WHEN regexp_matches(u, '\.(pdf|doc|xls|zip|rar)') THEN 'document' WHEN ({LIST}) AND NOT contains(u, '/info/') AND NOT contains(u, '/system/') THEN 'list' ELSE 'detail' END AS page_role FROM parts)
SELECT page_id, substr({CLEAN.format(H1)}, 1, 200) AS title, content, CASE WHEN length(content) < 50 THEN 'failed' WHEN length(content) < CASE page_role WHEN 'list' THEN 200 ELSE 100 END THEN 'short' ELSE 'good' END AS content_quality,
  page_role, '' AS publish_time, CAST(0 AS INTEGER) AS n_links FROM role"""
)
def page_content_dom(spark, sf_dir):
    """Links stand in the nav only, which is gone when they are asked for."""
    return dom.parse_pages(read(spark, sf_dir, "pages")).select("page_id", "title", "content", "content_quality", "page_role", "publish_time", F.size("links").alias("n_links"))


COLUMN_WORDS = ("最新动态", "学院公告", "科研信息", "党团园地", "国际交流")


@query(
    f"""WITH c AS (SELECT doc_id, text, {pick_sql(ROLES)} AS page_role FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'failed' WHEN doc_id % 9 = 0 THEN 'nav_noise' WHEN length(text) < 50 THEN 'failed' WHEN length(text) < CASE page_role WHEN 'list' THEN 200 ELSE 100 END THEN 'short' ELSE 'good' END AS content_quality FROM c"""
)
def content_quality(spark, sf_dir):
    """Every ninth text gets the names of five columns, which makes it navigation."""
    judge = F.pandas_udf(lambda t, r: t.combine(r, dom.content_quality), "string")
    words = F.when((F.col("doc_id") % 9 == 0) & (F.length("content") > 0), F.lit(" " + " ".join(COLUMN_WORDS))).otherwise("")
    return corpus(spark, sf_dir).select("doc_id", judge(F.concat("content", words), "page_role").alias("content_quality"))


NEXT = ("下一页", "more", "Next »", "3")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host FROM pages), l AS (
  SELECT page_id, host || '/next' || page_id AS link FROM p WHERE page_id % 4 IN (0, 2) UNION ALL SELECT page_id, host || '/boxed' FROM p WHERE page_id % 4 = 3
  UNION ALL SELECT page_id, host || '/a/list' || n || '.htm' FROM p, (SELECT unnest(range(0, 30)) AS n) WHERE n BETWEEN greatest(1, page_id % 20 - 5) AND page_id % 20 + 5 AND n <> page_id % 20)
SELECT page_id, count(*) AS n_links, md5(array_to_string(list(link ORDER BY link), ' ')) AS links FROM l GROUP BY page_id"""
)
def page_pagination(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    word = F.expr("array({})[cast(page_id % 4 as int)]".format(", ".join(map(repr, NEXT))))
    boxed = F.when(F.col("page_id") % 4 == 3, F.lit("<div class='Pages'><a href='/boxed'>3</a></div>")).otherwise("")
    html = F.concat(F.lit("<a href='/next"), "page_id", F.lit("'>"), F.when(F.col("page_id") % 4 == 3, F.lit("x")).otherwise(word), F.lit("</a>"), boxed)
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/a/list"), F.col("page_id") % 20, F.lit(".htm"))
    found = dom.parse_pages(pages.select("page_id", url.alias("url"), html.alias("html"))).where(F.size("pagination") > 0)
    return found.select("page_id", F.size("pagination").cast("long").alias("n_links"), F.md5(F.array_join(F.array_sort("pagination"), " ").cast("binary")).alias("links"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/f' || page_id || '.pdf' ELSE '/d' || page_id END AS url,
  CASE page_id % 3 WHEN 0 THEN 'file' ELSE '申请表 ' || page_id END AS anchor_text FROM pages WHERE page_id % 3 < 2"""
)
def page_attachments(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    html = F.expr("CASE page_id % 3 WHEN 0 THEN concat('<a href=\"/f', page_id, '.pdf\">file</a><a href=\"#x\">附件</a>') WHEN 1 THEN concat('<a href=\"/d', page_id, '\">申请表 ', page_id, '</a>') ELSE '<a href=\"/x\">other</a>' END")
    return dom.parse_pages(pages.select("page_id", "url", html.alias("html"))).select("page_id", F.explode("attachments").alias("a")).select("page_id", "a.*")


# --- URLs


@query(rf"SELECT page_id, regexp_matches(lower({PATH}), '\.(pdf|docx?|xlsx?|zip|rar|pptx?)') AS attachment FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '/a.PDF?x' WHEN 1 THEN '?f=a.doc' ELSE '/b.pptx' END AS url FROM pages)")
def url_is_attachment(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, "/a.PDF?x").when(F.col("page_id") % 3 == 1, "?f=a.doc").otherwise("/b.pptx")
    return read(spark, sf_dir, "pages").select("page_id", urls.is_attachment(F.concat(F.regexp_replace("url", "[?#].*$", ""), end)).alias("attachment"))


SNIFFED = "SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/get' WHEN 2 THEN '/x.xlsx?y' ELSE '/down' END AS url FROM pages"
EXTENSION = "CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' ELSE '.unknown' END"


@query(f"SELECT page_id, {EXTENSION} AS extension, substr(md5(url), 1, 12) || {EXTENSION} AS file_name FROM ({SNIFFED})")
def extension_sniff(spark, sf_dir):
    end = F.expr("CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/get' WHEN 2 THEN '/x.xlsx?y' ELSE '/down' END")
    header = F.expr("""CASE page_id % 4 WHEN 1 THEN 'attachment; filename="plan of all.docx"' WHEN 3 THEN 'inline' ELSE 'attachment; filename=no.zip' END""")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), end)
    return read(spark, sf_dir, "pages").select("page_id", urls.extension(url, header).alias("extension"), urls.download_name(url, header).alias("file_name"))


@query("SELECT page_id, CAST(CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 2 END AS INTEGER) AS priority FROM pages")
def url_priority(spark, sf_dir):
    role = F.expr("CASE page_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'detail' WHEN 2 THEN 'other' WHEN 3 THEN 'portal' END")
    return read(spark, sf_dir, "pages").select("page_id", urls.priority(F.regexp_replace("url", "[?#].*$", ""), role, F.col("page_id") % 6 == 4).alias("priority"))


SITES = (("://m.", "mobile"), ("example.com", "Com"), ("", "nothing"), ("example.net", "Net"))
SITE = "CASE WHEN contains(url, '://m.') THEN 'mobile' WHEN contains(url, 'example.com') THEN 'Com' WHEN contains(url, 'example.net') THEN 'Net' ELSE '未知站点' END"


@query(f"SELECT page_id, {SITE} AS site FROM pages")
def site_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.site_name(F.col("url"), SITES).alias("site"))


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'own' WHEN page_id % 2 = 0 THEN 'seeded' ELSE {SITE} END AS source_site, CASE WHEN page_id % 3 = 0 THEN 'mine' WHEN page_id % 2 = 0 THEN 'of seed' ELSE '' END AS category FROM pages")
def seed_lookup(spark, sf_dir):
    """Even pages are seeds; every fifth page has a source, every third a category of its own. Each page's URL is made its
    own by a parameter, which stands before where a fragment would be: that isn't part of what is looked up."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "#.*$", "")
    own_url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&n=").otherwise("?n="), "page_id")
    asked = read(spark, sf_dir, "pages").select("page_id", own_url.alias("url"), F.expr("CASE WHEN page_id % 5 = 0 THEN 'own' ELSE '其他' END").alias("source_site"), F.expr("CASE WHEN page_id % 3 = 0 THEN 'mine' ELSE '' END").alias("category"))
    seeds = asked.where("page_id % 2 = 0").select("url", F.lit("seeded").alias("source_site"), F.lit("of seed").alias("category"), F.col("page_id").alias("seq"))
    asked = asked.withColumn("norm_url", urls.normalize(F.col("url")))
    return frontier.seed_info(asked, seeds, SITES).select("page_id", "source_site", "category")


# --- frontier


@query(
    f"""WITH {QUEUE}, quota AS (SELECT source_site, greatest(0, 3 - count(*) FILTER (WHERE priority = 0)) AS own FROM queue GROUP BY source_site),
  waiting AS (SELECT * FROM queue WHERE priority > 0), s AS (SELECT source_site, row_number() OVER (ORDER BY min(seq), source_site) AS source_ordinal, count(*) OVER () AS active FROM waiting GROUP BY source_site),
  turns AS (SELECT w.*, row_number() OVER (PARTITION BY w.source_site ORDER BY priority, seq, norm_url) AS turn FROM waiting w),
  marked AS (SELECT t.norm_url, t.turn, s.source_ordinal, t.turn > q.own AS beyond FROM turns t JOIN s ON s.source_site = t.source_site JOIN quota q ON q.source_site = t.source_site)
SELECT norm_url, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (ORDER BY beyond, CASE WHEN beyond THEN source_ordinal ELSE turn END, CASE WHEN beyond THEN turn ELSE source_ordinal END) AS BIGINT) AS position FROM marked"""
)
def frontier_quota(spark, sf_dir):
    """Ten documents are wanted, so a source may have three; URLs of priority 0 count as crawled."""
    queue = page_queue(spark, sf_dir)
    crawled = queue.where("priority = 0").groupBy("source_site").agg(F.count("*").alias("crawled"))
    return frontier.round_robin(queue.where("priority > 0"), None, crawled, 10).select("norm_url", "turn", "position")


@query(
    f"""WITH {QUEUE}, open AS (SELECT * FROM queue WHERE length(source_site) % 3 > 0), s AS (SELECT source_site, row_number() OVER (ORDER BY min(seq), source_site) AS source_ordinal FROM open GROUP BY source_site),
  turns AS (SELECT o.*, row_number() OVER (PARTITION BY source_site ORDER BY priority, seq, norm_url) AS turn FROM open o)
SELECT norm_url, CAST(row_number() OVER (ORDER BY turn, source_ordinal) AS BIGINT) AS position FROM turns t JOIN s ON s.source_site = t.source_site"""
)
def frontier_depleted(spark, sf_dir):
    queue = page_queue(spark, sf_dir)
    return frontier.round_robin(queue, queue.where("length(source_site) % 3 = 0").select("source_site").distinct()).select("norm_url", "position")


@query(f"WITH {QUEUE} SELECT norm_url, seq FROM queue WHERE seq % 3 = 1")
def frontier_unseen(spark, sf_dir):
    """What is queued (a third) or visited (another) already doesn't come in again."""
    queue = page_queue(spark, sf_dir)
    found = queue.select("url", "source_site", "priority", "seq")
    return frontier.enqueue(found, queue.where("seq % 3 = 0"), queue.where("seq % 3 = 2")).select("norm_url", "seq")


# --- a crawl

CRAWLED = r"""seeds AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url), asked AS (
  SELECT page_id, regexp_replace(u, '/+$', '') AS n, CASE WHEN u LIKE '%/' AND length(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1)) > 1 THEN regexp_replace(u, '/+$', '') ELSE u END AS norm_url, url
  FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM seeds)), firsts AS (SELECT min(page_id) AS page_id FROM asked GROUP BY norm_url)"""


def crawled(spark, sf_dir) -> str:
    """The path of a crawl whose seeds and web are the pages table; nothing links outside it but what is missing."""
    path = folder(spark, "crawl")
    pages = read(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    web = pages.select("url", F.when(F.col("page_id") % 10 > 0, F.col("html")).alias("html"), F.when(F.col("page_id") % 10 == 0, "HTTP 404").otherwise("").alias("error"))
    seeds = pages.select("url", F.lit("").alias("source_site"), F.lit("all").alias("category"), F.lit(2).alias("priority"), F.col("page_id").alias("seq"))
    n = pages.count()
    crawling.crawl(spark, path, seeds, lambda asked: asked.join(web, "url"), ["example.com", "example.net", "example.org"], n, 1, False, sites=SITES)
    return path


@query(
    rf"""WITH {CRAWLED}, got AS (SELECT p.page_id, p.url, {CLEAN.format(H1)} AS title, html FROM pages p JOIN firsts f ON f.page_id = p.page_id WHERE p.page_id % 10 > 0), bare AS (SELECT *, {BODY} AS b FROM got),
  parts AS (SELECT *, {ARTICLE} AS article, {AD} AS ad, {WHOLE} AS whole FROM bare), texts AS (SELECT *, {CONTENT} AS content FROM parts), new AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY title, content ORDER BY page_id) = 1)
SELECT printf('nk_%06d', row_number() OVER (ORDER BY page_id)) AS doc_id, url, title, CAST(length(content) AS INTEGER) AS content_length, {SITE} AS source_site, 'all' AS category, 'ok' AS parse_status,
  CASE WHEN row_number() OVER (ORDER BY page_id) <= 50 THEN printf('snapshots/nk_%06d.html', row_number() OVER (ORDER BY page_id)) ELSE '' END AS snapshot_path, md5(title || '|' || content) AS content_hash FROM new"""
)
def crawl_documents(spark, sf_dir):
    names = ("doc_id", "url", "title", "content_length", "source_site", "category", "parse_status", "snapshot_path", "content_hash")
    return crawling.table(spark, crawled(spark, sf_dir), "docs").select(*names)


@query(f"WITH {CRAWLED} SELECT p.url, 'fetch' AS kind, 'HTTP 404' AS error FROM pages p JOIN firsts f ON f.page_id = p.page_id WHERE p.page_id % 10 = 0")
def crawl_errors(spark, sf_dir):
    return crawling.table(spark, crawled(spark, sf_dir), "errors").select("url", "kind", "error")


@query(
    rf"""WITH {CRAWLED}, got AS (SELECT p.page_id, {CLEAN.format(H1)} AS title, html, p.page_id % 10 = 0 AS gone FROM pages p JOIN firsts f ON f.page_id = p.page_id), bare AS (SELECT *, {BODY} AS b FROM got),
  parts AS (SELECT *, {ARTICLE} AS article, {AD} AS ad, {WHOLE} AS whole FROM bare), texts AS (SELECT *, {CONTENT} AS content FROM parts)
SELECT count(DISTINCT title || '|' || content) FILTER (WHERE NOT gone) AS total_docs, count(*) FILTER (WHERE gone) AS failed_urls, count(*) FILTER (WHERE NOT gone) - count(DISTINCT title || '|' || content) FILTER (WHERE NOT gone) AS duplicate_urls,
  count(DISTINCT title || '|' || content) FILTER (WHERE NOT gone) AS html_pages, 0 AS pdf_files FROM texts"""
)
def crawl_statistics(spark, sf_dir):
    return crawling.statistics(spark, crawled(spark, sf_dir)).select("total_docs", "failed_urls", "duplicate_urls", "html_pages", "pdf_files")


BASE = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN contains(regexp_extract(p, '([^/]*)$', 1), '.') THEN regexp_replace(p, '/?[^/]*$', '') ELSE p END || '/'"


@query(
    rf"""SELECT page_id AS doc_id, CASE WHEN contains(lower(html), '</head>') THEN regexp_replace(html, '(?i)(<head[^>]*>)', '\1' || chr(10) || '<base href="' || {BASE} || '">') ELSE html END AS html
FROM (SELECT *, {PATH} AS p FROM pages) ORDER BY page_id LIMIT 50"""
)
def snapshot_base_href(spark, sf_dir):
    """The first fifty, which is what is kept of a crawl."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html", F.lit("html").alias("file_type"), F.lit("").alias("page_role"))
    return frontier.snapshots(pages)


@query("SELECT page_id AS doc_id, row_number() OVER (ORDER BY page_id) <= 50 AS has_snapshot, CASE WHEN row_number() OVER (ORDER BY page_id) <= 50 THEN length(html) ELSE 0 END AS size FROM pages")
def snapshot_read(spark, sf_dir):
    """Which pages have one, and the size of what was saved, without the base address that was put in."""
    path, pages = folder(spark, "snapshots"), read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html", F.lit("html").alias("file_type"), F.lit("").alias("page_role"))
    frontier.snapshots(pages).write.parquet(f"{path}/snapshots")
    bare = F.regexp_replace("html", '\n<base href="[^"]*">', "")
    return tables.snapshots_of(pages, path).select("doc_id", "has_snapshot", F.coalesce(F.length(bare), F.lit(0)).cast("long").alias("size"))


@query(rf"WITH {CORPUS}, c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(content, '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM corpus) SELECT * FROM c")
def clean_crawled_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.clean_crawled(F.col("content")).alias("cleaned"))
