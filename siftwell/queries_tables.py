"""Registered queries over what is written and read again, over whole searches, and over reports."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from siftwell import schema
from siftwell.functions import text
from siftwell.functions.batches import mapped
from siftwell.operators import frontier, index, logs, quality, ranking, suggest
from siftwell.queries import ASKED, CORPUS, FULL, INDEX, MARK, ORDER, QUEUE, STOP, WORDS, bm25_sql, corpus, dec, engine, folder, page_queue, pick_sql, query, read, reason, search_log, tok, values
from siftwell.sources import tables

# --- corpus files


@query(f"WITH {CORPUS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, url, title, content, source_site, publish_time, file_type FROM corpus")
def corpus_scan(spark, sf_dir):
    """Written as JSON lines in two goes, with blank and malformed lines between, and read again."""
    path = folder(spark, "corpus")
    docs = corpus(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")).select("doc_id", "url", "title", "content", "source_site", "publish_time", "file_type")
    tables.write_corpus(docs.where("doc_id % 2 = 0"), path, fresh=True)
    tables.write_corpus(docs.where("doc_id % 2 = 1"), path)
    spark.createDataFrame([("",), ("{broken",), ("  ",)], "value string").write.mode("append").text(path)
    return tables.read_corpus(spark, path).select(*docs.columns)


@query(f"WITH {CORPUS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'new' AS title FROM corpus")
def corpus_fresh(spark, sf_dir):
    """A fresh corpus replaces the old one; one that isn't there is empty."""
    path = folder(spark, "corpus")
    for title in ("old", "new"):
        tables.write_corpus(corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(title).alias("title")), path, fresh=True)
    return tables.read_corpus(spark, path).union(tables.read_corpus(spark, path + "-none")).select("doc_id", "title")


@query(f"SELECT unnest([{', '.join(map(repr, STOP))}]) AS word")
def stop_words_file(spark, sf_dir):
    path = folder(spark, "stop")
    spark.createDataFrame([("# words",), *((f" {w} ",) for w in STOP), ("",), (STOP[0],)], "value string").write.text(path)
    return spark.createDataFrame([(w,) for w in tables.read_stop_words(spark, path)], "word string")


SEEDS = {"allowed_domains": ["a.org"], "sources": [{"name": f"S{k}", "site_tag": f"t{k}", "base_url": f"http://s{k}.a.org", "seed_urls": [{"url": f"http://s{k}.a.org/{n}.htm", "category": f"c{n}", **({} if n == 2 else {"page_role": ("portal", "list")[n]})} for n in range(3)]} for k in range(4)]}


@query("SELECT 'http://s' || k || '.a.org/' || n || '.htm' AS url, 'S' || k AS source_site, 'c' || n AS category, CASE n WHEN 0 THEN 3 ELSE 2 END AS priority, CAST(k * 1048576 + n AS BIGINT) AS seq FROM range(0, 4) a(k), range(0, 3) b(n)")
def seed_scan(spark, sf_dir):
    path = folder(spark, "seeds")
    spark.createDataFrame([(json.dumps(SEEDS),)], "value string").coalesce(1).write.text(path)
    return frontier.seeds(tables.read_seeds(spark, path)).select("url", "source_site", "category", "priority", "seq")


@query(f"WITH {QUEUE} SELECT 'frontier' AS name, norm_url AS value FROM queue WHERE priority > 0 UNION ALL SELECT 'visited', norm_url FROM queue WHERE priority = 0 UNION ALL SELECT DISTINCT 'depleted', source_site FROM queue WHERE priority = 0")
def crawl_checkpoint(spark, sf_dir):
    path, queue = folder(spark, "state"), page_queue(spark, sf_dir)
    assert tables.load_checkpoint(spark, path) is None
    done = queue.where("priority = 0")
    tables.save_checkpoint(path, queue.where("priority > 0"), done.select("norm_url"), done.select("source_site").distinct())
    loaded = zip(("frontier", "visited", "depleted"), tables.load_checkpoint(spark, path), ("norm_url", "norm_url", "source_site"))
    parts = [rows.select(F.lit(name).alias("name"), F.col(column).alias("value")) for name, rows, column in loaded]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {QUEUE} SELECT u.url, '' AS anchor_text, source_site, priority, seq FROM queue q JOIN (SELECT page_id, url FROM pages) u ON u.page_id = q.seq")
def frontier_serialised(spark, sf_dir):
    """As JSON and back, in the schema of the frontier."""
    path = folder(spark, "frontier")
    page_queue(spark, sf_dir).select("url", F.lit("").alias("anchor_text"), "source_site", F.lit("").alias("category"), F.lit("").alias("parent_url"), "priority", "seq").write.json(path)
    return spark.read.schema(schema.FRONTIER).json(path).select("url", "anchor_text", "source_site", "priority", "seq")


def docx(lines: list[str]) -> bytes:
    out = io.BytesIO()
    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{tables.W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def xlsx(lines: list[str]) -> bytes:
    out = io.BytesIO()
    rows = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>' for x in line.split(" ")) + "</row>" for line in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{tables.S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def made_file(path: str, kind: str, content: str) -> tuple:
    """Files of several kinds, some of them broken, with the lines of a text."""
    return path, kind, {"docx": docx, "xlsx": xlsx}.get(kind, lambda x: b"no such file")(content.split("\n"))


KINDS = ("docx", "xlsx", "doc", "zip", "ppt", "docx")
PLAIN = r"array_to_string(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''), chr(10))"
SHEET = r"array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: array_to_string(list_filter(string_split(x, ' '), lambda w: w <> ''), ' ')), lambda x: trim(x) <> '')[:200], chr(10))"


@query(
    rf"""WITH {CORPUS}, k AS (SELECT doc_id, {pick_sql(KINDS)} AS file_type, content FROM corpus), t AS (SELECT doc_id, file_type, CASE file_type WHEN 'docx' THEN {PLAIN} WHEN 'xlsx' THEN {SHEET} ELSE '' END AS content FROM k)
SELECT CAST(doc_id AS VARCHAR) AS path, file_type, md5(content) AS content_hash, CASE WHEN file_type = 'doc' THEN 'failed' WHEN file_type = 'zip' THEN 'skipped' WHEN file_type = 'ppt' THEN 'ok' WHEN trim(content) = '' THEN 'failed' ELSE 'ok' END AS parse_status FROM t"""
)
def attachment_texts(spark, sf_dir):
    docs = corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.expr(f"array({', '.join(map(repr, KINDS))})[cast(doc_id % {len(KINDS)} as int)]").alias("kind"), "content")
    files = mapped(docs, "content", made_file, "path string, file_type string, content binary")
    return tables.parse_files(files).select("path", "file_type", F.md5(F.col("content").cast("binary")).alias("content_hash"), "parse_status")


@query(
    f"""WITH c AS (SELECT doc_id, text, doc_id % 4 AS k, substr(text, 1, CAST(doc_id % 90 AS INTEGER)) AS body FROM documents WHERE doc_id IS NOT NULL),
  t AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 'f' || doc_id WHEN k = 1 THEN 'Plan ' || doc_id ELSE 'n' || doc_id || '.zip' END AS title, body FROM c),
  f AS (SELECT doc_id, k, title, CASE WHEN trim(body) = '' THEN title || CASE WHEN k = 1 THEN ' | 链接文本: Plan ' || doc_id || '.docx' ELSE '' END || CASE WHEN k < 3 THEN ' | 分类: cat' ELSE '' END ELSE body END AS content FROM t)
SELECT doc_id, title, CAST(length(content) AS INTEGER) AS content_length, CASE WHEN k <> 3 AND length(content) > 50 THEN 'good' ELSE 'short' END AS content_quality FROM f"""
)
def attachment_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr(
        "doc_id", "CASE WHEN doc_id % 4 = 0 THEN concat('f', doc_id, '.pdf') ELSE concat('n', doc_id, '.zip') END AS name", "CASE WHEN doc_id % 4 = 1 THEN concat('Plan ', doc_id, '.docx') ELSE '' END AS anchor_text",
        "CASE WHEN doc_id % 4 < 3 THEN 'cat' ELSE '' END AS category", "substr(text, 1, cast(doc_id % 90 as int)) AS content", "CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS parse_status",
    )
    return tables.attachment_documents(docs).select("doc_id", "title", "content_length", "content_quality")


# --- the saved index


def saved_index(spark, sf_dir) -> index.Index:
    """Built of two thirds of the documents, with the others added in a batch that is written twice."""
    path, docs = folder(spark, "index"), corpus(spark, sf_dir)
    index.build(docs.where("doc_id % 3 > 0")).save(path)
    for _ in range(2):
        index.append(spark, path, docs.where("doc_id % 3 = 0"), 1)
    return index.Index.load(spark, path)


@query(f"WITH {INDEX} SELECT field, term, df FROM term_stats")
def index_saved_terms(spark, sf_dir):
    return saved_index(spark, sf_dir).term_stats


@query(f"WITH {INDEX} SELECT n_docs, round(avg_title_len, 6) AS avg_title_len, round(avg_content_len, 6) AS avg_content_len FROM corpus_stats")
def index_saved_stats(spark, sf_dir):
    return saved_index(spark, sf_dir).corpus_stats.select("n_docs", F.round("avg_title_len", 6).alias("avg_title_len"), F.round("avg_content_len", 6).alias("avg_content_len"))


@query(f"WITH {bm25_sql(values(ASKED))} SELECT doc_id, {dec('bm25', 4)} AS score FROM scores")
def index_saved_search(spark, sf_dir):
    saved = saved_index(spark, sf_dir)
    wanted = spark.createDataFrame([(0, t) for t in ASKED], "query_id int, term string")
    scores = ranking.bm25(saved.lookup(ASKED), saved.term_stats, saved.corpus_stats, wanted)
    return scores.select("doc_id", ranking.rounded(F.col("bm25"), 4).alias("score"))


@query(f"WITH {INDEX} SELECT field, doc_id, tf, CASE field WHEN 'title' THEN title_len ELSE content_len END AS size FROM (SELECT p.*, l.title_len, l.content_len FROM postings p JOIN doc_len l ON l.doc_id = p.doc_id WHERE term IN ('the', 'thing'))")
def postings_lookup(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).lookup(("the", "thing")).select("field", "doc_id", "tf", "size")


@query(f"WITH {CORPUS} SELECT doc_id, CASE WHEN file_type = 'html' THEN printf('nk_%06d', doc_id) ELSE printf('nk_file_%06d', doc_id) END AS public_id FROM corpus")
def document_ids(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.document_id(F.col("doc_id"), F.col("file_type")).alias("public_id"))


# --- whole searches

ENRICHED = MARK.replace(r"a\.b", "with")
CUT = f"""cut AS (SELECT *, least({', '.join(f"nullif(instr(lower(content), '{w}'), 0)" for w in ASKED)}) AS hit FROM page), shown AS (
  SELECT *, CASE WHEN hit IS NULL THEN substr(content, 1, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END
    ELSE CASE WHEN hit > 51 THEN '...' ELSE '' END || substr(content, greatest(hit - 51, 0) + 1, 300) || CASE WHEN greatest(hit - 51, 0) + 300 < length(content) THEN '...' ELSE '' END END AS s FROM cut)"""
MULTI = {"filters": {"source": "src", "date_from": "2024-02-01"}, "page_size": 15}


def searched(spark, sf_dir, **more):
    from siftwell.queries import BOOSTS, KEYWORDS, SITES

    return engine(spark, sf_dir).search(WORDS, "multi", source_boosts=BOOSTS, keywords=KEYWORDS, sources=SITES, **(MULTI | more))


@query(
    f"""{FULL}, page AS (SELECT * FROM final ORDER BY {ORDER} LIMIT 15), {CUT}
SELECT doc_id, {dec('score', 4)} AS score, final_score, {ENRICHED.format('title')} AS title_highlight, {ENRICHED.format('s')} AS snippet,
  coalesce(nullif(concat_ws(' | ', {reason('标题命中', 'title').replace("['thing', 'The']", "['the', 'thing', 'with']")}, {reason('正文命中', 'content').replace("['thing', 'The']", "['the', 'thing', 'with']")}, {reason('来源匹配', 'source_site').replace("['thing', 'The']", "['the', 'thing', 'with']")}), ''), '模糊匹配') AS match_explanation FROM shown"""
)
def search_page(spark, sf_dir):
    """A whole search: its first page with highlights, snippets and explanations."""
    rows = searched(spark, sf_dir)["results"]
    return rows.select("doc_id", ranking.rounded(F.col("score"), 4).alias("score"), "final_score", "title_highlight", "snippet", "match_explanation")


@query(f"{FULL} SELECT count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS total_pages, 2 AS page, 'and' AS match_mode, '{' '.join(ASKED)}' AS matched, CASE WHEN count(*) > 0 THEN '默认用户' ELSE '默认用户' END AS profile FROM final")
def search_summary(spark, sf_dir):
    found = searched(spark, sf_dir, page=2)
    row = (found["total"], found["total_pages"], found["page"], found["match_mode"], " ".join(found["matched_terms"]), found["user_profile_name"])
    return spark.createDataFrame([row], "total long, total_pages long, page int, match_mode string, matched string, profile string")


@query("SELECT q.query, 0 AS total, 0 AS total_pages, 0 AS n FROM (VALUES ('qqqqzzzz normal'), ('zzzz* wildcard'), (' normal'), ('12 34 multi')) q(query)")
def search_empty(spark, sf_dir):
    """Searches that find nothing: unknown words, a wildcard that fits nothing, no words, digits only."""
    built, rows = engine(spark, sf_dir), []
    for words, kind in (("qqqqzzzz", "normal"), ("zzzz*", "wildcard"), ("", "normal"), ("12 34", "multi")):
        found = built.search(words, kind)
        rows.append((f"{words} {kind}", found["total"], found["total_pages"], len(found["results"].collect())))
    return spark.createDataFrame(rows, "query string, total int, total_pages int, n int")


WILD = "SELECT 0 AS query_id, term FROM (SELECT DISTINCT term FROM term_stats WHERE term LIKE 'thi%')"


@query(f"WITH {bm25_sql(WILD)} SELECT doc_id, {dec('bm25', 4)} AS score FROM scores WHERE bm25 > 0")
def search_wildcard(spark, sf_dir):
    """All results of a wildcard search; what scores nothing is left out."""
    found = engine(spark, sf_dir).ranked("thi*", "wildcard")[0]
    return found.select("doc_id", F.col("bm25_score").alias("score"))


@query(f"SELECT item_id, array_to_string({tok('text')}, ' ') AS words FROM benchmark")
def query_analysis(spark, sf_dir):
    """The words of every benchmark text, taken as a query."""
    analyze = index.analyzer()
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(analyze(F.col("text")), " ").alias("words"))


@query("SELECT * FROM (VALUES ('default', '默认用户'), ('study_user', '学习型用户'), ('research_user', '科研型用户'), ('admission_user', '招生型用户'), ('news_user', '新闻型用户')) p(user_id, name)")
def profile_list(spark, sf_dir):
    return ranking.profile_names(spark)


# --- logs and suggestions


@query("SELECT 'u' || (k % 2) AS user_id, 'words ' || k AS query, 'multi' AS search_type, '{\"source\": \"x\"}' AS filters, CAST(k * 3 AS INTEGER) AS result_count, '2024-01-0' || k || ' 10:00:00' AS search_time FROM range(1, 6) r(k)")
def log_inserts(spark, sf_dir):
    """Searches are logged one by one into tables that are made first; making them again keeps what is there."""
    path = folder(spark, "logs")
    logs.create(spark, path)
    for k in range(1, 6):
        logs.log_search(spark, path, f"u{k % 2}", f"words {k}", "multi", '{"source": "x"}', k * 3, f"2024-01-0{k} 10:00:00")
    logs.create(spark, path)
    return spark.read.parquet(f"{path}/search_logs").drop("id")


@query("SELECT 'u' || (k % 2) AS user_id, 'q' AS query, 'd' || k AS doc_id, 't' AS title, 'http://x/' || k AS url FROM range(1, 6) r(k) WHERE k % 2 = 1 ORDER BY k DESC LIMIT 2")
def click_scan(spark, sf_dir):
    """One user's latest clicks."""
    path = folder(spark, "logs")
    logs.create(spark, path)
    for k in range(1, 6):
        logs.log_click(spark, path, f"u{k % 2}", "q", f"d{k}", "t", f"http://x/{k}", f"2024-01-0{k} 10:00:00")
    return logs.page(spark.read.parquet(f"{path}/click_logs"), "click_time", "u1", 2).select("user_id", "query", "doc_id", "title", "url")


@query("SELECT event_type AS text, 'hot' AS type, round(count(*) * 1e0 / max(count(*)) OVER (), 6) AS score FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 4")
def suggest_popular(spark, sf_dir):
    """What is suggested without a prefix."""
    return suggest.suggestions(corpus(spark, sf_dir), search_log(spark, sf_dir), "", 4).select("text", "type", F.round("score", 6).alias("score"))


# --- reports


@query(f"WITH {CORPUS} SELECT doc_id, title FROM corpus ORDER BY md5('42|' || doc_id), doc_id LIMIT 20")
def random_sample(spark, sf_dir):
    return quality.random_sample(corpus(spark, sf_dir)).select("doc_id", "title")


@query(
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 < 7) AS most, count(*) FILTER (WHERE doc_id % 10 < 6) AS short, count(*) FILTER (WHERE doc_id % 10 < 3) AS noise, count(*) FILTER (WHERE doc_id % 50 = 1) AS list FROM documents WHERE doc_id IS NOT NULL)
SELECT '最大 source_site [big] 占比 ' || CAST(round(most * 100e0 / n, 1) AS VARCHAR) || '% > 50%' AS warning FROM c UNION ALL SELECT 'document 数量为 0，无法支撑文档查询与下载功能' FROM c
UNION ALL SELECT '短正文比例 ' || CAST(round(short * 100e0 / n, 1) AS VARCHAR) || '% > 50%' FROM c UNION ALL SELECT 'nav_noise 样本过多: ' || noise || ' 条' FROM c UNION ALL SELECT '疑似 list 误判为 detail: ' || list || ' 条' FROM c"""
)
def validation_warnings(spark, sf_dir):
    """Of a corpus that gives cause for every warning."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr(
        "doc_id", "concat('u', doc_id) AS url", "CASE WHEN doc_id % 50 = 1 THEN '通知公告' ELSE 'a title' END AS title", "CASE WHEN doc_id % 10 < 6 THEN 'short' ELSE repeat('long ', 50) END AS content",
        "CASE WHEN doc_id % 10 < 7 THEN 'big' ELSE concat('s', doc_id % 10) END AS source_site", "'detail' AS page_role", "CASE WHEN doc_id % 10 < 3 THEN 'nav_noise' ELSE 'good' END AS content_quality",
    )
    return quality.validation(docs).select(F.explode("warnings").alias("warning"))


@query(f"WITH {INDEX}, c AS (SELECT count(*) AS total_docs, count(*) FILTER (WHERE file_type = 'html') AS html_pages, count(*) FILTER (WHERE file_type = 'pdf') AS pdf_files FROM corpus) SELECT c.*, (SELECT n_docs FROM corpus_stats) AS index_docs, (SELECT count(*) FROM term_stats WHERE field = 'content') AS index_terms, (SELECT count(*) FROM events) AS search_count FROM c")
def api_statistics(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return quality.service_statistics(docs, index.build(docs), search_log(spark, sf_dir)).select("total_docs", "html_pages", "pdf_files", "index_docs", "index_terms", "search_count")


@query(
    f"""WITH {CORPUS}, n AS (SELECT count(*) AS total FROM corpus), lines AS (
  SELECT '| 总文档数 | ' || total || ' |' AS line FROM n UNION ALL SELECT '# 数据质量报告' UNION ALL SELECT '## file_type 分布' UNION ALL SELECT '- ' || file_type || ': ' || count(*) FROM corpus GROUP BY file_type
  UNION ALL SELECT '- ' || source_site || ': ' || count(*) || ' (' || CAST(round(count(*) * 100e0 / (SELECT total FROM n), 1) AS VARCHAR) || '%)' FROM corpus GROUP BY source_site
  UNION ALL SELECT '- ' || page_role || ': ' || count(*) || ' (' || CAST(round(count(*) * 100e0 / (SELECT total FROM n), 1) AS VARCHAR) || '%)' FROM corpus GROUP BY page_role
  UNION ALL SELECT '- ' || page_role || ': ' || count(*) FROM corpus WHERE length(content) > 0 AND length(content) < 100 GROUP BY page_role
  UNION ALL SELECT '- ' || source_site || ': ' || n || ' (' || CAST(round(n * 100e0 / all_failed, 1) AS VARCHAR) || '%)' FROM (SELECT source_site, count(*) AS n, sum(count(*)) OVER () AS all_failed FROM corpus WHERE content_quality = 'failed' GROUP BY source_site ORDER BY n DESC, source_site LIMIT 10))
SELECT DISTINCT line FROM lines"""
)
def report_lines(spark, sf_dir):
    """Lines of the written report: its heads, the overview's total and three distributions."""
    docs, path = corpus(spark, sf_dir), folder(spark, "report")
    tables.write_report(docs, path)
    rows = spark.read.text(f"{path}/report_markdown").select(F.col("value").alias("line"))
    names = docs.select(F.col("source_site").alias("v")).union(docs.select("page_role")).union(docs.select("file_type")).distinct()
    own = rows.where("line LIKE '- %'").withColumn("v", F.regexp_extract("line", "^- (.*): [0-9]+", 1)).join(names, "v", "left_semi")
    of_kind = rows.where("line LIKE '| 总文档数%' OR line IN ('# 数据质量报告', '## file_type 分布')")
    return own.select("line").union(of_kind).distinct()
