"""The registered queries over the given tables, each with the SQL that gives the same rows where SQL can.

The tables have no titles, dates or file types; corpus() derives them from doc_id and text, alike in Spark and SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text, urls
from siftwell.operators import frontier, index, logs, quality, ranking, suggest, terms
from siftwell.plans.search import SearchEngine
from siftwell.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...]) -> str:
    return f"array({', '.join(map(repr, values))})[cast(doc_id % {len(values)} as int)]"


def pick_sql(values: tuple[str, ...]) -> str:
    return f"[{', '.join(map(repr, values))}][doc_id % {len(values)} + 1]"


TYPES = ("html", "html", "html", "pdf", "doc")
QUALITIES = ("good", "short", "failed", "nav_noise", "good", "good", "")
ROLES = ("detail", "list", "document", "portal", "detail", "detail")
ENDS = (".htm", ".html", "/", ".pdf", "")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr(
        "doc_id",
        f"concat('https://', source, '.example.org/', lang, '/', doc_id, {pick(ENDS)}) AS url",
        "substring_index(text, '\n', 1) AS title",
        "text AS content",
        "source AS source_site",
        "lang AS category",
        "date_format(date_add(date'2024-01-01', cast(doc_id % 400 as int)), 'yyyy-MM-dd') AS publish_time",
        f"{pick(TYPES)} AS file_type",
        f"{pick(QUALITIES)} AS content_quality",
        f"{pick(ROLES)} AS page_role",
    )
    return docs.withColumn("content_hash", text.content_hash(F.col("title"), F.col("content"))).withColumn("summary", F.substring("content", 1, 200))


CORPUS = rf"""corpus AS (
  SELECT doc_id, 'https://' || source || '.example.org/' || lang || '/' || doc_id || {pick_sql(ENDS)} AS url,
    split_part(text, chr(10), 1) AS title, text AS content, source AS source_site, lang AS category,
    strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS publish_time,
    {pick_sql(TYPES)} AS file_type, {pick_sql(QUALITIES)} AS content_quality, {pick_sql(ROLES)} AS page_role,
    md5(split_part(text, chr(10), 1) || '|' || text) AS content_hash, substr(text, 1, 200) AS summary
  FROM documents WHERE doc_id IS NOT NULL
)"""


def tok(x: str, stop: tuple[str, ...] = ()) -> str:
    clean = f"coalesce({x}, '')"
    for pattern in (r"<[^>]+>", r"https?://\S+", r"\s+"):
        clean = f"regexp_replace({clean}, '{pattern}', ' ', 'g')"
    keep = r"regexp_matches(t, '[\p{L}\p{Nl}\p{No}]')" + (f" AND t NOT IN ({', '.join(map(repr, stop))})" if stop else "")
    return rf"list_filter(regexp_extract_all(lower({clean}), '[\p{{L}}\p{{N}}]+'), lambda t: {keep})"


STOP = ("and", "das", "de", "der", "die", "for", "in", "la", "of", "that", "the", "und")
TOKENS = f"{CORPUS}, tok AS (SELECT doc_id, {tok('title')} AS t, {tok('source_site')} AS s, {tok('content')} AS c FROM corpus)"
POSTINGS = f"""{TOKENS}, each AS (
  SELECT 'title' AS field, doc_id, unnest(list_concat(t, s)) AS term FROM tok UNION ALL SELECT 'content', doc_id, unnest(c) FROM tok
), postings AS (SELECT field, term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM each GROUP BY ALL)"""
INDEX = f"""{POSTINGS}, term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
  doc_len AS (SELECT doc_id, CAST(len(t) AS INTEGER) AS title_len, CAST(len(c) AS INTEGER) AS content_len FROM tok),
  corpus_stats AS (SELECT count(*) AS n_docs, sum(title_len) / count(*) AS avg_title_len, sum(content_len) / count(*) AS avg_content_len FROM doc_len)"""


def bm25_sql(queries: str, title: str = "3e0", content: str = "1e0") -> str:
    """queries: a CTE body with query_id, term. Ends with a CTE `scores`: query_id, doc_id, bm25."""
    return f"""{INDEX}, asked AS ({queries}), wanted AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
  hits AS (
    SELECT w.query_id, p.doc_id, p.tf, w.qtf, CAST(ts.df AS DOUBLE) AS df, CAST(cs.n_docs AS DOUBLE) AS n,
      CASE p.field WHEN 'title' THEN {title} ELSE {content} END AS weight,
      CAST(CASE p.field WHEN 'title' THEN l.title_len ELSE l.content_len END AS DOUBLE) AS size,
      CASE p.field WHEN 'title' THEN cs.avg_title_len ELSE cs.avg_content_len END AS mean
    FROM wanted w JOIN postings p ON p.term = w.term JOIN term_stats ts ON ts.field = p.field AND ts.term = p.term
      JOIN doc_len l ON l.doc_id = p.doc_id CROSS JOIN corpus_stats cs
  ), scores AS (
    SELECT query_id, doc_id, sum(CASE WHEN size > 0 THEN weight * qtf * ln((n - df + 5e-1) / (df + 5e-1) + 1e0)
      * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * size / CASE WHEN mean > 0 THEN mean ELSE 1e0 END))) ELSE 0e0 END) AS bm25
    FROM hits GROUP BY query_id, doc_id
  )"""


def dec(x: str, digits: int) -> str:
    """As ranking.rounded()."""
    return f"CAST(round(CAST({x} AS DECIMAL(30,9)), {digits}) AS DOUBLE)"


def values(words: tuple[str, ...], query_id: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT {query_id} AS query_id, {w!r} AS term" for w in words)


ASKED = ("the", "thing", "with")
WORDS = " ".join(ASKED)


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    return SearchEngine(index.build(corpus(spark, sf_dir)), as_of=F.to_date(F.lit("2024-12-31")))


# --- index


@query(f"WITH {TOKENS} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_title, CAST(len(s) AS INTEGER) AS n_source, CAST(len(c) AS INTEGER) AS n_content FROM tok")
def tokenize_counts(spark, sf_dir):
    rows = index.analyzed(corpus(spark, sf_dir), index.analyzer())
    return rows.select("doc_id", F.size("title_tokens").alias("n_title"), F.size("source_tokens").alias("n_source"), F.size("content_tokens").alias("n_content"))


@query(f"WITH {CORPUS} SELECT doc_id, array_to_string({tok('title', STOP)}, ' ') AS kept_terms FROM corpus")
def stopword_filter(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.array_join(text.tokens(F.col("title"), STOP), " ").alias("kept_terms"))


@query(f"WITH {POSTINGS} SELECT * FROM postings")
def postings_tf(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).postings.drop("size")


@query(f"WITH {INDEX} SELECT field, term, df FROM term_stats")
def term_document_frequency(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).term_stats


@query(f"WITH {INDEX} SELECT DISTINCT term FROM term_stats")
def vocabulary_union(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).vocabulary()


@query(f"WITH {INDEX} SELECT * FROM doc_len")
def doc_lengths(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).doc_len


@query(f"WITH {INDEX} SELECT n_docs, round(avg_title_len, 6) AS avg_title_len, round(avg_content_len, 6) AS avg_content_len FROM corpus_stats")
def corpus_stats(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).corpus_stats.select("n_docs", F.round("avg_title_len", 6).alias("avg_title_len"), F.round("avg_content_len", 6).alias("avg_content_len"))


@query(f"WITH {INDEX} SELECT (SELECT n_docs FROM corpus_stats) AS doc_count, count(*) FILTER (WHERE field = 'content') AS term_count, count(*) FILTER (WHERE field = 'title') AS title_term_count FROM term_stats")
def index_statistics(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).statistics()


@query(f"WITH {INDEX} SELECT field, term, round(ln((n_docs - df + 5e-1) / (df + 5e-1) + 1e0), 4) AS idf FROM term_stats CROSS JOIN corpus_stats")
def idf_table(spark, sf_dir):
    built = index.build(corpus(spark, sf_dir))
    n = F.col("n_docs").cast("double")
    return built.term_stats.join(F.broadcast(built.corpus_stats)).select("field", "term", F.round(ranking.idf(n, F.col("df")), 4).alias("idf"))


@query(
    rf"""WITH {TOKENS}, each AS (SELECT doc_id, unnest(c) AS term, unnest(range(len(c))) AS place FROM tok),
  counted AS (SELECT doc_id, term, count(*) AS tf, min(place) AS first_at FROM each GROUP BY ALL),
  ranked AS (SELECT doc_id, term, tf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first_at) AS INTEGER) AS rank FROM counted)
SELECT doc_id, rank, term, tf FROM ranked WHERE rank <= 5"""
)
def keyword_extract_topk(spark, sf_dir):
    return index.keywords(corpus(spark, sf_dir), k=5)


# --- search


@query(f"WITH {bm25_sql(values(ASKED))} SELECT doc_id, {dec('bm25', 4)} AS score FROM scores ORDER BY {dec('bm25', 4)} DESC, doc_id LIMIT 20")
def bm25_or_search(spark, sf_dir):
    rows = index.analyzed(corpus(spark, sf_dir), index.analyzer())
    postings = index.postings_of(rows, index.one_of(ASKED))
    wanted = spark.createDataFrame([(0, t) for t in ASKED], "query_id int, term string")
    scores = ranking.bm25(postings, index.term_statistics(postings), index.statistics_of(index.lengths_of(rows)), wanted)
    return scores.select("doc_id", ranking.rounded(F.col("bm25"), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    f"""WITH {bm25_sql(values(ASKED))}, met AS (
  SELECT p.doc_id FROM postings p JOIN wanted w ON w.term = p.term GROUP BY p.doc_id
  HAVING count(DISTINCT p.term) = (SELECT count(DISTINCT term) FROM postings WHERE term IN (SELECT term FROM wanted))
) SELECT doc_id, {dec('bm25', 4)} AS score FROM scores WHERE doc_id IN (SELECT doc_id FROM met) ORDER BY {dec('bm25', 4)} DESC, doc_id LIMIT 20"""
)
def bm25_and_search(spark, sf_dir):
    found, _, _, _ = engine(spark, sf_dir).ranked(WORDS, "normal")
    return found.select("doc_id", F.col("bm25_score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {bm25_sql(values(ASKED), '5e0', '2e0')} SELECT doc_id, {dec('bm25', 4)} AS score FROM scores")
def bm25_two_field(spark, sf_dir):
    built = index.build(corpus(spark, sf_dir)).of(index.one_of(ASKED))
    wanted = spark.createDataFrame([(0, t) for t in ASKED], "query_id int, term string")
    scores = ranking.bm25(built.postings, built.term_stats, built.corpus_stats, wanted, {"title": 5.0, "content": 2.0})
    return scores.select("doc_id", ranking.rounded(F.col("bm25"), 4).alias("score"))


@query(
    f"""WITH {bm25_sql(f"SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark")},
  rounded AS (SELECT query_id, doc_id, {dec('bm25', 4)} AS score FROM scores),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM rounded)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5"""
)
def bm25_batch_search(spark, sf_dir):
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return engine(spark, sf_dir).search_many(asked, k=5, every=False)


@query(f"WITH {INDEX} SELECT DISTINCT term FROM term_stats WHERE term LIKE 'th%' AND term SIMILAR TO 'th.*ing'")
def wildcard_star_terms(spark, sf_dir):
    return terms.wildcard_terms(index.build(corpus(spark, sf_dir)).vocabulary(), "th*ing")


@query(f"WITH {INDEX} SELECT DISTINCT term FROM term_stats WHERE term LIKE 't_e__'")
def wildcard_question_terms(spark, sf_dir):
    return terms.wildcard_terms(index.build(corpus(spark, sf_dir)).vocabulary(), "t?e??")


@query(f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM postings WHERE term LIKE 'thing%'")
def wildcard_docs(spark, sf_dir):
    built = index.build(corpus(spark, sf_dir))
    return built.postings.join(terms.wildcard_terms(built.vocabulary(), "thing*"), "term", "left_semi").select("doc_id").distinct()


#: DuckDB's distance counts bytes: letters beyond ASCII get one byte each, from what terms don't have.
BEYOND = "áàâäãåçéèêëíìîïñóòôöõßúùûüýÿæœøðþ"
ONE_BYTE = f"translate({{}}, '{BEYOND}', '{''.join(map(chr, [*range(65, 91), *range(33, 39), *range(40, 48)]))[: len(BEYOND)]}')"
FUZZY = ("thing", "wiht", "ofthe")
SIMILAR = f"""{INDEX}, vocabulary AS (SELECT DISTINCT term FROM term_stats), asked AS ({' UNION ALL '.join(f'SELECT {k} AS position, {t!r} AS query_term' for k, t in enumerate(FUZZY))}),
  near AS (SELECT query_term, position, term, CAST(levenshtein(query_term, {ONE_BYTE.format('term')}) AS INTEGER) AS distance FROM asked, vocabulary WHERE abs(length(term) - length(query_term)) <= 2 AND levenshtein(query_term, {ONE_BYTE.format('term')}) <= 2),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_term ORDER BY distance, length(term) DESC, term) AS INTEGER) AS rank FROM near)"""


def vocabulary(spark, sf_dir):
    return index.build(corpus(spark, sf_dir)).vocabulary()


def fuzzy_asked(spark):
    return spark.createDataFrame(list(enumerate(FUZZY)), "position int, query_term string")


@query(f"WITH {SIMILAR} SELECT query_term, term, distance, rank FROM ranked WHERE rank <= 10")
def fuzzy_similar_terms(spark, sf_dir):
    return terms.similar_terms(vocabulary(spark, sf_dir), fuzzy_asked(spark))


@query(
    f"""WITH {SIMILAR}, every AS (SELECT query_term AS term, 0 AS kind, position, 0 AS rank FROM asked UNION ALL SELECT term, 1, position, rank FROM ranked WHERE rank <= 5),
  first AS (SELECT term, min(kind * 1000000 + position * 1000 + rank) AS place FROM every GROUP BY term)
SELECT term, CAST(row_number() OVER (ORDER BY place, term) AS INTEGER) AS ordinal FROM first"""
)
def fuzzy_expand(spark, sf_dir):
    return terms.expand(vocabulary(spark, sf_dir), fuzzy_asked(spark))


@query(f"WITH {INDEX} SELECT term, round(CASE WHEN term = 'thing' THEN 1e0 ELSE 1e0 - CAST(levenshtein('thing', {ONE_BYTE.format('term')}) AS DOUBLE) / greatest(5, length(term)) END, 6) AS match_score FROM (SELECT DISTINCT term FROM term_stats)")
def fuzzy_match_score(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", F.round(terms.match_score(F.lit("thing"), F.col("term")), 6).alias("match_score"))


EXACT = "CASE WHEN lower(title) = 'the' THEN 5e0 WHEN contains(lower(title), 'the') THEN 2e0 ELSE 0e0 END + CASE WHEN contains(lower(url), 'the') THEN 1e0 ELSE 0e0 END + CASE WHEN contains(lower(source_site), 'the') THEN 5e-1 ELSE 0e0 END"


@query(f"WITH {CORPUS} SELECT doc_id, {EXACT} AS exact_boost FROM corpus")
def exact_boost(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", ranking.exact_boost(" The ", F.col("title"), F.col("url"), F.col("source_site")).alias("exact_boost"))


AS_OF = "date_diff('day', CAST(publish_time AS DATE), DATE '2024-12-31')"
RECENCY = f"CASE WHEN {AS_OF} <= 7 THEN 3e-1 WHEN {AS_OF} <= 30 THEN 2e-1 WHEN {AS_OF} <= 90 THEN 1e-1 WHEN {AS_OF} <= 365 THEN 5e-2 ELSE 0e0 END"
BOOSTS = (("src1", 0.3), ("src2", 0.2))
SOURCE = "CASE WHEN contains(source_site, 'src1') THEN 3e-1 WHEN contains(source_site, 'src2') THEN 2e-1 ELSE 0e0 END"
KEYWORDS, SITES = {"the": 1.3, "thing": 1.8, "der": 1.2}, {"src3": 2.0}
PERSONAL = (
    "".join(f"CASE WHEN contains(title || ' ' || substr(content, 1, 500), '{k}') THEN {w!r}::DOUBLE ELSE 0e0 END + " for k, w in KEYWORDS.items())
    + "CASE WHEN contains(source_site, 'src3') THEN 2e0 ELSE 0e0 END"
)


@query(f"WITH {CORPUS} SELECT doc_id, {RECENCY} AS recency_boost FROM corpus")
def recency_boost(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", ranking.recency_boost(F.col("publish_time"), F.to_date(F.lit("2024-12-31"))).alias("recency_boost"))


@query(f"WITH {CORPUS} SELECT doc_id, {SOURCE} AS source_boost FROM corpus")
def source_boost(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", ranking.source_boost(F.col("source_site"), BOOSTS).alias("source_boost"))


@query(f"WITH {CORPUS} SELECT doc_id, round({PERSONAL}, 4) AS profile_boost FROM corpus")
def profile_boost(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.round(ranking.profile_boost(F.col("title"), F.col("content"), F.col("source_site"), KEYWORDS, SITES), 4).alias("profile_boost"))


FULL = f"""WITH {bm25_sql(values(ASKED))}, met AS (
  SELECT p.doc_id FROM postings p JOIN wanted w ON w.term = p.term GROUP BY p.doc_id HAVING count(DISTINCT p.term) = {len(ASKED)}
), boosted AS (
  SELECT c.*, s.bm25, {RECENCY} AS recency_boost, {SOURCE} AS source_boost, {EXACT.replace("'the'", repr(WORDS))} AS exact_boost, {PERSONAL} AS personal
  FROM corpus c JOIN scores s ON s.doc_id = c.doc_id JOIN met m ON m.doc_id = c.doc_id
  WHERE contains(source_site, 'src') AND publish_time >= '2024-02-01'
), pre AS (SELECT *, {dec('bm25 + recency_boost + source_boost', 4)} + exact_boost AS pre_score FROM boosted),
final AS (
  SELECT *, {dec('pre_score + personal', 3)} AS final_score,
    CASE content_quality WHEN 'nav_noise' THEN greatest(0e0, pre_score - 5e0) WHEN 'failed' THEN greatest(0e0, pre_score * 3e-1) ELSE pre_score END AS score,
    CASE content_quality WHEN 'good' THEN 0 WHEN 'short' THEN 1 WHEN 'failed' THEN 2 WHEN 'nav_noise' THEN 3 ELSE 5 END AS quality_rank
  FROM pre
)"""
ORDER = "score DESC, quality_rank DESC, final_score DESC, pre_score DESC, doc_id"


def ranked_documents(spark, sf_dir):
    built = engine(spark, sf_dir)
    return built.ranked(WORDS, "multi", filters={"source": "src", "date_from": "2024-02-01"}, source_boosts=BOOSTS, keywords=KEYWORDS, sources=SITES)[0]


@query(f"{FULL} SELECT doc_id, {dec('score', 4)} AS score, final_score, {dec('bm25', 4)} AS bm25_score, exact_boost FROM final ORDER BY {ORDER} LIMIT 20")
def search_full_pipeline(spark, sf_dir):
    rows = ranking.page_of(ranked_documents(spark, sf_dir), ranking.final_order(), 1, 20)
    return rows.select("doc_id", ranking.rounded(F.col("score"), 4).alias("score"), "final_score", "bm25_score", "exact_boost")


@query(f"{FULL} SELECT doc_id, {dec('score', 4)} AS score, quality_rank FROM final")
def quality_penalty_order(spark, sf_dir):
    return ranked_documents(spark, sf_dir).select("doc_id", ranking.rounded(F.col("score"), 4).alias("score"), "quality_rank")


@query(f"{FULL} SELECT doc_id FROM final ORDER BY {ORDER} LIMIT 10 OFFSET 10")
def paginate(spark, sf_dir):
    return ranking.page_of(ranked_documents(spark, sf_dir), ranking.final_order(), 2, 10).select("doc_id")


@query(f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE contains(source_site, 'src1') AND file_type = 'pdf' AND (publish_time = '' OR publish_time >= '2024-03-01') AND (publish_time = '' OR publish_time <= '2024-12-31')")
def filter_source_type_date(spark, sf_dir):
    return ranking.filtered(corpus(spark, sf_dir), "src1", "pdf", "2024-03-01", "2024-12-31").select("doc_id")


@query(f"WITH {CORPUS} SELECT DISTINCT source_site FROM corpus WHERE source_site <> ''")
def facet_sources(spark, sf_dir):
    return engine(spark, sf_dir).sources()


@query(f"WITH {CORPUS} SELECT DISTINCT file_type FROM corpus WHERE file_type <> ''")
def facet_file_types(spark, sf_dir):
    return engine(spark, sf_dir).file_types()


# --- presentation

SHOWN = ("thing", "the", "a.b")
MARK = r"regexp_replace({}, '(thing|a\.b|the)', '<mark>\1</mark>', 'gi')"


@query(f"WITH {CORPUS} SELECT doc_id, {MARK.format('title')} AS highlighted FROM corpus")
def highlight(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.highlight(F.col("title"), SHOWN).alias("highlighted"))


SNIPPET = """hits AS (SELECT doc_id, content, least(nullif(instr(lower(content), 'thing'), 0), nullif(instr(lower(content), 'the'), 0), nullif(instr(lower(content), 'a.b'), 0)) AS hit FROM corpus),
  cut AS (SELECT *, greatest(hit - 51, 0) AS start FROM hits),
  plain AS (SELECT doc_id, CASE WHEN hit IS NULL THEN substr(content, 1, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END
    ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || substr(content, start + 1, 300) || CASE WHEN start + 300 < length(content) THEN '...' ELSE '' END END AS s FROM cut)"""


@query(f"WITH {CORPUS}, {SNIPPET} SELECT doc_id, {MARK.format('s')} AS snippet FROM plain")
def snippet(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.snippet(F.col("content"), SHOWN).alias("snippet"))


def reason(name: str, column: str) -> str:
    found = f"list_filter(['thing', 'The'], lambda t: contains(lower({column}), lower(t)))"
    return f"CASE WHEN len({found}) > 0 THEN '{name}: ' || array_to_string({found}, ', ') END"


@query(f"WITH {CORPUS} SELECT doc_id, coalesce(nullif(concat_ws(' | ', {reason('标题命中', 'title')}, {reason('正文命中', 'content')}, {reason('来源匹配', 'source_site')}), ''), '模糊匹配') AS match_explanation FROM corpus")
def match_explanation(spark, sf_dir):
    asked = F.array(F.lit("thing"), F.lit("The"))
    return corpus(spark, sf_dir).select("doc_id", text.explanation(F.col("title"), F.col("content"), F.col("source_site"), asked).alias("match_explanation"))


@query(rf"WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || '...' END AS summary FROM flat")
def summary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


# --- URLs and pages

PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1)"
TYPE = "CASE " + " ".join(f"WHEN contains(lower({PATH}), '.{e}') THEN '{t}'" for e, t in urls.FILE_TYPES) + " ELSE 'html' END"


@query(
    r"""WITH bare AS (SELECT page_id, regexp_replace(replace(url, '/../', '/'), '#.*$', '') AS u FROM pages)
SELECT page_id, CASE WHEN u LIKE '%/' AND length(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1)) > 1 THEN regexp_replace(u, '/+$', '') ELSE u END AS norm_url FROM bare"""
)
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm_url"))


@query(f"SELECT page_id, {TYPE} AS file_type FROM (SELECT page_id, url || CASE page_id % 4 WHEN 1 THEN '.PDF' WHEN 2 THEN '/a.docx?x=1' WHEN 3 THEN '/b.pptx' ELSE '' END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages))")
def url_file_type(spark, sf_dir):
    end = F.when(F.col("page_id") % 4 == 1, ".PDF").when(F.col("page_id") % 4 == 2, "/a.docx?x=1").when(F.col("page_id") % 4 == 3, "/b.pptx").otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", urls.file_type(F.concat(F.regexp_replace("url", "[?#].*$", ""), end)).alias("file_type"))


@query(r"SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.net' OR h LIKE '%.example.net' AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def url_allowed_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.allowed(F.col("url"), ("example.com", "example.net")).alias("allowed"))


LIST = " OR ".join(f"regexp_matches(url, '{p}', 'i')" for p in urls.LIST_PATTERNS)
DETAIL = r"contains(u, '/info/') OR (contains(u, '/system/') AND u LIKE '%.shtml') OR contains(u, '/content/') OR contains(u, '/article/') OR regexp_matches(u, '/c\d+a\d+/page\.htm') OR (u LIKE '%.htm' AND NOT contains(u, '/list') AND regexp_matches(u, '/\d{4}/\d{2,4}/')) OR regexp_matches(u, '[?&]p=\d+')"


@query(
    rf"""WITH c AS (SELECT page_id, url, lower(url) AS u, {PATH} AS p FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '\.(pdf|doc|xls|zip|rar)') THEN 'document'
  WHEN ({LIST}) AND NOT contains(u, '/info/') AND NOT contains(u, '/system/') THEN 'list'
  WHEN {DETAIL} THEN 'detail' WHEN regexp_matches(regexp_replace(url, '/+$', ''), '/index\.(htm|html|shtml|php)$|/main\.htm$') THEN 'portal'
  WHEN len(string_split(trim(p, '/'), '/')) >= 2 THEN 'detail' ELSE 'list' END AS page_role FROM c"""
)
def page_role_url_rules(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.role_by_url(F.col("url")).alias("page_role"))


@query(f"WITH {CORPUS} SELECT doc_id, content_hash FROM (SELECT *, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM corpus WHERE file_type = 'html') WHERE doc_id = first_id UNION ALL SELECT doc_id, content_hash FROM corpus WHERE file_type <> 'html'")
def content_hash_dedup(spark, sf_dir):
    return frontier.first_of_hash(corpus(spark, sf_dir)).select("doc_id", "content_hash")


def page_queue(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("url", urls.domain(F.col("url")).alias("source_site"), (F.col("page_id") % 4).cast("int").alias("priority"), F.col("page_id").alias("seq"))
    return frontier.enqueue(found)


QUEUE = r"""norm AS (SELECT page_id AS seq, CAST(page_id % 4 AS INTEGER) AS priority, regexp_extract(url, '://([^/?#]*)', 1) AS source_site, regexp_replace(replace(url, '/../', '/'), '#.*$', '') AS u FROM pages),
  named AS (SELECT seq, priority, source_site, CASE WHEN u LIKE '%/' AND length(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1)) > 1 THEN regexp_replace(u, '/+$', '') ELSE u END AS norm_url FROM norm),
  queue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY seq) AS k FROM named) WHERE k = 1),
  sources AS (SELECT source_site, row_number() OVER (ORDER BY min(seq), source_site) AS source_ordinal FROM queue GROUP BY source_site)"""


@query(
    f"""WITH {QUEUE}, turns AS (SELECT q.*, row_number() OVER (PARTITION BY source_site ORDER BY priority, seq, norm_url) AS turn FROM queue q)
SELECT norm_url, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (ORDER BY turn, source_ordinal) AS BIGINT) AS position FROM turns t JOIN sources s ON s.source_site = t.source_site"""
)
def frontier_round_robin(spark, sf_dir):
    return frontier.round_robin(page_queue(spark, sf_dir)).select("norm_url", "turn", "position")


@query(f"WITH {QUEUE} SELECT norm_url, q.priority, CAST(row_number() OVER (ORDER BY q.priority, source_ordinal, seq, norm_url) AS BIGINT) AS position FROM queue q JOIN sources s ON s.source_site = q.source_site")
def frontier_priority(spark, sf_dir):
    return frontier.by_priority(page_queue(spark, sf_dir)).select("norm_url", "priority", "position")


@query(
    f"""WITH {QUEUE}, q AS (SELECT source_site, count(*) AS queue_size FROM queue WHERE priority > 0 GROUP BY source_site), c AS (SELECT source_site, count(*) AS crawled FROM queue WHERE priority = 0 GROUP BY source_site),
  r AS (SELECT coalesce(q.source_site, c.source_site) AS source_site, coalesce(crawled, 0) AS crawled, coalesce(queue_size, 0) AS queue_size FROM q FULL JOIN c ON q.source_site = c.source_site)
SELECT source_site, crawled, queue_size, CAST(greatest(30, greatest(1, floor(100 / greatest(1, count(*) FILTER (WHERE queue_size > 0) OVER ())))) AS BIGINT) AS quota_max,
  queue_size = 0 AND crawled > 0 AS depleted, round(crawled * 100e0 / sum(crawled) OVER (), 1) AS pct FROM r"""
)
def quota_report(spark, sf_dir):
    queue = page_queue(spark, sf_dir)
    return frontier.quota_report(queue.where("priority > 0"), queue.where("priority = 0"), 100)


@query(f"WITH {QUEUE} SELECT coalesce(source_site, 'all') AS source_site, coalesce(CAST(priority AS VARCHAR), 'all') AS priority, count(*) AS queue_size FROM queue GROUP BY ROLLUP (source_site, priority)")
def queue_sizes(spark, sf_dir):
    total = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return frontier.sizes(page_queue(spark, sf_dir)).select(total("source_site"), total("priority"), "queue_size")


# --- quality, logs, suggestions

DIMENSIONS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value FROM corpus" for d in ("source_site", "page_role", "file_type", "content_quality")) + " UNION ALL SELECT 'parse_status', 'ok' FROM corpus"


@query(f"WITH {CORPUS}, d AS ({DIMENSIONS}), n AS (SELECT dimension, value, count(*) AS n FROM d GROUP BY ALL) SELECT *, round(n * 100e0 / sum(n) OVER (PARTITION BY dimension), 1) AS pct FROM n")
def corpus_distribution(spark, sf_dir):
    return quality.distributions(corpus(spark, sf_dir))


@query(
    f"""WITH {CORPUS} SELECT count(*) AS total_docs, count(*) FILTER (file_type = 'html') AS html_pages, count(*) FILTER (file_type = 'pdf') AS pdf_files, count(*) FILTER (file_type = 'doc') AS doc_files,
  count(*) FILTER (file_type = 'docx') AS docx_files, count(*) FILTER (file_type = 'xls') AS xls_files, count(*) FILTER (file_type = 'xlsx') AS xlsx_files, count(*) FILTER (file_type IN ('zip', 'rar')) AS zip_files,
  count(*) FILTER (file_type IN ('ppt', 'pptx')) AS ppt_files, 0 AS other_files FROM corpus"""
)
def file_type_counts(spark, sf_dir):
    return quality.file_counts(corpus(spark, sf_dir))


NOISE = ("the", "thing", "der", "und", "les", "que", "with", "for")
NOISE_SCORE = " + ".join(f"CAST(contains(title, '{w}') OR contains(content, '{w}') AS INTEGER)" for w in NOISE)


@query(f"WITH {CORPUS} SELECT doc_id, CAST({NOISE_SCORE} AS INTEGER) AS noise_score FROM corpus WHERE {NOISE_SCORE} >= 5")
def nav_noise_docs(spark, sf_dir):
    return quality.noise_documents(corpus(spark, sf_dir), NOISE)


@query(
    rf"""WITH {CORPUS}, f AS (
  SELECT count(*) AS total_docs, count(*) FILTER (title = '' OR title = '无标题') AS no_title_count, count(*) FILTER (trim(regexp_replace(content, '\s+', '', 'g')) = '') AS empty_content_count,
    count(*) FILTER (length(content) > 0 AND length(content) < 100) AS short_content_count, CAST(floor(sum(length(content)) / greatest(count(*), 1)) AS BIGINT) AS avg_content_length,
    count(*) FILTER ({NOISE_SCORE} >= 5) AS suspected_noise_docs, count(*) FILTER (page_role = 'document') AS document_count, count(*) FILTER (page_role = 'detail' AND title IN ('In.', 'Der.')) AS list_misclassify_count,
    count(*) FILTER (content_quality = 'nav_noise') AS nav_noise_count, count(*) FILTER (content_quality = 'failed') AS failed_count,
    count(*) - count(DISTINCT url) AS duplicate_urls, count(*) - count(DISTINCT nullif(content_hash, '')) AS duplicate_content_hashes FROM corpus
), s AS (SELECT source_site, count(*) AS k FROM corpus GROUP BY source_site), m AS (SELECT source_site AS max_source_site, k FROM s ORDER BY k DESC, source_site DESC LIMIT 1)
SELECT f.*, m.max_source_site, round(no_title_count * 100e0 / total_docs, 1) AS no_title_ratio, round(empty_content_count * 100e0 / total_docs, 1) AS empty_content_ratio, round(short_content_count * 100e0 / total_docs, 1) AS short_content_ratio,
  round(document_count * 100e0 / total_docs, 1) AS document_pct, round(failed_count * 100e0 / total_docs, 1) AS failed_pct, round(k * 100e0 / total_docs, 1) AS max_source_site_pct FROM f CROSS JOIN m"""
)
def validation_report(spark, sf_dir):
    return quality.validation(corpus(spark, sf_dir), NOISE, ("In.", "Der.")).drop("warnings")


@query(f"WITH {CORPUS} SELECT count(*) - count(DISTINCT url) AS duplicate_urls, count(*) - count(DISTINCT nullif(content_hash, '')) AS duplicate_content_hashes FROM corpus")
def duplicate_counts(spark, sf_dir):
    return quality.duplicate_counts(corpus(spark, sf_dir))


@query(
    rf"""WITH {CORPUS}, p AS (
  SELECT 'failed_by_source' AS kind, source_site AS value FROM corpus WHERE content_quality = 'failed' UNION ALL SELECT 'failed_by_type', file_type FROM corpus WHERE content_quality = 'failed'
  UNION ALL SELECT 'failed_by_pattern', CASE WHEN regexp_extract(url, 'https?://[^/]+(/[^/]+/[^/]+/?)', 1) = '' THEN 'other' ELSE regexp_extract(url, 'https?://[^/]+(/[^/]+/[^/]+/?)', 1) END FROM corpus WHERE content_quality = 'failed'
  UNION ALL SELECT 'short_by_role', page_role FROM corpus WHERE length(content) > 0 AND length(content) < 100 UNION ALL SELECT 'short_by_source', source_site FROM corpus WHERE length(content) > 0 AND length(content) < 100
), n AS (SELECT kind, value, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS k FROM n)
SELECT kind, value, n FROM r WHERE k <= CASE kind WHEN 'failed_by_source' THEN 10 WHEN 'failed_by_pattern' THEN 15 ELSE 1000000 END"""
)
def failure_breakdown(spark, sf_dir):
    return quality.breakdown(corpus(spark, sf_dir))


def search_log(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("query"), F.col("ts").alias("search_time"))


@query("SELECT event_type AS query, count(*) AS cnt FROM events GROUP BY event_type ORDER BY cnt DESC, query LIMIT 3")
def popular_queries(spark, sf_dir):
    return logs.popular_queries(search_log(spark, sf_dir), 3)


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS query FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def search_log_page(spark, sf_dir):
    return logs.page(search_log(spark, sf_dir), "search_time", None, 50, 50).select("id", "user_id", "query")


@query("SELECT count(*) AS total FROM events")
def search_count(spark, sf_dir):
    return logs.search_count(search_log(spark, sf_dir))


HISTORY = "history AS (SELECT event_type AS text, count(*) AS cnt, max(ts) AS last FROM events WHERE lower(event_type) LIKE 'p%' GROUP BY 1 ORDER BY cnt DESC, last DESC, text LIMIT 10)"


@query(f"WITH {HISTORY} SELECT text, round(cnt * 1e0 / max(cnt) OVER (), 6) AS score FROM history")
def suggest_history(spark, sf_dir):
    return suggest.from_history(search_log(spark, sf_dir), "P").select("text", F.round("score", 6).alias("score"))


def titles_sql(prefix: str) -> str:
    return f"""titles AS (SELECT text, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(substr(title, instr(lower(title), '{prefix}'), 30)) AS text FROM corpus WHERE contains(lower(title), '{prefix}')) WHERE text <> '' GROUP BY text ORDER BY 2, text LIMIT 10)"""


def phrases_sql(prefix: str) -> str:
    n = len(prefix)
    return f"""starts AS (SELECT title, unnest(range(1, length(title) + 1)) AS i FROM corpus WHERE contains(title, '{prefix}')), sizes AS (SELECT unnest(range(greatest(2, {n}), 8)) AS n),
  phrases AS (SELECT substr(title, i, n) AS text, count(*) AS cnt FROM starts, sizes WHERE substr(title, i, {n}) = '{prefix}' AND i + n - 1 <= length(title) GROUP BY 1 ORDER BY cnt DESC, text LIMIT 10)"""


@query(f"WITH {CORPUS}, {titles_sql('th')} SELECT text, CAST(row_number() OVER (ORDER BY doc_id, text) AS INTEGER) AS ordinal FROM titles")
def suggest_title(spark, sf_dir):
    return suggest.from_titles(corpus(spark, sf_dir), "Th").select("text", "ordinal")


@query(f"WITH {CORPUS}, {phrases_sql('Th')} SELECT text, cnt, round(cnt * 7e-1 / max(cnt) OVER (), 6) AS score FROM phrases".replace("text, cnt, round", "text, round"))
def suggest_hot_phrases(spark, sf_dir):
    return suggest.from_phrases(corpus(spark, sf_dir), "Th").select("text", F.round("score", 6).alias("score"))


@query(
    f"""WITH {CORPUS}, {HISTORY}, {titles_sql('p')}, {phrases_sql('p')}, every AS (
  SELECT text, 'history' AS type, cnt * 1e0 / max(cnt) OVER () AS score, row_number() OVER (ORDER BY cnt DESC, last DESC, text) AS k FROM history
  UNION ALL SELECT text, 'title', 5e-1, 1000 + row_number() OVER (ORDER BY doc_id, text) FROM titles
  UNION ALL SELECT text, 'hot', cnt * 7e-1 / max(cnt) OVER (), 2000 + row_number() OVER (ORDER BY cnt DESC, text) FROM phrases
), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS again FROM every) WHERE again = 1 ORDER BY k LIMIT 10)
SELECT text, type, round(score, 6) AS score FROM first"""
)
def suggest_merged(spark, sf_dir):
    return suggest.suggestions(corpus(spark, sf_dir), search_log(spark, sf_dir), "p").select("text", "type", F.round("score", 6).alias("score"))


# --- streaming


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the session names. Without one a temporary one is made, which is right for
    one machine only, so anything but a local master is refused."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="siftwell-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def event_stream(spark, sf_dir):
    static = read(spark, sf_dir, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*").select(F.col("event_type").alias("query"), F.col("ts").alias("search_time"), "event_id", "user_id")


@query("SELECT event_type AS query, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, sf_dir):
    where = folder(spark, "counts")
    counts = streams.log_counts(event_stream(spark, sf_dir))

    def keep(batch: DataFrame, number: int) -> None:  # the counts that changed
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    latest = spark.read.parquet(f"{where}/out").groupBy("window_start", "query").agg(F.max_by("n", "batch").alias("n"))
    return latest.groupBy("query").agg(F.sum("n").alias("n"))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_dedup(spark, sf_dir):
    where = folder(spark, "first")
    first = streams.first_seen(event_stream(spark, sf_dir), "user_id", "search_time", "400 days").select("user_id")
    return streams.run_to_table(first, f"{where}/out", f"{where}/state").groupBy("user_id").agg(F.count("*").alias("n"))


from siftwell import queries_pages, queries_tables  # noqa: E402,F401  more of them
