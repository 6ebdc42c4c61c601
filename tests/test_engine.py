"""The engine on small hand-made data: index, terms, ranking, search."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text, urls
from siftwell.functions.segment import segmented_tokens
from siftwell.operators import frontier, index, logs, quality, ranking, suggest, terms
from siftwell.plans.search import SearchEngine, match_mode_for

POSTINGS = [
    *(("title", t, d, n) for t, d, n in (("南开", "doc1", 2), ("南开", "doc2", 1), ("大学", "doc1", 1), ("大学", "doc2", 1), ("大学", "doc3", 1), ("计算机", "doc2", 3))),
    *(
        ("content", t, d, n)
        for t, d, n in (("南开", "doc1", 5), ("南开", "doc2", 2), ("南开", "doc3", 1), ("大学", "doc1", 10), ("大学", "doc2", 8), ("大学", "doc3", 5), ("计算机", "doc2", 15), ("计算机", "doc1", 1))
    ),
]


@pytest.fixture(scope="module")
def mock(spark):
    sizes = {"doc1": (5, 100), "doc2": (8, 200), "doc3": (3, 50)}
    postings = spark.createDataFrame([(f, t, d, n, sizes[d][f == "content"]) for f, t, d, n in POSTINGS], "field string, term string, doc_id string, tf int, size int")
    lengths = spark.createDataFrame([(d, *n) for d, n in sizes.items()], "doc_id string, title_len int, content_len int")
    return postings, index.term_statistics(postings), index.statistics_of(lengths)


def scores(spark, mock, words, weights=None):
    asked = spark.createDataFrame([(0, w) for w in words], "query_id int, term string")
    return {r["doc_id"]: round(r["bm25"], 6) for r in ranking.bm25(*mock, asked, weights).collect()}


@pytest.mark.parametrize(
    "words, expected",
    [
        (["计算机"], {"doc1": 0.502294, "doc2": 5.377825}),
        (["大学"], {"doc1": 0.706587, "doc2": 0.586210, "doc3": 0.783770}),
        (["南开"], {"doc1": 2.318898, "doc2": 1.306170, "doc3": 0.179754}),
        (["南开", "大学", "计算机"], {"doc1": 3.527779, "doc2": 7.270204, "doc3": 0.963524}),
        (["不存在词"], {}),
    ],
)
def test_bm25(spark, mock, words, expected):
    assert scores(spark, mock, words) == expected


def test_bm25_weights_and_repeats(spark, mock):
    assert scores(spark, mock, ["南开"], {"title": 5.0, "content": 1.0})["doc1"] == 3.689296
    once, twice = scores(spark, mock, ["大学"]), scores(spark, mock, ["大学", "大学"])
    assert all(twice[d] == pytest.approx(2 * once[d], abs=2e-6) for d in once)


def test_fixture_searched_end_to_end(spark, mock):
    """Scores, order and matched terms of whole searches over the given postings, with the given words as tokens."""
    postings, stats, corpus = mock
    found = spark.createDataFrame([(d, f"{d}的标题", "正文") for d in ("doc1", "doc2", "doc3")], "doc_id string, title string, content string")
    lengths = postings.select("doc_id").distinct().selectExpr("doc_id", "0 AS title_len", "0 AS content_len")
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    built = SearchEngine(index.Index(index.with_defaults(found), postings, stats, lengths, corpus), analyze=words)
    got = built.search("南开 大学 计算机", "exact")
    assert [(r["doc_id"], r["bm25_score"]) for r in got["results"].collect()] == [("doc2", 7.2702), ("doc1", 3.5278), ("doc3", 0.9635)]
    assert built.search("南开 计算机", "normal")["total"] == 2  # a space means all words: doc3 has one of them
    assert [r["doc_id"] for r in built.search("大学", "normal")["results"].collect()] == ["doc3", "doc1", "doc2"]
    wild = built.search("计算*", "wildcard")
    assert wild["matched_terms"] == ["计算机"] and [r["doc_id"] for r in wild["results"].collect()] == ["doc2", "doc1"]
    for words_, kind in (("不存在词", "normal"), ("xyz*", "wildcard"), ("", "normal")):
        none = built.search(words_, kind)
        assert (none["total"], none["total_pages"], none["results"].count(), none["user_profile_name"]) == (0, 0, 0, "默认用户")


def test_chinese_text(spark):
    """Han characters become pairs, other words stay; a search for a part of a title finds it."""
    docs = spark.createDataFrame([("a", "南开大学计算机学院2024年招生简章", "AI技术 and 机器学习"), ("b", "图书馆开放时间", "周一至周五")], "doc_id string, title string, content string")
    built = index.build(docs, analyze=index.analyzer(segmented=False))
    rows = {r["doc_id"]: r for r in index.analyzed(docs, index.analyzer(segmented=False)).collect()}
    assert rows["a"]["title_tokens"][:4] == ["南开", "开大", "大学", "学计"] and rows["a"]["content_tokens"] == ["ai", "技术", "and", "机器", "器学", "学习"]
    search = SearchEngine(built, analyze=index.analyzer(segmented=False))
    assert [r["doc_id"] for r in search.search("计算机")["results"].collect()] == ["a"]
    assert [r["doc_id"] for r in search.search("图书馆")["results"].collect()] == ["b"]


def test_segmenter(spark, tmp_path):
    """Where there is a segmenter, texts with Han characters go through it and others don't."""
    (tmp_path / "cutter_of_tests.py").write_text("def lcut(t):\n    return ['南开', ' ', 'ABC', '12', '大学']\n")
    spark.sparkContext.addPyFile(str(tmp_path / "cutter_of_tests.py"))
    rows = spark.createDataFrame([("南开ABC",), ("plain Words 12",), (None,)], "t string")
    found = rows.select(segmented_tokens(F.col("t"), ("大学", "plain"), "cutter_of_tests").alias("x")).collect()
    assert [r["x"] for r in found] == [["南开", "abc"], ["words"], []]


WILD = "南开大学 南开大学计算机学院 南开大学人工智能学院 南开大学教务部 奖学金申请 奖学金评定 奖助学金 2024年 2025年 2026年 温度计 温馨提醒 温和 研究生招生 本科生教学 人工智能 机器学习".split()


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("南开*", 4), ("*教学", 1), ("奖*金", 1), ("202?年", 3), ("温??", 1), ("温???", 1), ("人工智能", 1), ("xyz123*", 0), ("199?年", 0), ("", 0), ("奖*", 3), ("*", 17), ("a.b*", 0),
    ],
)
def test_wildcard(spark, pattern, expected):
    vocabulary = spark.createDataFrame([(w,) for w in WILD], "term string")
    assert terms.wildcard_terms(vocabulary, pattern).count() == expected


def test_fuzzy(spark):
    words = "南开大学 南开大院 南开大穴 计算机学院 计算计学院 计算机学 奖学金申请 奖学金评定 奖学今申请".split()
    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    asked = spark.createDataFrame([(0, "南开大学")], "position int, query_term string")
    near = [(r["term"], r["distance"]) for r in terms.similar_terms(vocabulary, asked).orderBy("rank").collect()]
    assert near == [("南开大学", 0), ("南开大穴", 1), ("南开大院", 1)]
    assert [r["term"] for r in terms.similar_terms(vocabulary, asked, max_distance=0).collect()] == ["南开大学"]
    assert terms.expand(vocabulary, asked).orderBy("ordinal").first()["term"] == "南开大学"
    score = lambda a, b: spark.range(1).select(terms.match_score(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert score("abc", "ABC") == 1.0 and score("", "x") == 0.0 and 0 < score("南开大学", "南开大院") < 1 and score("abc", "xyz") < 0.5


DOCS = [
    ("a", "http://x/info/1.htm", "alpha beta", "alpha gamma gamma", "good", "2024-12-30", "html", "siteone"),
    ("b", "http://x/2.pdf", "alpha", "beta beta", "nav_noise", "", "pdf", "sitetwo"),
    ("c", "http://x/3", "", "delta", "failed", "2020-01-01", "html", "alpha"),
    ("d", "http://x/4", "alphb", "epsilon <b>zeta</b> http://u.v/w 123 9a", "short", "junk", "html", "sitetwo"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, url string, title string, content string, content_quality string, publish_time string, file_type string, source_site string")


@pytest.fixture(scope="module")
def engine(docs):
    return SearchEngine(index.build(docs), as_of=F.to_date(F.lit("2024-12-31")))


def ids(result):
    return [r["doc_id"] for r in result["results"].collect()]


def test_index_rules(engine):
    built = engine.index
    assert {r["doc_id"]: (r["title_len"], r["content_len"]) for r in built.doc_len.collect()}["c"] == (0, 1)  # the source isn't in the length
    assert built.postings.where("field = 'title' AND term = 'alpha' AND doc_id = 'c'").count() == 1  # but in the postings
    assert {r["term"] for r in built.vocabulary("content").collect()} == {"alpha", "gamma", "beta", "delta", "epsilon", "zeta", "9a"}
    total = built.postings.where("field = 'content'").agg(F.sum("tf")).first()[0]
    assert total == built.doc_len.agg(F.sum("content_len")).first()[0]


def test_search_types(engine):
    assert set(ids(engine.search("alpha"))) == {"a", "b", "c"}
    assert ids(engine.search("alpha beta")) == ["a", "b"]  # a space means AND
    assert set(ids(engine.search("alpha nothing"))) == {"a", "b", "c"}  # unknown words don't count
    assert engine.search("nothing")["total"] == 0
    assert engine.search("nothing")["total_pages"] == 0
    assert set(ids(engine.search("alph?", "wildcard"))) == {"a", "b", "d"}  # c scores 0 and has only a wildcard term
    assert engine.search("zzz*", "wildcard")["total"] == 0
    assert "alphb" in engine.search("alpha", "fuzzy")["fuzzy_expansions"]
    assert "d" not in ids(engine.search("alpha", "fuzzy")) and "d" in ids(engine.search("alpha", "fuzzy", fuzzy_retrieval=True))
    assert ids(engine.search("alpha", "doc", doc_only=True)) == ["b"]
    assert set(ids(engine.search("alpha", "exact", filters={"source": "site", "date_from": "2024-01-01"}))) == {"a", "b"}
    first = engine.search("alpha", page_size=1)
    assert first["total_pages"] == 3 and ids(first) + ids(engine.search("alpha", page=2, page_size=2)) == [ids(engine.search("alpha"))[0], ids(engine.search("alpha"))[2]]
    row = engine.search("alpha beta")["results"].first()
    assert "<mark>" in row["title_highlight"] and row["match_explanation"].startswith("标题命中")
    with pytest.raises(ValueError):
        engine.search("alpha", page=0)
    assert [match_mode_for(*x) for x in (("a b", "normal"), ("a b", "exact"), ("ab", "multi"))] == ["and", "or", "or"]


def test_order_and_penalties(spark):
    rows = spark.createDataFrame(
        [("1", 8.0, "nav_noise"), ("2", 3.0, "nav_noise"), ("3", 3.0, "good"), ("4", 10.0, "failed"), ("5", 3.0, "")], "doc_id string, bm25 double, content_quality string"
    ).selectExpr("*", "'' AS title", "'' AS content", "'' AS url", "'' AS source_site", "'' AS publish_time")
    ranked = ranking.scored(rows, F.to_date(F.lit("2024-01-01")), None).orderBy(*ranking.final_order()).collect()
    assert [(r["doc_id"], round(r["score"], 4)) for r in ranked] == [("5", 3.0), ("1", 3.0), ("4", 3.0), ("3", 3.0), ("2", 0.0)]


def test_boosts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    day = F.to_date(F.lit("2024-06-30"))
    assert [one(ranking.recency_boost(F.lit(d), day)) for d in ("2024-06-25", "2024-6-1", "2024-04-15", "2023-09-01", "2001-01-01", "2030-01-01", "", "junk")] == [0.3, 0.2, 0.1, 0.05, 0.0, 0.3, 0.0, 0.0]
    assert one(ranking.source_boost(F.lit("南开大学教务部网"))) == 0.3
    _, words, sites = ranking.profile("admission_user")
    boost = lambda t: one(ranking.profile_boost(F.lit(t), F.lit(""), F.lit(""), words, sites))
    assert boost("研究生招生通知") == 4.0 and boost("校园") == 0.0
    assert {r["user_id"] for r in ranking.profile_names(spark).collect()} == set(ranking.PROFILES)
    assert ranking.profile("nobody") == ranking.profile("default")


def test_save_load_append(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    index.build(docs.where("doc_id < 'c'")).save(path)
    for _ in range(2):  # a batch that comes again replaces itself
        index.append(spark, path, docs.where("doc_id >= 'c'"), 1)
    saved, whole = index.Index.load(spark, path), index.build(docs)
    for t in ("postings", "term_stats", "doc_len", "corpus_stats"):
        a, b = getattr(saved, t), getattr(whole, t)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), t
    with pytest.raises(FileNotFoundError):
        index.Index.load(spark, str(tmp_path / "none"))


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.highlight(F.lit("南开大学奖学金申请通知"), ["奖学金", "学金"])) == "南开大学<mark>奖学金</mark>申请通知"
    assert one(text.highlight(F.lit("a.b aXb A.B"), ["a.b"])) == "<mark>a.b</mark> aXb <mark>A.B</mark>"
    assert one(text.plain_snippet(F.lit("x" * 100 + "key" + "y" * 400), ["key"])) == "..." + "x" * 50 + "key" + "y" * 247 + "..."
    assert one(text.plain_snippet(F.lit("abc"), ["zz"])) == "abc" and one(text.plain_snippet(F.lit(None).cast("string"), [])) == ""
    assert one(text.tokens(F.lit("<p>The 123 Cafés</p> 2a http://x.y/z, the"), ["the"])) == ["cafés", "2a"]
    assert one(text.summary(F.lit("a  b\n" + "c" * 300))).endswith("...")
    assert one(text.document_id(F.lit(7), F.lit("pdf"))) == "nk_file_000007"
    assert one(text.clean_crawled(F.lit("a&nbsp;b\x01  c"))) == "a b c"


@pytest.mark.parametrize(
    "url, norm, kind, role, link",
    [
        ("http://a.b/x/", "http://a.b/x", "html", "list", False),
        ("HTTP://a.b/", "http://a.b/", "html", "list", False),
        ("http://a.b/x/../y?q=1#f", "http://a.b/x/y?q=1", "html", "detail", False),
        ("http://a.b/doc.PDF?d=1", "http://a.b/doc.PDF?d=1", "pdf", "document", False),
        ("http://a.b/f.docx", "http://a.b/f.docx", "docx", "document", False),
        ("http://a.b/list2.htm", "http://a.b/list2.htm", "html", "list", False),
        ("http://a.b/info/1/2.htm", "http://a.b/info/1/2.htm", "html", "detail", False),
        ("http://a.b/2024/0101/c1a2/page.htm", "http://a.b/2024/0101/c1a2/page.htm", "html", "detail", True),
        ("http://a.b/index.html", "http://a.b/index.html", "html", "portal", False),
        ("http://a.b/?p=12", "http://a.b/?p=12", "html", "detail", True),
        ("", "", "html", "list", False),
    ],
)
def test_urls(spark, url, norm, kind, role, link):
    row = spark.range(1).select(urls.normalize(F.lit(url)), urls.file_type(F.lit(url)), urls.role_by_url(F.lit(url)), urls.is_detail_link(F.lit(url))).first()
    assert tuple(row) == (norm, kind, role, link)


def test_base_href(spark):
    one = lambda h, u: spark.range(1).select(urls.with_base_href(F.lit(h), F.lit(u)).alias("x")).first()["x"]
    assert one("<html><HEAD a>x</HEAD><head>", "http://a.b/c/d.htm") == '<html><HEAD a>\n<base href="http://a.b/c/">x</HEAD><head>'
    assert one("x", "http://a.b/c").startswith('<!DOCTYPE html>\n<html><head><base href="http://a.b/c/"></head>')
    assert one("x", "") == "x"


def test_frontier(spark):
    rows = spark.createDataFrame(
        [("http://a/1", "A", 2, 0), ("http://a/2", "A", 1, 1), ("http://b/1", "B", 2, 2), ("http://a/1#x", "A", 0, 3), ("http://c/1", None, 9, 4), ("http://v/", "A", 1, 5)],
        "url string, source_site string, priority int, seq long",
    )
    queue = frontier.enqueue(rows, visited=spark.createDataFrame([("http://v/",)], "norm_url string"))
    order = lambda d: [r["norm_url"] for r in d.orderBy("position").collect()]
    assert order(frontier.round_robin(queue)) == ["http://a/2", "http://b/1", "http://c/1", "http://a/1"]
    assert order(frontier.by_priority(queue)) == ["http://a/2", "http://a/1", "http://b/1", "http://c/1"]
    assert frontier.quota(1000, 0.3, 10) == 300 and frontier.quota(1000, 0.3, 2) == 500 and frontier.quota(None, 0.3, 2) is None
    report = {r["source_site"]: r for r in frontier.quota_report(queue, spark.createDataFrame([("Z",), ("Z",), ("B",)], "source_site string"), 100).collect()}
    assert report["Z"]["depleted"] and report["Z"]["pct"] == 66.7 and report["A"]["queue_size"] == 2


def test_quality(spark, docs):
    row = quality.verdicts(quality.validation(docs.withColumn("page_role", F.lit("detail")), ("alpha",), ("alpha",))).first()
    assert (row["total_docs"], row["no_title_count"], row["list_misclassify_count"], row["title_check"]) == (4, 1, 1, "FAIL")
    assert any("误判" in w for w in row["warnings"]) and any("document" in w for w in row["warnings"])
    empty = spark.createDataFrame([(1, ""), (2, ""), (3, "h")], "doc_id int, content_hash string")
    assert quality.duplicate_counts(empty).first()["duplicate_content_hashes"] == 2
    speed = quality.crawl_summary(spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string"), 4.0).first()
    assert tuple(speed) == (2, 1, 0, 0.5)


def test_suggestions(spark):
    log = spark.createDataFrame([("abc", "1"), ("abc", "2"), ("Abd", "3")], "query string, search_time string")
    titles = spark.createDataFrame([(1, "xx abcdef"), (2, "abq"), (3, None)], "doc_id int, title string")
    found = suggest.suggestions(titles, log, "ab").collect()
    assert [(r["text"], r["type"]) for r in found[:3]] == [("abc", "history"), ("ab", "hot"), ("Abd", "history")]
    assert [r["text"] for r in suggest.suggestions(titles, log, "").collect()] == ["abc", "Abd"]


def test_logs(spark, tmp_path):
    path = str(tmp_path)
    logs.create(spark, path)
    logs.create(spark, path)
    logs.log_search(spark, path, "u", "q", "normal", "", 3, "2024-01-02 00:00:00")
    logs.log_search(spark, path, "v", "q", "normal", "", 3, "2024-01-01 00:00:00")
    logs.log_click(spark, path, "u", "q", "d")
    rows = spark.read.parquet(f"{path}/search_logs")
    assert [r["user_id"] for r in logs.page(rows, "search_time").collect()] == ["u", "v"]
    assert logs.page(rows, "search_time", "v").count() == 1 and logs.popular_queries(rows).first()["cnt"] == 2
    assert spark.read.parquet(f"{path}/click_logs").count() == 1
