"""A crawl over a little site, and fetching with an opener of our own."""

import io
import zipfile

from siftwell.operators import frontier, index
from siftwell.plans.crawl import crawl, raw_html, sources, statistics
from siftwell.plans.search import SearchEngine
from siftwell.sources import fetch, tables

BODY = "A long sentence of the page that is there to be read. " * 5
SITE = {
    "http://a.b/": f"<title>Start page</title><div class='content'>{BODY}<a href='x/one.html'>one</a><a href='/x/two.html'>two</a><a href='http://other/'>no</a></div>",
    "http://a.b/x/one.html": f"<title>Page one</title><div class='content'>{BODY} 1 <a href='/x/two.html'>two</a><a href='/missing.html'>gone</a></div>",
    "http://a.b/x/two.html": f"<title>Page one</title><div class='content'>{BODY} 1 <a href='/x/two.html'>two</a><a href='/missing.html'>gone</a></div>",
}


def test_crawl(spark, tmp_path):
    site = spark.createDataFrame(list(SITE.items()), "url string, html string")
    get = lambda asked: asked.join(site, "url", "left").selectExpr("url", "html", "CASE WHEN html IS NULL THEN 'HTTP 404' ELSE '' END AS error")
    seeds = spark.createDataFrame([("http://a.b/", "S", 3, 0)], "url string, source_site string, priority int, seq long")
    docs = crawl(spark, str(tmp_path), seeds, get, ["a.b"], batches=1)
    assert {r["title"] for r in docs.collect()} == {"Start page"}
    docs = crawl(spark, str(tmp_path), None, get, ["a.b"], batches=5)  # goes on from the saved state
    assert sorted(r["url"] for r in docs.collect()) == ["http://a.b/", "http://a.b/x/one.html"]  # two has the same content
    visited = {r["norm_url"] for n in (1, 2) for r in spark.read.parquet(f"{tmp_path}/state/{n}/visited").collect()}
    assert visited == {"http://a.b/", "http://a.b/x/one.html", "http://a.b/x/two.html", "http://a.b/missing.html"}
    facts = statistics(spark, str(tmp_path)).first()
    assert (facts["total_docs"], facts["failed_urls"], facts["duplicate_urls"]) == (2, 1, 1)
    errors = spark.read.parquet(f"{tmp_path}/errors").collect()
    assert [(r["url"], r["kind"], r["error"]) for r in errors] == [("http://a.b/missing.html", "fetch", "HTTP 404")]


FILES_SITE = {
    "http://c.d/": f"<head></head><div class='content'>{BODY}<a href='/a/plan.docx'>培养方案</a><a href='/a/old.xls'>表</a><a href='/a/all.zip'>附件</a><a href='/info/1.htm'>Anchor of one</a></div>",
    "http://c.d/info/1.htm": f"<div class='content'>{BODY} of one<a href='http://e.f/'>outside</a></div>",
    "http://www.other.d/": f"<title>Other</title><div class='content'>{BODY} other</div>",
}


def docx(*lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_crawl_with_files(spark, tmp_path):
    """Attachments are fetched and read, titles fall back on anchors and sites, and the corpus can be indexed and searched."""
    path = str(tmp_path / "crawl")
    site = spark.createDataFrame(list(FILES_SITE.items()), "url string, html string")
    files = spark.createDataFrame([("http://c.d/a/plan.docx", docx("课程 plan of studies", "second line " * 5)), ("http://c.d/a/old.xls", b"old"), ("http://c.d/a/all.zip", b"PK")], "url string, content binary")
    get = lambda asked: asked.join(site, "url", "left").selectExpr("url", "html", "'gone' AS error")
    load = lambda asked: asked.join(files, "url", "left").selectExpr("url", "content", "'' AS error")
    seeds = spark.createDataFrame([("http://c.d/", "学院", "通知", 2, 0), ("http://www.other.d/", "", "", 2, 1)], "url string, source_site string, category string, priority int, seq long")
    docs = crawl(spark, path, seeds, get, ["c.d", "other.d"], batches=4, fetch_files=load, sites=[("http://www.other", "别的站")])
    rows = {r["url"]: r for r in docs.collect()}
    assert len(rows) == 6 and {r["doc_id"] for r in rows.values()} >= {"nk_000001", "nk_000002"} and len({r["doc_id"] for r in rows.values()}) == 6
    assert rows["http://c.d/"]["title"] == "学院-通知" and rows["http://c.d/info/1.htm"]["title"] == "Anchor of one"
    assert rows["http://c.d/info/1.htm"]["category"] == "通知" and rows["http://www.other.d/"]["source_site"] == "别的站"
    plan, old, zipped = (rows[f"http://c.d/a/{n}"] for n in ("plan.docx", "old.xls", "all.zip"))
    assert (plan["title"], plan["parse_status"], plan["content_quality"], plan["page_role"], plan["parent_url"]) == ("培养方案", "ok", "good", "document", "http://c.d/")
    assert plan["doc_id"].startswith("nk_file_") and plan["content"].startswith("课程 plan of studies second line")
    assert (old["parse_status"], old["content_quality"], old["content"]) == ("failed", "short", "表 | 链接文本: 表 | 分类: 通知")
    assert zipped["parse_status"] == "skipped"
    assert {r["kind"] for r in spark.read.parquet(f"{path}/errors").collect()} == {"parse"}
    first = rows["http://c.d/"]
    assert first["snapshot_path"] == f"snapshots/{first['doc_id']}.html" and '<base href="http://c.d/' in tables.read_snapshot(spark, path, first["doc_id"])
    assert tables.has_snapshot(spark, path, first["doc_id"]) and not tables.has_snapshot(spark, path, plan["doc_id"])
    assert raw_html(spark, path, first["doc_id"]) == FILES_SITE["http://c.d/"] and raw_html(spark, path, "none") is None
    report = {r["source_site"]: (r["crawled"], r["depleted"]) for r in sources(spark, path).collect()}
    assert report["学院"] == (5, True) and report["别的站"] == (1, True)
    index.build(docs).save(str(tmp_path / "index"))
    found = SearchEngine(index.Index.load(spark, str(tmp_path / "index"))).search("培养方案")
    assert [r["url"] for r in found["results"].collect()][0] == "http://c.d/a/plan.docx"


def test_quota_and_depletion(spark):
    """A source beyond its quota comes behind the others; depleted ones don't come; few sources have no quota."""
    rows = [(f"http://{s}/{k}", f"http://{s}/{k}", s, 1, k * 10 + n) for n, s in enumerate("abcd") for k in range(3)]
    queue = spark.createDataFrame(rows, "norm_url string, url string, source_site string, priority int, seq long")
    crawled = spark.createDataFrame([("b", 3), ("c", 1)], "source_site string, crawled long")
    place = lambda d: [r["url"][7:] for r in d.orderBy("position").collect()]
    assert place(frontier.round_robin(queue, crawled=crawled, total=6, ratio=0.5)) == ["a/0", "c/0", "d/0", "a/1", "c/1", "d/1", "a/2", "d/2", "b/0", "b/1", "b/2", "c/2"]
    assert place(frontier.round_robin(queue.where("source_site <> 'd'"), crawled=crawled, total=6, ratio=0.5))[:3] == ["a/0", "b/0", "c/0"]
    gone = spark.createDataFrame([("a",)], "source_site string")
    assert place(frontier.round_robin(queue, gone))[:3] == ["b/0", "c/0", "d/0"]


def test_stretches_of_the_queue(spark, monkeypatch):
    rows = [(f"u{k}", f"u{k}", f"s{k % 7 if k % 3 else 0}", k % 2, k) for k in range(200)]
    queue = spark.createDataFrame(rows, "norm_url string, url string, source_site string, priority int, seq long")
    crawled = spark.createDataFrame([("s1", 20), ("s0", 5)], "source_site string, crawled long")
    ask = lambda: [(r["url"], r["position"]) for r in frontier.round_robin(queue, None, crawled, 60, 0.2).orderBy("position").collect()]
    whole = ask()
    for size in (3, 20):  # fewer than the sources, and more
        monkeypatch.setattr(frontier, "STRETCH", size)
        assert ask() == whole and [p for _, p in whole] == [*range(1, 201)]


def test_fetch(spark):
    def opener(url, timeout):
        if url.endswith("gone"):
            return 404, {}, b""
        if url.endswith("down"):
            raise OSError("no route")
        if url.endswith("pdf"):
            return 200, {"content-type": "application/pdf"}, b"%PDF"
        return 200, {"content-type": "text/html; charset=gbk"}, "大学".encode("gbk")

    urls = spark.createDataFrame([(f"http://a/{x}",) for x in ("ok", "gone", "down", "pdf")], "url string")
    pages = {r["url"][9:]: r for r in fetch.fetch_pages(urls, opener, 0, 2, 0).collect()}
    assert pages["ok"]["html"] == "大学" and pages["gone"]["error"] == "HTTP 404" and "no route" in pages["down"]["error"] and "pdf" in pages["pdf"]["error"]
    files = {r["url"][9:]: r for r in fetch.fetch_files(urls, opener, 0, 2, 0).collect()}
    assert bytes(files["pdf"]["content"]) == b"%PDF" and files["ok"]["content"] is None
    assert frontier.quota(10, 0.0, 2) is None
