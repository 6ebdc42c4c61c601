"""Pages as trees, files, streams."""

import io
import json
import zipfile

from siftwell.functions import dom
from siftwell.operators import frontier, index
from siftwell.sources import tables
from siftwell.streaming import streams

LONG = "This is a sentence of the article that goes on for a while. " * 4
HTML = f"""<html><head><title>Real headline - Site</title><meta name="pubdate" content="2024年3月5日"><script>var x = "<a href='/no'>";</script></head>
<body><nav><a href="/nav.htm">nav</a></nav><div class="content"><h1>Real headline</h1><p>{LONG}<p>{LONG}
<a href="/info/1/2.htm">one</a> <a href="f.pdf">file</a> <a href="#x">no</a> <a href="mailto:a@b">no</a> <a href="list3.htm">下一页</a></div><div class="footer">版权所有</div></body></html>"""


def test_page():
    page = dom.Page(HTML, "http://a.b/c/d.html")
    assert page.title() == "Real headline"
    assert LONG.strip() in page.content() and "nav" not in page.content()
    assert page.publish_time() == "2024-03-05"
    assert page.role() == "detail"
    assert [x["url"] for x in page.links()] == ["http://a.b/info/1/2.htm", "http://a.b/c/f.pdf", "http://a.b/c/list3.htm"]
    assert [x["is_detail"] for x in page.links()] == [False, False, False]  # /info/1/2.htm ends like a numbered list page
    assert page.pagination() == ["http://a.b/c/list3.htm"]
    assert [*page.attachments()] == ["http://a.b/c/f.pdf"]


def test_page_fallbacks():
    assert dom.Page("", "http://a.b/some-page.html").title() == "some page"
    assert dom.Page("<title>首页</title>", "http://a.b/", site="S", category="C").title() == "S-C"
    assert dom.Page("<h2>Second</h2>", "u").title() == "Second"
    assert dom.Page("", "http://a.b/list7.htm").pagination() == [f"http://a.b/list{n}.htm" for n in (2, 3, 4, 5, 6, 8, 9, 10, 11, 12)]
    assert dom.Page("<li>" * 20 + "2024-01-01 " * 6, "http://a.b/x").role() == "list"
    assert dom.parse_date("on 2024.1.5!") == "2024-01-05" and dom.parse_date(" soon ") == "soon"
    assert [dom.content_quality(x, "detail") for x in ("", "a", "a" * 60, "a" * 150)] == ["failed", "failed", "short", "good"]
    assert dom.content_quality("a" * 150, "list") == "short"
    assert dom.content_quality(" ".join(sorted(dom.COLUMNS)), "detail") == "nav_noise"


def test_parse_pages(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c/d.html", HTML), (2, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in dom.parse_pages(rows).collect()}
    assert len(found[1]["links"]) == 3 and found[2]["content_quality"] == "failed"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "title": "t"}\n\nbroken{\n{"doc_id": "2"}\n')
    docs = tables.read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r["doc_id"] for r in docs.where("doc_id IS NOT NULL").collect()) == ["1", "2"]
    assert tables.read_corpus(spark, str(tmp_path / "none")).count() == 0
    tables.write_corpus(docs, str(tmp_path / "out"), fresh=True)
    tables.write_report(docs.na.fill(""), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/report")).count() == 1
    (tmp_path / "stop.txt").write_text("# no\n the \n\nand\n")
    assert tables.read_stop_words(spark, str(tmp_path / "stop.txt")) == ["and", "the"]


def test_seeds_and_checkpoint(spark, tmp_path):
    seeds = {"allowed_domains": ["a.b"], "sources": [{"name": "S", "base_url": "http://a.b", "seed_urls": [{"url": "http://a.b/1", "category": "c", "page_role": "portal"}, {"url": "http://a.b/2"}]}]}
    (tmp_path / "seeds.json").write_text(json.dumps(seeds))
    queue = frontier.enqueue(frontier.seeds(tables.read_seeds(spark, str(tmp_path / "seeds.json"))))
    assert {r["url"]: r["priority"] for r in queue.collect()} == {"http://a.b/1": 3, "http://a.b/2": 2}
    tables.save_checkpoint(str(tmp_path / "state"), queue, queue.select("norm_url"), queue.select("source_site"))
    assert tables.load_checkpoint(spark, str(tmp_path / "state"))[0].count() == 2
    assert tables.load_checkpoint(spark, str(tmp_path / "nothing")) is None


def zipped(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_attachments(spark, tmp_path):
    w, s = tables.W[1:-1], tables.S[1:-1]
    docx = zipped(word__document_xml=f'<d xmlns="{w}"><p><t>Hello</t><t> you</t></p><p><t> </t></p><p><t>End</t></p></d>')
    xlsx = zipped(xl__sharedStrings_xml=f'<s xmlns="{s}"><si><t>A</t></si></s>', xl__worksheets__sheet1_xml=f'<w xmlns="{s}"><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></w>')
    for name, data in (("a.docx", docx), ("b.xlsx", xlsx), ("c.docx", b"broken"), ("d.rar", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = {r["path"][-6:]: r for r in tables.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"]["content"] == "Hello you\nEnd" and rows["b.xlsx"]["content"] == "A 5"
    assert rows["c.docx"]["parse_status"] == "failed" and rows["/d.rar"]["parse_status"] == "skipped"
    given = spark.createDataFrame([("n.pdf", "", "", "", "failed"), ("n.doc", "plan.docx", "c", "x" * 60, "ok"), ("n.zip", "", "c", " ", "skipped")], "name string, anchor_text string, category string, content string, parse_status string")
    rows = tables.attachment_documents(given).collect()
    assert [(r["title"], r["content_quality"], r["content_length"]) for r in rows] == [("n", "short", 1), ("plan", "good", 60), ("n.zip", "short", 13)]
    assert rows[2]["content"] == "n.zip | 分类: c"


def test_snapshots(spark):
    pages = spark.createDataFrame([(k, "http://a.b/x", "<p>", "html", "list") for k in range(5)] + [(9, "u", "h", "pdf", "document")], "doc_id int, url string, html string, file_type string, page_role string")
    assert frontier.snapshots(pages, cap=3).count() == 3


def test_growing_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha"), ("b", "beta alpha")], "doc_id string, content string")
    path = str(tmp_path / "index")
    index.build(docs.limit(0)).save(path)
    docs.repartition(2, "doc_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.grow_index(stream, path, str(tmp_path / "state")).awaitTermination()
    grown = index.Index.load(spark, path)
    assert grown.corpus_stats.first()["n_docs"] == 2
    assert grown.lookup(["alpha"]).count() == 2
