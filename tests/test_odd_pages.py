"""Queries over few pages of odd kinds, against their SQL."""

import duckdb
import pytest

from siftwell.functions.dom import Page
from siftwell.queries import QUERIES, SQL

PAGE = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><a href=\"/x\">x</a></nav><div class=\"ad\">ad</div><article><h1>{0}</h1><p>{1}</p></article><footer>&copy; end</footer></body></html>"


def same_as_sql(spark, path, compare, name: str, pages: list[tuple]) -> None:
    file = f"{path}/pages.parquet"
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(file)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{file}/*.parquet')")
    compare(QUERIES[name](spark, str(path)).toPandas(), con.execute(SQL[name]).df())


#: Titles that were cut within a reference, and whole references.
CUT = [(k, f"https://a.example.com/en/{k}.html", PAGE.format(title, "Some words of a text &amp; more &lt;of it&gt;. " * 6)) for k, title in enumerate(("Of the &amp; and &amp", "One &quot;two&quot; &am", "The &lt; last &copy", "Whole &amp; well"), 1)]


@pytest.mark.parametrize("name", ["crawl_documents", "page_content_dom", "page_title"])
def test_cut_references(spark, tmp_path, compare, name):
    same_as_sql(spark, tmp_path, compare, name, CUT)


def test_references_without_semicolon_stay():
    page = Page('<p>a &amp b &copy;&notit; &#65 &nope; <a href="/p?a=1&copy=2&amp;c=3">x</a>', "http://h/")
    assert page.root.text("|") == "a &amp b ©&notit; A &nope;|x"
    assert page.links()[0]["url"] == "http://h/p?a=1&copy=2&c=3"


def test_seeds_apart_by_number(spark, tmp_path, compare):
    """The same page with and without a fragment, an odd and an even one; parameters, a query, no URL."""
    urls = ("http://a.example.net/1#top", "http://a.example.net/1#top", "http://a.example.net/1", "http://a.example.net/1;v", "http://a.example.net/1;v", "http://m.b.org/?p=1#x", "http://m.b.org/?p=1", None)
    same_as_sql(spark, tmp_path, compare, "seed_lookup", [(k, u, "") for k, u in enumerate(urls, 1)])
