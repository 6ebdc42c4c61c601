"""Terms are counted within a row: nothing but ids is shuffled for postings, and the rows of a repeated id count together."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import index
from siftwell.plans.search import SearchEngine
from siftwell.queries import QUERIES, SQL, WORDS, corpus

TEXTS = ("The thing with the thing\n2024 12 x3 3x", "the the a b c d e f", "", "with ünder Ünder 7", None, "ab cd ef <b>the</b> http://x/y thing")


@pytest.fixture()
def few(spark, tmp_path):
    """The path of documents with repeated ids, and their SQL."""
    rows = [(k % 9 if k != 5 else None, TEXTS[k % len(TEXTS)], "en", f"src{k % 3}") for k in range(24)]
    file = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(file)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{file}/*.parquet')")
    return str(tmp_path), con


def ran(rows) -> str:
    """The plan by which rows were collected."""
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def shuffled(rows) -> list[str]:
    """The columns by which rows were shuffled."""
    return [line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in ran(rows).split("\n") if "Exchange hashpartitioning(" in line]


@pytest.mark.parametrize("name", ["postings_tf", "term_document_frequency"])
def test_repeated_ids(spark, few, compare, name):
    path, con = few
    compare(QUERIES[name](spark, path).toPandas(), con.execute(SQL[name]).df())


def test_tokens(spark):
    """Words by the rules, one by one: marks, controls, blanks, digits, Han characters beside others."""
    told = {
        "ab\x01cd\x0bef <b>The</b> http://x/y?z Ünder": ["abcd", "ef", "the", "ünder"],
        "12 x3 3x 007 1²  9" + "8" * 40: ["x3", "3x", "1²"],
        "12中文字7 a中b 34中 x": ["中文", "文字", "a", "中", "b", "中", "x"],
        "\u00a0a\u0085b\u2003c\x1cd": ["a", "b", "cd"],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", text.tokens(F.col("t")).alias("words"))
    assert {r["t"]: r["words"] for r in rows.collect()} == told


def test_postings_are_not_shuffled(spark, sf_dir):
    built = index.build(corpus(spark, sf_dir))
    assert not {"field", "doc_id"} & {*shuffled(built.postings), *shuffled(built.lookup(WORDS.split()))}


def test_keywords_within_a_row(spark):
    rows = spark.createDataFrame([("b a c a b d",), ("x",), ("",)], "t string").select(index.frequent(text.tokens(F.col("t"))).alias("f"))
    assert [[tuple(x) for x in r["f"] or []] for r in rows.collect()] == [[("b", 2), ("a", 2), ("c", 1), ("d", 1)], [("x", 1)], []]


def test_saving_keeps_counts(spark, sf_dir, tmp_path, monkeypatch):
    """What is kept while an index is written are counts, not tokens."""
    frame, plans = type(spark.range(1)), []
    f = frame.sortWithinPartitions
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *c, **k: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or f(self, *c, **k))
    docs = corpus(spark, sf_dir)
    index.build(docs).save(str(tmp_path / "index"))
    kept = plans[0].split("InMemoryRelation [")[1].split("]")[0]
    assert "title_len" in kept and "tokens" not in kept
    saved = index.Index.load(spark, str(tmp_path / "index"))
    assert saved.postings.count() == index.build(docs).postings.count() and saved.doc_len.count() == docs.count()


def test_searches_without_terms_score_nothing(spark, sf_dir):
    """A search that finds no term reads no text; a wildcard counts only the terms that it fits."""
    engine = SearchEngine(index.build(corpus(spark, sf_dir)))
    for asked, kind in (("qqqqzzzz", "normal"), ("zzzz*", "wildcard"), ("", "normal"), ("12 34", "multi")):
        plan = ran(engine.ranked(asked, kind)[0])
        assert "FileScan" not in plan and "Exchange" not in plan
    assert engine.ranked("thi*", "wildcard")[0].count() > 0
    assert "field" not in shuffled(engine.fitting("thi*").postings)
