"""Many queries at once, against scoring every hit as a row: modes, ties, repeated ids, empty titles, blocks of any size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import batch, index, ranking, terms
from siftwell.plans.search import SearchEngine

TEXTS = ("red green blue red", "red", "green blue", "", "blue blue blue 7 red", "yellow", None)
ASKED = [(1, "red blue"), (2, "green"), (3, "red red nosuch"), (4, "nosuch"), (5, ""), (7, "blue green yellow"), (8, "s1")]


def by_rows(engine: SearchEngine, queries, k: int, every: bool | None):
    words = queries.select("query_id", "query", F.explode(engine.analyze(F.col("query"))).alias("term"))
    held = engine.index
    scores = ranking.bm25(held.postings, held.term_stats, held.corpus_stats, words)
    if every is not False:
        strict = terms.candidates(held.postings, words if every else words.where("query LIKE '% %'"), every=True)
        met = scores.join(strict, ["query_id", "doc_id"], "left_semi")
        scores = met if every else met.union(scores.join(words.where("query NOT LIKE '% %'").select("query_id").distinct(), "query_id", "left_semi"))
    scores = scores.select("query_id", "doc_id", ranking.rounded(F.col("bm25"), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


@pytest.mark.parametrize("every", [None, True, False])
@pytest.mark.parametrize("saved", [False, True])
def test_as_by_rows(spark, tmp_path, compare, monkeypatch, every, saved):
    monkeypatch.setattr(batch, "QUERIES_AT_ONCE", 3)
    rows = [(f"d{n % 37:02}" if n != 30 else None, TEXTS[n % 7], TEXTS[n % 5], f"s{n % 3}") for n in range(45)]
    built = index.build(spark.createDataFrame(rows, "doc_id string, content string, title string, source_site string").repartition(3))
    if saved:
        built.save(str(tmp_path / "index"))
        built = index.Index.load(spark, str(tmp_path / "index"))
    engine, queries = SearchEngine(built), spark.createDataFrame(ASKED, "query_id int, query string")
    compare(engine.search_many(queries, 4, every).toPandas(), by_rows(engine, queries, 4, every).toPandas())
    assert engine.search_many(queries.limit(0), 4, every).count() == 0
