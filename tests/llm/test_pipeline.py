import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import exact_dedup, mixing, packing, queries, quality_knn, simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, documents):
    """run() is what the operators' own decisions, applied one after the other, leave."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents
    good = {r["doc_id"] for r in quality_knn.score_quality(docs, labels).where("predicted = 1").collect()}
    assert 0 < len(good) < docs.count()
    docs = docs.where(docs["doc_id"].isin(sorted(good)))
    kept = {r["doc_id"] for r in exact_dedup.exact_groups(docs, True).where("kept").collect()}
    docs = docs.where(docs["doc_id"].isin(sorted(kept)))
    near = {r["doc_id"] for r in simhash.similar_groups(docs).where("doc_id = component_id").collect()}
    assert near <= kept <= good
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == near
    library = Tokenizer.from_file(queries.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[:300]:
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_stages_keep_columns(spark, documents):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns


def test_mixture_takes_effect(spark, documents):
    order = [r["doc_id"] for r in corpus_pipeline.mixture(spark, documents, SF).collect()]
    places = {r["doc_id"]: r["position"] for r in mixing.mix(documents).collect()}
    assert order == sorted(places, key=places.get)


def test_mixture_reaches_the_rows(spark, documents):
    """Sequences of run()'s rows are numbered in the order of their first document in the mixture."""
    rows = corpus_pipeline.run(spark, SF).toPandas()
    left = documents.where(documents["doc_id"].isin(rows["doc_id"].unique().tolist()))
    places = {r["doc_id"]: r["position"] for r in mixing.mix(left).collect()}
    first = rows.assign(place=rows["doc_id"].map(places)).sort_values("place").groupby("sequence_id")["place"].min()
    assert first.is_monotonic_increasing and first.iloc[0] == min(places.values()) and len(first) > 5


def test_stretches(spark, documents):
    """A node packs a stretch of the order; gapless, nothing lost."""
    docs = mixing.mix(documents, with_row=True).select("position", "row.doc_id", "row.text")
    rows = packing.pack_documents(docs, queries.VOCABULARY, position="position", node_items=40).toPandas()
    plain = packing.pack_documents(docs, queries.VOCABULARY).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows[key].values)) == sorted(map(tuple, plain[key].values))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= packing.CAPACITY


def test_mixture_of_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a", f"t{k}") for k in range(5)] + [(7, "b", "u")] * 4, "doc_id long, source string, text string")
    assert mixing.mixed(docs).count() == 9


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    """Null and repeated ids, repeated rows, empty and long texts, clashing names: one row of each text, and all its tokens."""
    extra = [(0, "same text here", "b"), (1, "another text here", "a"), (1, "same text here", "a"), (None, "same text here", "a"), (None, "only here", None), (None, "only here", None)]
    rows = odd.unionByName(spark.createDataFrame([(*r, "x", 0, "h", 1.5) for r in extra], odd.schema))
    named = rows.withColumnsRenamed({"n": "_quality_score", "score": "position", "key": "row", "_n": "at"})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = named
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == named.columns
            docs.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            kept = sorted((r["text"] or "", r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
            assert [t for t, _, _ in kept] == sorted({" ".join(t.split(" ")) for t, _, _ in kept}) and ("same text here", False, 0) in kept and ("only here", True, 0) in kept
        if k == 2:
            left = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    library = Tokenizer.from_file(queries.VOCABULARY)
    packed = docs.toPandas()
    assert packed["length"].sum() == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in left)
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]


def test_intermediate_tables_are_deleted(spark):
    import pathlib

    from siftwell.llm import common

    folder = pathlib.Path(common.shared_folder(spark))
    before = {p.name for p in folder.iterdir()}
    corpus_pipeline.run(spark, SF)
    assert len([p for p in folder.iterdir() if p.name not in before and p.name.endswith(".parquet")]) == 1


def test_empty(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
