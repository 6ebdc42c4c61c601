import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm import packing, queries, token_counts

LIBRARY = Tokenizer.from_file(queries.VOCABULARY)
ODD_TEXTS = [
    "", "a", "it's 's don't  x'll'S I're'rex  ' 's ''s\n's", "  a", "a  ", "a \n b", "\n\n\nb", "\t\tc 12ab!!x??", "<|endoftext|>a <|endoftext|> 's", "日本語 テスト 12 ３ ½",
    "é   x 　y", "a" * 3000, " " * 2000, "🙂🙂 🙂", "x<|endoftext|>", "'s", "'", "x'l", "'ve'v", "\x1c\x1d a\x85b", "<|endoftext|", "<|endoftext|><|endoftext|>",
]


def counted(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    return token_counts.transducer(queries.VOCABULARY).counts(np.frombuffer(b"".join(raw), np.uint8), at).tolist()


def expected(texts):
    return [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_odd_texts():
    assert counted(ODD_TEXTS) == expected(ODD_TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab est'\n\t 1é!日"), st.characters(codec="utf-8", categories=("L", "N", "P", "Zs"))), max_size=60), min_size=1, max_size=5))
def test_counts_of_any_texts(texts):
    assert counted(texts) == expected(texts)


def test_chunks_without_a_boundary(monkeypatch):
    """Pieces over many chunks: maps that forget, that go round, and chains of several lengths beside each other."""
    rng = np.random.default_rng(2)
    letters = lambda n, k: "".join(chr(97 + c) for c in rng.integers(0, k, n))
    some = ["a" * 5000, "x " + "ab" * 2500 + " y", letters(4000, 26), "the " + letters(3000, 2) + " " + letters(2500, 3), "é" * 1500, " " * 3000 + "!" * 2000, "日本" * 900]
    for chunk in (1024, 16, 5):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert counted(some) == expected(some)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'é 1", max_size=200), min_size=1, max_size=4), st.integers(1, 9))
def test_any_chunk_length(texts, chunk):
    before, token_counts.CHUNK = token_counts.CHUNK, chunk
    try:
        assert counted(texts) == expected(texts)
    finally:
        token_counts.CHUNK = before


def test_restart_does_not_change_counts(monkeypatch, texts):
    some = list(texts.values())[:40]
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    assert [counted([t])[0] for t in some[:10]] == expected(some[:10])


def test_query4(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in queries.op4_token_counts(spark, sf_dir).collect()}
    lengths = dict(zip(texts, expected(list(texts.values()))))
    assert {i: r["n_tokens"] for i, r in found.items()} == lengths
    assert all(r["n_bytes"] == len(texts[i].encode()) and r["over_limit"] == (lengths[i] > 512) for i, r in found.items())


def test_ids_are_the_library_s(texts):
    encoding = packing.encoder(queries.VOCABULARY)
    for t in [*ODD_TEXTS, *list(texts.values())[:60]]:
        assert packing.token_ids(encoding, t) == LIBRARY.encode(t, add_special_tokens=False).ids


def check_places(rows, ids, capacity):
    """Pieces are the documents' ids, sequences are gapless and within the capacity. rows: one per piece."""
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by_sequence)


def test_query2(spark, sf_dir, texts):
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    ids = {i: [*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    used = check_places(rows, ids, 1024)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert used <= -(-sum(map(len, ids.values())) // 1024) + 2
    for i in ids:
        lengths = [r["length"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])]
        assert lengths[1:] == [1024] * (len(lengths) - 1) and 1 <= lengths[0] <= 1024


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_best_fit(lengths):
    bins, offsets, fill = packing.best_fit(np.array(lengths, np.int64), 30)
    places: dict = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths):
        places.setdefault(b, []).append((o, n))
    for b, p in places.items():
        p.sort()
        assert all(o == sum(n for _, n in p[:k]) for k, (o, _) in enumerate(p)) and sum(n for _, n in p) == fill[b] <= 30
    room: list[int] = []  # plain best fit, longest first
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= n
        else:
            room.append(30 - n)
    assert len(places) == len(room)


@pytest.mark.parametrize("length", [600, 100])
def test_tree_of_nodes(spark, length):
    items = spark.range(2000).selectExpr("id AS row", f"cast({length} + id % 3 AS long) AS length")
    rows = packing.place(items, 1024, node_items=100).join(items, "row").toPandas()
    assert len(rows) == 2000
    sums = rows.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 1024 and (rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["offset"].first() == 0).all()
    assert len(sums) <= (2000 if length == 600 else 206)


def test_tree_ends_where_nothing_fits(spark):
    """Long items in half of the nodes and pairs of short ones in the others: no two bins fit in one."""
    items = spark.range(1600).selectExpr("id AS row", "cast(CASE WHEN id < 800 THEN 600 ELSE 424 END AS long) AS length", "id AS order")
    rows = packing.place(items, 1024, node_items=100).join(items, "row").toPandas()
    sums = rows.groupby("sequence_id")["length"].sum()
    assert len(rows) == 1600 and sums.max() <= 1024 and len(sums) == 1200


@pytest.mark.parametrize("node_items", [30, 100])
def test_query_with_many_nodes(spark, documents, texts, node_items):
    """The whole way of the query through a tree of several levels."""
    rows = packing.pack_documents(documents, queries.VOCABULARY, node_items=node_items).collect()
    ids = {i: [*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    used, total = check_places(rows, ids, 1024), sum(map(len, ids.values()))
    assert sum(r["length"] for r in rows) == total and used <= -(-total // 1024) + 5


def test_sequences(spark, documents):
    some = documents.limit(30)
    packed = packing.pack_documents(some, queries.VOCABULARY, with_ids=True)
    total = packed.selectExpr("sum(length)").first()[0]
    assert packing.sequences(packed).selectExpr("sum(size(ids))").first()[0] == total


def test_odd_rows(odd, empty):
    counts = token_counts.count_tokens(odd, queries.VOCABULARY).collect()
    assert sorted(r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)) == [0, 0] and len(counts) == odd.count()
    packed = packing.pack_documents(odd, queries.VOCABULARY).collect()
    assert sum(r["length"] for r in packed) == sum(r["n_tokens"] + 1 for r in counts)
    assert [r["length"] for r in packed if r["doc_id"] in (1, 2)] == [1, 1]
    assert token_counts.count_tokens(empty, queries.VOCABULARY).count() == 0
    assert packing.pack_documents(empty, queries.VOCABULARY).count() == 0
