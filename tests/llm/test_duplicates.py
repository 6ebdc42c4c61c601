import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import exact_dedup, queries, simhash


def plain_groups(rows):
    """doc_id: keep_id, size, sha of the texts after the given rule."""
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by_text.items() for i in ids}


def test_query5(spark, sf_dir, texts, duck, compare):
    found = queries.op5_exact_dedup(spark, sf_dir)
    compare(found.toPandas(), duck.execute(queries.OP5_SQL).df())
    plain = plain_groups(texts.items())
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in found.collect()} == plain


def test_refinement_reads_survivors_only(documents, texts):
    found = exact_dedup.exact_groups(documents).collect()
    plain = plain_groups(texts.items())
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found} == {i: p[:2] for i, p in plain.items()}
    assert all((r["text_sha256"] is None) or r["text_sha256"] == plain[r["doc_id"]][2] for r in found)
    assert any(r["text_sha256"] is None for r in found)


@pytest.mark.parametrize("digest_all", [True, False])
def test_same_length_and_prefix(spark, digest_all):
    head = "x" * 300
    rows = spark.createDataFrame([(3, head + "a"), (1, head + "b"), (2, head + "a"), (9, "z")], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(rows, digest_all).collect()}
    assert found == {3: (2, False), 1: (1, True), 2: (2, True), 9: (9, True)}


@pytest.mark.parametrize("digest_all", [True, False])
def test_odd_rows5(odd, empty, digest_all):
    found = exact_dedup.exact_groups(odd, digest_all).collect()
    assert len(found) == odd.count()
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["keep_id"] for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 4] and by_id[None]["kept"]
    assert by_id[4]["group_size"] == 3  # with both rows of 5
    assert exact_dedup.exact_groups(empty, digest_all).count() == 0
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 8]


#: Repeated and null ids: y is in four rows, x in one that shares its id with a y, and z only where there is no id.
REPEATED = [(0, "y"), (1, "x"), (1, "y"), (None, "y"), (None, "y"), (None, "z"), (None, "z"), (7, "w"), (7, "w")]


@pytest.mark.parametrize("drop", [exact_dedup.drop_duplicates, simhash.drop_near_duplicates])
@pytest.mark.parametrize("written", [True, False])
def test_rows_are_dropped_not_ids(spark, tmp_path, drop, written):
    rows = spark.createDataFrame([(i, t, k, "s", 1.0) for k, (i, t) in enumerate(REPEATED)], "doc_id long, text string, at int, file string, `row` double")
    if written:  # read from files, several of them, or not
        rows.repartition(3).write.parquet(str(tmp_path / "docs"))
        rows = spark.read.parquet(str(tmp_path / "docs"))
    found = drop(rows)
    assert found.columns == rows.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found.collect()))) == sorted(map(str, [(0, "y"), (1, "x"), (None, "z"), (7, "w")]))


def test_keys_are_the_rows(spark, documents, tmp_path):
    from siftwell.llm import common

    for rows in (documents, documents.union(documents), documents.repartition(5), documents.limit(0)):
        found = common.keyed(rows)
        again = found.select("file", "at", "row.doc_id").collect()
        assert len({(r["file"], r["at"]) for r in again}) == len(again) == rows.count()
        assert {(r["file"], r["at"]): r["doc_id"] for r in again} == {(r["file"], r["at"]): r["doc_id"] for r in found.select("file", "at", "row.doc_id").collect()}


@pytest.mark.parametrize("keys, sent", [(2, 0), (1000, 0), (1000, 100)])
def test_join_by_size(spark, monkeypatch, keys, sent):
    from siftwell.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", keys)
    monkeypatch.setattr(common, "SENT_ROWS", sent)
    rows = spark.range(100).selectExpr("id", "CASE WHEN id < 60 THEN 0 ELSE id % 7 END AS k")
    table = rows.groupBy("k").agg(F.count("*").alias("size"), F.max("id").alias("most")).where("k <> 3")
    for how in ("left", "inner", "left_semi"):
        plain = rows.join(table, "k", how)
        found = common.join_sized(rows, table, ["k"], how, "size", 100)
        assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_bitmap_lets_all_open_keys_through(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 100 AS int) AS n", "id * 7919 - 5000 AS prefix")
    open_keys = rows.where("n < 10")
    plain = {tuple(r) for r in open_keys.collect()}
    assert {tuple(r) for r in exact_dedup.maybe_open(rows, open_keys).collect()} == plain  # 300 of 4 million bits
    monkeypatch.setattr(exact_dedup, "BITMAP_BITS", 1 << 15)
    assert plain <= {tuple(r) for r in exact_dedup.maybe_open(rows, open_keys).collect()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id: smallest doc_id reachable over links of two or fewer bits."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query10(spark, sf_dir, texts):
    found = queries.op10_simhash_near_dedup(spark, sf_dir).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(prints)


def test_golay_keys():
    table = simhash.decoder()
    rng = np.random.default_rng(5)
    for x in rng.integers(0, 1 << 23, 300):
        keys = {*simhash.fuzzy_keys(np.array([x]))[0].tolist()}
        assert len(keys) in (1, 6)
        a, b = rng.integers(0, 23, 2)
        assert keys & {*simhash.fuzzy_keys(np.array([x ^ 1 << a ^ 1 << b]))[0].tolist()}
    assert np.bincount(table).tolist() == [2048] * 4096


def clusters(rng, n, near):
    """n random fingerprints, each with `near` others a bit or two from one of its cluster."""
    out = []
    for base in rng.integers(0, 1 << 63, n, dtype=np.uint64):
        own = [int(base)]
        for _ in range(near):
            x = own[rng.integers(len(own))]
            for b in rng.integers(0, 64, 2):
                x ^= 1 << int(b)
            own.append(x)
        out += own
    return [*dict.fromkeys(out)]


@pytest.mark.parametrize("bound, n, near", [(32, 40, 3), (2, 5, 60), (32, 2, 150)])
def test_links(spark, bound, n, near):
    """With few and with many fingerprints in a bucket, by pairs and by the vectors between them."""
    prints = clusters(np.random.default_rng(n), n, near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, bound)).collect()}
    plain = plain_components(dict(zip(map(signed, prints), prints)))
    assert {i: found.get(i, i) for i in plain} == plain


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_odd_rows10(odd, empty):
    found = simhash.near_groups(odd).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == odd.count() and by_id[1]["fingerprint"] == "0" * 16
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 4]
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


def shingle_sets(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies(rng, groups, copies, changes):
    """Texts of random words, each with copies in which some words are changed; which text each comes from."""
    out = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(100, 300))]
        out.append((g, " ".join(words)))
        for _ in range(copies):
            own = list(words)
            for k in rng.choice(len(own), max(1, int(len(own) * changes)), replace=False):
                own[k] = f"x{rng.integers(0, 5000)}"
            out.append((g, " ".join(own)))
    return out


@pytest.mark.parametrize("groups, copies, changes", [(80, 2, 0.018), (2, 150, 0.012), (60, 1, 0.005)])
def test_similar_texts_are_found(spark, groups, copies, changes):
    """Of all pairs with a similarity of 0.8 or more nine in ten are linked, in small and in large groups; others never."""
    texts = near_copies(np.random.default_rng(groups), groups, copies, changes)
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()}
    sets = [shingle_sets(t) for _, t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a][0] == texts[b][0] and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(pairs) >= 20 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(texts[k][0] == texts[c][0] for k, c in found.items())
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(rows).collect()}
    assert kept == set(found.values())


def test_wide_fingerprint():
    """Bits are majorities over distinct shingles; their share that differs tells the cosine."""
    text = b"one two three four five six seven one two three four five"
    hashes = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingle_sets(text.decode())}
    bits = [sum(int(simhash.widened(np.array([h], np.uint64), k)[0]) >> b & 1 for h in hashes) * 2 > len(hashes) for k in range(simhash.WIDE) for b in range(64)]
    found = np.unpackbits(simhash.wide_fingerprint(text, 5).view(np.uint8), bitorder="little")
    assert found.tolist() == [int(b) for b in bits]
    assert simhash.wide_fingerprint(b" \n", 5).tolist() == [0] * simhash.WIDE
    assert simhash.most_bits(1.0) == 0 and simhash.most_bits(0.0) == 32 * simhash.WIDE
    assert simhash.wide_fingerprint(b"a b c d e f g" * 3000, 5).tolist() == simhash.wide_fingerprint(b"A  b c d e f g" * 3000, 5).tolist()


def test_clean_documents_stay(spark, documents, texts):
    """What goes has a text in its component that shares a good part of its shingles."""
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents).collect()}
    sets = {i: shingle_sets(t or "") for i, t in texts.items()}
    for i, c in found.items():
        if i != c:
            assert max(jaccard(sets[i], sets[j]) for j in found if found[j] == c and j != i) > 0.5


def test_odd_rows_of_similar(odd, empty):
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(odd).collect()}
    assert [found[i] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 4]
    assert simhash.similar_groups(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def plain_similar(texts, similarity=0.8):
    """doc_id: smallest doc_id reachable over links, which are all pairs whose shingle sets have this cosine; and the links."""
    sets = {i: shingle_sets(t) for i, t in texts.items()}
    root, links = {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) >= similarity * (len(sets[i]) * len(sets[j])) ** 0.5 - 1e-6:
                links.append((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, links


@pytest.mark.parametrize("groups, copies, changes, held", [(120, 2, 0.03, 1 << 20), (1, 120, 0.022, 2000), (30, 3, 0.04, 500)])
def test_no_similar_pair_is_left_out(spark, monkeypatch, groups, copies, changes, held):
    """Near the limit too, in small and large groups, beside a common passage, with short texts and texts of other lengths."""
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "GROUPED", held)
    monkeypatch.setattr(simhash, "BLOCK", max(16, held >> 12))
    rng = np.random.default_rng(groups)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [t if g % 3 else f"{t} {passage}" for g, t in near_copies(rng, groups, copies, changes)]
    texts += [" ".join(t.split()[: int(n)]) for t, n in zip(texts[:60], rng.integers(60, 300, 60))]  # beginnings
    texts += [" ".join(f"s{x}" for x in range(a, a + n)) for a in (0, 50) for n in range(1, 30)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()}
    plain, links = plain_similar(dict(enumerate(texts)))
    assert len(links) > 50 and [(a, b) for a, b in links if found[a] != found[b]] == []
    assert found == plain


def test_missed_pairs_need_no_fingerprints(spark, documents, texts):
    """With every document a component of its own, the exact search alone has all similar pairs."""
    rows = simhash.placed(simhash.keyed(documents))
    sets = {i: shingle_sets(t or "") for i, t in texts.items()}
    ids = {i: simhash.set_id(simhash.shingle_set((t or "").encode(), 5)) for i, t in texts.items() if (t or "").split()}
    known = simhash.wide_fingerprints(rows).where("n > 0").select(F.col("fp").alias("node"), "n", F.col("fp").alias("root")).distinct()
    found = {(r["a"], r["b"]) for r in simhash.missed_pairs(rows, len(texts), known, 5, 0.8).collect()}
    _, links = plain_similar({i: texts[i] for i in ids})
    assert links and all(len(sets[a]) and (ids[a] == ids[b] or (min(ids[a], ids[b]), max(ids[a], ids[b])) in found) for a, b in links)
