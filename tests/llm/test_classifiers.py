import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import quality_knn, queries, toxicity

SF = "/root/testdata/sf0.1"


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.mark.parametrize("query, label, folds, fold", [(queries.op1_toxicity, "toxic", 5, 0), (queries.op6_quality_knn, "quality", 4, 2)])
def test_held_out(spark, query, label, folds, fold):
    found = query(spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found["score"].between(0, 1).all()
    assert (found["held_out"] == [held(i, folds, fold) for i in found["doc_id"]]).all()
    assert (found["predicted"] == (found["score"] >= (0.5 if label == "toxic" else 0.7))).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    test = found[found["held_out"] & found["doc_id"].isin(labels.index)]
    truth = labels[test["doc_id"]].to_numpy()
    for value in (0, 1):
        assert (test["predicted"].to_numpy()[truth == value] == value).mean() > 0.9


def labelled(spark, rows):
    return spark.createDataFrame([(k, y, t) for k, (t, y) in enumerate(rows)], "doc_id long, label int, text string")


def test_scores_follow_the_model(spark):
    texts = ["you idiot fool", "what an idiot", "idiot again here", "a fine day", "fine words here", "what a day"] * 3
    model = toxicity.train(labelled(spark, zip(texts, [1, 1, 1, 0, 0, 0] * 3)))
    one, two, none = model.score(["an idiot", "a fine day", ""])
    assert one > 0.5 > two and 0 <= none <= 1
    assert model.score(["an   IDIOT"])[0] == model.score(["an idiot"])[0]
    assert toxicity.train(labelled(spark, [("a", 1)])).score(["b"])[0] == pytest.approx(2 / 3)


def plain_grams(text):
    """The hashed n-grams of a text, one by one."""
    mask = (1 << 32) - 1
    text = " " + " ".join(text.lower().split()) + " "
    out = set()
    for n in toxicity.GRAMS:
        for k in range(len(text) - n + 1):
            x = ord(text[k]) * 2654435761 & mask
            for c in text[k + 1 : k + n]:
                x = (x * 0x9E3779B1 + ord(c) * 0x85EBCA6B) & mask
            out.add(((x ^ x >> 15) * 0x2C1B3C6D & mask) >> 32 - toxicity.HASH_BITS)
    return out


def test_toxicity_by_brute_force(spark, documents, texts):
    """Every score of the query is that of features, log ratios, choice and training worked out plainly."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    ids = sorted(i for i in labels if i in texts and not held(i, 5, 0))
    grams = {i: plain_grams(t) for i, t in texts.items()}
    ones = [i for i in ids if labels[i]]
    zeros = [i for i in ids if not labels[i]]
    assert 0 < len(ones) <= toxicity.SAMPLE[1] and 0 < len(zeros) <= toxicity.SAMPLE[0]  # the sample is all of them here
    n1, n0 = Counter(g for i in ones for g in grams[i]), Counter(g for i in zeros for g in grams[i])
    ratio = {g: math.log(((n1[g] + 1) / (len(ones) + 2)) / ((n0[g] + 1) / (len(zeros) + 2))) for g in n1 | n0}
    gain = {g: round(abs(r * (n1[g] / len(ones) - n0[g] / len(zeros))), 12) for g, r in ratio.items() if n1[g] + n0[g] >= toxicity.LEAST_TEXTS}
    kept = sorted((g for g in gain if gain[g] > 0), key=lambda g: (-gain[g], g))[: toxicity.KEPT]
    weight, bias = toxicity.fit([np.array([k for k, g in enumerate(kept) if g in grams[i]], np.int64) for i in ids], np.array([labels[i] for i in ids]), np.array([ratio[g] for g in kept]))
    for r in queries.op1_toxicity(spark, "/root/testdata/sf0.001").collect():
        z = sum(w * ratio[g] for w, g in zip(weight, kept) if g in grams[r["doc_id"]]) + bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, z)))), abs=1e-4)


def test_training_lessens_the_loss():
    rows, labels = [np.array(x) for x in ([0], [0, 1], [2], [1, 2])], np.array([1, 1, 0, 0])
    weight, bias = toxicity.fit(rows, labels, np.array([2.0, 0.1, -2.0]))
    z = np.array([sum(weight[r] * np.array([2.0, 0.1, -2.0])[r]) + bias for r in rows])
    assert (z > 0).tolist() == [True, True, False, False] and np.log1p(np.exp(-z * (2 * labels - 1))).mean() < 0.2


def test_windows(monkeypatch):
    texts = ["some words of a text", "", "more words", "x" * 50]
    whole = toxicity.present(texts)
    for window in (1, 3, 7, 30):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert all((a == b).all() for a, b in zip(whole, toxicity.present(texts)))


def test_grams_do_not_cross_texts():
    docs, grams = toxicity.present(["ab", "cd"])
    alone = set(toxicity.present(["ab"])[1]) | set(toxicity.present(["cd"])[1])
    assert set(grams) == alone and len({*zip(docs, grams)}) == len(docs)


def plain_vote(space, v):
    cosine = [round(float(c), quality_knn.DECIMALS) for c in space.vectors @ v]
    near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality_knn.NEIGHBOURS]
    weight = [max(cosine[k], 0) ** quality_knn.SHARPNESS + 1e-9 for k in near]
    return sum(w * space.labels[k] for w, k in zip(weight, near)) / sum(weight)


def test_votes_match_brute_force():
    rng = np.random.default_rng(1)
    space = quality_knn.Space(None, None, rng.normal(size=(50, 8)).astype(np.float32), rng.integers(0, 2, 50).astype(np.float32))
    space.vectors[20:40] = space.vectors[0]  # a tie for the last place
    space.vectors /= np.linalg.norm(space.vectors, axis=1, keepdims=True)
    asked = space.vectors[:7] + 0.01
    for v, got in zip(asked, space.vote(asked)):
        assert got == pytest.approx(plain_vote(space, v), rel=1e-4)


def plain_counts(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = Counter(zlib.crc32(w) % quality_knn.WORD_TERMS for w in words)
    n[quality_knn.WORD_TERMS] = sum(a == b for a, b in zip(words, words[1:]))
    n[quality_knn.WORD_TERMS + 1] = len(lines) - len(set(lines))
    for a, b, c in zip(text, text[1:], text[2:]):
        x = ((a * 65599 + b) * 65599 + c) * 0x9E3779B1 & 0xFFFFFFFF
        n[quality_knn.WORD_TERMS + quality_knn.REPEAT_TERMS + (x >> 20)] += 1
    return n


def test_quality_by_brute_force(spark, documents, texts):
    """The scores of the query are the votes over all vectors of the sample, text by text."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ids, marks, counts = quality_knn.sample_counts(toxicity.training_sample(documents, labels, "quality", 4, 2, quality_knn.SAMPLE))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert ids == sorted(i for i in known if i in texts and not held(i, 4, 2)) and marks.tolist() == [known[i] for i in ids]
    for i, (terms, n) in [*zip(ids, counts)][:40]:
        assert dict(zip(terms.tolist(), n.tolist())) == {k: v for k, v in plain_counts(texts[i].encode()).items() if v}
    space = quality_knn.fit(counts, marks)
    for r in queries.op6_quality_knn(spark, "/root/testdata/sf0.001").collect():
        v = space.project(quality_knn.term_counts([texts[r["doc_id"]].encode()]))[0]
        assert r["score"] == pytest.approx(plain_vote(space, v), abs=1e-3)


def test_latent_space_is_the_truncated_svd():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 200, 30)), None) for _ in range(150)]
    rows = [(t, np.ones(len(t), np.float32)) for t, _ in rows]
    space = quality_knn.fit(rows, np.zeros(150))
    matrix = quality_knn.weighted(quality_knn.dense(rows), space.weights)
    best = np.linalg.svd(matrix, compute_uv=False)[: quality_knn.LATENT]
    assert np.linalg.norm(matrix @ space.basis) == pytest.approx(np.linalg.norm(best), rel=0.02)


def test_odd_rows(odd, empty, no_labels, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (6, 0, 1), (None, 1, 1), (2, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality_knn.score_quality):
        for known in (labels, no_labels):
            found = score(odd, known).collect()
            assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
            assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
        assert score(empty, labels).count() == 0
    named = odd.withColumnsRenamed({"n": "_quality_score", "score": "row", "key": "label"})
    kept = quality_knn.keep_good(named, no_labels)
    assert kept.columns == named.columns and kept.count() == odd.count()
