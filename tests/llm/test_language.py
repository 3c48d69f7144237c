from __future__ import annotations

import numpy as np
import pytest

from bazaarflow.llm import language as L
from tests.llm import edges


def test_forward_backward_equals_enumeration():
    from itertools import product

    random = np.random.default_rng(5)
    scores, turn = random.normal(size=(6, 3)), random.normal(size=(3, 3))
    first = np.array([0, 4, 4, 6])
    got, _, _ = L.forward_backward(scores, first, turn)
    for a, b in ((0, 4), (4, 6)):
        total = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            weight = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(turn[p, q] for p, q in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))


def test_held_out_accuracy_and_code_switching(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    got = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    model = L.train(*L.training_sample(docs))
    assert (np.argmax(model.transitions, axis=1) == np.arange(len(model.labels))).all()


def test_every_label_is_learned(spark):
    """Seventy languages, the rare ones too, each with words of its own."""
    random = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = [["".join(random.choice(letters, 6)) for _ in range(6)] for _ in range(70)]
    rows = [(f"l{k:02}", " ".join(random.choice(vocabulary[k], 40))) for k in range(70) for _ in range(12 if k else 40)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    texts, labels = L.training_sample(docs)
    assert len(texts) == len(rows) and len(set(labels)) == 70
    got = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len({r["lang_pred"] for r in got}) == 70 and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    with pytest.raises(ValueError, match="more than 69 labels"):
        L.training_sample(docs, languages=69)


def test_edges(spark):
    docs = edges.documents(spark)
    rows = L.identify_languages(docs).collect()
    assert len(rows) == len(edges.rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    for doc in (3, 4, 5, 8):
        assert by_id[doc] == [("und", 0.0)]
    assert by_id[12][0][0] in ("en", "de", "und") and by_id[6][0] != ("und", 0.0)
    assert L.identify_languages(edges.empty(spark)).count() == 0
    no_labels = docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, "lang")
    assert {r["lang_pred"] for r in L.identify_languages(no_labels).collect()} == {"und"}


def test_what_is_held_out(spark):
    import zlib

    got = spark.range(200).select("id", L.held_out("id", 5).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
