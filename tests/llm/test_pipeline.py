from __future__ import annotations

import corpus_pipeline
from bazaarflow.llm import exact_dedup, ngram_join, sanitise
from bazaarflow.session import materialise
from tests.llm.test_ngram_join import brute


def test_stages(spark, folder):
    """Each stage against what it should leave of its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = materialise(stage(spark, docs, folder), "test")
        outputs[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outputs["quality classifier"]}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
    assert sum(d in kept for d in clean) > 0.95 * len(clean)

    best = {}
    for r in inputs["exact dedup"]:
        text = r["text"].encode().lower()
        best[text] = max(best.get(text, -1), r["doc_id"])
    assert {r["doc_id"] for r in outputs["exact dedup"]} == set(best.values())

    rows = [(r["doc_id"], r["text"]) for r in inputs["n-gram Jaccard join"]]
    assert {r["doc_id"] for r in outputs["n-gram Jaccard join"]} == {
        doc for doc, n, component in brute(rows, 5, 80) if doc == component or n == 0}

    before = {r["doc_id"]: r["text"] for r in inputs["PII"]}
    for r in outputs["PII"]:
        assert not sanitise.pattern_spans(r["text"]) or sanitise.pattern_spans(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert len(outputs["PII"]) == len(before)
    assert {r["doc_id"] for r in outputs["packing"]} == set(before)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_the_stages_are_the_operators():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert exact_dedup and ngram_join
