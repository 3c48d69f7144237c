from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bazaarflow.llm import quality as Q
from tests.llm import edges


def test_held_out_accuracy(spark, folder):
    """Labels of half of the documents are shown; the others are judged."""
    folder = folder.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    shown = labels.where("doc_id % 2 = 0")
    judged = Q.score_documents(docs, shown).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["keep"] for r in judged if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in judged if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1 and len(bad) > 100


def test_sparse_sites_shrink(spark):
    """A path with little evidence stays near its host, one with much goes its own way."""
    rows = []
    for host, path, n, rate in (("a", "big", 4000, 0.9), ("a", "small", 2, 0.0), ("b", "big", 4000, 0.2),
                                ("b", "other", 3000, 0.3), ("c", "tiny", 1, 1.0), ("d", "x", 2000, 0.6)):
        rows += [(host, path, 0.0, float(i < rate * n)) for i in range(n)]
    rates = {(r["host"], r["path"]): r for r in Q.site_rates(
        spark.createDataFrame(rows, "host string, path string, evidence double, label double")).collect()}
    assert abs(rates["a", "big"]["path_rate"] - 0.9) < 0.02 and abs(rates["b", "big"]["path_rate"] - 0.2) < 0.02
    assert rates["a", "small"]["path_rate"] > 0.6
    assert 0.3 < rates["c", "tiny"]["path_rate"] < 0.95
    assert all(0 < r["path_rate"] < 1 for r in rates.values())


def test_sample_comes_from_the_documents(spark, monkeypatch):
    """Far more labels than documents, and a class of long texts only."""
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 10)
    rows = [(i, "useful careful words about gardens" if i < 20 else "click spam offers now " * 3000, "s", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.range(20_000).select(
        F.col("id").alias("doc_id"), ((F.col("id") < 20) | (F.col("id") % 2 == 0) & (F.col("id") >= 40)).cast("int").alias("quality"),
        F.lit(0).alias("toxic"))
    keep = {r["doc_id"]: r["keep"] for r in Q.score_documents(docs, labels).collect()}
    assert all(keep[i] == (i < 20) for i in range(40))


def test_edges(spark):
    docs = edges.documents(spark)
    rows = Q.score_documents(docs, edges.labels(spark)).collect()
    assert len(rows) == len(edges.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    kept = Q.keep_good(docs, edges.labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in rows)
    assert Q.score_documents(edges.empty(spark), edges.labels(spark)).count() == 0
    unlabelled = Q.score_documents(docs, edges.labels(spark).where(F.lit(False)))
    assert unlabelled.where("keep").count() == len(edges.rows())
