from __future__ import annotations

import numpy as np
import pytest

from bazaarflow.llm import nearest as N

KIND = "vec_id long, embedding array<float>, label int"


def exact(rows, every=20, k=20):
    valid = [(i, np.array(v, float)) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, a in valid:
        if q % every == 0:
            near = sorted({(-float(a @ b), i) for i, b in valid if i != q and len(b) == len(a)})[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    hits = sum(len({i for _, i, _ in got.get(q, [])} & {i for i, _ in v}) for q, v in want.items())
    return hits / sum(len(v) for v in want.values())


@pytest.mark.parametrize("shard_rows", [400, 8192])
def test_recall(spark, folder, monkeypatch, shard_rows):
    monkeypatch.setattr(N.build_index, "__defaults__", (shard_rows,))
    df = spark.read.parquet(folder.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    got, want = found(N.nearest_neighbours(df)), exact(rows)
    assert recall(got, want) > 0.95
    vectors = {i: np.array(v, float) for i, v, _ in rows}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21))
        for _, i, score in near:
            assert score == pytest.approx(vectors[q] @ vectors[i], abs=1e-14)
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)


def test_norms_differ(spark):
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(size=16) * random.uniform(0.1, 5)).astype(np.float32).tolist(), 0) for i in range(1500)]
    df = spark.createDataFrame(rows, KIND)
    assert recall(found(N.nearest_neighbours(df)), exact(rows)) > 0.9


def test_ties_repeats_and_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(100)] + [(5, same, 0), (5, same, 9)]
    rows += [(200, None, 0), (220, [0.0, 0.0, 0.0], 0), (240, [1.0, None, 2.0], 0), (260, [1.0, float("nan"), 2.0], 0),
             (280, [1.0, float("inf"), 2.0], 0), (None, same, 0), (300, [1.0, 2.0], 0), (301, [0.5, 0.5], 0), (320, [], 0)]
    got = found(N.nearest_neighbours(spark.createDataFrame(rows, KIND).repartition(4)))
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == {q: v for q, v in exact(rows).items() if v}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)], KIND)
    assert found(N.nearest_neighbours(df)) == {0: [(1, 1, 0.5)]}
    assert N.nearest_neighbours(df.limit(0)).count() == 0


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-1, 0]], np.float32)
    kept = N.robust_prune(points, (points ** 2).sum(axis=1), np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)
    assert set(kept[0].tolist()) - {5} == {1, 3, 4}
