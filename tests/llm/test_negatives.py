from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from bazaarflow.llm import negatives, rtree
from bazaarflow.llm.queries import ORACLE
from tests.oracle import difference

COLUMNS = "vec_id long, embedding array<float>, label int, dim int, ask long, vector string, windows int, own string"


def random_tree(chance, n, dims, spread=40):
    return chance.integers(-spread, spread + 1, (n, dims))


def test_boxes_hold_their_points_and_bound_their_scores():
    chance = np.random.default_rng(1)
    for n, dims in ((1, 3), (127, 2), (1000, 6), (3000, 1), (40, 0)):
        points = random_tree(chance, n, dims)
        tree = rtree.build(points, leaf=8, fanout=4)
        assert sorted(tree.order.tolist()) == list(range(n)) and np.array_equal(tree.points, points[tree.order])
        assert tree.last[:tree.leaves].tolist()[-1] == n
        queries = random_tree(chance, 5, dims)
        low, high = rtree.intervals(tree, queries)
        for node in range(tree.leaves):
            scores = queries @ tree.points[tree.first[node]:tree.last[node]].T
            assert (scores.min(axis=1) >= low[:, node]).all() and (scores.max(axis=1) <= high[:, node]).all()
        for node in range(tree.leaves, len(tree.low)):
            below = range(tree.first[node], tree.last[node])
            assert (low[:, node] <= low[:, below].min(axis=1)).all() and (high[:, node] >= high[:, below].max(axis=1)).all()


def test_search_against_sorting_everything():
    chance = np.random.default_rng(2)
    read = leaves = 0
    for trial in range(120):
        dims = int(chance.integers(1, 5))
        points = random_tree(chance, int(chance.integers(1, 600)), dims, int(chance.integers(1, 50)))
        tree = rtree.build(points, leaf=8, fanout=4)
        ids = [[int(i), int(i) + 10_000] if i % 9 == 0 else [int(i)] for i in tree.order]
        query = random_tree(chance, 1, dims)[0]
        scores = points @ query
        low, high = rtree.intervals(tree, query[None])
        middle = int(np.median(scores))
        windows = [rtree.Window(0, None, None), rtree.Window(1, middle - 5, middle), rtree.Window(2, 10**6, 10**7),
                   rtree.Window(3, None, int(scores.min()))]
        for some in (windows, windows[1:3]):
            bests = [rtree.Best(w, 7) for w in some]
            own = 3 if trial % 2 else None
            read += rtree.search(tree, low[0], high[0], query, bests, ids, own)
            leaves += tree.leaves
            for w, best in zip(some, bests):
                every = sorted((-int(s), i) for p, s in zip(tree.order, tree.points @ query)
                               for i in ([int(p), int(p) + 10_000] if p % 9 == 0 else [int(p)])
                               if i != own and (w.low is None or s >= w.low) and (w.high is None or s <= w.high))[:7]
                assert [(-s, i) for s, i in zip(best.scores, best.ids)] == every
    assert read < 0.8 * leaves  # boxes are pruned


def test_sums_beyond_doubles_are_exact():
    points = np.array([[2**52, 1], [2**52, 0], [-2**52, 3]])
    tree, queries = rtree.exact(rtree.build(points, leaf=2), np.array([[3, 1]]))
    low, high = rtree.intervals(tree, queries)
    best = rtree.Best(rtree.Window(0, None, None), 3)
    rtree.search(tree, low[0], high[0], queries[0], [best], [[int(i)] for i in tree.order], None)
    assert best.scores == [3 * 2**52 + 1, 3 * 2**52, 3 - 3 * 2**52] and best.ids == [0, 1, 2]


def against_sql(spark, tmp_path, table):
    path = str(tmp_path / "embeddings")
    table.coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert difference(negatives.hard_negatives(table), ORACLE["op12_hard_negatives"], connection) is None


def rows(n=1500, dims=4):
    chance = np.random.default_rng(5)
    out = []

    def row(i, vector, label):
        out.append((i, vector, label, 1, 2, "v", 3, "o"))

    for i in range(n):
        vector = (chance.integers(-6, 7, dims) / 16).astype(float).tolist()  # many ties and equal vectors
        row(i, [0.25] * dims if i % 3 == 0 else vector, int(i % 13 % 10) if i % 4 else 2)
    row(2000, None, 1)
    row(2100, [0.1, None, 0.2, 0.3], 1)
    row(2200, [0.1, math.nan, 0.2, 0.3], 1)
    row(2300, [0.1, math.inf, 0.2, 0.3], 1)
    row(2400, [0.0] * dims, 1)
    row(2500, [0.5] * dims, None)
    row(2600, [0.5, 0.5], 4)  # another length
    row(2601, [0.25, 0.5], 4)
    row(2602, [0.2, 0.2], 5)
    row(2700, [], 4)
    row(2701, [], 4)
    row(2702, [], 5)
    row(None, [0.5] * dims, 1)
    return out


def test_awkward_rows_against_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    against_sql(spark, tmp_path, spark.createDataFrame(rows(), COLUMNS).repartition(5))


def test_whole_tables_against_sql(spark, folder, tmp_path):
    against_sql(spark, tmp_path, spark.read.parquet(f"{folder}/embeddings.parquet"))


def test_repeated_rows_and_small_shards(spark):
    table = spark.createDataFrame(rows(400), COLUMNS)
    one = sorted(map(tuple, negatives.hard_negatives(table).collect()))
    assert one == sorted(map(tuple, negatives.hard_negatives(table.unionAll(table)).collect()))
    points = table.where(negatives.usable(table["embedding"])).selectExpr(
        "vec_id AS id", "label", "embedding").withColumn("vector", negatives.scaled(table["embedding"], 256))
    shards = negatives.shards_of(points.where("id IS NOT NULL AND label IS NOT NULL").drop("embedding"), 10, shard_rows=16)
    counts = [len(eval(r["ids"])) for r in shards.collect()]
    assert max(counts) <= 16 and sum(counts) == points.where("id IS NOT NULL AND label IS NOT NULL").select(
        "label", "vector").distinct().count()


def test_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("label", [1, 2])
def test_one_label_only_has_no_negatives(spark, label):
    table = spark.createDataFrame([(i * 100 + 1 - (i == 0), [1.0, 0.5], label) for i in range(9)],
                                  "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(table, flip_every=0).count() == 0
