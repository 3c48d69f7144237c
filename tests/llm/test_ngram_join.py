from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from bazaarflow.llm import graph, ngram_join as J
from tests.llm import edges


def ngrams(text, size):
    words = (text or "").encode().lower().split()
    if len(words) >= size:
        return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute(rows, size, percent):
    """(n, smallest reachable id) per row; rows of one id are told apart by their place."""
    sets = [ngrams(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for gram in own for j in lists[gram])
        for gram in own:
            lists[gram].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        best[r] = min([d for d in (best.get(r), doc) if d is not None], default=None)
    return edges.brief((doc, len(sets[i]), best[root(i)]) for i, (doc, _) in enumerate(rows))


def families(seed, count=40):
    chance = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [f"w{chance.randrange(400)}" for _ in range(chance.choice([2, 4, 8, 30, 100]))]
        for _ in range(chance.randint(1, 8)):
            words = list(base)
            for _ in range(chance.randint(0, 3)):
                words[chance.randrange(len(words))] = f"e{chance.randrange(30)}"
            rows.append((len(rows) * 3, " ".join(words)))
    return rows


def result(df):
    return edges.brief((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("size, percent", [(3, 90), (2, 70), (5, 80)])
def test_families(spark, size, percent):
    rows = families(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(J.near_duplicates(df, size, percent)) == brute(rows, size, percent)


def test_a_chain_of_links(spark):
    """Each text differs from the next in one word, the ends share little: one component."""
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(30):
        words[2 * i] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)


def test_the_second_pass_finds_what_the_first_leaves(spark, monkeypatch):
    monkeypatch.setattr(J, "_first_links", lambda shared, *_: shared.selectExpr("node AS u", "node AS v").where("false"))
    rows = families(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.near_duplicates(df, 3, 90)) == brute(rows, 3, 90)


def test_whole_table(spark, folder):
    df = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert result(J.near_duplicates(df, 3, 90)) == brute(rows, 3, 90)


def test_edges(spark):
    rows = [r[:2] for r in edges.rows()]
    assert result(J.near_duplicates(edges.documents(spark), 3, 90)) == brute(rows, 3, 90)
    assert J.near_duplicates(edges.empty(spark)).count() == 0
    kept = J.drop_near_duplicates(edges.documents(spark), 3, 90)
    assert kept.columns == edges.documents(spark).columns
    left = [r["doc_id"] for r in kept.collect()]
    assert left.count(1) == 1 and 2 not in left and 7 not in left and {3, 4, 5, 9} <= set(left) and 10 not in left


def test_maps_differ_in_no_more_bits_than_sets(spark):
    import numpy as np

    rows = families(4, 10)
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, key long, text string")
    described = {r["doc_id"]: r for r in J.describe_sets(df, np.zeros(J.COUNTERS, np.uint8), 3, 90).collect()}
    sets = {i: ngrams(t, 3) for i, t in rows}
    for i in sets:
        for j in sets:
            bits = sum(bin((described[i][m] ^ described[j][m]) & (1 << 64) - 1).count("1") for m in J._MAP)
            assert bits <= len(sets[i] ^ sets[j])


def test_components(spark):
    chance = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 300) if i % 50] + [(chance.randrange(1000, 1200), chance.randrange(1000, 1200)) for _ in range(90)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "u long, v long").repartition(6)
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
