"""Ordered scans and joins when one key holds a third of the rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import ordered
from bazaarflow.operators.latest import first_per_key, last_event, top_per_key
from bazaarflow.operators.skew import sliced_left_join
from bazaarflow.session import materialise, path_exists, scratch_path, scratch_scope


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(7)
    made = []
    for i in range(9000):
        key = "hot" if i % 3 == 0 else (None if i % 10 == 0 else f"k{chance.randrange(40)}")
        made.append((i, key, chance.randrange(300), chance.choice([None, "a", "b"])))
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts long, v string").repartition(6)


@pytest.fixture(scope="module")
def scan(df):
    return ordered.OrderedScan(df, ["key"], [F.col("ts"), F.col("id")], "test")


@pytest.fixture(scope="module")
def runs(df):
    return ordered._sorted_runs(df, ["key"], [F.col("ts"), F.col("id")], "test", None)


@pytest.fixture(scope="module")
def groups(rows):
    by_key = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key[r[1]].append(r)
    return by_key


@pytest.fixture(scope="module", autouse=True)
def many_small_partitions(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_hot_key_spans_several_balanced_runs(runs, rows):
    sizes = {r["_run"]: r["count"] for r in runs.groupBy("_run").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < len(rows) / 8 * 2
    assert runs.where("key = 'hot'").select("_run").distinct().count() >= 2


def test_position(scan, groups):
    got = {r["id"]: r["n"] for r in scan.position("n").rows().collect()}
    assert got == {r[0]: n for g in groups.values() for n, r in enumerate(g, start=1)}


def test_position_over_all_rows(df, rows):
    got = {r["id"]: r["position"] for r in ordered.with_position(df, [], [F.col("ts").desc(), F.col("id")]).collect()}
    expected = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(expected, start=1)}


def test_previous(scan, groups):
    got = {r["id"]: r["p"] and r["p"]["v"] for r in scan.previous(["v"], "p").rows().collect()}
    assert got == {r[0]: (g[i - 1][3] if i else None) for g in groups.values() for i, r in enumerate(g)}


@pytest.mark.parametrize("before_row", [False, True])
def test_latest(scan, groups, before_row):
    found = scan.latest(F.col("v"), "last", before_row=before_row).rows()
    expected = {}
    for g in groups.values():
        last = None
        for r in g:
            now = r[3] if r[3] is not None else last
            expected[r[0]] = last if before_row else now
            last = now
    assert {r["id"]: r["last"] for r in found.collect()} == expected


def test_what_runs_hand_over_has_one_row_per_run(runs):
    assert ordered._run_ends(runs).count() == 8
    ends = ordered._run_ends(runs).select("_run", "key", F.lit(1).alias("_carry"))
    assert ordered._hand_over(ends, ["key"], F.sum).count() == 7
    tails = ordered._tails(runs, ["key"])
    assert tails.select("_run", "key").distinct().count() == 8


def test_tops_and_firsts(df, groups):
    top = top_per_key(df, "key", [F.col("ts"), F.col("id")], 3).collect()
    assert {(r["id"], r["position"]) for r in top} == {
        (r[0], n) for g in groups.values() for n, r in enumerate(g[:3], start=1)}
    first = first_per_key(df, ["key"], [F.col("ts"), F.col("id")]).collect()
    assert {r["id"] for r in first} == {g[0][0] for g in groups.values()}


def test_last_event(df, groups):
    events = df.withColumnRenamed("id", "event_id").where("key is not null")
    got = {r["key"]: (r["v"], r["ts"]) for r in last_event(events, "key", ["v"]).collect()}
    assert got == {k: (g[-1][3], g[-1][2]) for k, g in groups.items() if k is not None}


def test_sliced_left_join(spark, df, rows):
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "side_key string, w long")
    joined = sliced_left_join(df, side, "key", "side_key", "id")
    weights = {"hot": 1, "k1": 2}
    assert {r["id"]: r["w"] for r in joined.collect()} == {r[0]: weights.get(r[1]) for r in rows}
    assert joined.count() == len(rows)
    assert set(joined.columns) == {*df.columns, "side_key", "w"}


def test_windows_over_rows_are_partitioned(df):
    placed = ordered.with_position(df, [], [F.col("ts"), F.col("id")])
    text = placed._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("[_run" in line for line in windows)


def test_scratch_goes_with_its_scope(spark, df):
    with scratch_scope(spark):
        path = scratch_path(spark, "scoped")
        materialise(df, "scoped", path)
        assert path_exists(spark, path)
    assert not path_exists(spark, path)
