"""Keyed state in buckets."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F, types as T

from bazaarflow.streaming.keyed import KeyedState

ROW = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.LongType()),
                    T.StructField("live", T.BooleanType())])


def rows_of(df):
    return {r["name"]: r["value"] for r in df.where("live").collect()}


def test_equals_a_dict(spark, tmp_path):
    chance = random.Random(5)
    state, expected = KeyedState(spark, str(tmp_path), ROW, "name", F.col("live"), cell_keys=10, folders=2), {}
    widths = set()
    for batch in range(7):
        keys = chance.sample([*(f"k{i}" for i in range(400)), "", "é ü"], 90)
        asked = spark.createDataFrame([(k,) for k in keys], "name string")
        assert rows_of(state.of(asked)) == {k: expected[k] for k in keys if k in expected}
        changes = [(k, chance.randrange(1000), chance.random() < 0.8) for k in keys]
        given = spark.createDataFrame(changes, ROW)
        assert state.add(given, batch) and not state.add(given.withColumn("value", F.lit(-1)), batch)
        for name, value, live in changes:
            expected.pop(name, None)
            if live:
                expected[name] = value
        widths.add(state._bits(state._store(4).manifest()))
    assert rows_of(state.current()) == expected
    assert len(widths) > 1 and max(widths) > 4  # the buckets have doubled on the way


def test_nothing_there_and_nothing_new(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path), ROW, "name")
    asked = spark.createDataFrame([("a",)], "name string")
    assert state.of(asked).count() == 0 and state.current().count() == 0 and not state.applied(0)
    assert state.add(spark.createDataFrame([], ROW), 0) and state.applied(0)
    assert state.of(asked.limit(0)).count() == 0


def test_a_batch_that_died_leaves_nothing(spark, tmp_path, monkeypatch):
    state = KeyedState(spark, str(tmp_path), ROW, "name")
    state.add(spark.createDataFrame([("a", 1, True)], ROW), 0)
    monkeypatch.setattr("bazaarflow.sources.versions.rename_to_new", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        state.add(spark.createDataFrame([("a", 2, True)], ROW), 1)
    monkeypatch.undo()
    assert rows_of(state.current()) == {"a": 1} and not state.applied(1)
    assert state.add(spark.createDataFrame([("a", 3, True)], ROW), 1)
    assert rows_of(state.current()) == {"a": 3}


def test_a_key_reads_as_much_among_ten_times_the_keys(spark, tmp_path):
    read = {}
    for size in (4_000, 40_000):
        state = KeyedState(spark, str(tmp_path / str(size)), ROW, "name", cell_keys=500, folders=1)
        keys = spark.range(size).select(
            F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), F.col("id").alias("value"), F.lit(True).alias("live"))
        state.add(keys, 0)
        state.add(keys.limit(1), 1)  # sums up the first batch, whose buckets are too full
        one = state.of(spark.createDataFrame([("k17",)], "name string"))
        assert one.first()["value"] == 17
        read[size] = sum(os.path.getsize(urlparse(f).path) for f in one.inputFiles() if str(tmp_path) in f)
    assert 0 < read[40_000] < 2 * read[4_000]
