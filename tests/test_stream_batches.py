"""Batches of a stream that are shared by tasks, and hold the same rows as one file each would."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import lifecycle as L
from bazaarflow.plans import views
from bazaarflow.plans.catalog import Source
from bazaarflow.session import materialise
from bazaarflow.streaming import folds
from bazaarflow.streaming.batches import read_batches, start, write_batch


def delivered(spark, folder, out, name="booking_requests", moment="ts"):
    """All rows with their batch, and of how many files there are rows in each batch."""
    stream, files = views.stream_view(spark, folder, name, moment, 4), []

    def write(batch, number):
        files.append(batch.select(F.input_file_name()).distinct().count())
        write_batch(batch, out, number)

    start(stream, write, f"{out}-checkpoint", once=True).awaitTermination()
    rows = read_batches(spark, out, stream.schema).collect()
    return {tuple(r) for r in rows}, files


def test_a_large_batch_is_several_files_of_the_same_rows(spark, folder, tmp_path, monkeypatch):
    plain, files = delivered(spark, folder, str(tmp_path / "plain"))
    assert files == [1, 1, 1, 1]
    monkeypatch.setattr(views, "ROWS_PER_FILE", 60)
    several, files = delivered(spark, folder, str(tmp_path / "several"))
    assert several == plain and len(several) == 1500
    assert files == [7, 7, 7, 7]


@pytest.mark.parametrize("limit", [2, 80])
def test_batches_with_few_rows_keep_their_bounds(spark, folder, tmp_path, monkeypatch, limit):
    """Where times tie, slices differ in size; a small one is filled up with empty files."""
    spark.createDataFrame([(n, n, "F", 1.0, 1 if n < 150 else n - 148, "5-LOW") for n in range(160)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day int, "
                          "o_orderpriority string").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "timestamp_seconds(day * 86400) AS o_orderdate", "o_orderpriority").write.parquet(str(tmp_path / "in/orders.parquet"))
    plain, _ = delivered(spark, str(tmp_path / "in"), str(tmp_path / "plain"))
    monkeypatch.setattr(views, "ROWS_PER_FILE", limit)
    several, files = delivered(spark, str(tmp_path / "in"), str(tmp_path / "several"))
    assert several == plain and len(several) == 160
    assert len(files) == 2 and (files[0] == 20) == (limit == 2)


def test_what_arrives_in_one_file_is_written_in_several(spark, folder, tmp_path, monkeypatch):
    rows = spark.range(1000).coalesce(1)
    path = str(tmp_path / "rows")
    assert materialise(rows, "rows", path, 100).count() == 1000
    assert len([n for n in os.listdir(path) if n.endswith(".parquet")]) == 10

    seen, real = [], folds.materialise

    def watched(df, label, path=None, *more):
        found = real(df, label, path, *more)
        if path and path.endswith("arrived"):
            seen.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(folds, "materialise", watched)
    monkeypatch.setattr(folds, "ROWS_PER_FILE", 50)
    source = Source(spark, folder)
    out = str(tmp_path / "out")
    folds.accept_requests(
        source.stream("booking_requests"), source("providers_core"), source("profiles"), out, f"{out}-checkpoint",
        once=True).awaitTermination()
    assert len(seen) == 4 and min(seen) >= 7
    batch = L.accept_bookings(source("booking_requests"), source("providers_core"), source("profiles"))
    got = spark.read.parquet(f"{out}/accepted").drop("batch_id")
    assert got.exceptAll(batch.accepted).count() == batch.accepted.exceptAll(got).count() == 0
