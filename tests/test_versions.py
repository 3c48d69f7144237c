from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import published
from bazaarflow.operators.rollups import provider_rollup
from bazaarflow.schemas import conform
from bazaarflow.sources.versions import Change, Conflict, Manifest, Store

EVENT = "event_id long, booking_id string, status string, ts timestamp"


def moment(day: int) -> dt.datetime:
    return dt.datetime(2024, 9, day, 12)


def bookings(spark):
    rows = [(f"TF-{i}", f"P{i % 3}" if i % 5 else None, "pending" if i % 2 else "completed", dt.date(2024, 1 + i % 4, 3),
             dt.datetime(2024, 1 + i % 4, 2) if i != 11 else None, float(10 * i), None if i % 4 else float(i % 5))
            for i in range(24)]
    return conform(spark.createDataFrame(
        rows, "id string, provider_id string, status string, booking_date date, created_at timestamp, price double, "
        "rating double"), "bookings")


def providers(spark):
    return conform(spark.createDataFrame(
        [(f"P{i}", "pending", False) for i in range(5)], "id string, status string, verified boolean"), "providers")


def status(spark, *events):
    return spark.createDataFrame([(n, b, s, moment(day)) for n, b, s, day in events], EVENT)


@pytest.fixture
def store(spark, tmp_path):
    found = published.open_store(spark, str(tmp_path / "store"))
    published.load_tables(found, {"bookings": bookings(spark), "providers": providers(spark)})
    return found


def files(store, name="bookings"):
    return {c: sorted(f for folder in folders for f in os.listdir(f"{store.path}/data/{folder}") if f.endswith(".parquet"))
            for c, folders in store.manifest().tables[name].items()}


def statuses(store):
    return {r["id"]: r["status"] for r in store.read("bookings").collect()}


def rollups(store, month="2024-01"):
    kept = published.maintained_rollup(store, month)
    rebuilt = provider_rollup(store.read("bookings"), month)
    text = [F.col(c).cast("decimal(38,2)").alias(c) for c in kept.columns[1:]]
    return [sorted(map(tuple, df.select("provider_id", *text).collect())) for df in (kept, rebuilt)]


def test_only_touched_months_are_written_again(spark, store):
    before = files(store)
    assert set(before) == {"2024-01", "2024-02", "2024-03", "2024-04", "undated"}
    assert published.publish_status(store, status(spark, (1, "TF-5", "accepted", 1), (2, "nobody", "accepted", 1)), 0)
    after = files(store)
    assert after["2024-02"] != before["2024-02"]
    assert {c: f for c, f in after.items() if c != "2024-02"} == {c: f for c, f in before.items() if c != "2024-02"}
    assert statuses(store)["TF-5"] == "accepted" and len(statuses(store)) == 24


def test_a_batch_is_applied_once(spark, store):
    events = status(spark, (1, "TF-5", "completed", 1))
    assert published.publish_status(store, events, 0, count_completions=True)
    assert not published.publish_status(store, events, 0, count_completions=True)
    done = {r["id"]: r["completed_jobs"] for r in store.read("providers").collect()}
    assert store.versions() == [1, 2] and done == {**dict.fromkeys(done, None)}  # TF-5 has no provider
    assert published.publish_status(store, status(spark, (3, "TF-7", "completed", 2), (4, "TF-7", "completed", 3)), 1,
                                    count_completions=True)
    assert {r["id"]: r["completed_jobs"] for r in store.read("providers").collect()}["P1"] == 2


def test_an_older_event_in_a_later_batch_loses(spark, store):
    published.publish_status(store, status(spark, (10, "TF-1", "accepted", 9)), 0)
    published.publish_status(store, status(spark, (2, "TF-1", "cancelled", 4), (11, "TF-2", "cancelled", 1)), 1)
    assert (statuses(store)["TF-1"], statuses(store)["TF-2"]) == ("accepted", "cancelled")
    row = store.read("bookings").where("id = 'TF-1'").first()
    assert row["updated_at"] == moment(9) and row["status_event"] == 10
    approvals = "event_id long, provider_id string, status string, ts timestamp"
    published.publish_provider_status(store, spark.createDataFrame([(5, "P1", "active", moment(8))], approvals), 0)
    published.publish_provider_status(store, spark.createDataFrame(
        [(6, "P1", "suspended", moment(7)), (7, "P2", "rejected", moment(9))], approvals), 1)
    found = {r["id"]: (r["status"], r["verified"]) for r in store.read("providers").collect()}
    assert found["P1"] == ("active", True) and found["P2"] == ("pending", False)


def test_a_writer_that_dies_publishes_nothing_and_can_run_again(spark, store, monkeypatch):
    events = status(spark, (1, "TF-1", "completed", 1), (2, "TF-2", "cancelled", 1))
    before, parts = statuses(store), rollups(store)
    real = published._differences
    monkeypatch.setattr(published, "_differences", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        published.publish_status(store, events, 0)
    assert statuses(store) == before and store.versions() == [1]
    assert len(os.listdir(f"{store.path}/data")) == 2  # what the dead writer left has no name in any manifest
    monkeypatch.setattr(published, "_differences", real)
    assert published.publish_status(store, events, 0)
    assert statuses(store)["TF-1"] == "completed"
    kept, rebuilt = rollups(store)
    assert kept == rebuilt != parts[0]


def test_a_reader_keeps_its_version(spark, store):
    manifest = store.manifest()
    reading = store.read("bookings", manifest=manifest)
    published.publish_status(store, status(spark, *[(i, f"TF-{i}", "cancelled", 1) for i in range(24)]), 0)
    assert reading.where("status = 'cancelled'").count() == 0
    assert store.read("bookings", manifest=manifest).where("status = 'cancelled'").count() == 0
    assert store.read("bookings").where("status = 'cancelled'").count() == 24
    store.vacuum(keep=2)
    assert reading.count() == 24
    store.vacuum(keep=1)
    assert store.versions() == [2] and len(os.listdir(f"{store.path}/data")) >= 1
    assert store.read("bookings").count() == 24


def test_the_slower_writer_starts_again_on_the_new_version(spark, store):
    rival = Store(spark, store.path, store.layouts)
    turns = []

    def write(change):
        turns.append(change.base.version)
        if len(turns) == 1:  # another writer publishes while this one is at work
            rival.publish("rival", 0, lambda c: c.append("bookings", c.read("bookings").where("id = 'TF-3'").withColumn(
                "id", F.lit("TF-900"))))
        change.rewrite("bookings", change.read("bookings", ["2024-04"]).where("id <> 'TF-3'"), ["2024-04"])

    assert store.publish("mine", 0, write)
    assert turns == [1, 2] and store.versions() == [1, 2, 3]
    assert {"TF-900"} <= set(statuses(store)) and "TF-3" not in statuses(store)
    assert store.manifest().applied == {"load": 0, "rival": 0, "mine": 0}

    def always_late(change):
        rival.publish("rival", rival.manifest().version, lambda c: None)

    with pytest.raises(Conflict):
        store.publish("mine", 1, always_late)


def test_tables_are_replaced_in_one_version(spark, store):
    assert published.load_tables(store, {"bookings": bookings(spark).limit(0), "providers": providers(spark).limit(2)}, 1)
    assert store.read("bookings").count() == 0 and store.read("providers").count() == 2
    assert rollups(store) == [[], []]
    assert store.read("bookings", manifest=store.manifest(1)).count() == 24
    assert not published.load_tables(store, {"bookings": bookings(spark)}, 1)


def test_counters_follow_every_change(spark, store):
    assert rollups(store)[0] == rollups(store)[1]
    new = bookings(spark).where("id IN ('TF-1', 'TF-2')").withColumn("id", F.concat(F.lit("N"), "id"))
    assert published.publish_bookings(store, new.unionByName(new).unionByName(bookings(spark)), 0)
    assert store.read("bookings").count() == 26
    ratings = spark.createDataFrame(
        [(1, "TF-4", "4.5", "good", moment(1)), (2, "TF-4", "n/a", "bad", moment(2)), (3, "TF-8", "3", None, moment(2)),
         (4, "NTF-1", "12345678901234567890123456789", "x", moment(2)), (5, "NTF-2", "99999999999999999999", "x", moment(2))],
        "event_id long, booking_id string, rating string, review string, ts timestamp")
    assert published.publish_ratings(store, ratings, 0)
    published.publish_status(store, status(spark, (1, "TF-2", "cancelled", 1), (2, "NTF-1", "completed", 1)), 0)
    for month in ("2024-01", "2024-02", "2024-03", "1999-01"):
        kept, rebuilt = rollups(store, month)
        assert kept == rebuilt and kept
    folders = {c: len(f) for c, f in store.manifest().tables["partials"].items()}
    assert max(folders.values()) > 1
    assert published.compact_counters(store, 0, folders=1)
    assert {len(f) for f in store.manifest().tables["partials"].values()} == {1}
    assert rollups(store)[0] == rollups(store)[1]


def test_a_fold_reads_only_touched_months(spark, store, monkeypatch):
    seen = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, cells=None, manifest=None: (
        seen.append((name, cells)), real(self, name, cells, manifest))[1])
    published.publish_status(store, status(spark, (1, "TF-5", "accepted", 1)), 0)
    assert ("bookings", ["2024-02"]) in seen and [n for n, c in seen if c is None] == ["bookings"]  # ids, to find months
    plan = store.read("bookings", ["2024-02"])._jdf.inputFiles()
    assert all("cell=2024-02" in path for path in plan)


def test_versions_before_the_first(spark, tmp_path):
    empty = published.open_store(spark, str(tmp_path / "none"))
    assert empty.manifest() == Manifest() and empty.read("bookings").count() == 0
    assert published.publish_status(empty, status(spark, (1, "TF-5", "accepted", 1)), 0)
    assert empty.read("bookings").count() == 0 and published.maintained_rollup(empty, "2024-01").count() == 0


def test_a_fold_computes_its_changes_once(spark, store, monkeypatch):
    """The touched months are read twice: a few columns to find the changes, and whole to be written again."""
    read, written = [], []
    real_read, real_write = Store.read, Change._write
    monkeypatch.setattr(Store, "read", lambda self, name, cells=None, manifest=None: (
        read.append((name, cells)), real_read(self, name, cells, manifest))[1])
    monkeypatch.setattr(Change, "_write", lambda self, name, rows, in_place=False: (
        written.append((name, in_place)), real_write(self, name, rows, in_place))[1])
    events = status(spark, (5, "TF-5", "accepted", 2), (6, "TF-6", "accepted", 2))
    published.publish_status(store, events, 0)
    months = ["2024-02", "2024-03"]
    assert read.count(("bookings", months)) == 2
    assert written == [("bookings", True), ("partials", False)]  # no shuffle of months that were written at once

    written.clear()
    older = status(spark, (1, "TF-5", "cancelled", 1), (9, "TF-6", "completed", 3))
    published.publish_status(store, older, 1)
    assert set(store.manifest().tables["bookings"]["2024-02"]) == set(store.manifest(2).tables["bookings"]["2024-02"])
    assert store.manifest().tables["bookings"]["2024-03"] != store.manifest(2).tables["bookings"]["2024-03"]
    assert (statuses(store)["TF-5"], statuses(store)["TF-6"]) == ("accepted", "completed")
    assert rollups(store)[0] == rollups(store)[1]

    new = bookings(spark).where("id = 'TF-6'").withColumn("id", F.lit("TF-60"))
    published.publish_bookings(store, new, 0)
    written.clear()
    published.publish_status(store, status(spark, (10, "TF-60", "completed", 4)), 2)
    monkeypatch.setattr(published, "BROADCAST_BYTES", 0)
    published.publish_status(store, status(spark, (11, "TF-60", "cancelled", 5)), 3)
    assert [w for w in written if w[0] == "bookings"] == [("bookings", False)] * 2
    assert statuses(store)["TF-60"] == "cancelled" and store.read("bookings").count() == 25
    assert rollups(store)[0] == rollups(store)[1]


def test_a_batch_that_was_applied_reads_nothing(spark, store):
    published.publish_status(store, status(spark, (1, "TF-5", "accepted", 1)), 0)
    lost = status(spark, (2, "TF-6", "accepted", 1)).withColumn("ts", F.raise_error(F.lit("read")).cast("timestamp"))
    assert not published.publish_status(store, lost, 0)
