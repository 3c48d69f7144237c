"""Streams over several batches, compared with the batch operators."""

from __future__ import annotations

import os
import random
import time
from datetime import datetime, timedelta

import pytest

from bazaarflow.operators import lifecycle as L
from bazaarflow.schemas import BOOKING_REQUESTS, BOOKING_STATUS_EVENTS
from bazaarflow.streaming import codes, folds
from bazaarflow.streaming.batches import read_batches
from tests import golden
from tests.test_codes import EVENT, START, random_events, replay
from tests.test_folds import request

T0 = datetime(2024, 7, 1)


def file_stream(spark, batches, schema, folder):
    """A stream that delivers each list of rows as one batch, in order."""
    os.makedirs(folder)
    for number, rows in enumerate(batches):
        staging = f"{folder}-staging-{number}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(staging)
        part = next(n for n in os.listdir(staging) if n.endswith(".parquet"))
        target = f"{folder}/{number:03d}.parquet"
        os.link(f"{staging}/{part}", target)
        moment = time.time() - 1000 + number * 10
        os.utime(target, (moment, moment))
    read_schema = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(read_schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def paths(tmp_path):
    return {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}


def batches_of(rows, size):
    return [rows[i:i + size] for i in range(0, len(rows), size)]


@pytest.fixture(scope="module")
def status_rows():
    chance = random.Random(11)
    states = ["pending", "accepted", "in-progress", "completed", "cancelled", "rejected"]
    rows = [(i, "TF-1" if i % 3 == 0 else f"TF-{chance.randrange(1, 12)}", chance.choice(states),
             T0 + timedelta(minutes=i + chance.randrange(60))) for i in range(200)]
    return rows


def test_current_status_equals_the_batch_fold(spark, paths, status_rows):
    stream = file_stream(spark, batches_of(status_rows, 60), BOOKING_STATUS_EVENTS, paths["in"])
    folds.track_status(stream, paths["out"], paths["checkpoint"], once=True).awaitTermination()
    got = {r["booking_id"]: r["status"] for r in folds.current_status(spark, paths["out"]).collect()}
    expected = {}
    for event, booking, status, ts in sorted(status_rows, key=lambda r: (r[3], r[0])):
        if status != "rejected":
            expected[booking] = status
    assert got == expected
    changes = read_batches(spark, f"{paths['out']}/changes", folds.STATUS_UPDATE)
    assert changes.select("batch_id").distinct().count() == 4


def test_what_a_stream_keeps_has_one_size(spark, paths, status_rows):
    """Many batches with a snapshot every third: results stay right and old folders go."""
    schema = BOOKING_STATUS_EVENTS
    known = [r for r in status_rows if r[2] != "rejected"]
    sizes = []
    for number, rows in enumerate(batches_of(known, 12)):
        df = spark.createDataFrame(rows, schema)
        folds._statuses(spark, paths["out"], 3).add(folds._last_status(df), number)
        sizes.append(len(os.listdir(f"{paths['out']}/changes")))
    assert len(sizes) > 11 and max(sizes) <= 8
    expected = {}
    for event, booking, status, ts in sorted(known, key=lambda r: (r[3], r[0])):
        expected[booking] = status
    got = {r["booking_id"]: r["status"] for r in folds.current_status(spark, paths["out"], 3).collect()}
    assert got == expected


def test_completions_equal_the_batch_count(spark, paths, status_rows):
    jobs = golden.bookings(spark)
    stream = file_stream(spark, batches_of(status_rows, 70), BOOKING_STATUS_EVENTS, paths["in"])
    folds.track_completions(stream, paths["out"], paths["checkpoint"], once=True, snapshot_every=2).awaitTermination()
    batch = L.completion_counts(spark.createDataFrame(status_rows, BOOKING_STATUS_EVENTS), jobs)
    got = {tuple(r) for r in folds.running_completions(spark, paths["out"], jobs, 2).collect()}
    assert got == {tuple(r) for r in batch.collect()} and got


def test_a_batch_written_twice_counts_once(spark, paths):
    jobs = golden.bookings(spark)
    counts = spark.createDataFrame([("TF-1", 3)], folds.COMPLETIONS)
    for _ in range(2):
        folds._completions(spark, paths["out"], 50).add(counts, 0)
    assert folds.running_completions(spark, paths["out"], jobs).first()["completions"] == 3
    assert folds.running_completions(spark, paths["out"] + "-none", jobs).count() == 0


def test_requests_split_like_the_batch(spark, paths):
    rows = [tuple(request(n, provider_id="p1" if n % 3 else "nobody",
                          role="customer" if n % 5 else "admin")[f.name] for f in BOOKING_REQUESTS.fields)
            for n in range(40)]
    sellers, people = golden.providers(spark), golden.profiles(spark)
    stream = file_stream(spark, batches_of(rows, 15), BOOKING_REQUESTS, paths["in"])
    folds.accept_requests(
        stream, lambda: sellers, people, paths["out"], paths["checkpoint"], once=True).awaitTermination()
    batch = L.accept_bookings(spark.createDataFrame(rows, BOOKING_REQUESTS), sellers, people)
    for part, expected in (("accepted", batch.accepted), ("rejected", batch.rejected)):
        got = spark.read.parquet(f"{paths['out']}/{part}").drop("batch_id")
        assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0


def sent(number, **changes):
    return tuple(request(number, **changes)[f.name] for f in BOOKING_REQUESTS.fields)


def test_a_resent_request_is_accepted_once(spark, paths):
    """Resent in the same batch, in a later one, after a refusal, and over snapshots."""
    late = T0 + timedelta(days=3)
    batches = [
        [sent(1), sent(1, ts=late, description="again"), sent(2, address="short"), sent(3)],
        [sent(1, ts=late), sent(4), sent(2)],
        [sent(2), sent(3), sent(3), sent(5)],
        [sent(n) for n in (1, 2, 3, 4, 5, 6)],
        [sent(6), sent(None)],
    ]
    stream = file_stream(spark, batches, BOOKING_REQUESTS, paths["in"])
    folds.accept_requests(
        stream, golden.providers(spark), golden.profiles(spark), paths["out"], paths["checkpoint"], once=True,
        snapshot_every=2).awaitTermination()
    accepted = spark.read.parquet(f"{paths['out']}/accepted").collect()
    assert sorted((r["id"], r["batch_id"]) for r in accepted) == [
        ("TF-100001", 0), ("TF-100002", 1), ("TF-100003", 0), ("TF-100004", 1), ("TF-100005", 2), ("TF-100006", 3)]
    assert {r["description"] for r in accepted if r["id"] == "TF-100001"} == {"Fan"}
    repeated = read_batches(spark, f"{paths['out']}/repeated", folds.REPEATED).collect()
    assert sorted((r["batch_id"], r["request_id"], r["repeats"]) for r in repeated) == [
        (0, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2), (3, 1, 1), (3, 2, 1), (3, 3, 1), (3, 4, 1), (3, 5, 1), (4, 6, 1)]
    refused = spark.read.parquet(f"{paths['out']}/rejected").collect()
    assert {(r["request_id"], r["reason"]) for r in refused} == {(2, "address_too_short"), (None, "missing_field")}


def test_late_bookings_correct_their_day(spark, paths):
    from decimal import Decimal as D

    def row(i, status, price, day):
        return (str(i), status, D(price), None if day is None else T0 + timedelta(days=day, hours=3))

    batches = [
        [row(1, "completed", 10, 0), row(2, "pending", 5, 0)],
        [row(3, "completed", 1, 4), row(4, "completed", 2, 1)],
        [row(5, "completed", 100, 0), row(6, "pending", 1, 4), row(7, "completed", 7, None)],
        [row(8, "completed", 50, 0), row(9, "pending", 1, 3)],
    ]
    stream = file_stream(
        spark, batches, "id string, status string, price decimal(14,2), created_at timestamp", paths["in"])
    folds.track_daily_totals(
        stream, paths["out"], paths["checkpoint"], once=True, snapshot_every=2).awaitTermination()
    revised = sorted(((r["batch_id"], r["day"], r["bookings"], r["pending"], r["revenue"]) for r in read_batches(
        spark, f"{paths['out']}/revisions", folds.DAILY).where("day IS NOT NULL").collect()))
    day = [T0 + timedelta(n) for n in range(5)]
    assert revised == [
        (0, day[0], 2, 1, 10), (1, day[1], 1, 0, 2), (1, day[4], 1, 0, 1),
        (2, day[0], 3, 1, 110), (2, day[4], 2, 1, 1), (3, day[0], 4, 1, 160), (3, day[3], 1, 1, 0)]
    found = {r["day"]: r["revenue"] for r in folds.daily_totals_so_far(spark, paths["out"], 2).collect()}
    assert found == {None: 7, day[0]: 160, day[1]: 2, day[3]: 0, day[4]: 1}
    late = read_batches(spark, f"{paths['out']}/late", folds.LATE).collect()
    assert sorted((r["batch_id"], r["day"], r["rows"]) for r in late) == [(2, day[0], 1), (3, day[0], 1)]


def test_repeated_events_are_dropped(spark, paths):
    rows = [(n, "TF-1", "completed", T0 + timedelta(minutes=n)) for n in range(6)]
    stream = file_stream(spark, [rows[:4] + rows[:2], rows[3:], rows[:1]], BOOKING_STATUS_EVENTS, paths["in"])
    folds.write_stream(folds.without_repeats(stream), paths["out"], paths["checkpoint"], once=True).awaitTermination()
    seen = [r["event_id"] for r in read_batches(spark, paths["out"], BOOKING_STATUS_EVENTS).collect()]
    assert sorted(seen) == [0, 1, 2, 3, 4, 5]


def test_daily_totals_drop_late_rows(spark, paths):
    schema = "id string, status string, price decimal(14,2), created_at timestamp"
    from decimal import Decimal as D

    def row(i, status, price, day):
        return (str(i), status, D(price), T0 + timedelta(days=day, hours=3))

    stream = file_stream(spark, [
        [row(1, "completed", 10, 0), row(2, "pending", 5, 0), row(3, "completed", 7, 1)],
        [row(4, "completed", 1, 1), row(5, "completed", 9, 4)],
        [row(6, "pending", 1, 9)],
        [row(7, "completed", 100, 0), row(8, "pending", 1, 9)],   # row 7 is days late
    ], schema, paths["in"])
    folds.write_stream(folds.daily_totals(stream), paths["out"], paths["checkpoint"], once=True).awaitTermination()
    got = {(r["day"], r["bookings"], r["pending"], r["revenue"])
           for r in read_batches(spark, paths["out"], folds.DAILY).collect()}
    assert got == {(T0, 2, 1, 10), (T0 + timedelta(1), 2, 0, 8), (T0 + timedelta(4), 1, 0, 9)}


STREAM_EVENT = EVENT + ", is_issue boolean"


@pytest.mark.parametrize("kind", ["verify", "reset"])
def test_codes_equal_a_replay(spark, paths, kind):
    issues, attempts = random_events(8, 700)
    accounts = {f"+91 {9000000000 + n}" for n in range(0, 30, 2)}
    rows = sorted([(*i, True) for i in issues] + [(*a, False) for a in attempts], key=lambda r: (r[4], r[0]))
    stream = file_stream(spark, batches_of(rows, 120), STREAM_EVENT, paths["in"])
    people = spark.createDataFrame([(p,) for p in sorted(accounts)], "phone string")
    codes.match_code_stream(
        stream, paths["out"], paths["checkpoint"], kind=kind, profiles=people, cell_keys=3, folders=2, once=True,
    ).awaitTermination()
    got = codes.outcomes(spark, paths["out"]).collect()
    assert len(got) == len(attempts)
    assert {r["event_id"]: r["outcome"] for r in got} == replay(issues, attempts, kind, accounts)
    work = f"{paths['out']}/work"
    assert not os.path.exists(work) or not os.listdir(work)


def test_codes_carry_over_between_batches(spark, paths):
    phone = "+91 9000000001"
    stream = file_stream(spark, [
        [(1, phone, "11", "login", START, True)],
        [(2, phone, "99", "login", START + timedelta(seconds=1), False)],
        [(3, phone, "11", "login", START + timedelta(seconds=2), False)],
        [(4, phone, "11", "login", START + timedelta(seconds=3), False)],
    ], STREAM_EVENT, paths["in"])
    codes.match_code_stream(stream, paths["out"], paths["checkpoint"], once=True).awaitTermination()
    got = {r["event_id"]: r["outcome"] for r in codes.outcomes(spark, paths["out"]).collect()}
    assert got == {2: "invalid", 3: "ok", 4: "not_requested"}
