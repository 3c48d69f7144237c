"""Places of notification feeds, found by counts."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import bookings as B, feed, notifications as N, published
from bazaarflow.schemas import BOOKINGS
from tests import golden

PROVIDER_ROWS = {"busy": 400, "some": 37, "one": 1}


def many_bookings(spark):
    """A provider with most rows; ties in time, undated rows, and rows without a provider."""
    rows, n = [], 0
    for provider, size in [*PROVIDER_ROWS.items(), (None, 9)]:
        for i in range(size):
            n += 1
            created = None if i % 17 == 3 else datetime(2024, 1 + i * 7 % 5, 1 + i % 3)
            rows.append(dict(id=f"TF-{n * 7919 % 1009:04d}", provider_id=provider, customer_id="c1", price=Decimal(1),
                             status="pending" if i % 2 else "accepted", created_at=created))
    return golden.table(spark, BOOKINGS, rows)


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    jobs, people = many_bookings(spark).cache(), golden.profiles(spark).cache()
    store = published.open_store(spark, str(tmp_path_factory.mktemp("feed")))
    late = F.xxhash64("id") % 3 == 0
    published.load_tables(store, {"bookings": jobs.where(~late)})
    for copies in range(2):
        published.publish_bookings(store, jobs.where(late), copies)
    return jobs, people, store


def whole_feed(jobs, people):
    return {(r["provider_id"], r["id"]): r for r in N.notifications(B.provider_bookings(jobs, people)).collect()}


def wanted(spark, rows):
    return spark.createDataFrame(rows, "provider_id string, id long")


def test_every_place_equals_the_sorted_feed(spark, market):
    jobs, people, store = market
    expected = whole_feed(jobs, people)
    ids = wanted(spark, [*expected, *list(expected)[:5]])  # some are asked for twice
    for got in (published.stored_notices(store, ids, people).collect(),
                feed.notices_at(lambda months: jobs, feed.feed_counts(jobs), ids, people).collect()):
        assert len(got) == len(expected) and {(r["provider_id"], r["id"]): r for r in got} == expected


def test_ids_that_are_not_there(spark, market):
    jobs, people, store = market
    ids = wanted(spark, [("some", 999), ("some", 1037), ("some", 1036), ("one", 1000), ("nobody", 1000),
                         (None, 1000), ("some", None), ("busy", 10**12)])
    got = published.stored_notices(store, ids, people).collect()
    assert {(r["provider_id"], r["id"]) for r in got} == {("some", 1036), ("one", 1000)}
    assert published.stored_notices(store, ids.limit(0), people).count() == 0


def test_a_store_without_bookings(spark, tmp_path):
    store = published.open_store(spark, str(tmp_path))
    people = golden.profiles(spark)
    assert published.stored_notices(store, wanted(spark, [("some", 1000)]), people).count() == 0


def test_pages(spark, market):
    jobs, people, store = market
    expected = whole_feed(jobs, people)
    providers = spark.createDataFrame([(p,) for p in PROVIDER_ROWS], "provider_id string")
    got = published.stored_notices(store, feed.page(providers, 30, 20), people).collect()
    assert {(r["provider_id"], r["id"]) for r in got} == {k for k in expected if 1030 <= k[1] < 1050}


def test_one_place_reads_one_month_of_one_provider(spark, market):
    jobs, _, store = market
    months = []

    def read(chosen):
        months.append(chosen)
        return store.read("bookings", chosen)

    located = feed.locate(wanted(spark, [("busy", 1390)]), store.read("feed_counts")).first()
    at = feed.bookings_at(read, store.read("feed_counts"), wanted(spark, [("busy", 1390)]))
    assert at.count() == 1 and months == [[located["month"]]]
    folders = {f"cell={located['month']}"}
    assert {part for f in store.read("bookings", months[0]).inputFiles() for part in f.split("/") if part.startswith("cell=")} == folders
    text = store.read("bookings", months[0]).where(F.col("provider_id").isin(["busy"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "provider_id" in text.split("PushedFilters: [")[1].split("]")[0]


def test_answers_count_for_the_version_that_was_seen(spark, tmp_path):
    people = golden.profiles(spark)
    store = published.open_store(spark, str(tmp_path))
    jobs = golden.bookings(spark)
    published.load_tables(store, {"bookings": jobs})
    seen = store.manifest().version
    newer = golden.table(spark, BOOKINGS, [dict(id="TF-99", provider_id="p1", status="pending", created_at=datetime(2025, 1, 1))])
    published.publish_bookings(store, newer, 0)  # moves all dated places of p1 by one
    answers = spark.createDataFrame(
        [(1, "p1", 1001, True, datetime(2025, 2, 1)), (2, "p9", 1000, False, datetime(2025, 2, 1)),
         (3, "p1", 77, True, datetime(2025, 2, 1))],
        "event_id long, provider_id string, id long, accept boolean, ts timestamp")
    assert published.publish_answers(store, answers, 0, seen)
    assert not published.publish_answers(store, answers, 0, seen)
    status = {r["id"]: r["status"] for r in store.read("bookings").collect()}
    before = {r["id"]: r["status"] for r in jobs.collect()} | {"TF-99": "pending"}
    assert status == before | {"TF-2": "accepted", "TF-7": "cancelled"}
    assert published.publish_answers(store, answers.where("id = 1001").withColumn("ts", F.col("ts") + timedelta(days=1)), 1)
    assert {r["id"]: r["status"] for r in store.read("bookings").collect()}["TF-99"] == "accepted"


def test_counts_are_summed_up(spark, market):
    jobs, people, store = market
    before = whole_feed(jobs, people)
    published.compact_counters(store, 0, folders=1)
    assert all(len(f) == 1 for f in store.manifest().tables["feed_counts"].values())
    got = published.stored_notices(store, wanted(spark, list(before)[::3]), people)
    assert got.count() == len(list(before)[::3])
