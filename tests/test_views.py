"""Directory, booking, admin and notification views over golden tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import admin, bookings as B, directory as D, filters, notifications as N, rollups
from bazaarflow.sources.dimensions import dim_area, dim_category
from tests import golden


@pytest.fixture(scope="module")
def tables(spark):
    made = golden.profiles(spark), golden.providers(spark), golden.bookings(spark)
    return [t.cache() for t in made]


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("options, expected", [
    ({}, ["p1", "p4", "p2"]),
    ({"sort": "price-low"}, ["p2", "p4", "p1"]),
    ({"sort": "price-high"}, ["p1", "p4", "p2"]),
    ({"sort": "whatever"}, ["p1", "p4", "p2"]),
    ({"category": "Plumber"}, ["p4", "p2"]),
    ({"category": "All Services", "area": "All Areas", "search": ""}, ["p1", "p4", "p2"]),
    ({"category": ""}, ["p1", "p4", "p2"]),
    ({"area": "KK Nagar"}, ["p1", "p4"]),
    ({"area": "kk nagar"}, []),
    ({"emergency": "true"}, ["p1"]),
    ({"emergency": "false"}, ["p1", "p4", "p2"]),
    ({"search": "10%"}, ["p1"]),
    ({"search": "_"}, []),
    ({"search": "PLUMB"}, ["p4", "p2"]),
    ({"limit": 2}, ["p1", "p4"]),
])
def test_directory(tables, options, expected):
    people, sellers, _ = tables
    assert ids(D.provider_directory(sellers, people, **options)) == expected


def test_adding_a_filter_never_adds_rows(tables):
    people, sellers, _ = tables
    every = set(ids(D.provider_directory(sellers, people)))
    assert every <= {r["id"] for r in sellers.where("status = 'active'").collect()}
    for options in ({"category": "Plumber"}, {"area": "KK Nagar"}, {"search": "f"}):
        assert set(ids(D.provider_directory(sellers, people, **options))) <= every


def test_detail_shows_every_status(spark, tables):
    people, sellers, _ = tables
    assert sorted(ids(D.provider_detail(sellers, people))) == ["p1", "p2", "p3", "p4", "p5", "p6"]
    wanted = spark.createDataFrame([("p3",), ("p3",), ("nobody",)], "id string")
    assert ids(D.provider_detail(sellers, people, wanted)) == ["p3"]
    row = D.provider_detail(sellers, people, ["p1"]).first()
    assert row["phone"] == "+91 8888888880" and row["price"] == 150


def test_admin_list_and_views(tables):
    people, sellers, _ = tables
    listed = D.admin_provider_list(sellers, people)
    shown = {r["id"]: (r["name"], r["phone"], r["email"], r["area"]) for r in listed.collect()}
    missing = "Not provided"
    assert shown == {
        "p1": ("Fast Fixers 10%", "+91 8888888880", missing, "KK Nagar"),
        "p2": ("Mani Plumbing", missing, missing, "Not specified"),
        "p3": ("Raj Painters", "+91 8888888890", missing, "Not specified"),
        "p4": ("No Profile", missing, missing, "KK Nagar, "),
        "p5": ("Unknown", missing, missing, "Not specified"),
        "p6": ("Gone", missing, missing, "Not specified"),
    }
    pick = filters.admin_providers
    assert sorted(ids(pick(listed, "verification"))) == ["p3", "p5"]
    assert ids(pick(listed, "rejected", "active")) == ["p6"]
    assert sorted(ids(pick(listed, "providers", "active", "PLUMB"))) == ["p2", "p4"]
    assert pick(listed).count() == 6


def test_review_queue(tables):
    people, sellers, _ = tables
    rows = {r["id"]: r for r in admin.review_queue(sellers, people).collect()}
    assert set(rows) == {"p3", "p5"}
    assert (rows["p3"]["area"], rows["p3"]["joined_date"]) == ("", datetime(2024, 5, 1))
    p5 = rows["p5"].asDict()
    assert p5 == {
        "id": "p5", "name": "Unknown", "category": "Cleaning", "area": "Not specified", "experience": 0,
        "phone": "Not provided", "email": "Not provided", "status": "pending", "joined_date": None,
        "id_proof_type": "Unknown ID", "id_proof_number": "-", "id_proof_url": None, "skills": [],
        "profile_photo": None, "about_bio": ""}


def test_platform_kpis(tables):
    people, sellers, jobs = tables
    rows = admin.platform_kpis(people, sellers, jobs).collect()
    assert {r["label"]: (r["amount"], r["value"], r["change"]) for r in rows} == {
        "Total Users": (6, "6", "Live from DB"), "Total Providers": (6, "6", "3 active"),
        "Total Bookings": (8, "8", "3 pending"), "Total Revenue": (250, "₹250", "Real-time")}
    empty = admin.platform_kpis(people.limit(0), sellers.limit(0), jobs.limit(0)).collect()
    assert {r["value"] for r in empty} == {"0", "₹0"}


def test_customer_history(tables):
    people, sellers, jobs = tables
    rows = B.customer_bookings(jobs, sellers, people, "c1").collect()
    assert [(r["id"], r["provider_name"], r["provider_phone"], r["provider_category"]) for r in rows] == [
        ("TF-2", "Fast Fixers 10%", "+91 8888888880", "Electrician"),
        ("TF-6", "No Profile", None, "Plumber"),
        ("TF-1", "Fast Fixers 10%", "+91 8888888880", "Electrician")]
    everyone = {r["id"]: r["provider_name"] for r in B.customer_bookings(jobs, sellers, people).collect()}
    assert len(everyone) == 8
    assert everyone["TF-3"] is None and everyone["TF-5"] == everyone["TF-7"] == "Unknown Service"


def test_work_list_puts_undated_first_and_masks(tables):
    people, _, jobs = tables
    work = B.provider_bookings(jobs, people, "p1")
    assert [(r["id"], r["customer_name"]) for r in work.collect()] == [
        ("TF-4", "Unknown"), ("TF-2", "Test Customer"), ("TF-1", "Test Customer"), ("TF-8", "Unknown")]
    masked = {r["id"]: r["customer_phone"] for r in B.masked_contacts(work).collect()}
    assert masked == {"TF-4": None, "TF-2": None, "TF-1": "+91 7777777770", "TF-8": None}
    assert B.provider_bookings(jobs, people).count() == 7


def test_ledger_orders(tables):
    people, sellers, jobs = tables
    assert ids(B.booking_ledger(jobs, sellers, people, ordered=True)) == [
        "TF-4", "TF-5", "TF-2", "TF-3", "TF-6", "TF-1", "TF-8", "TF-7"]
    assert ids(B.recent_bookings(jobs, sellers, people, 6)) == [
        "TF-2", "TF-3", "TF-6", "TF-1", "TF-8", "TF-7"]
    found = filters.search_bookings(B.booking_ledger(jobs, sellers, people), "fast fix")
    assert sorted(ids(found)) == ["TF-1", "TF-2", "TF-4", "TF-8"]


def test_recent_by_provider(tables):
    people, _, jobs = tables
    recent = B.recent_by_provider(jobs, people, n=2)
    assert {(r["provider_id"], r["id"], r["position"]) for r in recent.collect()} == {
        ("p1", "TF-4", 1), ("p1", "TF-2", 2), ("p2", "TF-3", 1), ("p4", "TF-6", 1), ("p9", "TF-7", 1)}
    one = B.recent_by_provider(jobs, people, "p1", 3).orderBy("position")
    assert ids(one) == ["TF-4", "TF-2", "TF-1"]
    assert {r["date_label"] for r in B.dashboard_cards(one, 1).collect()} == {"04/06/2024"}


def test_tabs_and_scopes(tables):
    _, _, jobs = tables
    counts = {r["customer_id"]: tuple(r)[1:] for r in B.booking_tab_counts(jobs).collect()}
    assert counts == {"c1": (3, 1, 2), "c2": (2, 1, 1), "gone": (1, 1, 0), None: (2, 2, 0)}
    assert tuple(B.booking_tab_counts(jobs, None).first()) == (8, 5, 3)
    assert filters.booking_tab(jobs, "ongoing").count() == 5
    assert filters.booking_tab(jobs, "all").count() == filters.filter_status(jobs).count() == 8
    assert filters.filter_status(jobs, "pending", "cancelled").count() == 4
    scope = filters.scope_bookings
    assert [scope(jobs, r, u).count() for r, u in [
        ("admin", None), ("customer", "c2"), ("provider", "p1"), ("stranger", "x")]] == [8, 2, 4, 0]


def test_stats_and_tiles(tables):
    _, sellers, _ = tables
    tiles = B.provider_tiles(B.provider_stats(sellers, ["p1", "p2"])).orderBy("id", "tile").collect()
    assert [(r["id"], r["value"], r["change"]) for r in tiles] == [
        ("p1", "3", "Lifetime jobs"), ("p1", "1", "Finished tasks"), ("p1", "₹0", "Current month"),
        ("p1", "4.9", "0 reviews"), ("p2", "0", "Lifetime jobs"), ("p2", "0", "Finished tasks"),
        ("p2", "₹0", "Current month"), ("p2", "0.0", "0 reviews")]


def test_rollups(tables):
    people, sellers, jobs = tables
    rebuilt = rollups.provider_rollup(jobs, "2024-06")
    rows = {r["provider_id"]: tuple(r)[1:] for r in rebuilt.collect()}
    assert rows["p1"] == (4, 1, Decimal(250), Decimal(5), 1)
    assert rows["p4"] == (1, 1, Decimal(0), Decimal(4), 1)
    assert rollups.provider_rollup(jobs, "2024-05").where("monthly_earnings <> 0").count() == 0
    drift = {r["id"]: r for r in rollups.counter_drift(sellers, rebuilt).collect()}
    pairs = {i: [tuple(float(r[f"{side}_{c}"]) for c in rollups.COUNTERS) for side in ("stored", "rebuilt")] for i, r in drift.items()}
    assert pairs == {
        "p1": [(3, 1, 0, 4.9, 0), (4, 1, 250, 5, 1)], "p2": [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0)],
        "p3": [(0, 0, 0, 4.9, 0), (0, 0, 0, 0, 0)], "p4": [(0, 0, 0, 4.1, 0), (1, 1, 0, 4, 1)]}
    jobs_only = rollups.counter_drift(sellers, rebuilt, ("total_jobs", "completed_jobs"))
    assert {r["id"]: tuple(r)[1:] for r in jobs_only.collect()} == {"p1": (3, 4, 1, 1), "p2": (0, 1, 0, 0), "p4": (0, 1, 0, 1)}
    totals = rollups.revenue_rollup(jobs, sellers, people)
    assert tuple(totals.where("level = 7").select("bookings", "revenue").first()) == (8, 250)
    assert totals.where("level = 0").agg(F.sum("bookings")).first()[0] == 8


def test_nonconforming(spark, tables):
    _, sellers, _ = tables
    odd = D.nonconforming(sellers, "category", dim_category(spark), "name")
    assert {(r["id"], r["value"]) for r in odd.collect()} == {("p3", "Painter"), ("p5", "Cleaning")}
    assert D.nonconforming(sellers, "areas_served", dim_area(spark), "name").count() == 0
    assert dim_category(spark).count() == 7 and dim_area(spark).count() == 9


def test_users(tables):
    people, _, _ = tables
    rows = {r["id"]: r for r in D.admin_users(people).collect()}
    assert rows["c2"]["name"] == "Solo" and rows["c2"]["contact"] == "solo@example.com"
    assert rows["p1"]["joined"] == "02/01/2024" and "password" not in rows["c2"].asDict()


def test_notifications(spark, tables):
    people, _, jobs = tables
    feed = N.notifications(B.provider_bookings(jobs, people))
    rows = {r["booking_id"]: r for r in feed.collect()}
    assert {b: r["id"] for b, r in rows.items() if r["provider_id"] == "p1"} == {
        "TF-4": 1000, "TF-2": 1001, "TF-1": 1002, "TF-8": 1003}
    assert (rows["TF-2"]["title"], rows["TF-2"]["message"], rows["TF-2"]["read"]) == (
        "New Booking Request", "Test Customer has requested Wiring on 2024-06-02 at 09:00 AM", False)
    assert rows["TF-8"]["message"] == "Unknown has requested a service on 2024-06-08 at 09:00 AM"
    assert (rows["TF-4"]["title"], rows["TF-4"]["message"], rows["TF-4"]["action_required"]) == (
        "Booking Accepted", "Booking TF-4 is currently accepted.", False)

    assert {r["provider_id"]: r["unread"] for r in N.unread_count(feed).collect()} == {
        "p1": 2, "p2": 0, "p4": 0, "p9": 1}
    assert N.unread_count(N.mark_read(feed), None).first()[0] == 0
    assert N.unread_count(N.mark_read(feed, [1001]), None).first()[0] == 2
    one = spark.createDataFrame([("p1", 1001), ("p2", 1000)], "provider_id string, id long")
    assert N.unread_count(N.mark_read(feed, one), None).first()[0] == 2

    others = spark.createDataFrame(
        [("p1", 5, "system", "Profile Verified", "ok", True), ("p1", 4, "review", "New Review", "ok", False),
         ("p1", 3, "status", "old", "old", False), ("p1", 1, "booking", "old", "old", False)],
        "provider_id string, id long, type string, title string, message string, read boolean")
    mixed = N.notifications(B.provider_bookings(jobs, people), others)
    tabs = {tab: filters.filter_notifications(mixed, tab).count() for tab in ("all", "bookings", "reviews", "system")}
    assert tabs == {"all": 9, "bookings": 7, "reviews": 1, "system": 1}

    answers = spark.createDataFrame(
        [(1, "p1", 1001, True), (2, "p9", 1000, False), (3, "p1", 77, True)],
        "event_id long, provider_id string, id long, accept boolean").withColumn("ts", F.current_timestamp())
    told = {r["booking_id"]: r["status"] for r in N.notification_events(answers, mixed).collect()}
    assert told == {"TF-2": "accepted", "TF-7": "cancelled"}
