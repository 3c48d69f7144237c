"""Requests, events, onboarding, quality rules and loads over golden rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import lifecycle as L, onboarding as O, quality as Q
from bazaarflow.schemas import BOOKING_REQUESTS, BOOKING_STATUSES
from bazaarflow.sources.loads import insert_children, insert_if_absent
from tests import golden

T0 = datetime(2024, 7, 1)
STATUS = "event_id long, booking_id string, status string, ts timestamp"
LONG_ADDRESS = "x" * 30


def request(number, **changes):
    row = dict(request_id=number, customer_id="c1", role="customer", provider_id="p1",
               booking_date=date(2024, 7, 2), booking_time="10:00 AM", description="Fan",
               address=LONG_ADDRESS, is_emergency=None, ts=T0)
    return {**row, **changes}


@pytest.fixture(scope="module")
def requests(spark):
    return golden.table(spark, BOOKING_REQUESTS, [
        request(1), request(2, role="provider", address=None), request(3, role=None),
        request(4, provider_id=""), request(5, booking_date=None), request(6, booking_time=None),
        request(7, description=""), request(8, address=None), request(9, address="x" * 29),
        request(10, provider_id="nobody"), request(11, provider_id="nobody", address="short"),
        request(12, provider_id="p6", is_emergency=True), request(13, provider_id="p4"),
    ])


def test_request_screening(spark, requests):
    screened = L.screen_requests(requests, golden.providers(spark), golden.profiles(spark))
    reasons = {r["request_id"]: r["reason"] for r in screened.collect()}
    assert reasons == {
        1: None, 2: "not_a_customer", 3: "not_a_customer", 4: "missing_field", 5: "missing_field",
        6: "missing_field", 7: "missing_field", 8: "missing_field", 9: "address_too_short",
        10: "provider_not_found", 11: "address_too_short", 12: None, 13: None}


def test_accepted_bookings(spark, requests):
    accepted, rejected = L.accept_bookings(requests, golden.providers(spark), golden.profiles(spark))
    rows = {r["id"]: r for r in accepted.collect()}
    assert accepted.count() + rejected.count() == requests.count()
    assert set(rows) == {"TF-100001", "TF-100012", "TF-100013"}
    first = rows["TF-100001"]
    assert (first["status"], first["price"], first["is_emergency"], first["provider_phone"]) == (
        "pending", 150, False, "+91 8888888880")
    assert rows["TF-100012"]["is_emergency"] and rows["TF-100013"]["provider_phone"] is None
    strict = L.accept_bookings(requests, golden.providers(spark), golden.profiles(spark), strict=True)
    assert {r["request_id"] for r in strict.rejected.where("reason = 'provider_inactive'").collect()} == {12}


def status_events(spark):
    return spark.createDataFrame([
        (1, "TF-2", "accepted", T0), (2, "TF-2", "completed", T0 + timedelta(hours=2)),
        (3, "TF-2", "in-progress", T0 + timedelta(hours=1)),      # arrives late
        (4, "TF-2", "completed", T0 + timedelta(hours=3)),         # sent again
        (5, "TF-1", "rejected", T0 + timedelta(hours=9)), (6, "TF-1", None, T0),
        (7, "none", "completed", T0), (8, "TF-6", "completed", T0),
        (9, "TF-3", "pending", T0), (10, "TF-3", "accepted", T0),  # same time: the id decides
        (11, "TF-5", "completed", T0),                             # booking without a provider
    ], STATUS)


def test_apply_status(spark):
    folded = L.apply_status(golden.bookings(spark), status_events(spark))
    rows = {r["id"]: (r["status"], r["updated_at"]) for r in folded.rows.collect()}
    assert rows["TF-2"] == ("completed", T0 + timedelta(hours=3))
    assert rows["TF-3"] == ("accepted", T0) and rows["TF-1"] == ("completed", None)
    assert rows["TF-4"] == ("accepted", None) and len(rows) == 8
    assert folded.rows.columns and set(folded.rows.columns) == set(golden.bookings(spark).columns)
    assert [r["event_id"] for r in folded.unmatched.collect()] == [7]
    assert sorted(r["event_id"] for r in folded.invalid.collect()) == [5, 6]


def test_status_does_not_depend_on_arrival(spark):
    chance = random.Random(5)
    made = [(i, f"TF-{chance.randrange(1, 9)}", chance.choice(BOOKING_STATUSES),
             T0 + timedelta(minutes=chance.randrange(50))) for i in range(400)]
    folded = []
    for _ in range(2):
        chance.shuffle(made)
        rows = L.apply_status(golden.bookings(spark), spark.createDataFrame(made, STATUS)).rows
        folded.append(sorted(tuple(r) for r in rows.select("id", "status", "updated_at").collect()))
    assert folded[0] == folded[1]


def test_completions(spark):
    jobs, events = golden.bookings(spark), status_events(spark)
    count = L.completion_counts
    assert {tuple(r) for r in count(events, jobs).collect()} == {("p1", 2), ("p4", 1)}
    assert {tuple(r) for r in count(events, jobs, distinct_bookings=True).collect()} == {("p1", 1), ("p4", 1)}
    after = L.apply_completions(golden.providers(spark), count(events, jobs))
    done = {r["id"]: r["completed_jobs"] for r in after.collect()}
    assert (done["p1"], done["p4"], done["p2"]) == (3, 1, None)


def test_owner_rules(spark):
    events = spark.createDataFrame([
        (1, "TF-1", "cancelled", T0, "p1"), (2, "TF-2", "cancelled", T0, "stranger")],
        STATUS + ", actor_id string")
    folded = L.apply_status(golden.bookings(spark), events, enforce_owner=True)
    status = {r["id"]: r["status"] for r in folded.rows.collect()}
    assert (status["TF-1"], status["TF-2"]) == ("cancelled", "pending")
    assert [r["event_id"] for r in folded.foreign.collect()] == [2]


@pytest.mark.parametrize("enforce", [False, True])
def test_every_event_is_accounted_for(spark, enforce):
    """Effective, superseded or listed: no event is lost, and none is listed twice."""
    chance = random.Random(3)
    rows = [(i, chance.choice(["TF-1", "TF-2", "TF-5", "TF-8", "none"]),
             chance.choice(["pending", "accepted", "rejected", None]), T0 + timedelta(minutes=chance.randrange(50)),
             chance.choice(["p1", "p2", None])) for i in range(200)]
    events = spark.createDataFrame(rows, STATUS + ", actor_id string")
    folded = L.apply_status(golden.bookings(spark), events, enforce_owner=enforce)
    listed = [r["event_id"] for part in (folded.unmatched, folded.invalid, folded.foreign) for r in part.collect()]
    owners = {r["id"]: r["provider_id"] for r in golden.bookings(spark).collect()}
    counted = [r for r in rows if r[1] in owners and r[2] in ("pending", "accepted")
               and (not enforce or (r[4] is not None and r[4] == owners[r[1]]))]
    assert len(listed) == len(set(listed))
    assert sorted([*listed, *[r[0] for r in counted]]) == list(range(200))


def test_long_numbers(spark):
    events = spark.createDataFrame([(1, "TF-1", "9" * 29, "x", T0), (2, "TF-2", "12345678901.5", "y", T0)],
                                   "event_id long, booking_id string, rating string, review string, ts timestamp")
    folded = L.apply_ratings(golden.bookings(spark), events)
    rows = {r["id"]: r["rating"] for r in folded.rows.collect()}
    assert rows["TF-1"] == 5 and rows["TF-2"] == Decimal("12345678901.5")
    assert [r["event_id"] for r in folded.invalid.collect()] == [1]
    apps = spark.createDataFrame(
        [(1, "A", "6000000001", "99999", "[]", "[]", "12345678901.5"), (2, "B", "6000000002", "9" * 40, "[]", "[]", "1")],
        "app_id long, full_name string, phone string, experience string, categories string, areas_served string, price_min string")
    onboarded = O.onboard_providers(apps, golden.profiles(spark))
    row = onboarded.providers.first()
    assert (row["experience"], row["base_price"]) == (99999, Decimal("12345678901.5"))
    assert [(r["app_id"], r["reason"]) for r in onboarded.rejected.collect()] == [(2, "number_too_long")]


def test_ratings(spark):
    events = spark.createDataFrame([
        (1, "TF-1", "3", "ok", T0), (2, "TF-1", "4.5", "better", T0 + timedelta(1)),
        (3, "TF-6", "n/a", None, T0), (4, "TF-2", "9", "", T0), (5, "none", "5", "x", T0)],
        "event_id long, booking_id string, rating string, review string, ts timestamp")
    folded = L.apply_ratings(golden.bookings(spark), events)
    rows = {r["id"]: (r["rating"], r["review_text"]) for r in folded.rows.collect()}
    assert rows["TF-1"] == (Decimal("4.5"), "better") and rows["TF-6"] == (None, None)
    assert rows["TF-2"] == (9, "") and rows["TF-3"] == (None, None)
    assert folded.unmatched.count() == 1 and folded.invalid.count() == 0


def test_provider_approval(spark):
    events = spark.createDataFrame([
        (1, "p3", "active", T0), (2, "p1", "suspended", T0), (3, "p5", "rejected", T0), (4, "none", "active", T0)],
        "event_id long, provider_id string, status string, ts timestamp")
    folded = L.apply_provider_status(golden.providers(spark), events)
    rows = {r["id"]: (r["status"], r["verified"]) for r in folded.rows.collect()}
    assert rows["p3"] == ("active", True) and rows["p1"] == ("suspended", False)
    assert rows["p5"] == ("pending", None)
    assert folded.unmatched.first()["event_id"] == 4 and folded.invalid.first()["event_id"] == 3


def test_customer_registration(spark):
    apps = spark.createDataFrame([
        (1, "A", "B", "7777777770", "x"), (2, "C", "D", "91-6000000001", "x"),
        (3, "E", "F", "6000000001", "x"), (4, "G", "H", None, "x"), (5, "I", "J", "", "x"),
        (6, "K", "L", "12345", "x")],
        "app_id long, first_name string, last_name string, phone string, area string")
    made = O.register_customers(apps, golden.profiles(spark))
    assert {(r["id"], r["phone"], r["role"], r["phone_verified"]) for r in made.profiles.collect()} == {
        ("CA-2", "+91 6000000001", "customer", True), ("CA-6", "12345", "customer", True)}
    # '' is a phone value too, and one profile already holds it.
    assert {r["app_id"] for r in made.rejected.collect()} == {1, 3, 4, 5}


def test_existing_accounts(spark):
    apps = spark.createDataFrame([("7777777770", "customer"), ("7777777770", "provider"), ("1", "customer")],
                                 "phone string, role string")
    assert O.existing_accounts(apps, golden.profiles(spark)).count() == 2
    assert O.existing_accounts(apps, golden.profiles(spark), same_role=True).count() == 1


@pytest.fixture(scope="module")
def applications(spark):
    both = '["Plumber","Painting"]'
    return spark.createDataFrame([
        (1, "Ann B  C", "6000000001", "5", both, '["Puthur"]', "100", "/a.png", T0),
        (2, "Late", "+916000000001", "1", both, "[]", "1", None, T0 + timedelta(1)),
        (3, "Upgraded One", "7777777770", "five", "[]", "bad", "x", None, T0),
        (4, "Again", "8888888880", "5", both, "[]", "1", None, T0),
        (5, "Boss", "9999999990", "5", both, "[]", "1", None, T0),
        (6, None, "6000000002", "5", both, "[]", "1", None, T0),
        (7, "Second", "6000000002", None, "Plumber", None, None, None, T0 + timedelta(2)),
        (8, None, "8888888880", "5", both, "[]", "1", None, T0),
    ], "app_id long, full_name string, phone string, experience string, categories string, "
       "areas_served string, price_min string, profile_photo_url string, ts timestamp")


def test_onboarding(spark, applications):
    people = golden.profiles(spark)
    done = O.onboard_providers(applications, people)
    new = {r["id"]: r for r in done.new_profiles.collect()}
    assert set(new) == {"PA-1", "PA-7"}
    assert (new["PA-1"]["first_name"], new["PA-1"]["last_name"]) == ("Ann", "B  C")
    upgraded = done.upgraded_profiles.collect()
    assert [(r["id"], r["first_name"], r["last_name"]) for r in upgraded] == [("c1", "Upgraded", "One")]
    rows = {r["id"]: r for r in done.providers.collect()}
    assert set(rows) == {"PA-1", "PA-7", "c1"}
    assert (rows["PA-1"]["category"], rows["PA-1"]["skills"], rows["PA-1"]["areas_served"]) == (
        "Plumber", ["Plumber", "Painting"], ["Puthur"])
    assert (rows["c1"]["category"], rows["c1"]["experience"], rows["c1"]["base_price"], rows["c1"]["areas_served"]) == (
        "General", 0, 0, [])
    assert rows["PA-7"]["category"] == "General" and {r["status"] for r in rows.values()} == {"pending"}
    assert {r["app_id"]: r["reason"] for r in done.rejected.collect()} == {
        2: "already_provider", 4: "already_provider", 5: "admin_phone", 6: "missing_name",
        8: "already_provider"}
    assert done.providers.count() + done.rejected.count() == applications.count()

    merged = {r["id"]: r for r in O.merge_profiles(people, done).collect()}
    assert len(merged) == people.count() + 2
    assert merged["c1"]["role"] == "provider" and merged["c1"]["area"] == "KK Nagar"
    assert merged["a1"]["role"] == "admin"


def test_onboarding_the_same_batch_again_adds_nothing(spark, applications):
    people = golden.profiles(spark)
    merged = O.merge_profiles(people, O.onboard_providers(applications, people))
    again = O.onboard_providers(applications, merged)
    assert again.providers.count() == 0


def test_application_issues(spark):
    rows = spark.createDataFrame([
        (1, "A", "6", True, True, '["x"]', True, "Passport", 10, 10),
        (2, "", None, None, False, "[]", None, "", None, 4_000_000),
        (3, "A", "6", True, True, '["x"]', True, "Passport", 3 * 1024 * 1024, 3 * 1024 * 1024 + 1)],
        "app_id long, full_name string, phone string, password_given boolean, otp_verified boolean, "
        "categories string, agree_terms boolean, id_proof_type string, id_proof_bytes long, photo_bytes long")
    assert {r["app_id"]: r["issues"] for r in O.application_issues(rows).collect()} == {
        1: [], 3: ["photo_size"],
        2: ["name", "phone", "password", "otp", "category", "terms", "id_proof_type", "id_proof_file", "photo_size"]}


def test_quality_rules(spark):
    people, sellers, jobs = golden.profiles(spark), golden.providers(spark), golden.bookings(spark)
    found = {r["rule"]: r["violations"] for r in Q.table_report(people, sellers, jobs).collect()}
    assert {k: v for k, v in found.items() if v} == {
        "providers.id references profiles": 3, "bookings.customer_id references profiles": 1,
        "bookings.provider_id references providers": 1}
    doubled = people.unionByName(people.where("id in ('c1', 'c2')")).withColumn(
        "role", F.when(F.col("id") == "a1", "owner").otherwise(F.col("role")))
    assert [tuple(r) for r in Q.duplicate_keys(doubled, "phone").collect()] == [("+91 7777777770", 2)]
    assert Q.enum_violations(doubled, "profiles").count() == 1
    typed = people.withColumn("phone", F.regexp_replace("phone", " ", ""))
    assert Q.phone_not_canonical(typed).count() == 4


def test_transition_audit(spark):
    events = spark.createDataFrame([
        (1, "b", "pending", T0), (2, "b", "accepted", T0), (3, "b", "completed", T0 + timedelta(1)),
        (4, "c", "completed", T0), (5, "c", "completed", T0 + timedelta(1)), (6, "d", None, T0),
        (7, "d", "pending", T0 + timedelta(1))], STATUS)
    assert {(r["event_id"], r["previous_status"]) for r in Q.transition_audit(events).collect()} == {
        (3, "accepted"), (5, "completed"), (7, None)}


def test_loading_twice_inserts_once(spark):
    target = spark.createDataFrame([("1", "a")], "id string, phone string")
    batch = spark.createDataFrame(
        [("2", "b"), ("3", "b"), ("4", "a"), ("5", None), ("6", None)], "id string, phone string")
    inserted = insert_if_absent(target, batch, ["phone"], [F.col("id")])
    assert sorted(r["id"] for r in inserted.collect()) == ["2", "5", "6"]
    again = insert_if_absent(target.unionByName(inserted), batch.where("phone is not null"), ["phone"])
    assert again.count() == 0
    details = spark.createDataFrame([("b", "Shop"), ("z", "Other")], "phone string, business_name string")
    assert [tuple(r) for r in insert_children(inserted, details).collect()] == [("2", "Shop")]
