"""Code matching against a one-by-one replay."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from bazaarflow.operators.codes import match_codes

START = datetime(2024, 1, 1)
EVENT = "event_id long, phone string, code string, purpose string, ts timestamp"


def replay(issues, attempts, kind="verify", accounts=None):
    """Outcome per attempt, walking all events in time order with a map of held codes."""
    held, outcome = {}, {}

    def canonical(phone):
        return f"+91 {phone[-10:]}"

    timeline = [(i[4], i[0], 0, i) for i in issues] + [(a[4], a[0], 1, a) for a in attempts]
    for ts, event, is_attempt, (_, raw, code, purpose, _) in sorted(timeline, key=lambda e: e[:3]):
        phone = canonical(raw)
        if not is_attempt:
            held[phone] = (ts, code, purpose)
            continue
        entry = held.get(phone)
        if entry is None:
            outcome[event] = "not_requested"
        elif ts > entry[0] + timedelta(minutes=5):
            outcome[event] = "expired"
            if kind == "verify" and raw == phone:
                del held[phone]
        elif code != entry[1]:
            outcome[event] = "invalid"
        elif kind == "verify" and entry[2] and entry[2] != purpose:
            outcome[event] = "purpose_mismatch"
        elif kind == "reset" and entry[2] != "forgot_password":
            outcome[event] = "purpose_mismatch"
        elif kind == "reset" and phone not in accounts:
            outcome[event] = "no_account"
        else:
            outcome[event] = "ok"
            del held[phone]
    return outcome


def random_events(seed, n=3000):
    """Issues and attempts with one phone in a third of the events."""
    chance = random.Random(seed)
    issues, attempts = [], []
    for event in range(n):
        number = 0 if chance.random() < 0.34 else chance.randrange(1, 30)
        phone = f"{chance.choice(['+91 ', '+91', ''])}{9000000000 + number}"
        row = (event, phone, str(chance.randrange(3)),
               chance.choice(["login", "register", "forgot_password", None, ""]),
               START + timedelta(seconds=event * 20 + chance.randrange(40)))
        (issues if chance.random() < 0.3 else attempts).append(row)
    return issues, attempts


@pytest.mark.parametrize("kind", ["verify", "login", "reset"])
def test_matches_a_replay(spark, kind):
    issues, attempts = random_events(3)
    accounts = {f"+91 {9000000000 + n}" for n in range(0, 30, 2)}
    got = match_codes(
        spark.createDataFrame(issues, EVENT), spark.createDataFrame(attempts, EVENT), kind=kind,
        profiles=spark.createDataFrame([(p,) for p in sorted(accounts)], "phone string"))
    expected = replay(issues, attempts, kind, accounts)
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == expected
    assert len(set(expected.values())) >= 4


def test_edges(spark):
    phone, other = "+91 9000000001", "+91 9000000002"

    def at(seconds):
        return START + timedelta(seconds=seconds)

    issues = [(1, phone, "11", "login", at(0)), (6, phone, "22", "login", at(700)),
              (20, other, "33", "register", at(0))]
    attempts = [
        (2, "9000000001", "99", "login", at(10)),      # wrong code does not use it up
        (3, "+919000000001", "11", "login", at(300)),  # exactly at expiry, other spelling
        (4, phone, "11", "login", at(301)),            # already used
        (5, phone, "11", "login", at(690)),            # used wins over expired
        (7, phone, "11", "login", at(701)),            # the reissue replaced the code
        (8, phone, "22", "other", at(702)),            # wrong purpose does not use it up
        (9, phone, "22", "login", at(1000)),
        (21, other, "33", "register", at(300) + timedelta(microseconds=1)),
        (22, "+91 9000000003", "1", "login", at(1)),
        (23, other, None, "register", at(1)),
    ]
    got = match_codes(spark.createDataFrame(issues, EVENT), spark.createDataFrame(attempts, EVENT))
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == {
        2: "invalid", 3: "ok", 4: "not_requested", 5: "not_requested", 7: "invalid",
        8: "purpose_mismatch", 9: "ok", 21: "expired", 22: "not_requested", 23: "invalid"}


def test_mixed_kinds(spark):
    phone = "+91 9000000001"
    issues = [(1, phone, "11", "register", START), (4, phone, "22", "forgot_password", START + timedelta(seconds=9))]
    attempts = spark.createDataFrame([
        (2, phone, "11", None, START + timedelta(seconds=1), "reset"),
        (3, phone, "11", None, START + timedelta(seconds=2), "login"),
        (5, phone, "22", None, START + timedelta(seconds=10), "reset"),
    ], EVENT + ", kind string")
    got = match_codes(spark.createDataFrame(issues, EVENT), attempts,
                      profiles=spark.createDataFrame([(phone,)], "phone string"))
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == {
        2: "purpose_mismatch", 3: "ok", 5: "ok"}
