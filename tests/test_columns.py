from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarflow import functions as C


def one(spark, schema, value, column):
    """The column's value over one row whose cell ``c`` is ``value``."""
    return spark.createDataFrame([(value,)], f"c {schema}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("phone, expected", [
    (None, ""), ("", ""),
    ("98765 43210", "+91 9876543210"),
    ("+919876543210", "+91 9876543210"),
    ("91-9876543210", "+91 9876543210"),
    ("+91 9876543210", "+91 9876543210"),
    ("12345", "12345"),
    ("12345678901", "12345678901"),
    ("9198765432101234", "+91 5432101234"),
    ("call me", "call me"),
])
def test_normalize_phone(spark, phone, expected):
    assert one(spark, "string", phone, C.normalize_phone(F.col("c"))) == expected


@pytest.mark.parametrize("phone, expected", [
    ("98765 43210", "919876543210"), ("12345", "12345"), (None, ""), ("call", ""),
])
def test_msisdn(spark, phone, expected):
    assert one(spark, "string", phone, C.msisdn(F.col("c"))) == expected


@pytest.mark.parametrize("name, expected", [
    ("Ann", ("Ann", "")), ("Ann B  C", ("Ann", "B  C")), ("", ("", "")), (" Ann", ("", "Ann")),
    (None, (None, None)),
])
def test_split_name(spark, name, expected):
    first, last = C.split_name(F.col("c"))
    row = spark.createDataFrame([(name,)], "c string").select(first.alias("a"), last.alias("b")).first()
    assert tuple(row) == expected


def test_display_name(spark):
    rows = spark.createDataFrame(
        [("A", "B", True), ("A", None, True), (None, None, False)], "f string, l string, p boolean")
    shown = rows.select(C.display_name(F.col("f"), F.col("l"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in shown] == ["A B", "A", "Unknown"]


@pytest.mark.parametrize("areas, own, queue, listed", [
    (None, None, "Not specified", "Not specified"),
    (None, "", "Not specified", "Not specified"),
    (None, "Puthur", "Puthur", "Not specified"),
    ([], "Puthur", "", "Not specified"),
    (["a"], "Puthur", "a", "a"),
    (["a", None, "b"], None, "a, , b", "a, , b"),
])
def test_area_labels(spark, areas, own, queue, listed):
    row = spark.createDataFrame([(areas, own)], "a array<string>, p string").select(
        C.area_label_queue(F.col("a"), F.col("p")).alias("q"),
        C.area_label_list(F.col("a")).alias("l")).first()
    assert tuple(row) == (queue, listed)


@pytest.mark.parametrize("text, expected", [
    ("5", 5), ("5d", None), (" 4.5 ", Decimal("4.5")), ("", 0), ("n/a", None), (None, None), ("1e2", 100),
])
def test_js_number(spark, text, expected):
    assert one(spark, "string", text, C.js_number(F.col("c"))) == expected
    assert one(spark, "string", text, C.number_or_zero(F.col("c"))) == (expected or 0)


@pytest.mark.parametrize("text, expected", [
    ('["a","b"]', ["a", "b"]), ("[]", []), ("Plumber", []), (None, []), ('{"a":1}', []), ("", []),
])
def test_parse_list(spark, text, expected):
    assert one(spark, "string", text, C.parse_list(F.col("c"))) == expected


@pytest.mark.parametrize("amount, expected", [
    ("1234.50", "₹1,234.5"), ("0", "₹0"), ("1234567.25", "₹1,234,567.25"), ("12", "₹12"),
])
def test_money_label(spark, amount, expected):
    assert one(spark, "decimal(14,2)", Decimal(amount), C.money_label(F.col("c"))) == expected


@pytest.mark.parametrize("status, label, tab, phone", [
    ("cancelled", "Rejected due to unavailability", "completed", None),
    ("in-progress", "In-progress", "ongoing", "1"),
    ("pending", "Pending", "ongoing", None),
    ("accepted", "Accepted", "ongoing", "1"),
    ("completed", "Completed", "completed", "1"),
    ("odd", "Odd", None, None),
])
def test_status_columns(spark, status, label, tab, phone):
    row = spark.createDataFrame([(status,)], "c string").select(
        C.status_label(F.col("c")).alias("l"), C.booking_bucket(F.col("c")).alias("b"),
        C.mask_contact(F.lit("1"), F.col("c")).alias("m")).first()
    assert tuple(row) == (label, tab, phone)


def test_small_labels(spark):
    row = spark.range(1).select(
        C.capitalize(F.lit("in-progress")).alias("capital"),
        C.date_label(F.lit(date(2024, 3, 9))).alias("day"),
        C.initial(F.lit("ravi")).alias("initial"), C.initial(F.lit("")).alias("none"),
        C.contact(F.lit(""), F.lit("a@b")).alias("contact"),
        C.user_name(F.lit(None).cast("string"), F.lit("B")).alias("name"),
        C.asset_path(F.lit("proofs"), F.lit("u1"), F.lit(datetime(1970, 1, 1, 0, 0, 1)),
                     F.lit("my id (1).png")).alias("path"),
        C.slot_minutes(F.lit("01:30 PM")).alias("slot"), C.slot_minutes(F.lit("soon")).alias("no_slot"),
    ).first()
    assert row.asDict() == {
        "capital": "In-progress", "day": "09/03/2024", "initial": "R", "none": "?",
        "contact": "a@b", "name": "B", "path": "proofs/u1/1000-myid1.png", "slot": 810,
        "no_slot": None}


@pytest.mark.parametrize("query, expected", [
    ("10%", ["10% off"]), ("_", ["a_b"]), ("PLUMB", ["Plumbers", "pLUMBing"]), ("zzz", []),
])
def test_text_match_is_literal(spark, query, expected):
    names = ["10% off", "10 off", "a_b", "axb", "Plumbers", "pLUMBing", None]
    rows = spark.createDataFrame([(n, None) for n in names], "a string, b string")
    found = rows.where(C.text_match(query, F.col("a"), F.col("b"))).collect()
    assert sorted(r["a"] for r in found) == sorted(expected)


def test_first_truthy(spark):
    row = spark.createDataFrame([(None, "", "x", Decimal(0))], "a string, b string, c string, n decimal(12,2)").select(
        C.first_truthy(F.col("a"), F.col("b"), F.col("c")).alias("t"),
        C.first_truthy_number(F.col("n"), F.lit(7)).alias("n")).first()
    assert row["t"] == "x" and row["n"] == 7
