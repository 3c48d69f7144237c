"""Parsing and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bazaarflow.schemas import NUMBER
from bazaarflow.texts import SLOT_FORMAT


def _digits(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9]", "")


def normalize_phone(phone: Column) -> Column:
    """Canonical ``+91 XXXXXXXXXX``; what cannot be canonical stays as it came; null becomes ''."""
    digits = _digits(phone)
    with_country_code = (F.length(digits) > 10) & digits.startswith("91")
    core = F.when(with_country_code, F.right(digits, F.lit(10))).otherwise(digits)
    return (
        F.when(phone.isNull() | (phone == ""), "")
        .when(F.length(core) == 10, F.concat(F.lit("+91 "), core))
        .otherwise(phone)
    )


def msisdn(phone: Column) -> Column:
    """Digits for the text-message gateway, country code included."""
    digits = _digits(normalize_phone(phone))
    return F.when(F.length(digits) == 10, F.concat(F.lit("91"), digits)).otherwise(digits)


def split_name(full_name: Column) -> tuple[Column, Column]:
    """First word and everything after the first space ('' when there is none)."""
    parts = F.split(full_name, " ", 2)
    rest = F.when(full_name.isNotNull(), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.get(parts, F.lit(0)), rest


def first_truthy(*columns: Column) -> Column:
    """First text that is neither null nor empty."""
    *fallible, last = columns
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in fallible], last)


def first_truthy_number(*columns: Column) -> Column:
    """First number that is neither null nor zero."""
    *fallible, last = columns
    return F.coalesce(*[F.nullif(c, F.lit(0).cast(NUMBER)) for c in fallible], last)


def js_number(text: Column) -> Column:
    """Text as a number: blank is 0, anything else that is not a number is null.

    The cast goes to decimal, because a cast to double would read '5d' as 5.
    """
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.lit(0).cast(NUMBER)).otherwise(trimmed.try_cast(NUMBER))


def is_unfit_number(text: Column) -> Column:
    """Whether a text is a number with more digits than NUMBER holds."""
    trimmed = F.trim(text)
    number = trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.coalesce(number & trimmed.try_cast(NUMBER).isNull(), F.lit(False))


def number_or_zero(text: Column) -> Column:
    """As ``js_number``, but what is not a number is 0; see ``is_unfit_number`` for what is too long."""
    return F.coalesce(js_number(text), F.lit(0).cast(NUMBER))


def parse_list(json_text: Column) -> Column:
    """A JSON-encoded list of strings; null or malformed text gives an empty list."""
    return F.coalesce(
        F.from_json(json_text, "array<string>"), F.array().cast("array<string>"))


def slot_minutes(slot: Column) -> Column:
    """Minutes after midnight of a 12-hour slot such as '09:00 AM', for ordering a day."""
    moment = F.try_to_timestamp(slot, F.lit(SLOT_FORMAT))
    return F.hour(moment) * 60 + F.minute(moment)
