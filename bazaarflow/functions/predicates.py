"""Conditions shared by several views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from bazaarflow.schemas import CLOSED_STATUSES, CONTACT_STATUSES, ONGOING_STATUSES


def text_match(query: str, *columns: Column) -> Column:
    """Case-insensitive literal substring in any column; never LIKE, so % and _ mean themselves."""
    needle = F.lower(F.lit(query))
    hits = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def booking_bucket(status: Column) -> Column:
    """The customer's tab a booking falls in; null for a status outside both tabs."""
    return F.when(status.isin(*ONGOING_STATUSES), "ongoing").when(
        status.isin(*CLOSED_STATUSES), "completed")


def mask_contact(phone: Column, status: Column) -> Column:
    """The customer's phone, shown only once the provider has taken the job."""
    return F.when(status.isin(*CONTACT_STATUSES), phone)
