"""Reusable row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions import booking_bucket, text_match

ALL_SERVICES = "All Services"
ALL_AREAS = "All Areas"


def active_only(providers: DataFrame) -> DataFrame:
    return providers.where(F.col("status") == "active")


def by_category(providers: DataFrame, category: str | None) -> DataFrame:
    if not category or category == ALL_SERVICES:
        return providers
    return providers.where(F.col("category") == category)


def by_emergency(providers: DataFrame, emergency: str | None) -> DataFrame:
    """Only the text 'true' filters, as the value comes from a query string."""
    return providers.where("emergency_available") if emergency == "true" else providers


def by_area(providers: DataFrame, area: str | None) -> DataFrame:
    """Exact area in the served list; a provider without a list is left out."""
    if not area or area == ALL_AREAS:
        return providers
    return providers.where(F.array_contains("areas_served", area))


def by_text(df: DataFrame, query: str | None, *columns: str) -> DataFrame:
    return df.where(text_match(query, *[F.col(c) for c in columns])) if query else df


def search_bookings(ledger: DataFrame, query: str | None) -> DataFrame:
    """Ledger rows whose id, customer name or provider name contains the text."""
    return by_text(ledger, query, "id", "customer_name", "provider_name")


def filter_status(df: DataFrame, *statuses: str) -> DataFrame:
    """Rows in one of the statuses; no statuses means all rows."""
    return df.where(F.col("status").isin(*statuses)) if statuses else df


def booking_tab(bookings: DataFrame, tab: str) -> DataFrame:
    """A customer's tab: 'ongoing' or 'completed'; any other name shows everything."""
    if tab not in ("ongoing", "completed"):
        return bookings
    return bookings.where(booking_bucket(F.col("status")) == tab)


def admin_providers(
    provider_list: DataFrame, view: str = "providers", status: str = "all", query: str | None = None,
) -> DataFrame:
    """The admin's provider screens over the admin provider list.

    'verification' shows pending providers, 'rejected' the turned-down ones whatever status is
    asked for, 'providers' all of them.
    """
    rows = provider_list
    if view == "verification":
        rows = filter_status(rows, "pending")
    if view == "rejected":
        rows = filter_status(rows, "suspended", "rejected")
    elif status != "all":
        rows = filter_status(rows, status)
    return by_text(rows, query, "name", "category")


_NOTIFICATION_TABS = {"bookings": "booking", "reviews": "review"}


def filter_notifications(notifications: DataFrame, tab: str = "all") -> DataFrame:
    """'all', 'bookings', 'reviews'; any other tab shows system messages."""
    if tab == "all":
        return notifications
    return notifications.where(F.col("type") == _NOTIFICATION_TABS.get(tab, "system"))


def lookup(df: DataFrame, key: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose ``key`` is listed, or present in a DataFrame that has a column of that name."""
    if isinstance(values, DataFrame):
        return df.join(values.select(key), key, "left_semi")
    return df.where(F.col(key).isin(list(values)))


def scope_bookings(bookings: DataFrame, role: str, user_id: str | None = None) -> DataFrame:
    """A customer sees own bookings, a provider own jobs, an admin everything, others nothing."""
    if role == "admin":
        return bookings
    owner = {"customer": "customer_id", "provider": "provider_id"}.get(role)
    if owner is None:
        return bookings.where(F.lit(False))
    return bookings.where(F.col(owner) == user_id)
