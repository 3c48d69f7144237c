"""Booking histories, work lists, ledger and dashboard cards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow import texts
from bazaarflow.functions import (
    booking_bucket, date_label, display_name, mask_contact, money_label, status_label,
)
from bazaarflow.operators.directory import with_profile
from bazaarflow.operators.filters import lookup, scope_bookings
from bazaarflow.operators.latest import top_per_key
from bazaarflow.operators.skew import sliced_left_join

BOOKING_FIELDS = (
    "id", "customer_id", "provider_id", "booking_date", "booking_time", "description",
    "address", "is_emergency", "status", "price", "rating", "review_text", "created_at",
)


def newest_first() -> list[Column]:
    """Database order: undated bookings come first."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def newest_first_undated_last() -> list[Column]:
    """The KPI screen's order: an undated booking counts as the oldest."""
    return [F.col("created_at").desc_nulls_last(), F.col("id").asc()]


def join_provider(bookings: DataFrame, providers: DataFrame, sliced: bool = False) -> DataFrame:
    """Bookings with ``provider_business_name`` and ``provider_category`` (null-safe presence).

    ``providers`` is unique on id. Its size is left to Spark: it is broadcast when small, and
    in a sort-merge join of two tables AQE splits the partition of a hot provider. ``sliced``
    is for providers that come from a join on their id, where AQE does not.
    """
    extra = [c for c in ("profile_phone",) if c in providers.columns]
    side = providers.select(
        F.col("id").alias("_provider_key"), F.col("business_name").alias("provider_business_name"),
        F.col("category").alias("provider_category"), *extra)
    if sliced:
        joined = sliced_left_join(bookings, side, "provider_id", "_provider_key", "id")
    else:
        joined = bookings.join(side, F.col("provider_id") == F.col("_provider_key"), "left")
    return joined.withColumn("has_provider", F.col("_provider_key").isNotNull()).drop("_provider_key")


def join_customer(bookings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bookings with ``customer_name`` and ``customer_phone``; ``profiles`` is unique on id."""
    side = profiles.select(
        F.col("id").alias("_customer_key"), F.col("first_name").alias("_first"),
        F.col("last_name").alias("_last"), F.col("phone").alias("customer_phone"))
    joined = bookings.join(side, F.col("customer_id") == F.col("_customer_key"), "left")
    name = display_name(F.col("_first"), F.col("_last"), F.col("_customer_key").isNotNull())
    return joined.withColumn("customer_name", name).drop("_customer_key", "_first", "_last")


def _booking_columns(df: DataFrame) -> list[Column]:
    renamed = {"booking_date": "date", "booking_time": "time"}
    return [F.col(c).alias(renamed.get(c, c)) for c in BOOKING_FIELDS if c in df.columns]


def customer_bookings(
    bookings: DataFrame, providers: DataFrame, profiles: DataFrame,
    customer_id: str | None = None, ordered: bool | None = None,
) -> DataFrame:
    """Customer histories with the provider's name, category and phone.

    One customer's history comes newest first; all histories are sorted only on request.

    Providers meet their profiles first: both are unique on id, so the bookings are joined, and
    shuffled, once.
    """
    own = bookings if customer_id is None else scope_bookings(bookings, "customer", customer_id)
    rows = join_provider(own, with_profile(providers, profiles, "phone"), sliced=customer_id is None)
    if ordered or (ordered is None and customer_id is not None):
        rows = rows.orderBy("customer_id", *newest_first())
    return rows.select(
        *_booking_columns(rows),
        F.when(F.col("has_provider"), F.col("provider_business_name"))
        .otherwise(texts.UNKNOWN_SERVICE).alias("provider_name"),
        F.col("profile_phone").alias("provider_phone"), "provider_category",
        status_label(F.col("status")).alias("status_label"),
        booking_bucket(F.col("status")).alias("tab"),
    )


def provider_bookings(
    bookings: DataFrame, profiles: DataFrame, provider_id: str | None = None, ordered: bool | None = None,
) -> DataFrame:
    """Work lists with the customer's name and phone; one provider's comes newest first.

    All work lists together are sorted only on request.
    """
    own = (
        bookings.where(F.col("provider_id").isNotNull()) if provider_id is None
        else scope_bookings(bookings, "provider", provider_id))
    rows = join_customer(own, profiles)
    if ordered or (ordered is None and provider_id is not None):
        rows = rows.orderBy("provider_id", *newest_first())
    return rows.select(*_booking_columns(rows), "customer_name", "customer_phone")


def masked_contacts(work_list: DataFrame) -> DataFrame:
    """A work list as the provider may see it: no phone before the job is accepted."""
    return work_list.withColumn(
        "customer_phone", mask_contact(F.col("customer_phone"), F.col("status")))


def booking_ledger(
    bookings: DataFrame, providers: DataFrame, profiles: DataFrame, ordered: bool = False,
) -> DataFrame:
    """All bookings with customer and provider names, newest first on request."""
    rows = join_provider(join_customer(bookings, profiles), providers)
    if ordered:
        rows = rows.orderBy(*newest_first())
    return rows.select(*_booking_columns(rows), "customer_name", _provider_name())


def _provider_name() -> Column:
    return F.when(F.col("has_provider"), F.col("provider_business_name")).otherwise(
        texts.UNKNOWN).alias("provider_name")


def recent_bookings(
    bookings: DataFrame, providers: DataFrame, profiles: DataFrame, n: int = 8,
) -> DataFrame:
    """The newest ``n`` bookings of the platform; names are joined to those ``n`` rows only."""
    newest = bookings.orderBy(*newest_first_undated_last()).limit(n)
    rows = join_provider(join_customer(newest, profiles), providers).orderBy(
        *newest_first_undated_last())
    return rows.select(*_booking_columns(rows), "customer_name", _provider_name())


def recent_by_provider(
    bookings: DataFrame, profiles: DataFrame, provider_id: str | None = None, n: int = 10,
) -> DataFrame:
    """Each provider's newest ``n`` bookings with customer contact, numbered from 1.

    The pick comes before the join, so at most ``n`` rows per provider reach it.
    """
    if provider_id is None:
        assigned = bookings.where(F.col("provider_id").isNotNull())
        picked = top_per_key(assigned, "provider_id", newest_first(), n)
    else:
        newest = scope_bookings(bookings, "provider", provider_id).orderBy(*newest_first()).limit(n)
        picked = top_per_key(newest, "provider_id", newest_first(), n)
    rows = join_customer(picked, profiles)
    return rows.select(*_booking_columns(rows), "customer_name", "customer_phone", "position")


def dashboard_cards(recent: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of each provider's recent bookings, contact masked, date formatted."""
    return masked_contacts(recent.where(F.col("position") <= n)).withColumn(
        "date_label", date_label(F.col("date")))


def provider_stats(providers: DataFrame, ids: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Stored counters per provider; a missing one is 0."""
    chosen = providers if ids is None else lookup(providers, "id", ids)
    zero = F.lit(0)
    return chosen.select(
        "id", F.coalesce("total_jobs", zero).alias("total_jobs"),
        F.coalesce("completed_jobs", zero).alias("completed_jobs"),
        F.coalesce("monthly_earnings", zero).alias("monthly_earnings"),
        F.coalesce("rating", zero).alias("avg_rating"),
        F.coalesce("reviews_count", zero).alias("reviews"),
    )


def provider_tiles(stats: DataFrame) -> DataFrame:
    """Provider stats as four label/value/change tiles per provider, in tile order.

    Ratings print without trailing zeros (4.50 as 4.5); an unrated provider shows 0.0.
    """
    rated = F.when(F.col("avg_rating") != 0, F.col("avg_rating"))
    rating_text = F.call_function("format_number", rated, F.lit(texts.RATING_FORMAT))
    tiles = F.array(*[
        F.struct(F.lit(place).alias("tile"), F.lit(label).alias("label"), value.alias("value"),
                 change.alias("change"))
        for place, (label, value, change) in enumerate([
            (texts.TOTAL_JOBS, F.col("total_jobs").cast("string"), F.lit(texts.LIFETIME)),
            (texts.COMPLETED, F.col("completed_jobs").cast("string"), F.lit(texts.FINISHED)),
            (texts.MONTHLY_EARNINGS, money_label(F.col("monthly_earnings")), F.lit(texts.THIS_MONTH)),
            (texts.AVG_RATING, F.coalesce(rating_text, F.lit(texts.NO_RATING)),
             F.concat(F.col("reviews").cast("string"), F.lit(texts.REVIEWS))),
        ], start=1)
    ])
    return stats.select("id", F.inline(tiles))


def booking_tab_counts(bookings: DataFrame, by: str | None = "customer_id") -> DataFrame:
    """Bookings per tab: all, ongoing, completed."""
    bucket = booking_bucket(F.col("status"))
    grouped = bookings.groupBy(by) if by else bookings.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("all_bookings"),
        F.count_if(bucket == "ongoing").alias("ongoing"),
        F.count_if(bucket == "completed").alias("completed"),
    )
