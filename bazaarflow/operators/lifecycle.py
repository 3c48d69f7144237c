"""Booking requests, status changes, completions, ratings and provider approvals as folds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions import is_unfit_number, js_number
from bazaarflow.operators.directory import with_profile
from bazaarflow.operators.latest import last_event
from bazaarflow.operators.skew import sliced_left_join
from bazaarflow.schemas import BOOKING_STATUSES, NUMBER, PROVIDER_STATUSES
from bazaarflow.texts import BOOKING_PREFIX

MIN_ADDRESS = 30
FIRST_BOOKING_NUMBER = 100_000


class Screened(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


class Folded(NamedTuple):
    """``rows`` is the whole table after the fold; the others are events without effect.

    ``unmatched`` has no such row, ``invalid`` a value that is not allowed, and ``foreign`` was
    sent by someone other than the row's owner (always empty where owners are not enforced).
    """

    rows: DataFrame
    unmatched: DataFrame
    invalid: DataFrame
    foreign: DataFrame


def screen_requests(
    requests: DataFrame, providers: DataFrame, profiles: DataFrame, strict: bool = False,
) -> DataFrame:
    """Every request with its provider's data and a ``reason``, null when it is acceptable.

    The first failing check names the reason. ``strict`` also turns down a provider that is not
    active. The requests to a hot provider are sliced.
    """
    side = with_profile(providers, profiles, "phone").select(
        F.col("id").alias("_provider_key"), F.col("business_name").alias("provider_name"),
        F.col("category").alias("provider_category"), F.col("profile_phone").alias("provider_phone"),
        F.col("base_price").alias("_base_price"), F.col("status").alias("_provider_status"))
    joined = sliced_left_join(requests, side, "provider_id", "_provider_key", "request_id")
    absent = F.lit(False)
    for name in ("provider_id", "booking_time", "description", "address"):
        absent = absent | F.col(name).isNull() | (F.col(name) == "")
    reason = (
        F.when(~F.col("role").eqNullSafe("customer"), "not_a_customer")
        .when(absent | F.col("booking_date").isNull(), "missing_field")
        .when(F.length("address") < MIN_ADDRESS, "address_too_short")
        .when(F.col("_provider_key").isNull(), "provider_not_found"))
    if strict:
        reason = reason.when(~F.col("_provider_status").eqNullSafe("active"), "provider_inactive")
    return joined.withColumn("reason", reason)


def accepted_rows(screened: DataFrame, first_number: int = FIRST_BOOKING_NUMBER) -> DataFrame:
    """New pending bookings with the confirmation's provider fields.

    The booking number is ``first_number`` plus the request id: unique, and the same on a rerun.
    Choose ``first_number`` above the numbers already given out.
    """
    number = (F.col("request_id") + F.lit(first_number)).cast("string")
    return screened.where(F.col("reason").isNull()).select(
        F.concat(F.lit(BOOKING_PREFIX), number).alias("id"), "customer_id", "provider_id",
        "booking_date", "booking_time", "description", "address",
        F.coalesce("is_emergency", F.lit(False)).alias("is_emergency"),
        F.lit("pending").alias("status"), F.col("_base_price").alias("price"),
        F.col("ts").alias("created_at"), "provider_name", "provider_category", "provider_phone",
    )


def rejected_rows(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reason").isNotNull()).select(
        "request_id", "customer_id", "provider_id", "role", "ts", "reason")


def accept_bookings(
    requests: DataFrame, providers: DataFrame, profiles: DataFrame,
    first_number: int = FIRST_BOOKING_NUMBER, strict: bool = False,
) -> Screened:
    """Split requests into new bookings and refusals; together they are all requests."""
    screened = screen_requests(requests, providers, profiles, strict)
    return Screened(accepted_rows(screened, first_number), rejected_rows(screened))


def _in_enum(events: DataFrame, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    valid = F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    return events.where(valid), events.where(~valid)


def _by_owner(
    events: DataFrame, bookings: DataFrame, owner: str, enforce: bool,
) -> tuple[DataFrame, DataFrame]:
    """Events whose ``actor_id`` is the booking's owner in column ``owner``, and those of others.

    Unknown bookings are in neither part. A null actor, or a booking without owner, is not a match.
    """
    if not enforce:
        return events, events.where(F.lit(False))
    owners = bookings.select(F.col("id").alias("booking_id"), F.col(owner).alias("_owner"))
    known = events.join(owners, "booking_id")
    own = F.coalesce(F.col("actor_id") == F.col("_owner"), F.lit(False))
    return known.where(own).drop("_owner"), known.where(~own).drop("_owner")


def apply_status(bookings: DataFrame, events: DataFrame, enforce_owner: bool = False) -> Folded:
    """Bookings with the latest status of each, by (ts, event_id).

    Any known status may follow any other. With ``enforce_owner`` only events sent by the
    booking's provider (column ``actor_id``) count; the others are ``foreign``.
    """
    valid, invalid = _in_enum(events, BOOKING_STATUSES)
    counted, foreign = _by_owner(valid, bookings, "provider_id", enforce_owner)
    latest = last_event(counted, "booking_id", ["status"]).select(
        F.col("booking_id").alias("id"), F.col("status").alias("_status"), F.col("ts").alias("_ts"))
    rows = bookings.join(latest, "id", "left").withColumn(
        "status", F.coalesce("_status", "status"))
    rows = _stamp(rows, bookings).drop("_status", "_ts")
    return Folded(rows, _unmatched(valid, bookings, "booking_id"), invalid, foreign)


def _stamp(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Set updated_at to the event time where an event changed the row."""
    old = F.col("updated_at") if "updated_at" in before.columns else F.lit(None).cast("timestamp")
    return rows.withColumn("updated_at", F.coalesce(F.col("_ts"), old))


def _unmatched(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Events whose key is not in the table (AQE splits the partition of a hot key)."""
    return events.join(table.select(F.col("id").alias(key)), key, "left_anti")


def completion_counts(
    events: DataFrame, bookings: DataFrame, distinct_bookings: bool = False,
) -> DataFrame:
    """Completions per provider, one for every completion event of a known booking.

    ``distinct_bookings`` counts a booking once however often its completion was sent. Events
    are counted per booking before the join, so it sees each booking once.
    """
    per_booking = events.where(F.col("status") == "completed").groupBy("booking_id").agg(
        F.lit(1).cast("bigint").alias("n") if distinct_bookings
        else F.count(F.lit(1)).alias("n"))
    owner = bookings.where(F.col("provider_id").isNotNull()).select(
        F.col("id").alias("booking_id"), "provider_id")
    return per_booking.join(owner, "booking_id").groupBy("provider_id").agg(
        F.sum("n").alias("completions"))


def apply_completions(providers: DataFrame, counts: DataFrame) -> DataFrame:
    """Providers with ``completions`` added to their stored completed_jobs."""
    added = counts.select(F.col("provider_id").alias("id"), "completions")
    total = F.coalesce("completed_jobs", F.lit(0)) + F.coalesce("completions", F.lit(0))
    return providers.join(added, "id", "left").withColumn(
        "completed_jobs",
        F.when(F.col("completions").isNotNull(), total).otherwise(F.col("completed_jobs"))
    ).drop("completions")


def apply_ratings(bookings: DataFrame, events: DataFrame, enforce_owner: bool = False) -> Folded:
    """Bookings with the latest rating and review text of each.

    There is no range check: a rating that is not a number stores null, as the source does. A
    number too long to be stored is ``invalid``. With ``enforce_owner`` only the booking's
    customer (column ``actor_id``) may rate; the other events are ``foreign``.
    """
    too_long = is_unfit_number(F.col("rating"))
    valid, invalid = events.where(~too_long), events.where(too_long)
    counted, foreign = _by_owner(valid, bookings, "customer_id", enforce_owner)
    latest = last_event(counted, "booking_id", ["rating", "review"]).select(
        F.col("booking_id").alias("id"), js_number(F.col("rating")).alias("_rating"),
        F.col("review").alias("_review"), F.col("ts").alias("_ts"))
    rated = F.col("_ts").isNotNull()
    old_text = F.col("review_text") if "review_text" in bookings.columns else F.lit(None).cast("string")
    rows = bookings.join(latest, "id", "left").withColumns({
        "rating": F.when(rated, F.col("_rating")).otherwise(F.col("rating").cast(NUMBER)),
        "review_text": F.when(rated, F.col("_review")).otherwise(old_text),
    })
    rows = _stamp(rows, bookings).drop("_rating", "_review", "_ts")
    return Folded(rows, _unmatched(valid, bookings, "booking_id"), invalid, foreign)


def apply_provider_status(providers: DataFrame, events: DataFrame) -> Folded:
    """Providers with the latest status of each; verified exactly when active."""
    valid, invalid = _in_enum(events, PROVIDER_STATUSES)
    latest = last_event(valid, "provider_id", ["status"]).select(
        F.col("provider_id").alias("id"), F.col("status").alias("_status"))
    decided = F.col("_status").isNotNull()
    rows = providers.join(latest, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "verified": F.when(decided, F.col("_status") == "active").otherwise(F.col("verified")),
    }).drop("_status")
    return Folded(rows, _unmatched(valid, providers, "provider_id"), invalid, events.where(F.lit(False)))
