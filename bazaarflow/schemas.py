"""Table schemas, enumerations and insert defaults of the marketplace."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Numbers that come without a precision: 28 digits before the point.
NUMBER = T.DecimalType(38, 10)
MONEY = T.DecimalType(28, 2)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _B, _I, _D, _TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.DateType(), T.TimestampType()
_LIST = T.ArrayType(_S)

# No password column: a credential hash never enters a DataFrame.
PROFILES = _struct(
    ("id", _S), ("first_name", _S), ("last_name", _S), ("email", _S), ("phone", _S),
    ("role", _S), ("area", _S), ("phone_verified", _B), ("profile_photo_url", _S),
    ("created_at", _TS), ("updated_at", _TS),
)

PROVIDERS = _struct(
    ("id", _S), ("business_name", _S), ("category", _S), ("experience", NUMBER),
    ("verified", _B), ("rating", T.DecimalType(3, 2)), ("reviews_count", _I),
    ("base_price", NUMBER), ("price_unit", _S), ("emergency_available", _B),
    ("is_available", _B), ("description", _S), ("skills", _LIST), ("areas_served", _LIST),
    ("status", _S), ("total_jobs", _I), ("completed_jobs", _I),
    ("monthly_earnings", MONEY), ("id_proof_type", _S), ("id_proof_number", _S),
    ("id_proof_url", _S), ("about_bio", _S), ("joined_date", _D),
)

# rating is numeric without a range check, as the rating form's target column is.
BOOKINGS = _struct(
    ("id", _S), ("customer_id", _S), ("provider_id", _S), ("booking_date", _D),
    ("booking_time", _S), ("description", _S), ("address", _S), ("is_emergency", _B),
    ("status", _S), ("price", NUMBER), ("rating", NUMBER), ("review_text", _S),
    ("created_at", _TS), ("updated_at", _TS),
)

BOOKING_REQUESTS = _struct(
    ("request_id", T.LongType()), ("customer_id", _S), ("role", _S), ("provider_id", _S),
    ("booking_date", _D), ("booking_time", _S), ("description", _S), ("address", _S),
    ("is_emergency", _B), ("ts", _TS),
)
BOOKING_STATUS_EVENTS = _struct(
    ("event_id", T.LongType()), ("booking_id", _S), ("status", _S), ("ts", _TS))
BOOKING_RATING_EVENTS = _struct(
    ("event_id", T.LongType()), ("booking_id", _S), ("rating", _S), ("review", _S), ("ts", _TS))
PROVIDER_STATUS_EVENTS = _struct(
    ("event_id", T.LongType()), ("provider_id", _S), ("status", _S), ("ts", _TS))
OTP_EVENTS = _struct(
    ("event_id", T.LongType()), ("phone", _S), ("code", _S), ("purpose", _S), ("ts", _TS))

TABLES = {
    "profiles": PROFILES,
    "providers": PROVIDERS,
    "bookings": BOOKINGS,
    "booking_requests": BOOKING_REQUESTS,
    "booking_status_events": BOOKING_STATUS_EVENTS,
    "booking_rating_events": BOOKING_RATING_EVENTS,
    "provider_status_events": PROVIDER_STATUS_EVENTS,
    "otp_issues": OTP_EVENTS,
    "otp_attempts": OTP_EVENTS,
}

# Parents first: the order in which foreign keys allow a load.
LOAD_ORDER = ("profiles", "providers", "bookings")

# The allowed values of each checked column.
ROLES = ("admin", "provider", "customer")
PROVIDER_STATUSES = ("pending", "active", "suspended")
BOOKING_STATUSES = ("pending", "accepted", "in-progress", "completed", "cancelled")
ONGOING_STATUSES = ("pending", "accepted", "in-progress")
CLOSED_STATUSES = ("completed", "cancelled")
CONTACT_STATUSES = ("accepted", "in-progress", "completed")

ENUMS = {
    "profiles": ("role", ROLES),
    "providers": ("status", PROVIDER_STATUSES),
    "bookings": ("status", BOOKING_STATUSES),
}

# The status changes the work-list screen offers.
STATUS_GRAPH = (
    ("pending", "accepted"),
    ("pending", "cancelled"),
    ("accepted", "in-progress"),
    ("in-progress", "completed"),
)

# Column defaults on insert.
DEFAULTS = {
    "profiles": {"phone_verified": False},
    "providers": {
        "verified": False, "rating": Decimal("0"), "reviews_count": 0, "price_unit": "/hr",
        "emergency_available": False, "is_available": True, "status": "pending",
        "total_jobs": 0, "completed_jobs": 0, "monthly_earnings": Decimal("0"),
    },
    "bookings": {"is_emergency": False, "status": "pending"},
}
_TIME_DEFAULTS = {
    "profiles": ("created_at", "updated_at"),
    "providers": ("joined_date",),
    "bookings": ("created_at", "updated_at"),
}


def fill_defaults(df: DataFrame, table: str, inserted_at=None) -> DataFrame:
    """Fill the column defaults of ``table``.

    Time defaults are filled only when ``inserted_at`` (a literal or Column) is given. Taking
    the clock on every read would give one row a different age in each query.
    """
    types = {f.name: f.dataType for f in TABLES[table].fields}
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(types[name]))
        for name, value in DEFAULTS.get(table, {}).items() if name in df.columns
    }
    if inserted_at is not None:
        moment = inserted_at if not isinstance(inserted_at, str) else F.lit(inserted_at)
        for name in _TIME_DEFAULTS.get(table, ()):
            if name in df.columns:
                filled[name] = F.coalesce(F.col(name), F.lit(moment).cast(types[name]))
    return df.withColumns(filled) if filled else df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the columns of ``table`` in order and type; columns ``df`` lacks become null.

    A value that does not fit its column becomes null here; ``unfit_rows`` finds such rows.
    """
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in TABLES[table].fields
    ])


def _unfit(df: DataFrame, table: str) -> Column:
    lost = [
        F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in TABLES[table].fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    return reduce(lambda a, b: a | b, lost, F.lit(False))


def unfit_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value that does not fit its column of ``table``."""
    return df.where(_unfit(df, table))


def fit_rows(df: DataFrame, table: str) -> DataFrame:
    return df.where(~_unfit(df, table))
