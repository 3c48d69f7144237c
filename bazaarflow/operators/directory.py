"""Provider directory and provider, user and dimension lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions import (
    area_label_list, contact, date_label, display_name, first_truthy, initial, user_name,
)
from bazaarflow.operators.filters import (
    active_only, by_area, by_category, by_emergency, by_text, lookup,
)
from bazaarflow.texts import NOT_PROVIDED


def with_profile(providers: DataFrame, profiles: DataFrame, *columns: str) -> DataFrame:
    """Providers with the chosen profile columns as ``profile_*``; both sides are unique on id."""
    side = profiles.select(
        F.col("id").alias("_profile_id"), *[F.col(c).alias(f"profile_{c}") for c in columns])
    joined = providers.join(side, F.col("id") == F.col("_profile_id"), "left")
    return joined.withColumn("has_profile", F.col("_profile_id").isNotNull()).drop("_profile_id")


def directory_order(sort: str | None) -> list[Column]:
    """price-low, price-high, anything else by rating; a missing number counts as 0."""
    price = F.coalesce(F.col("base_price"), F.lit(0))
    first = {"price-low": price.asc(), "price-high": price.desc()}.get(
        sort, F.coalesce(F.col("rating"), F.lit(0)).desc())
    return [first, F.col("id").asc()]


def provider_directory(
    providers: DataFrame, profiles: DataFrame, category: str | None = None,
    area: str | None = None, emergency: str | None = None, search: str | None = None,
    sort: str | None = "rating", limit: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Active providers matching every filter, in the requested order.

    All filters run before the join. ``ordered=False`` leaves the sort to the caller.
    """
    found = by_text(
        by_area(by_emergency(by_category(active_only(providers), category), emergency), area),
        search, "business_name", "category")
    if limit is not None:
        found = found.orderBy(*directory_order(sort)).limit(limit)
    listed = with_profile(found, profiles, "first_name", "last_name", "profile_photo_url", "area")
    if ordered:
        listed = listed.orderBy(*directory_order(sort))
    return listed.select(
        "id", F.col("business_name").alias("name"), "category", "experience", "verified",
        "rating", F.col("reviews_count").alias("reviews"), F.col("base_price").alias("price"),
        "price_unit", F.col("emergency_available").alias("emergency"),
        F.col("is_available").alias("available"), F.col("profile_area").alias("area"),
        "areas_served", "skills", "description", "status",
        F.col("profile_first_name").alias("first_name"),
        F.col("profile_last_name").alias("last_name"),
        F.col("profile_profile_photo_url").alias("profile_photo"),
    )


def provider_detail(
    providers: DataFrame, profiles: DataFrame, ids: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """One row per provider with contact data, whatever the status."""
    chosen = providers if ids is None else lookup(providers, "id", ids)
    listed = with_profile(
        chosen, profiles, "first_name", "last_name", "email", "phone", "profile_photo_url")
    return listed.select(
        "id", F.col("business_name").alias("name"), "category", "experience", "verified",
        "rating", F.col("reviews_count").alias("reviews"), F.col("base_price").alias("price"),
        "price_unit", F.col("emergency_available").alias("emergency"),
        F.col("is_available").alias("available"), "areas_served", "skills", "description",
        "status", F.col("profile_first_name").alias("first_name"),
        F.col("profile_last_name").alias("last_name"), F.col("profile_phone").alias("phone"),
        F.col("profile_email").alias("email"),
        F.col("profile_profile_photo_url").alias("profile_photo"),
    )


def provider_label() -> Column:
    """Business name, else the person's name, else 'Unknown' (over ``with_profile`` rows)."""
    person = display_name(
        F.col("profile_first_name"), F.col("profile_last_name"), F.col("has_profile"))
    return first_truthy(F.col("business_name"), person)


def admin_provider_list(providers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every provider with fallbacks for missing name, contact and area."""
    listed = with_profile(
        providers, profiles, "first_name", "last_name", "phone", "email", "profile_photo_url")
    missing = F.lit(NOT_PROVIDED)
    return listed.select(
        "id", provider_label().alias("name"), "category",
        first_truthy(F.col("profile_phone"), missing).alias("phone"),
        first_truthy(F.col("profile_email"), missing).alias("email"),
        area_label_list(F.col("areas_served")).alias("area"), "status", "verified",
        "experience", "rating", F.col("base_price").alias("price"), "emergency_available",
        F.nullif(F.col("profile_profile_photo_url"), F.lit("")).alias("profile_photo"),
    )


def provider_statuses(providers: DataFrame) -> DataFrame:
    return providers.select("status").distinct()


def admin_users(profiles: DataFrame) -> DataFrame:
    """All people with the labels of the users screen; no credential column exists to show."""
    return profiles.select(
        "id", "first_name", "last_name", "email", "phone", "role", "area", "phone_verified",
        "profile_photo_url", "created_at",
        user_name(F.col("first_name"), F.col("last_name")).alias("name"),
        contact(F.col("phone"), F.col("email")).alias("contact"),
        initial(F.col("first_name")).alias("initial"),
        date_label(F.col("created_at")).alias("joined"),
    )


def nonconforming(df: DataFrame, column: str, dimension: DataFrame, dimension_column: str) -> DataFrame:
    """Rows whose value (or any value of an array column) is not in the dimension, with it."""
    is_array = df.schema[column].dataType.typeName() == "array"
    value = F.explode(column) if is_array else F.col(column)
    valued = df.select("*", value.alias("value")).where(F.col("value").isNotNull())
    known = dimension.select(F.col(dimension_column).alias("value"))
    return valued.join(known, "value", "left_anti")
