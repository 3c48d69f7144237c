"""Platform KPIs and the provider review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow import texts
from bazaarflow.functions import area_label_queue, first_truthy, money_label
from bazaarflow.operators.directory import provider_label, with_profile


def revenue(price: Column, status: Column) -> Column:
    """Sum of completed prices; nothing completed is 0."""
    return F.coalesce(F.sum(F.when(status == "completed", price)), F.lit(0).cast("decimal(14,2)"))


def _tile(label: str, value: Column, shown: Column, change: Column) -> Column:
    return F.struct(
        F.lit(label).alias("label"), value.cast("decimal(24,2)").alias("amount"),
        shown.alias("value"), change.alias("change"))


def platform_kpis(profiles: DataFrame, providers: DataFrame, bookings: DataFrame) -> DataFrame:
    """Four tiles in long form. Each table is read once and reduced to one row; no join."""
    users = profiles.agg(F.count(F.lit(1)).alias("n"))
    supply = providers.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"))
    demand = bookings.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"),
        revenue(F.col("price"), F.col("status")).alias("revenue"))
    n, text = F.col("n"), F.col("n").cast("string")
    return users.select(
        F.inline(F.array(_tile(texts.TOTAL_USERS, n, text, F.lit(texts.LIVE))))
    ).unionByName(supply.select(
        F.inline(F.array(_tile(
            texts.TOTAL_PROVIDERS, n, text,
            F.concat(F.col("active").cast("string"), F.lit(texts.ACTIVE)))))
    )).unionByName(demand.select(
        F.inline(F.array(
            _tile(texts.TOTAL_BOOKINGS, n, text,
                  F.concat(F.col("pending").cast("string"), F.lit(texts.PENDING))),
            _tile(texts.TOTAL_REVENUE, F.col("revenue"), money_label(F.col("revenue")),
                  F.lit(texts.REAL_TIME))))
    ))


def review_queue(providers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pending providers with everything a reviewer reads, each gap filled."""
    waiting = with_profile(
        providers.where(F.col("status") == "pending"), profiles,
        "first_name", "last_name", "phone", "email", "area", "profile_photo_url", "created_at")
    missing = F.lit(texts.NOT_PROVIDED)
    return waiting.select(
        "id", provider_label().alias("name"), "category",
        area_label_queue(F.col("areas_served"), F.col("profile_area")).alias("area"),
        F.coalesce("experience", F.lit(0)).alias("experience"),
        first_truthy(F.col("profile_phone"), missing).alias("phone"),
        first_truthy(F.col("profile_email"), missing).alias("email"),
        "status",
        F.coalesce(F.col("joined_date").cast("timestamp"), F.col("profile_created_at"))
        .alias("joined_date"),
        first_truthy(F.col("id_proof_type"), F.lit(texts.UNKNOWN_ID)).alias("id_proof_type"),
        first_truthy(F.col("id_proof_number"), F.lit(texts.NO_ID_NUMBER)).alias("id_proof_number"),
        F.nullif(F.col("id_proof_url"), F.lit("")).alias("id_proof_url"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        F.nullif(F.col("profile_profile_photo_url"), F.lit("")).alias("profile_photo"),
        F.coalesce("about_bio", F.lit("")).alias("about_bio"),
    )
