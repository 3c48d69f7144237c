"""Counters and revenue rebuilt from the bookings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.operators.admin import revenue
from bazaarflow.schemas import MONEY, NUMBER


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def provider_rollup(bookings: DataFrame, month: str) -> DataFrame:
    """Per provider: jobs, completed jobs, earnings of ``month`` (yyyy-MM), rating and reviews.

    ``monthly_earnings`` sums completed prices by booking date; an unrated provider has rating 0.
    """
    in_month = F.when(_month(F.col("booking_date")) == month, F.col("price"))
    stars = F.col("rating").cast(NUMBER)
    return bookings.where(F.col("provider_id").isNotNull()).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        revenue(in_month, F.col("status")).alias("monthly_earnings"),
        F.coalesce(F.round(F.sum(stars) / F.count(stars), 2), F.lit(0))
        .cast(MONEY).alias("rating"),
        F.count(stars).alias("reviews_count"),
    )


COUNTERS = ("total_jobs", "completed_jobs", "monthly_earnings", "rating", "reviews_count")


def counter_drift(providers: DataFrame, rollup: DataFrame, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Providers of which a stored counter differs from the rebuilt one, as ``stored_*`` and ``rebuilt_*``.

    A provider without bookings counts as 0 in everything, and so does a missing stored counter.
    """
    rebuilt = rollup.select(
        F.col("provider_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in counters])
    zero = F.lit(0)
    both = providers.join(rebuilt, "id", "left").select("id", *[
        F.coalesce(F.col(name), zero).alias(alias)
        for c in counters for name, alias in ((c, f"stored_{c}"), (f"_{c}", f"rebuilt_{c}"))])
    return both.where(reduce(
        lambda a, b: a | b, [F.col(f"stored_{c}") != F.col(f"rebuilt_{c}") for c in counters]))


def revenue_rollup(bookings: DataFrame, providers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bookings and completed revenue by month, category and provider area, with subtotals.

    Bookings are first summed per (month, provider) and again per (month, category, area). The
    joins see one row per provider and month, a hot provider is gone before the first shuffle,
    and the subtotal expansion runs on the small result. ``level`` is the grouping id: 0 detail,
    1 all areas, 3 all categories, 7 everything.
    """
    monthly = bookings.groupBy(_month(F.col("booking_date")).alias("month"), "provider_id").agg(
        F.count(F.lit(1)).alias("n"), revenue(F.col("price"), F.col("status")).alias("amount"))
    category = providers.select(F.col("id").alias("provider_id"), "category")
    area = profiles.select(F.col("id").alias("provider_id"), "area")
    detail = (
        monthly.join(category, "provider_id", "left").join(area, "provider_id", "left")
        .groupBy("month", "category", "area")
        .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))
    return detail.rollup("month", "category", "area").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("bookings"),
        F.sum("amount").cast("decimal(24,2)").alias("revenue"),
    ).select("month", "category", "area", F.col("level").cast("bigint").alias("level"),
             "bookings", "revenue")
