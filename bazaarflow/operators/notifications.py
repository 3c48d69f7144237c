"""A provider's notification feed derived from its bookings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from bazaarflow import texts
from bazaarflow.functions import capitalize, first_truthy
from bazaarflow.operators.ordered import with_position

FIRST_ID = 1000
BOOKING_TYPES = ("booking", "status")


def booking_notices(work_list: DataFrame) -> DataFrame:
    """One notice per booking of a provider work list, not numbered yet."""
    pending = F.col("status") == "pending"
    request = F.concat(
        first_truthy(F.col("customer_name"), F.lit(texts.SOME_CUSTOMER)), F.lit(texts.HAS_REQUESTED),
        first_truthy(F.col("description"), F.lit(texts.SOME_SERVICE)), F.lit(texts.ON),
        F.coalesce(F.col("date").cast("string"), F.lit("null")), F.lit(texts.AT),
        F.coalesce(F.col("time"), F.lit("null")))
    change = F.concat(
        F.lit(texts.BOOKING), F.col("id"), F.lit(texts.IS_CURRENTLY), F.col("status"), F.lit("."))
    return work_list.select(
        "provider_id", F.col("id").alias("booking_id"), "created_at",
        F.lit("booking").alias("type"),
        F.when(pending, texts.NEW_REQUEST)
        .otherwise(F.concat(F.lit(texts.BOOKING), capitalize(F.col("status")))).alias("title"),
        F.when(pending, request).otherwise(change).alias("message"),
        (~pending).alias("read"), pending.alias("action_required"))


def notifications(work_list: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The feed of a provider work list, whose own order does not matter.

    A notification's id is 1000 plus the booking's place, from 0, in its provider's newest-first
    list. ``others`` adds notifications of the remaining types (its booking rows are replaced).
    """
    order = [F.col("created_at").desc_nulls_first(), F.col("booking_id").asc()]
    placed = with_position(booking_notices(work_list), ["provider_id"], order)
    feed = placed.select(
        "provider_id", (F.col("position") - 1 + FIRST_ID).alias("id"), "type", "title",
        "message", "read", "booking_id", "action_required")
    if others is None:
        return feed
    kept = others.where(~F.col("type").isin(*BOOKING_TYPES))
    return feed.unionByName(kept, allowMissingColumns=True)


def unread_count(feed: DataFrame, by: str | None = "provider_id") -> DataFrame:
    grouped = feed.groupBy(by) if by else feed.groupBy()
    return grouped.agg(F.count_if(~F.col("read")).alias("unread"))


def mark_read(feed: DataFrame, ids: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """The feed with all notifications read, or only those listed.

    A DataFrame of (provider_id, id) names them across providers; ids alone repeat per provider.
    """
    if ids is None:
        return feed.withColumn("read", F.lit(True))
    if isinstance(ids, DataFrame):
        keys = ["provider_id", "id"]
        seen = ids.select(*keys).distinct().withColumn("_seen", F.lit(True))
        return feed.join(seen, keys, "left").withColumn(
            "read", F.col("read") | F.col("_seen").isNotNull()).drop("_seen")
    return feed.withColumn("read", F.col("read") | F.col("id").isin(list(ids)))


def notification_events(answers: DataFrame, feed: DataFrame) -> DataFrame:
    """Status events from answers (event_id, provider_id, id, accept, ts) to notifications.

    Accepting gives 'accepted', declining 'cancelled'. An answer to a notification that has no
    booking changes nothing.
    """
    target = feed.where(F.col("booking_id").isNotNull()).select("provider_id", "id", "booking_id")
    return answers.join(target, ["provider_id", "id"]).select(
        "event_id", "booking_id",
        F.when(F.col("accept"), "accepted").otherwise("cancelled").alias("status"), "ts")
