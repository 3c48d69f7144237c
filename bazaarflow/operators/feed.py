"""Single places of notification feeds, found by counts instead of sorting the feeds.

A notification's id is its place in its provider's newest-first list. Notices counted per provider and
month say how many are newer than a month's first, so an id leads to its month by one look at these
counts, and only the rows of the months that are asked for are read and ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from bazaarflow.operators.bookings import provider_bookings
from bazaarflow.operators.notifications import FIRST_ID, booking_notices
from bazaarflow.operators.ordered import with_position
from bazaarflow.operators.skew import sliced_left_join
from bazaarflow.session import materialise
from bazaarflow.sources.versions import month_cell

PUSHED_PROVIDERS = 1000

FEED_COUNTS = T.StructType([
    T.StructField("provider_id", T.StringType()), T.StructField("month", T.StringType()),
    T.StructField("notices", T.LongType()), T.StructField("newest", T.TimestampType())])

feed_month = month_cell("created_at")


def feed_counts(bookings: DataFrame) -> DataFrame:
    """Notices per provider and month of creation, and the newest one's time; undated ones are a month of their own."""
    return summed_counts(bookings.where(F.col("provider_id").isNotNull()).select(
        "provider_id", feed_month().alias("month"), F.lit(1).cast("long").alias("notices"),
        F.col("created_at").alias("newest")))


def summed_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("provider_id", "month").agg(
        F.sum("notices").alias("notices"), F.max("newest").alias("newest"))


def locate(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(provider_id, notice_id, month, position) of the ids in ``wanted`` (provider_id, id) that there are.

    ``position`` counts from 1 within the month. Months of a provider are in one row, in the order of
    the feed: as many as the calendar has, however many bookings. A repeated id is found once; an id
    outside its provider's list, or without a provider, not at all.
    """
    asked = wanted.where(F.col("provider_id").isNotNull() & F.col("id").isNotNull()).select(
        "provider_id", F.col("id").cast("long").alias("notice_id")).distinct()
    own = summed_counts(counts.join(asked.select("provider_id").distinct(), "provider_id", "left_semi"))
    newest_first = W.partitionBy("provider_id").orderBy(F.col("newest").desc_nulls_first())
    months = own.withColumn("before", F.sum("notices").over(newest_first) - F.col("notices")).groupBy(
        F.col("provider_id").alias("_provider")).agg(
        F.collect_list(F.struct("before", "month", "notices")).alias("_months"))
    place = F.col("notice_id") - FIRST_ID
    found = F.array_max(F.filter("_months", lambda m: m["before"] <= place))
    return sliced_left_join(asked, months, "provider_id", "_provider", "notice_id").withColumn("_in", found).where(
        place < F.col("_in")["before"] + F.col("_in")["notices"]).select(
        "provider_id", "notice_id", F.col("_in")["month"].alias("month"),
        (place - F.col("_in")["before"] + 1).alias("position"))


def bookings_at(read: Callable[[list[str]], DataFrame], counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bookings behind the notifications in ``wanted``, with their ``notice_id``.

    ``read`` gives the bookings of some months. Of these, the rows of the (provider, month) pairs in question
    are ranked, by ordered scans, so that a provider with most of a month does not end in one task. Where
    few providers are asked for, their names reach the file scan as a filter.
    """
    located = materialise(locate(wanted, counts), "feed-places")
    months = sorted(r[0] for r in located.select("month").distinct().collect())
    providers = [r[0] for r in located.select("provider_id").distinct().limit(PUSHED_PROVIDERS + 1).collect()]
    rows = read(months)
    if len(providers) <= PUSHED_PROVIDERS:
        rows = rows.where(F.col("provider_id").isin(providers))
    asked = located.select("provider_id", "month").distinct()
    own = rows.withColumn("month", feed_month()).join(asked, ["provider_id", "month"], "left_semi")
    order = [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    placed = with_position(own, ["provider_id", "month"], order)
    return placed.join(located, ["provider_id", "month", "position"]).drop("month", "position")


def notices_at(
    read: Callable[[list[str]], DataFrame], counts: DataFrame, wanted: DataFrame, profiles: DataFrame,
) -> DataFrame:
    """The rows of ``notifications.notifications`` with the ids in ``wanted`` (provider_id, id), and no others."""
    rows = materialise(bookings_at(read, counts, wanted), "feed-rows")
    numbers = rows.select(F.col("id").alias("booking_id"), F.col("notice_id").alias("id"))
    notices = booking_notices(provider_bookings(rows, profiles, ordered=False))
    return notices.join(numbers, "booking_id").select(
        "provider_id", "id", "type", "title", "message", "read", "booking_id", "action_required")


def page(providers: DataFrame, first: int, size: int) -> DataFrame:
    """The ids of one page of each provider's feed: ``size`` notifications from place ``first``, from 0."""
    ids = F.sequence(F.lit(FIRST_ID + first).cast("long"), F.lit(FIRST_ID + first + size - 1).cast("long"))
    return providers.select("provider_id", F.explode(ids).alias("id"))
