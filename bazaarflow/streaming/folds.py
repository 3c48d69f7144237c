"""Requests, statuses, completions and daily totals on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bazaarflow.operators.admin import revenue
from bazaarflow.operators.latest import first_per_key
from bazaarflow.operators.lifecycle import (
    FIRST_BOOKING_NUMBER, accepted_rows, rejected_rows, screen_requests,
)
from bazaarflow.schemas import BOOKING_STATUSES, MONEY
from bazaarflow.session import discard, materialise
from bazaarflow.streaming.batches import BATCH, Snapshots, Table, as_of_now, start, write_batch


SNAPSHOT_EVERY = 50
ROWS_PER_FILE = 200_000

ACCEPTED_IDS = T.StructType([T.StructField("request_id", T.LongType())])
REPEATED = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("repeats", T.LongType())])


def _accepted_ids(spark: SparkSession, out: str, every: int) -> Snapshots:
    return Snapshots(spark, f"{out}/ids", ACCEPTED_IDS, lambda rows: rows.select("request_id"), every)


def accept_requests(
    requests: DataFrame, providers: Table, profiles: Table, out: str, checkpoint: str,
    first_number: int = FIRST_BOOKING_NUMBER, once: bool = False, snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """New bookings to ``out/accepted``, refusals to ``out/rejected``, repeats to ``out/repeated``.

    A request is accepted once, however often and in whatever batch it is sent: of equal request ids the
    first acceptable one by (ts, customer, provider) makes the booking, and the others are counted per
    id. A refused request may be sent again; one without an id is refused, as it could get no number. The ids accepted before are read as one sorted column, of which
    the id range of the batch is pushed down to the files. Each batch is written once, joined to the
    tables (as they are then, when given as functions) and written with its outcome; all parts are
    read from that. What arrives in few large files is written in more, so that all tasks share the rest.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = f"{out}/work/{BATCH}={batch_id}"
        arrived = materialise(batch, "requests", f"{work}/arrived", ROWS_PER_FILE)
        judged = screen_requests(arrived, as_of_now(providers), as_of_now(profiles))
        nameless = F.when(F.col("request_id").isNull(), "missing_field")
        screened = materialise(
            judged.withColumn("reason", F.coalesce("reason", nameless)), "requests", f"{work}/screened")
        write_batch(rejected_rows(screened), f"{out}/rejected", batch_id)
        valid = screened.where(F.col("reason").isNull())
        ids = _accepted_ids(spark, out, snapshot_every)
        low, high = valid.agg(F.min("request_id"), F.max("request_id")).first()  # one row
        before = ids.state(batch_id).where(
            F.col("request_id").between(low, high) if low is not None else F.lit(False))
        order = [F.col(c).asc_nulls_last() for c in ("ts", "customer_id", "provider_id")]
        new = materialise(
            first_per_key(valid, ["request_id"], order).join(before, "request_id", "left_anti").select(*valid.columns),
            "requests", f"{work}/new")
        write_batch(accepted_rows(new, first_number), f"{out}/accepted", batch_id)
        taken = new.select("request_id", F.lit(1).alias("_taken"))
        write_batch(
            valid.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).join(taken, "request_id", "left").select(
                "request_id", (F.col("n") - F.coalesce("_taken", F.lit(0))).alias("repeats")).where("repeats > 0"),
            f"{out}/repeated", batch_id)
        ids.add(new.select("request_id").sort("request_id"), batch_id)
        discard(spark, work)

    return start(requests, write, checkpoint, once=once)


STATUS_UPDATE = T.StructType([
    T.StructField("booking_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()),
])


def _last_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("booking_id").agg(
        F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    ).select("booking_id", "last.*")


def _statuses(spark: SparkSession, out: str, every: int) -> Snapshots:
    return Snapshots(spark, out, STATUS_UPDATE, _last_status, every)


def track_status(
    events: DataFrame, out: str, checkpoint: str, once: bool = False, snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Each booking's latest known status; every batch writes the bookings it has events of.

    The stream keeps no state of its own: ``current_status`` folds the batches, and a late event
    loses against a newer one, since the fold keeps the greatest (ts, event_id).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("status").isin(*BOOKING_STATUSES))
        _statuses(batch.sparkSession, out, snapshot_every).add(_last_status(known), batch_id)

    return start(events, write, checkpoint, once=once)


def current_status(spark: SparkSession, out: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataFrame:
    """What ``track_status`` has found so far, one row per booking."""
    return _statuses(spark, out, snapshot_every).current()


COMPLETIONS = T.StructType([
    T.StructField("booking_id", T.StringType()), T.StructField("n", T.LongType()),
])


def _add_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("booking_id").agg(F.sum("n").alias("n"))


def _completions(spark: SparkSession, out: str, every: int) -> Snapshots:
    return Snapshots(spark, out, COMPLETIONS, _add_up, every)


def track_completions(
    events: DataFrame, out: str, checkpoint: str, once: bool = False, snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Completion events of each batch per booking; no table is read while the stream runs."""
    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.where((F.col("status") == "completed") & F.col("booking_id").isNotNull())
        counted = done.groupBy("booking_id").agg(F.count(F.lit(1)).alias("n"))
        _completions(batch.sparkSession, out, snapshot_every).add(counted, batch_id)

    return start(events, write, checkpoint, once=once)


def running_completions(
    spark: SparkSession, out: str, bookings: DataFrame, snapshot_every: int = SNAPSHOT_EVERY,
) -> DataFrame:
    """Completions per provider over all batches so far; the bookings are joined here, once."""
    owner = bookings.where(F.col("provider_id").isNotNull()).select(
        F.col("id").alias("booking_id"), "provider_id")
    counted = _completions(spark, out, snapshot_every).current()
    return counted.join(owner, "booking_id").groupBy("provider_id").agg(F.sum("n").alias("completions"))


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream with repeats of an event_id dropped while they arrive within ``delay``.

    A row more than ``delay`` behind the newest one seen by earlier batches is dropped, repeat or
    not. Where late rows must count, choose a ``delay`` beyond them, or do without this step.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


DAILY = T.StructType([
    T.StructField("day", T.TimestampType()), T.StructField("bookings", T.LongType()),
    T.StructField("pending", T.LongType()),
    T.StructField("revenue", MONEY),
])


def daily_totals(bookings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bookings, pending bookings and completed revenue per day of a stream of bookings.

    A day is final, and appears, once the newest booking is ``delay`` past its end; a booking of
    a final day that arrives in a later batch is dropped.
    """
    day = F.window("created_at", "1 day")
    return bookings.withWatermark("created_at", delay).groupBy(day).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        revenue(F.col("price"), F.col("status")).cast(MONEY).alias("revenue"),
    ).select(F.col("window.start").alias("day"), "bookings", "pending", "revenue")


LATE = T.StructType([T.StructField("day", T.TimestampType()), T.StructField("rows", T.LongType())])


def _add_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(
        F.sum("bookings").alias("bookings"), F.sum("pending").alias("pending"),
        F.sum("revenue").cast(MONEY).alias("revenue"))


def _days(spark: SparkSession, out: str, every: int) -> Snapshots:
    return Snapshots(spark, f"{out}/days", DAILY, _add_days, every)


def track_daily_totals(
    bookings: DataFrame, out: str, checkpoint: str, delay: str = "1 day", once: bool = False,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Totals per day that late bookings correct; nothing is dropped, however late.

    Every batch writes the new totals of the days it has bookings of to ``out/revisions``, where the
    batch id is the revision number, and to ``out/late`` how many of its rows belong to days that
    ended more than ``delay`` before the newest day of earlier batches. Days are kept as sums of batches, so
    a batch that is run again replaces its own part. Bookings without a time form a day of their own (null).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = _days(spark, out, snapshot_every)
        own = batch.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(
            F.count(F.lit(1)).alias("bookings"), F.count_if(F.col("status") == "pending").alias("pending"),
            revenue(F.col("price"), F.col("status")).cast(MONEY).alias("revenue"))
        work = f"{out}/work/{BATCH}={batch_id}"
        own = materialise(own, "days", f"{work}/own")
        before = days.state(batch_id)
        newest = before.agg(F.max("day")).first()[0]  # one row
        mark = own["day"].eqNullSafe(before["day"])
        earlier = before.join(own, mark, "left_semi")
        write_batch(_add_days(earlier.unionByName(own)), f"{out}/revisions", batch_id)
        closed = F.col("day") + F.expr(f"INTERVAL 1 DAY + INTERVAL {delay}") <= F.lit(newest)
        write_batch(own.where(closed).select("day", F.col("bookings").alias("rows")), f"{out}/late", batch_id)
        days.add(own, batch_id)
        discard(spark, work)

    return start(bookings, write, checkpoint, once=once)


def daily_totals_so_far(spark: SparkSession, out: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The totals of every day over all batches so far."""
    return _days(spark, out, snapshot_every).current()


def write_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream's rows to batch folders."""
    return start(stream, lambda df, n: write_batch(df, out, n), checkpoint, once=once)
