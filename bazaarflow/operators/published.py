"""The folds on versioned tables: each batch of events becomes one version, once.

Bookings remember the last event of each kind, so a batch that comes late does not undo a newer
change. Counters per provider and month are kept by differences: every change adds what the touched
bookings count for now and subtracts what they counted for before, in the same version.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bazaarflow.functions import is_unfit_number, js_number
from bazaarflow.operators.feed import FEED_COUNTS, bookings_at, feed_counts, notices_at, summed_counts
from bazaarflow.operators.latest import last_event
from bazaarflow.operators.lifecycle import apply_completions, completion_counts
from bazaarflow.operators.notifications import notification_events
from bazaarflow.schemas import BOOKING_STATUSES, BOOKINGS, MONEY, NUMBER, PROVIDER_STATUSES, PROVIDERS, conform
from bazaarflow.session import materialise
from bazaarflow.sources.loads import insert_if_absent
from bazaarflow.sources.versions import CELL, Change, Layout, Store, bucket_cell, month_cell

PROVIDER_BUCKETS = 16
PARTIAL_BUCKETS = 4
FOLDERS_PER_CELL = 16
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48  # of a change beside its texts

BOOKING_STATE = T.StructType([
    *BOOKINGS.fields, T.StructField("status_at", T.TimestampType()), T.StructField("status_event", T.LongType()),
    T.StructField("rated_at", T.TimestampType()), T.StructField("rating_event", T.LongType())])
PROVIDER_STATE = T.StructType([
    *PROVIDERS.fields, T.StructField("decided_at", T.TimestampType()), T.StructField("decision", T.LongType())])
PARTIALS = T.StructType([
    T.StructField("provider_id", T.StringType()), T.StructField("month", T.StringType()),
    T.StructField("jobs", T.LongType()), T.StructField("completed", T.LongType()),
    T.StructField("revenue", NUMBER), T.StructField("stars", NUMBER), T.StructField("ratings", T.LongType())])

LAYOUTS = {
    "bookings": Layout(BOOKING_STATE, month_cell("created_at"), ("provider_id",)),
    "providers": Layout(PROVIDER_STATE, bucket_cell("id", PROVIDER_BUCKETS)),
    "partials": Layout(PARTIALS, bucket_cell("provider_id", PARTIAL_BUCKETS)),
    "feed_counts": Layout(FEED_COUNTS, bucket_cell("provider_id", PARTIAL_BUCKETS), ("provider_id",)),
}
_SUMS = ("jobs", "completed", "revenue", "stars", "ratings")
_COUNTED = ("provider_id", "booking_date", "price", "status", "rating")  # what ``_counts`` reads of a booking


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, LAYOUTS)


def _state(rows: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    have = set(rows.columns)
    plain = conform(rows, name)
    if not {f.name for f in schema.fields}.issubset(have):
        return plain.select("*", *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in plain.columns])
    return rows.select(*schema.names)


def load_tables(store: Store, tables: Mapping[str, DataFrame], batch: int = 0) -> bool:
    """Replace bookings and providers, and the counters and feed counts of the bookings, in one version."""
    def write(change: Change) -> None:
        if "providers" in tables:
            change.replace("providers", _state(tables["providers"], "providers", PROVIDER_STATE))
        if "bookings" in tables:
            rows = change.replace("bookings", _state(tables["bookings"], "bookings", BOOKING_STATE))
            change.replace("partials", _summed(rows.select(_counts("").alias("c")).select("c.*")))
            change.replace("feed_counts", feed_counts(rows))

    return store.publish("load", batch, write)


# --- counters -------------------------------------------------------------------------------

def _counts(prefix: str, sign: int = 1) -> Column:
    """What one booking counts for; ``prefix`` names the columns it is taken from."""
    def own(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    done = own("status").eqNullSafe("completed")
    rated = own("rating").isNotNull()
    zero = F.lit(0).cast(NUMBER)
    one = F.lit(sign).cast("long")
    return F.struct(
        F.col("provider_id"), F.coalesce(F.date_format("booking_date", "yyyy-MM"), F.lit("undated")).alias("month"),
        one.alias("jobs"), F.when(done, one).otherwise(0).alias("completed"),
        F.when(done & F.col("price").isNotNull(), F.col("price") * sign).otherwise(zero).cast(NUMBER).alias("revenue"),
        F.when(rated, own("rating") * sign).otherwise(zero).cast(NUMBER).alias("stars"),
        F.when(rated, one).otherwise(0).alias("ratings"))


def _summed(counts: DataFrame) -> DataFrame:
    """Counts per provider and month, without those that come to nothing."""
    some = counts.where(F.col("provider_id").isNotNull()).groupBy("provider_id", "month").agg(
        *[F.sum(c).alias(c) for c in _SUMS])
    nothing = F.lit(True)
    for c in _SUMS:
        nothing = nothing & (F.col(c) == 0)
    return some.where(~nothing).select("provider_id", "month", *[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in PARTIALS.fields[2:]])


def _differences(changed: DataFrame) -> DataFrame:
    """Of rows with new values in ``new_status`` and ``new_rating``: now minus before, per provider and month."""
    both = F.array(_counts("new_"), _counts("", -1))
    return _summed(changed.select(F.explode(both).alias("c")).select("c.*"))


def maintained_rollup(store: Store, month: str) -> DataFrame:
    """``rollups.provider_rollup`` from the kept counters: reads a row per provider and month, no booking."""
    total = store.read("partials").groupBy("provider_id").agg(
        F.sum("jobs").alias("total_jobs"), F.sum("completed").alias("completed_jobs"),
        F.coalesce(F.sum(F.when(F.col("month") == month, F.col("revenue"))), F.lit(0)).cast(MONEY)
        .alias("monthly_earnings"),
        F.sum("stars").alias("stars"), F.sum("ratings").alias("reviews_count"))
    return total.where(F.col("total_jobs") > 0).select(
        "provider_id", "total_jobs", "completed_jobs", "monthly_earnings",
        F.when(F.col("reviews_count") > 0, F.round(F.col("stars") / F.col("reviews_count"), 2))
        .otherwise(0).cast(MONEY).alias("rating"), "reviews_count")


def compact_counters(store: Store, batch: int, folders: int = FOLDERS_PER_CELL) -> bool:
    """Sum up the buckets of providers whose counters lie in more than ``folders`` folders."""
    def write(change: Change) -> None:
        for table, total in (("partials", _summed), ("feed_counts", summed_counts)):
            many = [c for c, f in change.base.tables.get(table, {}).items() if len(f) > folders]
            if many:
                change.rewrite(table, total(change.read(table, many)), many)

    return store.publish("compact", batch, write)


# --- folds ----------------------------------------------------------------------------------

def _fold_bookings(change: Change, latest: DataFrame, at: str, event: str, values: Mapping[str, str]) -> None:
    """Apply the latest event of each booking, where it is newer than what the booking has had.

    ``latest`` is (id, event_id, ts, ...); ``values`` maps columns of a booking to those of ``latest``.
    The bookings that change are found once, with the few columns that they are counted by; only the
    months that hold one are then read whole and written again. Changes of up to ``BROADCAST_BYTES`` go to
    every task, and months that were written at once are then not shuffled.
    """
    sent = latest.select("id", F.lit(True).alias("_sent"), F.col("ts").alias("_ts"), F.col("event_id").alias("_event"),
                         *[F.col(source).alias(f"_{name}") for name, source in values.items()])
    seen = F.col(at).isNull() & F.col(event).isNull()
    newer = F.col("_sent").isNotNull() & (seen | (F.struct("_ts", "_event") > F.struct(at, event)))
    cell = change.store.layouts["bookings"].cell().alias(CELL)
    held = change.read("bookings", change.touched("bookings", latest)).select("id", cell, *_COUNTED, at, event)
    changed = materialise(held.join(sent, "id").where(newer), "changed-bookings")
    texts = F.sum(F.octet_length(F.concat_ws("", "id", *[F.col(f"_{name}").cast("string") for name in values])))
    sizes = changed.groupBy(CELL).agg((texts + ROW_BYTES * F.count(F.lit(1))).alias("size")).collect()  # a row per month
    if not sizes:
        return
    cells = sorted(r[CELL] for r in sizes)
    applied = changed.select(*sent.columns).dropDuplicates(["id"])
    in_place = sum(r["size"] for r in sizes) <= BROADCAST_BYTES and change.gathered("bookings", cells)
    if in_place:
        applied = F.broadcast(applied)
    judged = change.read("bookings", cells).join(applied, "id", "left").withColumn("_newer", newer)
    change.rewrite("bookings", judged.withColumns({
        **{name: F.when(F.col("_newer"), F.col(f"_{name}")).otherwise(F.col(name)) for name in values},
        "updated_at": F.when(F.col("_newer"), F.greatest("updated_at", "_ts")).otherwise(F.col("updated_at")),
        at: F.when(F.col("_newer"), F.col("_ts")).otherwise(F.col(at)),
        event: F.when(F.col("_newer"), F.col("_event")).otherwise(F.col(event))}), cells, in_place)
    change.append("partials", _differences(changed.withColumns({
        f"new_{name}": F.col(f"_{name}" if name in values else name) for name in ("status", "rating")})))


def publish_status(
    store: Store, events: DataFrame, batch: int, count_completions: bool = False, source: str = "status",
) -> bool:
    """Apply a batch of status events to the bookings as one version; False if it was applied before.

    As ``lifecycle.apply_status``, over all batches together: the greatest (ts, event_id) wins
    whichever batch it came in. Events of unknown bookings and unknown statuses do nothing. With
    ``count_completions`` every completion event of a known booking adds one to its provider's
    completed_jobs, in the same version.
    """
    if store.manifest().has(source, batch):
        return False
    valid = events.where(F.col("status").isin(*BOOKING_STATUSES) & F.col("booking_id").isNotNull())
    latest = materialise(_latest(valid, "booking_id", ["status"]), "status-batch")

    def write(change: Change) -> None:
        _fold_bookings(change, latest, "status_at", "status_event", {"status": "status"})
        if count_completions:
            counts = completion_counts(valid, change.read("bookings", change.touched("bookings", latest)))
            counts = materialise(counts, "completions-batch")
            owners = counts.select(F.col("provider_id").alias("id"))
            cells = change.touched("providers", owners)
            change.rewrite("providers", apply_completions(change.read("providers", cells), counts), cells)

    return store.publish(source, batch, write)


def publish_ratings(store: Store, events: DataFrame, batch: int) -> bool:
    """Apply a batch of rating events as one version; as ``lifecycle.apply_ratings``, over all batches together."""
    if store.manifest().has("rating", batch):
        return False
    valid = events.where(~is_unfit_number(F.col("rating")) & F.col("booking_id").isNotNull())
    latest = _latest(valid, "booking_id", ["rating", "review"]).withColumn("stars", js_number(F.col("rating")))
    latest = materialise(latest, "rating-batch")
    return store.publish("rating", batch, lambda change: _fold_bookings(
        change, latest, "rated_at", "rating_event", {"rating": "stars", "review_text": "review"}))


def publish_provider_status(store: Store, events: DataFrame, batch: int) -> bool:
    """Apply a batch of approvals as one version; a provider is verified exactly when active."""
    if store.manifest().has("approval", batch):
        return False
    valid = events.where(F.col("status").isin(*PROVIDER_STATUSES) & F.col("provider_id").isNotNull())
    latest = materialise(_latest(valid, "provider_id", ["status"]), "approval-batch")

    def write(change: Change) -> None:
        cells = change.touched("providers", latest)
        sent = latest.select("id", F.lit(True).alias("_sent"), F.col("status").alias("_status"),
                             F.col("ts").alias("_ts"), F.col("event_id").alias("_event"))
        joined = change.read("providers", cells).join(sent, "id", "left")
        seen = F.col("decided_at").isNull() & F.col("decision").isNull()
        newer = F.col("_sent").isNotNull() & (
            seen | (F.struct("_ts", "_event") > F.struct("decided_at", "decision")))
        change.rewrite("providers", joined.withColumn("_newer", newer).withColumns({
            "status": F.when(F.col("_newer"), F.col("_status")).otherwise(F.col("status")),
            "verified": F.when(F.col("_newer"), F.col("_status") == "active").otherwise(F.col("verified")),
            "decided_at": F.when(F.col("_newer"), F.col("_ts")).otherwise(F.col("decided_at")),
            "decision": F.when(F.col("_newer"), F.col("_event")).otherwise(F.col("decision"))}), cells)

    return store.publish("approval", batch, write)


def publish_bookings(store: Store, rows: DataFrame, batch: int) -> bool:
    """Append new bookings as one version; an id that is there, or came earlier in the batch, adds nothing.

    Only the id column of the table is read.
    """
    given = _state(rows, "bookings", BOOKING_STATE)

    def write(change: Change) -> None:
        new = change.append("bookings", insert_if_absent(
            change.read("bookings").select("id"), given.where(F.col("id").isNotNull()), ["id"]))
        change.append("partials", _summed(new.select(_counts("").alias("c")).select("c.*")))
        change.append("feed_counts", feed_counts(new))

    return store.publish("bookings", batch, write)


# --- feeds ----------------------------------------------------------------------------------

def _feed_tables(store: Store, version: int | None):
    """The reader of some months' bookings and the feed counts, both of one version."""
    manifest = store.manifest(version)
    return (lambda months: store.read("bookings", months, manifest)), store.read("feed_counts", manifest=manifest)


def stored_notices(store: Store, wanted: DataFrame, profiles: DataFrame, version: int | None = None) -> DataFrame:
    """The notifications with the ids in ``wanted`` (provider_id, id), as of a version, by default the newest.

    Reads the counts and the months that hold such a notification.
    """
    return notices_at(*_feed_tables(store, version), wanted, profiles)


def publish_answers(store: Store, answers: DataFrame, batch: int, version: int | None = None) -> bool:
    """Apply answers (event_id, provider_id, id, accept, ts) to notifications as one version of the bookings.

    As ``notifications.notification_events`` and ``publish_status``. Ids are places, which move as bookings
    come: ``version`` is the one whose feeds were answered. An answer to a place that is not there does nothing.
    """
    if store.manifest().has("answers", batch):
        return False
    behind = bookings_at(*_feed_tables(store, version), answers)
    targets = behind.select("provider_id", F.col("notice_id").alias("id"), F.col("id").alias("booking_id"))
    return publish_status(store, notification_events(answers, targets), batch, source="answers")


def _latest(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return last_event(events, key, [*columns, "event_id"]).withColumnRenamed(key, "id")
