"""Queries over versioned tables: batches of events published one after another, one of them twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.operators import feed, published
from bazaarflow.plans.catalog import query, time_sql
from bazaarflow.plans.folds import _COMPLETIONS, _LATEST_STATUS
from bazaarflow.plans.reads import _FEED_CTES, ROLLUP_MONTH
from bazaarflow.session import materialise, scratch_path

_LATEST_RATING = """latest_rating AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM booking_rating_events) WHERE rn = 1)"""


def _store(t, *names):
    store = published.open_store(t.spark, scratch_path(t.spark, "store"))
    published.load_tables(store, {n: t("providers_core" if n == "providers" else n) for n in names})
    return store


def _in_batches(events, publish, parts=3):
    """Neighbouring event ids fall into different batches, so batches overlap in time; the second comes twice."""
    for batch in (0, 1, 1, 2):
        publish(events.where(F.col("event_id") % parts == batch), batch)


@query("status_folds_published", "bookings booking_status_events", f"""
SELECT b.id, coalesce(e.status, b.status) AS status, {time_sql('coalesce(e.ts, b.updated_at)')} AS updated_at
FROM bookings b LEFT JOIN latest e ON b.id = e.booking_id""", ctes=_LATEST_STATUS)
def _(t):
    store = _store(t, "bookings")
    _in_batches(t("booking_status_events"), lambda e, n: published.publish_status(store, e, n))
    return store.read("bookings").select("id", "status", "updated_at")


@query("providers_published", "providers_core bookings booking_status_events provider_status_events", f"""
SELECT p.id, coalesce(e.status, p.status) AS status, CASE WHEN e.status IS NULL THEN p.verified ELSE e.status = 'active' END AS verified,
 CAST(c.completions AS bigint) AS completed_jobs
FROM providers_core p LEFT JOIN decided e ON p.id = e.provider_id LEFT JOIN done c ON p.id = c.provider_id""", ctes=f"""decided AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM provider_status_events WHERE status IN ('pending', 'active', 'suspended')) WHERE rn = 1),
done AS ({_COMPLETIONS})""")
def _(t):
    store = _store(t, "bookings", "providers")
    _in_batches(t("booking_status_events"), lambda e, n: published.publish_status(store, e, n, count_completions=True))
    _in_batches(t("provider_status_events"), lambda e, n: published.publish_provider_status(store, e, n), parts=3)
    return store.read("providers").select("id", "status", "verified", "completed_jobs")


@query("provider_rollup_maintained", "bookings booking_status_events booking_rating_events", f"""
SELECT provider_id, count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
 CAST(coalesce(sum(price) FILTER (WHERE status = 'completed' AND strftime(booking_date, '%Y-%m') = '{ROLLUP_MONTH}'), 0) AS double) AS monthly_earnings,
 coalesce(CAST(round(sum(CAST(rating AS decimal(24,4))) / count(rating), 2) AS double), 0) AS rating, count(rating) AS reviews_count
FROM changed WHERE provider_id IS NOT NULL GROUP BY provider_id""", ctes=f"""{_LATEST_STATUS},
{_LATEST_RATING},
changed AS (SELECT b.provider_id, b.booking_date, b.price, coalesce(s.status, b.status) AS status,
 CASE WHEN r.ts IS NULL THEN b.rating ELSE try_cast(r.rating AS decimal(38,10)) END AS rating
FROM bookings b LEFT JOIN latest s ON b.id = s.booking_id LEFT JOIN latest_rating r ON b.id = r.booking_id)""")
def _(t):
    bookings = materialise(t("bookings"), "bookings")  # read three times
    early = F.col("booking_date") < "1995-01-01"
    store = published.open_store(t.spark, scratch_path(t.spark, "store"))
    published.load_tables(store, {"bookings": bookings.where(early)})
    for batch, copies in enumerate((bookings.where(~early), bookings.where("booking_date >= '1998-01-01'"))):
        published.publish_bookings(store, copies, batch)  # the second brings nothing that is new
    _in_batches(t("booking_status_events"), lambda e, n: published.publish_status(store, e, n))
    _in_batches(t("booking_rating_events"), lambda e, n: published.publish_ratings(store, e, n))
    published.compact_counters(store, 0, folders=3)
    return published.maintained_rollup(store, ROLLUP_MONTH)


def _store_in_parts(t):
    """A store of which the later bookings were published after the first ones, in an order of their own."""
    bookings = t("bookings")
    late = F.xxhash64("id") % 3 == 0
    store = published.open_store(t.spark, scratch_path(t.spark, "store"))
    published.load_tables(store, {"bookings": bookings.where(~late)})
    published.publish_bookings(store, bookings.where(late), 0)
    return store


# Every provider asks for some places of its feed, of which a short feed does not have the last.
_ASKED = """asked AS (SELECT id AS provider_id, 1000 + (s_suppkey * 7 + k * 53) % 160 AS place, s_suppkey % 2 = 0 AS accept
FROM providers_core, (SELECT unnest([0, 1, 2]) AS k))"""


def _asked(t):
    place = F.lit(1000) + (F.col("s_suppkey") * 7 + F.col("k") * 53) % 160
    return t("providers_core").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.col("id").alias("provider_id"), place.cast("long").alias("id"), (F.col("s_suppkey") % 2 == 0).alias("accept"))


@query("notices_by_place", "bookings profiles providers_core", """
SELECT DISTINCT f.* FROM feed f JOIN asked a ON f.provider_id = a.provider_id AND f.id = a.place""", ctes=f"{_FEED_CTES},\n{_ASKED}")
def _(t):
    return published.stored_notices(_store_in_parts(t), _asked(t), t("profiles"))


@query("feed_third_page", "bookings profiles providers_core", """
SELECT f.* FROM feed f JOIN providers_core p ON f.provider_id = p.id WHERE f.id BETWEEN 1040 AND 1059""", ctes=_FEED_CTES)
def _(t):
    pages = feed.page(t("providers_core").select(F.col("id").alias("provider_id")), 40, 20)
    return published.stored_notices(_store_in_parts(t), pages, t("profiles"))


@query("answers_published", "bookings profiles providers_core", """
SELECT b.id, CASE WHEN a.provider_id IS NULL THEN b.status WHEN a.accept THEN 'accepted' ELSE 'cancelled' END AS status
FROM bookings b LEFT JOIN feed f ON b.id = f.booking_id
LEFT JOIN (SELECT DISTINCT * FROM asked) a ON f.provider_id = a.provider_id AND f.id = a.place""", ctes=f"{_FEED_CTES},\n{_ASKED}")
def _(t):
    store = _store_in_parts(t)
    answers = _asked(t).withColumns({
        "event_id": F.xxhash64("provider_id", "id"), "ts": F.lit("2025-01-01 00:00:00").cast("timestamp")})
    seen = store.manifest().version
    for _ in range(2):  # the second time does nothing
        published.publish_answers(store, answers, 0, seen)
    return store.read("bookings").select("id", "status")
