"""Streaming queries, each run over several batches of the test tables to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.plans.catalog import query, time_sql
from bazaarflow.plans.folds import (
    ACCEPTED, REJECTED, REQUEST_VIEWS, _COMPLETIONS, _LATEST_STATUS, _SCREENED, code_sql,
)
from bazaarflow.schemas import BOOKING_STATUS_EVENTS
from bazaarflow.session import scratch_path
from bazaarflow.streaming import codes, folds
from bazaarflow.streaming.batches import BATCH, read_batches


def _folders(t, name):
    base = scratch_path(t.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def _accepted_and_rejected(t, requests="booking_requests"):
    out, checkpoint = _folders(t, "requests")
    folds.accept_requests(
        t.stream(requests), t("providers_core"), t("profiles"), out, checkpoint, once=True,
    ).awaitTermination()
    return out


@query("stream_accept_bookings", REQUEST_VIEWS, ACCEPTED, ctes=_SCREENED)
def _(t):
    return t.spark.read.parquet(f"{_accepted_and_rejected(t)}/accepted").drop(BATCH)


@query("stream_reject_reasons", REQUEST_VIEWS, REJECTED, ctes=_SCREENED)
def _(t):
    return t.spark.read.parquet(f"{_accepted_and_rejected(t)}/rejected").drop(BATCH)


@query("stream_accept_resent", REQUEST_VIEWS, ACCEPTED, ctes=_SCREENED)
def _(t):
    return t.spark.read.parquet(f"{_accepted_and_rejected(t, 'resent_requests')}/accepted").drop(BATCH)


@query("stream_repeated_requests", f"{REQUEST_VIEWS} resent_requests", """
SELECT request_id, count(*) - 1 AS repeats FROM resent_requests
WHERE request_id IN (SELECT request_id FROM screened WHERE reason IS NULL) GROUP BY request_id HAVING count(*) > 1""", ctes=_SCREENED)
def _(t):
    sent = read_batches(t.spark, f"{_accepted_and_rejected(t, 'resent_requests')}/repeated", folds.REPEATED)
    return sent.groupBy("request_id").agg(F.sum("repeats").alias("repeats"))


@query("stream_current_status", "booking_status_events", f"""
SELECT booking_id, status, {time_sql('ts')} AS ts, event_id FROM latest""", ctes=_LATEST_STATUS)
def _(t):
    out, checkpoint = _folders(t, "status")
    folds.track_status(t.stream("booking_status_events"), out, checkpoint, once=True).awaitTermination()
    return folds.current_status(t.spark, out)


@query("stream_completions", "bookings booking_status_events", _COMPLETIONS)
def _(t):
    out, checkpoint = _folders(t, "completions")
    folds.track_completions(t.stream("booking_status_events"), out, checkpoint, once=True).awaitTermination()
    return folds.running_completions(t.spark, out, t("bookings"))


@query("stream_without_repeats", "booking_status_events", f"""
SELECT event_id, booking_id, status, {time_sql('ts')} AS ts FROM booking_status_events""")
def _(t):
    out, checkpoint = _folders(t, "repeats")
    doubled = t.stream("booking_status_events").select(
        "*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    folds.write_stream(folds.without_repeats(doubled), out, checkpoint, once=True).awaitTermination()
    return read_batches(t.spark, out, BOOKING_STATUS_EVENTS).drop(BATCH)


# A day is written once the newest booking is a day past its end.
@query("stream_daily_totals", "booking_amounts", f"""
SELECT {time_sql("date_trunc('day', created_at)")} AS day, count(*) AS bookings, count(*) FILTER (WHERE status = 'pending') AS pending,
 CAST(coalesce(sum(price) FILTER (WHERE status = 'completed'), 0) AS double) AS revenue
FROM booking_amounts GROUP BY date_trunc('day', created_at)
HAVING date_trunc('day', created_at) + INTERVAL '1' DAY <= (SELECT max(created_at) FROM booking_amounts) - INTERVAL '1' DAY""")
def _(t):
    out, checkpoint = _folders(t, "daily")
    folds.write_stream(
        folds.daily_totals(t.stream("booking_amounts", "created_at")), out, checkpoint, once=True).awaitTermination()
    return read_batches(t.spark, out, folds.DAILY).drop(BATCH)


@query("daily_totals_corrected", "booking_amounts", f"""
SELECT {time_sql("date_trunc('day', created_at)")} AS day, count(*) AS bookings, count(*) FILTER (WHERE status = 'pending') AS pending,
 CAST(coalesce(sum(price) FILTER (WHERE status = 'completed'), 0) AS double) AS revenue
FROM booking_amounts GROUP BY date_trunc('day', created_at)""")
def _(t):
    out, checkpoint = _folders(t, "corrected")
    folds.track_daily_totals(t.stream("late_amounts", "arrived"), out, checkpoint, once=True).awaitTermination()
    revised = read_batches(t.spark, f"{out}/revisions", folds.DAILY)
    return revised.groupBy("day").agg(F.max_by(F.struct("bookings", "pending", "revenue"), BATCH).alias("last")).select(
        "day", "last.*")


@query("stream_code_match", "otp_issues otp_attempts", code_sql("verify"))
def _(t):
    out, checkpoint = _folders(t, "codes")
    codes.match_code_stream(
        t.stream("otp_events"), out, checkpoint, ttl="1 day", once=True).awaitTermination()
    return codes.outcomes(t.spark, out)
