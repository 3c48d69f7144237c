"""The marketplace tables as SQL views over the star-schema test tables.

One text serves both engines. ``{S}`` is the string type, ``{LIST(x)}`` a sorted list of a
column, and a table in braces its source. Nulls and irregular values are planted throughout, so
that the fallbacks have work to do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.session import child_names, scratch_path

ROWS_PER_FILE = 200_000
BASE_TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events")

VIEWS = {
    "profiles": """
SELECT concat('C', CAST(c_custkey AS {S})) AS id, 'Customer' AS first_name,
 CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE substr(c_name, 10) END AS last_name,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('c', CAST(c_custkey AS {S}), '@example.com') END AS email,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('+91 ', CAST(7000000000 + c_custkey AS {S})) END AS phone,
 'customer' AS role, c_mktsegment AS area, c_custkey % 2 = 0 AS phone_verified,
 CASE WHEN c_custkey % 4 = 0 THEN concat('/photos/c', CAST(c_custkey AS {S})) END AS profile_photo_url,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(concat('2023-0', CAST(1 + c_custkey % 9 AS {S}), '-15 08:30:00') AS timestamp) END AS created_at
FROM {customer}
UNION ALL
SELECT concat('P', CAST(s_suppkey AS {S})), 'Supplier', substr(s_name, 10),
 CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('p', CAST(s_suppkey AS {S}), '@example.com') END,
 concat('+91 ', CAST(8000000000 + s_suppkey AS {S})), 'provider', n_name, TRUE,
 CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('/photos/p', CAST(s_suppkey AS {S})) END,
 CAST(concat('2022-0', CAST(1 + s_suppkey % 9 AS {S}), '-20 09:00:00') AS timestamp)
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",

    # Providers without the list of areas, which only some queries read.
    "providers_core": """
SELECT concat('P', CAST(s_suppkey AS {S})) AS id, s_suppkey,
 CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE s_name END AS business_name,
 CASE s_suppkey % 7 WHEN 0 THEN 'Electrician' WHEN 1 THEN 'Plumber' WHEN 2 THEN 'AC Repair' WHEN 3 THEN 'Appliance'
  WHEN 4 THEN 'Painting' WHEN 5 THEN 'Carpentry' ELSE 'Driver' END AS category,
 CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 15 AS decimal(5,1)) END AS experience,
 s_suppkey % 10 < 7 AS verified,
 CASE WHEN s_suppkey % 10 < 7 THEN 'active' WHEN s_suppkey % 10 < 9 THEN 'pending' ELSE 'suspended' END AS status,
 s_suppkey % 3 = 0 AS emergency_available, s_suppkey % 4 <> 0 AS is_available,
 CASE WHEN s_suppkey % 31 = 0 THEN NULL ELSE CAST(s_acctbal AS decimal(12,2)) END AS base_price, '/hr' AS price_unit,
 CASE WHEN s_suppkey % 33 = 0 THEN NULL ELSE CAST((s_suppkey % 21) / 10.0 + 3 AS decimal(3,1)) END AS rating,
 CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(concat('2024-0', CAST(1 + s_suppkey % 9 AS {S}), '-05') AS date) END AS joined_date,
 CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 8 = 1 THEN '' ELSE 'Passport' END AS id_proof_type,
 CASE WHEN s_suppkey % 8 < 4 THEN NULL ELSE concat('ID', CAST(s_suppkey AS {S})) END AS id_proof_number,
 CASE WHEN s_suppkey % 8 < 4 THEN '' ELSE concat('/proofs/', CAST(s_suppkey AS {S})) END AS id_proof_url,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('About ', s_name) END AS about_bio,
 s_name AS description
FROM {supplier}""",

    # Areas: nations of customers with an urgent order of which the supplier's part came back.
    "providers": """
SELECT p.*, CASE WHEN p.s_suppkey % 11 = 0 THEN NULL ELSE a.areas END AS areas_served
FROM {providers_core} p LEFT JOIN (
 SELECT l_suppkey, {LIST(n_name)} AS areas FROM (
  SELECT DISTINCT l_suppkey, n_name FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R') x GROUP BY l_suppkey) a
ON p.s_suppkey = a.l_suppkey""",

    "bookings": """
SELECT concat('TF-', CAST(o_orderkey AS {S})) AS id, concat('C', CAST(o_custkey AS {S})) AS customer_id,
 CASE WHEN p.k IS NULL THEN NULL ELSE concat('P', CAST(p.k AS {S})) END AS provider_id,
 CAST(o_orderdate AS date) AS booking_date,
 CASE o_orderkey % 4 WHEN 0 THEN '09:00 AM' WHEN 1 THEN '12:00 PM' WHEN 2 THEN '03:00 PM' ELSE NULL END AS booking_time,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS description,
 concat('No. 12, Long Street, Old Town, ', o_orderpriority) AS address,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'cancelled' ELSE 'pending' END
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'in-progress' END END AS status,
 o_orderpriority = '1-URGENT' AS is_emergency, CAST(o_totalprice AS decimal(14,2)) AS price,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 5 AS decimal(12,2)) END AS rating,
 CAST(NULL AS {S}) AS review_text,
 CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE CAST(o_orderdate AS timestamp) END AS created_at,
 CAST(NULL AS timestamp) AS updated_at
FROM {orders} LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM {lineitem} GROUP BY l_orderkey) p
ON o_orderkey = p.l_orderkey""",

    # Providers with stored counters that were last brought up to date at the end of 1997.
    "providers_stored": """
SELECT p.*, c.total_jobs, c.completed_jobs, c.monthly_earnings, c.reviews_count
FROM {providers_core} p LEFT JOIN (
 SELECT provider_id, CAST(count(*) AS bigint) AS total_jobs,
  CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS bigint) AS completed_jobs,
  CAST(sum(CASE WHEN status = 'completed' AND booking_date >= DATE '1997-12-01' THEN price END) AS decimal(14,2)) AS monthly_earnings,
  CAST(count(rating) AS bigint) AS reviews_count
 FROM {bookings} WHERE booking_date < DATE '1998-01-01' AND provider_id IS NOT NULL GROUP BY provider_id) c
ON p.id = c.provider_id""",

    "booking_status_events": """
SELECT event_id, concat('TF-', CAST(user_id AS {S})) AS booking_id,
 CASE WHEN event_id % 101 = 0 THEN 'rejected' ELSE CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'accepted'
  WHEN 'signup' THEN 'in-progress' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END END AS status,
 CAST(ts AS timestamp) AS ts FROM {events}""",

    # Who sent an event: the owner, someone else or nobody.
    "sent_status_events": """
SELECT e.event_id, e.booking_id, e.status, e.ts, CASE e.event_id % 3 WHEN 0 THEN 'P1' WHEN 1 THEN b.provider_id END AS actor_id
FROM {booking_status_events} e LEFT JOIN {bookings} b ON e.booking_id = b.id""",

    "sent_rating_events": """
SELECT e.event_id, e.booking_id, e.rating, e.review, e.ts, CASE e.event_id % 3 WHEN 0 THEN 'C1' WHEN 1 THEN b.customer_id END AS actor_id
FROM {booking_rating_events} e LEFT JOIN {bookings} b ON e.booking_id = b.id""",

    "booking_rating_events": """
SELECT event_id, concat('TF-', CAST(user_id AS {S})) AS booking_id,
 CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CASE WHEN event_id % 11 = 0 THEN '12345678901.5' ELSE CAST(1 + event_id % 5 AS {S}) END END AS rating, event_type AS review,
 CAST(ts AS timestamp) AS ts FROM {events} WHERE event_type = 'purchase'""",

    "provider_status_events": """
SELECT event_id, concat('P', CAST(user_id AS {S})) AS provider_id,
 CASE WHEN event_id % 17 = 0 THEN 'rejected' WHEN event_type = 'signup' THEN 'active' ELSE 'suspended' END AS status,
 CAST(ts AS timestamp) AS ts FROM {events} WHERE event_type IN ('signup', 'error')""",

    "booking_requests": """
SELECT o_orderkey AS request_id, concat('C', CAST(o_custkey AS {S})) AS customer_id,
 CASE WHEN o_orderkey % 23 = 0 THEN 'provider' ELSE 'customer' END AS role,
 concat('P', CAST(o_orderkey % 1100 AS {S})) AS provider_id, CAST(o_orderdate AS date) AS booking_date,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE '10:00 AM' END AS booking_time, o_orderpriority AS description,
 CASE WHEN o_orderkey % 29 = 0 THEN 'short' ELSE concat('No. 12, Long Street, Old Town, ', o_orderpriority) END AS address,
 o_orderpriority = '1-URGENT' AS is_emergency, CAST(o_orderdate AS timestamp) AS ts FROM {orders}""",

    # One request in fifty is sent again, some in the same batch and most of them in a later one.
    "resent_requests": """
SELECT * FROM {booking_requests}
UNION ALL SELECT request_id, customer_id, role, provider_id, booking_date, booking_time, description, address, is_emergency,
 ts + INTERVAL '90' DAY FROM {booking_requests} WHERE request_id % 50 = 7
UNION ALL SELECT request_id, customer_id, role, provider_id, booking_date, booking_time, description, address, is_emergency,
 ts + INTERVAL '900' DAY FROM {booking_requests} WHERE request_id % 100 = 7""",

    "customer_applications": """
SELECT c_custkey AS app_id, 'New' AS first_name, c_name AS last_name,
 CASE c_custkey % 4 WHEN 0 THEN CAST(7000000000 + c_custkey AS {S}) WHEN 1 THEN concat('+91', CAST(6000000000 + c_custkey % 400 AS {S}))
  WHEN 2 THEN concat('91-', CAST(6000000000 + c_custkey % 400 AS {S})) ELSE '12345' END AS phone, c_mktsegment AS area FROM {customer}""",

    "provider_applications": """
SELECT c_custkey AS app_id, CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_name ELSE concat('Ann ', c_name, ' B') END AS full_name,
 CASE c_custkey % 3 WHEN 0 THEN CAST(7000000000 + c_custkey AS {S}) WHEN 1 THEN CAST(8000000000 + c_custkey % 120 AS {S})
  ELSE CAST(6500000000 + c_custkey % 900 AS {S}) END AS phone,
 CASE WHEN c_custkey % 9 = 0 THEN 'five' WHEN c_custkey % 17 = 0 THEN '99999' WHEN c_custkey % 19 = 0 THEN '12345678901234567890123456789'
  ELSE CAST(c_custkey % 20 AS {S}) END AS experience,
 CASE c_custkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN 'Plumber' ELSE '["Plumber","Painting"]' END AS categories,
 '["MACHINERY","BUILDING"]' AS areas_served, CASE WHEN c_custkey % 23 = 0 THEN '12345678901.5' ELSE CAST(c_acctbal AS {S}) END AS price_min,
 c_custkey % 6 <> 0 AS otp_verified, c_custkey % 10 <> 0 AS agree_terms, TRUE AS password_given,
 CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'Passport' END AS id_proof_type,
 CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_custkey * 4000 END AS id_proof_bytes,
 CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 1000 END AS photo_bytes FROM {customer}""",

    "otp_issues": """
SELECT event_id, concat('+91 ', CAST(9000000000 + user_id AS {S})) AS phone, CAST(user_id % 3 AS {S}) AS code,
 CASE WHEN event_id % 2 = 0 THEN 'register' WHEN event_id % 7 = 0 THEN 'forgot_password' ELSE 'login' END AS purpose,
 CAST(ts AS timestamp) AS ts FROM {events} WHERE event_type = 'signup'""",

    "otp_attempts": """
SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN '+91 ' WHEN 1 THEN '+91' ELSE '' END, CAST(9000000000 + user_id AS {S})) AS phone,
 CAST(CASE WHEN event_id % 4 = 0 THEN 9 ELSE user_id % 3 END AS {S}) AS code,
 CASE WHEN event_id % 2 = 0 THEN 'register' ELSE 'login' END AS purpose,
 CAST(ts AS timestamp) AS ts FROM {events} WHERE event_type IN ('click', 'view')""",

    # Phones with an account: those of people who made a larger purchase.
    "accounts": """
SELECT DISTINCT concat('+91 ', CAST(9000000000 + user_id AS {S})) AS phone FROM {events}
WHERE event_type = 'purchase' AND value > 60""",

    # Issues and attempts as they would arrive on one stream.
    "otp_events": """
SELECT event_id, concat(CASE WHEN event_type = 'signup' OR event_id % 3 = 0 THEN '+91 ' WHEN event_id % 3 = 1 THEN '+91' ELSE '' END,
  CAST(9000000000 + user_id AS {S})) AS phone,
 CAST(CASE WHEN event_type <> 'signup' AND event_id % 4 = 0 THEN 9 ELSE user_id % 3 END AS {S}) AS code,
 CASE WHEN event_id % 2 = 0 THEN 'register' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'forgot_password' ELSE 'login' END AS purpose,
 CAST(ts AS timestamp) AS ts, event_type = 'signup' AS is_issue FROM {events} WHERE event_type IN ('signup', 'click', 'view')""",

    # What a stream of new bookings carries for the daily totals.
    "booking_amounts": """
SELECT concat('TF-', CAST(o_orderkey AS {S})) AS id, CAST(o_totalprice AS decimal(14,2)) AS price,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'accepted' END AS status,
 CAST(o_orderdate AS timestamp) AS created_at FROM {orders}""",

    # The same, with the time of arrival: one in seven comes more than a year late.
    "late_amounts": """
SELECT a.*, CASE WHEN CAST(substr(a.id, 4) AS bigint) % 7 = 0 THEN created_at + INTERVAL '400' DAY ELSE created_at END AS arrived
FROM {booking_amounts} a""",
}

_TOKEN = re.compile(r"\{(\w+)(?:\((\w+)\))?\}")


def _spark_sql(name: str, source: Callable[[str], str]) -> str:
    def fill(match: re.Match) -> str:
        word, argument = match.groups()
        if word == "S":
            return "string"
        if word == "LIST":
            return f"sort_array(collect_list({argument}))"
        if word in BASE_TABLES:
            return source(word)
        return f"({_spark_sql(word, source)})"

    return _TOKEN.sub(fill, VIEWS[name])


def _file(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}.parquet"


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The view over the parquet files of ``folder``."""
    return spark.sql(_spark_sql(name, lambda table: f"parquet.`{_file(folder, table)}`"))


def stream_view(
    spark: SparkSession, folder: str, name: str, moment: str, files: int,
) -> DataFrame:
    """The view as a stream that delivers its rows in ``files`` batches by the time column ``moment``.

    Each batch is one file per ``ROWS_PER_FILE`` rows of a mean batch, so that tasks share a large one.
    """
    rows = view(spark, folder, name)
    time = F.unix_micros(moment)
    limits, count = rows.agg(
        F.percentile_approx(time, [i / files for i in range(1, files)]), F.count(F.lit(1))).first()  # one row
    parts = max(1, math.ceil(count / files / ROWS_PER_FILE))
    target = scratch_path(spark, f"stream-{name}")
    bounds = [None, *sorted(set(limits or [])), None]
    for number, (low, high) in enumerate(zip(bounds, bounds[1:]), 1):
        inside = (F.lit(True) if low is None else time > low) & (F.lit(True) if high is None else time <= high)
        undated = F.col(moment).isNull() & F.lit(low is None)
        chosen = rows.where(F.coalesce(inside, F.lit(False)) | undated)
        (chosen.repartition(parts) if parts > 1 else chosen.coalesce(1)).write.mode("append").parquet(target)
        for _ in range(number * parts - _data_files(spark, target)):  # a batch is so many files, also of few rows
            rows.limit(0).coalesce(1).write.mode("append").parquet(target)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(target)


def _data_files(spark: SparkSession, folder: str) -> int:
    return sum(n.startswith("part-") for n in child_names(spark, folder))


def _duckdb_text(name: str) -> tuple[str, list[str]]:
    used: list[str] = []

    def fill(match: re.Match) -> str:
        word, argument = match.groups()
        if word == "S":
            return "varchar"
        if word == "LIST":
            return f"list_sort(list({argument}))"
        if word not in BASE_TABLES:
            used.append(word)
        return word

    return _TOKEN.sub(fill, VIEWS[name]), used


def duckdb_ctes(*names: str) -> list[str]:
    """The views and those they build on as 'name AS (...)' texts, in order of use."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        text, used = _duckdb_text(name)
        for other in used:
            add(other)
        done[name] = f"{name} AS ({text}\n)"

    for name in names:
        add(name)
    return list(done.values())
