"""Request, event, onboarding, load and code-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.functions import normalize_phone
from bazaarflow.operators import bookings as B, lifecycle as L, notifications as N, onboarding as O
from bazaarflow.operators.codes import match_codes
from bazaarflow.plans.catalog import phone_sql, query, time_sql
from bazaarflow.plans.reads import _FEED_CTES
from bazaarflow.schemas import PROVIDERS, conform
from bazaarflow.session import materialise, scratch_path
from bazaarflow.sources.loads import insert_children, insert_if_absent
from bazaarflow.sources.tables import overwrite_all, read_legacy_json, read_table, write_json

# --- booking requests -----------------------------------------------------------------------

_SCREENED = """screened AS (
SELECT r.*, p.id AS found, p.business_name, p.category, p.base_price, f.phone AS provider_phone,
 CASE WHEN role IS DISTINCT FROM 'customer' THEN 'not_a_customer'
  WHEN coalesce(r.provider_id, '') = '' OR booking_date IS NULL OR coalesce(booking_time, '') = ''
   OR coalesce(r.description, '') = '' OR coalesce(address, '') = '' THEN 'missing_field'
  WHEN length(address) < 30 THEN 'address_too_short' WHEN p.id IS NULL THEN 'provider_not_found' END AS reason
FROM booking_requests r LEFT JOIN providers_core p ON r.provider_id = p.id LEFT JOIN (SELECT id, phone FROM profiles) f ON p.id = f.id)"""
ACCEPTED = f"""
SELECT 'TF-' || (100000 + request_id) AS id, customer_id, provider_id, CAST(booking_date AS varchar) AS booking_date, booking_time,
 description, address, is_emergency, 'pending' AS status, CAST(base_price AS double) AS price, {time_sql('ts')} AS created_at,
 business_name AS provider_name, category AS provider_category, provider_phone FROM screened WHERE reason IS NULL"""
REJECTED = f"""
SELECT request_id, customer_id, provider_id, role, {time_sql('ts')} AS ts, reason FROM screened WHERE reason IS NOT NULL"""
REQUEST_VIEWS = "booking_requests providers_core profiles"


def _screen(t):
    return L.accept_bookings(t("booking_requests"), t("providers_core"), t("profiles"))


@query("accept_bookings", REQUEST_VIEWS, ACCEPTED, ctes=_SCREENED)
def _(t):
    return _screen(t).accepted


@query("reject_reasons", REQUEST_VIEWS, REJECTED, ctes=_SCREENED)
def _(t):
    return _screen(t).rejected


@query("reject_reasons_strict", REQUEST_VIEWS, REJECTED, ctes=_SCREENED.replace(
    "'provider_not_found' END", "'provider_not_found' WHEN p.status <> 'active' THEN 'provider_inactive' END"))
def _(t):
    return L.accept_bookings(
        t("booking_requests"), t("providers_core"), t("profiles"), strict=True).rejected


# --- status, completion, rating and approval events -----------------------------------------

_KNOWN = "('pending', 'accepted', 'in-progress', 'completed', 'cancelled')"
_LATEST_STATUS = f"""latest AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM booking_status_events WHERE status IN {_KNOWN}) WHERE rn = 1)"""


@query("apply_status", "bookings booking_status_events", f"""
SELECT b.id, coalesce(e.status, b.status) AS status, {time_sql('coalesce(e.ts, b.updated_at)')} AS updated_at
FROM bookings b LEFT JOIN latest e ON b.id = e.booking_id""", ctes=_LATEST_STATUS)
def _(t):
    return L.apply_status(t("bookings"), t("booking_status_events")).rows.select(
        "id", "status", "updated_at")


@query("status_events_without_effect", "bookings booking_status_events", f"""
SELECT event_id, 'unmatched' AS why FROM booking_status_events e ANTI JOIN bookings b ON e.booking_id = b.id
 WHERE status IN {_KNOWN}
UNION ALL SELECT event_id, 'invalid' FROM booking_status_events WHERE status IS NULL OR status NOT IN {_KNOWN}""")
def _(t):
    folded = L.apply_status(t("bookings"), t("booking_status_events"))
    return folded.unmatched.select("event_id", F.lit("unmatched").alias("why")).unionByName(
        folded.invalid.select("event_id", F.lit("invalid").alias("why")))


_OWNERS_STATUS = f"""own AS (SELECT e.* FROM sent_status_events e JOIN bookings b ON e.booking_id = b.id AND e.actor_id = b.provider_id WHERE e.status IN {_KNOWN}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, event_id DESC) AS rn FROM own) WHERE rn = 1)"""


def _owned_status(t):
    return L.apply_status(t("bookings"), t("sent_status_events"), enforce_owner=True)


@query("apply_owners_status", "bookings sent_status_events", """
SELECT b.id, coalesce(e.status, b.status) AS status FROM bookings b LEFT JOIN latest e ON b.id = e.booking_id""", ctes=_OWNERS_STATUS)
def _(t):
    return _owned_status(t).rows.select("id", "status")


@query("status_events_of_strangers", "bookings sent_status_events", f"""
SELECT e.event_id, e.actor_id FROM sent_status_events e JOIN bookings b ON e.booking_id = b.id
WHERE e.status IN {_KNOWN} AND e.actor_id IS DISTINCT FROM b.provider_id OR e.status IN {_KNOWN} AND e.actor_id IS NULL""")
def _(t):
    return _owned_status(t).foreign.select("event_id", "actor_id")


@query("ratings_of_strangers", "bookings sent_rating_events", """
SELECT e.event_id, e.actor_id FROM sent_rating_events e JOIN bookings b ON e.booking_id = b.id
WHERE e.actor_id IS NULL OR e.actor_id IS DISTINCT FROM b.customer_id""")
def _(t):
    return L.apply_ratings(t("bookings"), t("sent_rating_events"), enforce_owner=True).foreign.select("event_id", "actor_id")


_COMPLETIONS = """
SELECT provider_id, count(*) AS completions FROM booking_status_events e JOIN bookings b ON e.booking_id = b.id
WHERE e.status = 'completed' AND provider_id IS NOT NULL GROUP BY provider_id"""


@query("completion_counts", "bookings booking_status_events", _COMPLETIONS)
def _(t):
    return L.completion_counts(t("booking_status_events"), t("bookings"))


@query("completed_bookings_per_provider", "bookings booking_status_events",
       _COMPLETIONS.replace("count(*)", "count(DISTINCT booking_id)"))
def _(t):
    return L.completion_counts(t("booking_status_events"), t("bookings"), distinct_bookings=True)


@query("apply_completions", "providers_stored booking_status_events", """
SELECT p.id, CASE WHEN c.completions IS NULL THEN p.completed_jobs ELSE coalesce(p.completed_jobs, 0) + c.completions END AS completed_jobs
FROM providers_stored p LEFT JOIN added c ON p.id = c.provider_id""", ctes=f"added AS ({_COMPLETIONS})")
def _(t):
    counts = L.completion_counts(t("booking_status_events"), t("bookings"))
    return L.apply_completions(t("providers_stored"), counts).select("id", "completed_jobs")


@query("apply_ratings", "bookings booking_rating_events", f"""
SELECT b.id, CAST(CASE WHEN e.ts IS NULL THEN b.rating ELSE try_cast(e.rating AS decimal(38,10)) END AS double) AS rating,
 CASE WHEN e.ts IS NULL THEN b.review_text ELSE e.review END AS review_text,
 {time_sql('coalesce(e.ts, b.updated_at)')} AS updated_at
FROM bookings b LEFT JOIN latest e ON b.id = e.booking_id""", ctes="""latest AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM booking_rating_events) WHERE rn = 1)""")
def _(t):
    return L.apply_ratings(t("bookings"), t("booking_rating_events")).rows.select(
        "id", "rating", "review_text", "updated_at")


@query("approve_providers", "providers_core provider_status_events", """
SELECT p.id, coalesce(e.status, p.status) AS status, CASE WHEN e.status IS NULL THEN p.verified ELSE e.status = 'active' END AS verified
FROM providers_core p LEFT JOIN latest e ON p.id = e.provider_id""", ctes="""latest AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM provider_status_events WHERE status IN ('pending', 'active', 'suspended')) WHERE rn = 1)""")
def _(t):
    return L.apply_provider_status(t("providers_core"), t("provider_status_events")).rows.select(
        "id", "status", "verified")


@query("approval_events_without_effect", "providers_core provider_status_events", """
SELECT event_id, 'unmatched' AS why FROM provider_status_events e ANTI JOIN providers_core p ON e.provider_id = p.id
 WHERE status IN ('pending', 'active', 'suspended')
UNION ALL SELECT event_id, 'invalid' FROM provider_status_events WHERE status NOT IN ('pending', 'active', 'suspended')""")
def _(t):
    folded = L.apply_provider_status(t("providers_core"), t("provider_status_events"))
    return folded.unmatched.select("event_id", F.lit("unmatched").alias("why")).unionByName(
        folded.invalid.select("event_id", F.lit("invalid").alias("why")))


@query("notification_answers", "bookings profiles", """
SELECT b.id, CASE WHEN f.booking_id IS NULL THEN b.status WHEN contains(f.message, '1-URGENT') THEN 'accepted' ELSE 'cancelled' END AS status
FROM bookings b LEFT JOIN (SELECT * FROM feed WHERE action_required) f ON b.id = f.booking_id""", ctes=_FEED_CTES)
def _(t):
    work = B.provider_bookings(t("bookings"), t("profiles"))
    # Written once, since it is both where answers come from and what they are matched with.
    feed = materialise(N.notifications(work), "feed")
    answers = feed.where("action_required").select(
        F.xxhash64("provider_id", "id").alias("event_id"), "provider_id", "id",
        F.contains("message", F.lit("1-URGENT")).alias("accept"),
        F.lit("2025-01-01 00:00:00").cast("timestamp").alias("ts"))
    events = N.notification_events(answers, feed)
    return L.apply_status(t("bookings"), events).rows.select("id", "status")


# --- registration and onboarding ------------------------------------------------------------

_CANON = phone_sql("phone")
_REGISTERED = f"""canonical AS (SELECT * REPLACE ({_CANON} AS phone) FROM customer_applications),
created AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY app_id) AS rn
 FROM canonical WHERE phone NOT IN (SELECT phone FROM profiles WHERE phone IS NOT NULL)) WHERE rn = 1)"""


def _register(t):
    return O.register_customers(t("customer_applications"), t("profiles"))


@query("register_customers", "customer_applications profiles", """
SELECT 'CA-' || app_id AS id, first_name, last_name, phone, 'customer' AS role, area, TRUE AS phone_verified FROM created""",
       ctes=_REGISTERED)
def _(t):
    return _register(t).profiles.drop("created_at")


@query("registration_rejects", "customer_applications profiles", """
SELECT app_id, phone, 'phone_exists' AS reason FROM canonical WHERE app_id NOT IN (SELECT app_id FROM created)""",
       ctes=_REGISTERED)
def _(t):
    return _register(t).rejected


@query("existing_accounts", "customer_applications profiles", f"""
SELECT app_id, phone FROM (SELECT app_id, {_CANON} AS phone FROM customer_applications) a
WHERE EXISTS (SELECT 1 FROM profiles f WHERE f.phone = a.phone AND f.role = 'customer')""")
def _(t):
    requests = t("customer_applications").withColumn("role", F.lit("customer"))
    return O.existing_accounts(requests, t("profiles"), same_role=True).select("app_id", "phone")


_JUDGED = f"""apps AS (SELECT * REPLACE ({_CANON} AS phone) FROM provider_applications),
owned AS (SELECT a.*, f.id AS owner_id, CASE WHEN f.role = 'provider' THEN 'already_provider' WHEN f.role = 'admin' THEN 'admin_phone'
  WHEN full_name IS NULL THEN 'missing_name' WHEN length(experience) > 28 THEN 'number_too_long' END AS problem
 FROM apps a LEFT JOIN (SELECT id, phone, role FROM profiles WHERE phone IS NOT NULL) f ON a.phone = f.phone),
judged AS (SELECT o.*, coalesce(problem, CASE WHEN row_number() OVER (PARTITION BY phone, problem IS NULL ORDER BY app_id) > 1
  THEN 'already_provider' WHEN owner_id IS NOT NULL THEN 'upgrade' ELSE 'new' END) AS outcome FROM owned o)"""
_FIRST = "split_part(full_name, ' ', 1)"
_LAST = "CASE WHEN contains(full_name, ' ') THEN full_name[instr(full_name, ' ') + 1:] ELSE '' END"
_CATEGORY_LIST = "CASE WHEN categories LIKE '[%' THEN CAST(categories::json AS varchar[]) ELSE [] END"
_ONBOARD_VIEWS = "provider_applications profiles"


def _onboard(t):
    return O.onboard_providers(t("provider_applications"), t("profiles"))


@query("onboard_new_profiles", _ONBOARD_VIEWS, f"""
SELECT 'PA-' || app_id AS id, {_FIRST} AS first_name, {_LAST} AS last_name, phone, 'provider' AS role, TRUE AS phone_verified
FROM judged WHERE outcome = 'new'""", ctes=_JUDGED)
def _(t):
    return _onboard(t).new_profiles.drop("profile_photo_url", "created_at")


@query("onboard_upgraded_profiles", _ONBOARD_VIEWS, f"""
SELECT owner_id AS id, {_FIRST} AS first_name, {_LAST} AS last_name, phone, 'provider' AS role FROM judged WHERE outcome = 'upgrade'""",
       ctes=_JUDGED)
def _(t):
    return _onboard(t).upgraded_profiles.drop("profile_photo_url", "updated_at")


@query("onboard_providers", _ONBOARD_VIEWS, f"""
SELECT coalesce(owner_id, 'PA-' || app_id) AS id, full_name AS business_name,
 CASE WHEN len({_CATEGORY_LIST}) > 0 THEN ({_CATEGORY_LIST})[1] ELSE 'General' END AS category,
 CAST(coalesce(try_cast(experience AS decimal(38,10)), 0) AS double) AS experience,
 CAST(coalesce(try_cast(price_min AS decimal(38,10)), 0) AS double) AS base_price,
 array_to_string({_CATEGORY_LIST}, '|') AS skills, array_to_string(CAST(areas_served::json AS varchar[]), '|') AS areas_served,
 id_proof_type, FALSE AS emergency_available, 'pending' AS status
FROM judged WHERE outcome IN ('new', 'upgrade')""", ctes=_JUDGED)
def _(t):
    return _onboard(t).providers.drop("id_proof_url", "about_bio")


@query("onboard_rejects", _ONBOARD_VIEWS, """
SELECT app_id, phone, outcome AS reason FROM judged WHERE outcome NOT IN ('new', 'upgrade')""", ctes=_JUDGED)
def _(t):
    return _onboard(t).rejected


@query("profiles_after_onboarding", _ONBOARD_VIEWS, f"""
SELECT f.id, CASE WHEN j.app_id IS NULL THEN f.first_name ELSE {_FIRST} END AS first_name,
 CASE WHEN j.app_id IS NULL THEN f.last_name ELSE {_LAST} END AS last_name, f.phone,
 CASE WHEN j.app_id IS NULL THEN f.role ELSE 'provider' END AS role,
 CASE WHEN j.app_id IS NULL THEN f.profile_photo_url END AS profile_photo_url
FROM profiles f LEFT JOIN (SELECT * FROM judged WHERE outcome = 'upgrade') j ON f.id = j.owner_id
UNION ALL SELECT 'PA-' || app_id, {_FIRST}, {_LAST}, phone, 'provider', NULL FROM judged WHERE outcome = 'new'""", ctes=_JUDGED)
def _(t):
    merged = O.merge_profiles(t("profiles"), _onboard(t))
    return merged.select("id", "first_name", "last_name", "phone", "role", "profile_photo_url")


@query("application_issues", "provider_applications", f"""
SELECT app_id, array_to_string(list_filter([
 CASE WHEN coalesce(full_name, '') = '' THEN 'name' END, CASE WHEN coalesce(phone, '') = '' THEN 'phone' END,
 CASE WHEN NOT coalesce(password_given, FALSE) THEN 'password' END, CASE WHEN NOT coalesce(otp_verified, FALSE) THEN 'otp' END,
 CASE WHEN len({_CATEGORY_LIST}) = 0 THEN 'category' END, CASE WHEN NOT coalesce(agree_terms, FALSE) THEN 'terms' END,
 CASE WHEN coalesce(id_proof_type, '') = '' THEN 'id_proof_type' END, CASE WHEN id_proof_bytes IS NULL THEN 'id_proof_file' END,
 CASE WHEN photo_bytes IS NULL THEN 'profile_photo' END, CASE WHEN id_proof_bytes > 3145728 THEN 'id_proof_size' END,
 CASE WHEN photo_bytes > 3145728 THEN 'photo_size' END], lambda x: x IS NOT NULL), '|') AS issues
FROM provider_applications""")
def _(t):
    return O.application_issues(t("provider_applications")).select("app_id", "issues")


# --- repeatable loads -----------------------------------------------------------------------

@query("insert_if_absent", "customer_applications profiles", """
SELECT app_id, phone FROM created""", ctes=_REGISTERED)
def _(t):
    incoming = t("customer_applications").withColumn("phone", normalize_phone(F.col("phone")))
    return insert_if_absent(
        t("profiles"), incoming, ["phone"], [F.col("app_id")]).select("app_id", "phone")


@query("insert_children", "customer_applications provider_applications profiles", f"""
SELECT 'CA-' || c.app_id AS id, d.app_id AS detail_id FROM created c
JOIN (SELECT app_id, {_CANON} AS phone FROM provider_applications) d ON c.phone = d.phone""", ctes=_REGISTERED)
def _(t):
    details = t("provider_applications").select(
        F.col("app_id").alias("detail_id"), normalize_phone(F.col("phone")).alias("phone"))
    return insert_children(_register(t).profiles, details)


@query("tables_written_and_read", "profiles providers_stored bookings", """
SELECT 'profiles' AS source, id, role AS kind, phone_verified AS flag, NULL AS number FROM profiles UNION ALL
SELECT 'providers', id, status, is_available, coalesce(total_jobs, 0) FROM providers_stored UNION ALL
SELECT 'bookings', id, status, is_emergency, CAST(price AS double) FROM bookings""")
def _(t):
    folder = scratch_path(t.spark, "tables")
    overwrite_all({
        "bookings": t("bookings"), "profiles": t("profiles"), "providers": t("providers_stored")}, folder)
    columns = {
        "profiles": ("role", "phone_verified", F.lit(None)),
        "providers": ("status", "is_available", F.col("total_jobs")),
        "bookings": ("status", "is_emergency", F.col("price")),
    }
    parts = [
        read_table(t.spark, f"{folder}/{name}", name).select(
            F.lit(name).alias("source"), "id", F.col(kind).alias("kind"), F.col(flag).alias("flag"),
            number.cast("double").alias("number"))
        for name, (kind, flag, number) in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("json_written_and_read", "providers_stored", """
SELECT id, business_name, status, CAST(base_price AS double) AS base_price, total_jobs,
 CAST(joined_date AS varchar) AS joined_date FROM providers_stored""")
def _(t):
    path = scratch_path(t.spark, "json")
    write_json(conform(t("providers_stored"), "providers"), path)
    back = t.spark.read.schema(PROVIDERS).json(path)
    return back.select("id", "business_name", "status", "base_price", "total_jobs", "joined_date")


@query("legacy_json_read", "providers_core", """
SELECT id, business_name, status, CAST(base_price AS double) AS base_price FROM providers_core""")
def _(t):
    """Arrays of a hundred providers per file, a file that does not parse and a path that is absent."""
    path = scratch_path(t.spark, "legacy")
    rows = conform(t("providers_core"), "providers").withColumn(
        "part", F.floor(F.substring("id", 2, 20).cast("bigint") / 100))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*PROVIDERS.names))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).mode("append").text(path)
    t.spark.createDataFrame([("[{",)], "value string").write.mode("append").text(path)
    found = read_legacy_json(t.spark, path, PROVIDERS)
    absent = read_legacy_json(t.spark, f"{path}-none", PROVIDERS)
    return found.unionByName(absent).select("id", "business_name", "status", "base_price")


# --- one-time codes -------------------------------------------------------------------------

def code_sql(kind: str) -> str:
    """Outcome SQL; the fixture's codes live one day."""
    purpose = {
        "verify": "(coalesce(ip, '') = '' OR ip IS NOT DISTINCT FROM purpose)",
        "login": "TRUE",
        "reset": "(ip IS NOT DISTINCT FROM 'forgot_password')",
    }[kind]
    account = "phone IN (SELECT phone FROM accounts)" if kind == "reset" else "TRUE"
    ends_late = "raw = phone" if kind == "verify" else "FALSE"
    canonical = phone_sql("phone")
    return f"""
SELECT * FROM (WITH u AS (SELECT phone AS raw, {canonical} AS phone, ts, event_id, code, purpose, 1 AS is_issue FROM otp_issues
 UNION ALL SELECT phone, {canonical}, ts, event_id, code, purpose, 0 FROM otp_attempts),
n AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY ts, event_id) AS seq,
 sum(is_issue) OVER (PARTITION BY phone ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS issue_no FROM u),
m AS (SELECT a.*, i.ts AS its, i.code AS icode, i.purpose AS ip FROM n a LEFT JOIN n i ON i.phone = a.phone AND i.issue_no = a.issue_no AND i.is_issue = 1 WHERE a.is_issue = 0),
j AS (SELECT *, {purpose} AS good_purpose, {account} AS has_account, ts > its + INTERVAL '1' DAY AS late FROM m),
k AS (SELECT *, min(CASE WHEN its IS NOT NULL AND (late AND {ends_late} OR NOT late AND code = icode AND good_purpose AND has_account) THEN seq END)
 OVER (PARTITION BY phone, issue_no) AS last_seq FROM j)
SELECT event_id, phone, {time_sql('ts')} AS ts, CASE WHEN its IS NULL OR seq > last_seq THEN 'not_requested' WHEN late THEN 'expired'
 WHEN seq = last_seq THEN 'ok' WHEN code <> icode THEN 'invalid' WHEN NOT good_purpose THEN 'purpose_mismatch'
 ELSE 'no_account' END AS outcome FROM k)"""


def _match(t, kind):
    profiles = t("accounts") if kind == "reset" else None
    return match_codes(t("otp_issues"), t("otp_attempts"), ttl="1 day", kind=kind, profiles=profiles)


@query("code_match", "otp_issues otp_attempts", code_sql("verify"))
def _(t):
    return _match(t, "verify")


@query("code_match_login", "otp_issues otp_attempts", code_sql("login"))
def _(t):
    return _match(t, "login")


@query("code_match_reset", "otp_issues otp_attempts accounts", code_sql("reset"))
def _(t):
    return _match(t, "reset")
