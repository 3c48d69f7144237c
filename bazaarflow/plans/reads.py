"""Directory, history, dashboard and quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions import (
    asset_path, capitalize, date_label, money_label, msisdn, normalize_phone, slot_minutes,
    status_label,
)
from bazaarflow.operators import (
    admin, bookings as B, directory as D, filters, notifications as N, quality as Q, rollups,
)
from bazaarflow.operators.ordered import with_position
from bazaarflow.plans.catalog import money_sql, name_sql, phone_sql, query, time_sql
from bazaarflow.schemas import conform, fill_defaults
from bazaarflow.sources.dimensions import AREAS, CATEGORIES, dim_area, dim_category
from bazaarflow.sources.tables import source_counts

ROLLUP_MONTH = "1997-05"

# --- platform -------------------------------------------------------------------------------


@query("platform_kpis", "profiles providers_core bookings", f"""
SELECT 'Total Users' AS label, CAST(count(*) AS double) AS amount, CAST(count(*) AS varchar) AS value, 'Live from DB' AS change FROM profiles
UNION ALL
SELECT 'Total Providers', CAST(count(*) AS double), CAST(count(*) AS varchar), count(*) FILTER (WHERE status = 'active') || ' active' FROM providers_core
UNION ALL
SELECT 'Total Bookings', CAST(count(*) AS double), CAST(count(*) AS varchar), count(*) FILTER (WHERE status = 'pending') || ' pending' FROM bookings
UNION ALL
SELECT 'Total Revenue', CAST(r AS double), {money_sql('r')}, 'Real-time'
FROM (SELECT coalesce(sum(price) FILTER (WHERE status = 'completed'), 0) AS r FROM bookings)""")
def _(t):
    return admin.platform_kpis(t("profiles"), t("providers_core"), t("bookings"))


@query("source_counts", "profiles providers_core bookings", """
SELECT 'profiles' AS source, count(*) AS rows FROM profiles UNION ALL
SELECT 'providers', count(*) FROM providers_core UNION ALL
SELECT 'bookings', count(*) FROM bookings""")
def _(t):
    return source_counts({
        "profiles": t("profiles"), "providers": t("providers_core"), "bookings": t("bookings")})


@query("review_queue", "providers profiles", f"""
SELECT p.id, coalesce(nullif(business_name, ''), {name_sql('first_name', 'last_name', 'f.id')}) AS name, category,
 CASE WHEN areas_served IS NOT NULL THEN array_to_string(areas_served, ', ') ELSE coalesce(nullif(area, ''), 'Not specified') END AS area,
 CAST(coalesce(experience, 0) AS double) AS experience, coalesce(nullif(phone, ''), 'Not provided') AS phone,
 coalesce(nullif(email, ''), 'Not provided') AS email, status,
 {time_sql('coalesce(CAST(joined_date AS timestamp), created_at)')} AS joined_date,
 coalesce(nullif(id_proof_type, ''), 'Unknown ID') AS id_proof_type,
 coalesce(nullif(id_proof_number, ''), '-') AS id_proof_number, nullif(id_proof_url, '') AS id_proof_url,
 '' AS skills, nullif(profile_photo_url, '') AS profile_photo, coalesce(about_bio, '') AS about_bio
FROM providers p LEFT JOIN profiles f ON p.id = f.id WHERE status = 'pending'""")
def _(t):
    return admin.review_queue(conform(t("providers"), "providers"), conform(t("profiles"), "profiles"))


@query("admin_users", "profiles", """
SELECT id, first_name, last_name, email, phone, role, area, phone_verified, profile_photo_url,
 strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, trim(concat_ws(' ', first_name, last_name)) AS name,
 coalesce(nullif(phone, ''), email) AS contact, coalesce(upper(left(nullif(first_name, ''), 1)), '?') AS initial,
 strftime(created_at, '%d/%m/%Y') AS joined FROM profiles""")
def _(t):
    return D.admin_users(t("profiles"))


# --- directory ------------------------------------------------------------------------------

_LISTED = """
SELECT p.id, business_name AS name, category, CAST(rating AS double) AS rating, CAST(base_price AS double) AS price, price_unit,
 emergency_available AS emergency, is_available AS available, f.area, array_to_string(areas_served, '|') AS areas_served,
 first_name, last_name, profile_photo_url AS profile_photo, row_number() OVER (ORDER BY %s, p.id) AS position
FROM providers p LEFT JOIN profiles f ON p.id = f.id WHERE status = 'active'"""
_BY_RATING = _LISTED % "coalesce(rating, 0) DESC"


def _directory(t, sort, **chosen):
    """The directory with each row's place, so that the order shows in an unordered comparison."""
    rows = D.provider_directory(
        conform(t("providers"), "providers"), conform(t("profiles"), "profiles"), sort=sort,
        ordered=False, **chosen)
    order = D.directory_order(sort)
    placed = with_position(rows.withColumn("base_price", F.col("price")), [], order)
    return placed.select(
        "id", "name", "category", "rating", "price", "price_unit", "emergency", "available", "area",
        "areas_served", "first_name", "last_name", "profile_photo", "position")


@query("directory_by_rating", "providers profiles", _BY_RATING)
def _(t):
    return _directory(t, "rating", category="All Services", area="All Areas", emergency="false")


@query("directory_by_price_low", "providers profiles", _LISTED % "coalesce(base_price, 0)")
def _(t):
    return _directory(t, "price-low")


@query("directory_by_price_high", "providers profiles", _LISTED % "coalesce(base_price, 0) DESC")
def _(t):
    return _directory(t, "price-high")


@query("directory_filtered", "providers profiles", _BY_RATING + """
 AND category = 'Plumber' AND list_contains(areas_served, 'NATION_3') AND emergency_available""")
def _(t):
    return _directory(t, None, category="Plumber", area="NATION_3", emergency="true")


@query("directory_text_search", "providers profiles", _BY_RATING + """
 AND (contains(lower(business_name), 'ap') OR contains(lower(category), 'ap'))""")
def _(t):
    return _directory(t, "unknown", search="aP")


@query("directory_top_20", "providers profiles", "SELECT * FROM listed WHERE position <= 20",
       ctes=f"listed AS ({_BY_RATING})")
def _(t):
    return _directory(t, "rating", limit=20)


@query("provider_detail", "providers profiles", """
SELECT p.id, business_name AS name, category, CAST(experience AS double) AS experience, CAST(rating AS double) AS rating,
 CAST(base_price AS double) AS price, emergency_available AS emergency, status, first_name, last_name, phone, email,
 profile_photo_url AS profile_photo, array_to_string(areas_served, '|') AS areas_served
FROM providers p LEFT JOIN profiles f ON p.id = f.id""")
def _(t):
    detail = D.provider_detail(conform(t("providers"), "providers"), t("profiles"))
    return detail.select(
        "id", "name", "category", "experience", "rating", "price", "emergency", "status",
        "first_name", "last_name", "phone", "email", "profile_photo", "areas_served")


_ADMIN_LIST = f"""
SELECT p.id, coalesce(nullif(business_name, ''), {name_sql('first_name', 'last_name', 'f.id')}) AS name, category,
 coalesce(nullif(phone, ''), 'Not provided') AS phone, coalesce(nullif(email, ''), 'Not provided') AS email,
 CASE WHEN len(areas_served) > 0 THEN array_to_string(areas_served, ', ') ELSE 'Not specified' END AS area, status, verified,
 CAST(experience AS double) AS experience, CAST(rating AS double) AS rating, CAST(base_price AS double) AS price,
 emergency_available, nullif(profile_photo_url, '') AS profile_photo
FROM providers p LEFT JOIN profiles f ON p.id = f.id"""


@query("admin_provider_list", "providers profiles", _ADMIN_LIST)
def _(t):
    return D.admin_provider_list(t("providers"), t("profiles"))


@query("admin_rejected_providers", "providers profiles",
       "SELECT * FROM listed WHERE status IN ('suspended', 'rejected') AND (contains(lower(name), 'supplier') OR contains(lower(category), 'supplier'))",
       ctes=f"listed AS ({_ADMIN_LIST})")
def _(t):
    return filters.admin_providers(
        D.admin_provider_list(t("providers"), t("profiles")), "rejected", "pending", "SUPPLIER")


@query("admin_active_providers", "providers profiles", "SELECT * FROM listed WHERE status = 'active'",
       ctes=f"listed AS ({_ADMIN_LIST})")
def _(t):
    return filters.admin_providers(
        D.admin_provider_list(t("providers"), t("profiles")), "providers", "active")


@query("admin_verification", "providers profiles", "SELECT * FROM listed WHERE status = 'pending'",
       ctes=f"listed AS ({_ADMIN_LIST})")
def _(t):
    return filters.admin_providers(D.admin_provider_list(t("providers"), t("profiles")), "verification")


@query("provider_statuses", "providers_core", "SELECT DISTINCT status FROM providers_core")
def _(t):
    return D.provider_statuses(t("providers_core"))


_AREA_VALUES = ", ".join(f"'{a}'" for a in AREAS)
_CATEGORY_VALUES = ", ".join(f"'{c}'" for c, _ in CATEGORIES)


@query("nonconforming_areas", "providers", f"""
SELECT id, value FROM (SELECT id, unnest(areas_served) AS value FROM providers) WHERE value NOT IN ({_AREA_VALUES})""")
def _(t):
    found = D.nonconforming(t("providers"), "areas_served", dim_area(t.spark), "name")
    return found.select("id", "value")


@query("nonconforming_categories", "providers_core", f"""
SELECT id, category AS value FROM providers_core WHERE category NOT IN ({_CATEGORY_VALUES})""")
def _(t):
    found = D.nonconforming(t("providers_core"), "category", dim_category(t.spark), "name")
    return found.select("id", "value")


# --- bookings -------------------------------------------------------------------------------

_FIELDS = f"""b.id, customer_id, provider_id, CAST(booking_date AS varchar) AS date, booking_time AS time, b.description, address,
 is_emergency, b.status, CAST(price AS double) AS price, CAST(b.rating AS double) AS rating, review_text, {time_sql('b.created_at')} AS created_at"""
_CUSTOMER = f"{name_sql('f.first_name', 'f.last_name', 'f.id')} AS customer_name"
_PROVIDER = "CASE WHEN p.id IS NOT NULL THEN business_name ELSE 'Unknown' END AS provider_name"
_STATUS_LABEL = "CASE WHEN {0} = 'cancelled' THEN 'Rejected due to unavailability' ELSE upper({0}[1]) || {0}[2:] END"
_TAB = "CASE WHEN {0} IN ('pending', 'accepted', 'in-progress') THEN 'ongoing' WHEN {0} IN ('completed', 'cancelled') THEN 'completed' END"


@query("customer_bookings", "bookings providers_core profiles", f"""
SELECT {_FIELDS}, CASE WHEN p.id IS NOT NULL THEN business_name ELSE 'Unknown Service' END AS provider_name,
 f.phone AS provider_phone, category AS provider_category, {_STATUS_LABEL.format('b.status')} AS status_label,
 {_TAB.format('b.status')} AS tab
FROM bookings b LEFT JOIN providers_core p ON b.provider_id = p.id LEFT JOIN profiles f ON p.id = f.id""")
def _(t):
    return B.customer_bookings(t("bookings"), t("providers_core"), t("profiles"))


_WORK = f"""
SELECT {_FIELDS}, {_CUSTOMER}, f.phone AS customer_phone
FROM bookings b LEFT JOIN profiles f ON b.customer_id = f.id WHERE provider_id IS NOT NULL"""


@query("provider_bookings", "bookings profiles", _WORK)
def _(t):
    return B.provider_bookings(t("bookings"), t("profiles"))


@query("masked_contacts", "bookings profiles", """
SELECT id, provider_id, status, customer_name,
 CASE WHEN status IN ('accepted', 'in-progress', 'completed') THEN customer_phone END AS customer_phone FROM work""",
       ctes=f"work AS ({_WORK})")
def _(t):
    work = B.provider_bookings(t("bookings"), t("profiles"), ordered=False)
    return B.masked_contacts(work).select(
        "id", "provider_id", "status", "customer_name", "customer_phone")


_LEDGER = f"""
SELECT {_FIELDS}, {_CUSTOMER}, {_PROVIDER}
FROM bookings b LEFT JOIN profiles f ON b.customer_id = f.id LEFT JOIN providers_core p ON b.provider_id = p.id"""


@query("booking_ledger", "bookings profiles providers_core", _LEDGER)
def _(t):
    return B.booking_ledger(t("bookings"), t("providers_core"), t("profiles"))


@query("booking_search", "bookings profiles providers_core", """
SELECT * FROM ledger WHERE contains(lower(id), 'r#00000000') OR contains(lower(customer_name), 'r#00000000')
 OR contains(lower(provider_name), 'r#00000000')""", ctes=f"ledger AS ({_LEDGER})")
def _(t):
    ledger = B.booking_ledger(t("bookings"), t("providers_core"), t("profiles"), ordered=False)
    return filters.search_bookings(ledger, "R#00000000")


@query("ongoing_bookings", "bookings", """
SELECT id, status FROM bookings WHERE status IN ('pending', 'accepted', 'in-progress')""")
def _(t):
    return filters.booking_tab(t("bookings"), "ongoing").select("id", "status")


@query("closed_bookings", "bookings", """
SELECT id, status FROM bookings WHERE status IN ('completed', 'cancelled')""")
def _(t):
    return filters.filter_status(t("bookings"), "completed", "cancelled").select("id", "status")


@query("recent_bookings_8", "bookings profiles providers_core", f"""
{_LEDGER} ORDER BY b.created_at DESC NULLS LAST, b.id LIMIT 8""")
def _(t):
    return B.recent_bookings(t("bookings"), t("providers_core"), t("profiles"))


_RANKED = f"""
SELECT {_FIELDS}, {_CUSTOMER}, f.phone AS customer_phone,
 row_number() OVER (PARTITION BY provider_id ORDER BY b.created_at DESC NULLS FIRST, b.id) AS position
FROM bookings b LEFT JOIN profiles f ON b.customer_id = f.id WHERE provider_id IS NOT NULL"""


@query("recent_10_per_provider", "bookings profiles", "SELECT * FROM ranked WHERE position <= 10",
       ctes=f"ranked AS ({_RANKED})")
def _(t):
    return B.recent_by_provider(t("bookings"), t("profiles"))


@query("dashboard_cards", "bookings profiles", """
SELECT id, provider_id, customer_name, position, strftime(CAST(date AS date), '%d/%m/%Y') AS date_label,
 CASE WHEN status IN ('accepted', 'in-progress', 'completed') THEN customer_phone END AS customer_phone
FROM ranked WHERE position <= 5""", ctes=f"ranked AS ({_RANKED})")
def _(t):
    recent = B.recent_by_provider(t("bookings"), t("profiles"))
    return B.dashboard_cards(recent).select(
        "id", "provider_id", "customer_name", "position", "date_label", "customer_phone")


@query("booking_tab_counts", "bookings", """
SELECT customer_id, count(*) AS all_bookings, count(*) FILTER (WHERE status IN ('pending', 'accepted', 'in-progress')) AS ongoing,
 count(*) FILTER (WHERE status IN ('completed', 'cancelled')) AS completed FROM bookings GROUP BY customer_id""")
def _(t):
    return B.booking_tab_counts(t("bookings"))


@query("booking_labels", "bookings", f"""
SELECT id, {_STATUS_LABEL.format('status')} AS status_label, upper(status[1]) || status[2:] AS capitalized,
 strftime(booking_date, '%d/%m/%Y') AS date_label, {money_sql('price')} AS price_label,
 CAST(epoch(strptime('1970-01-01 ' || booking_time, '%Y-%m-%d %I:%M %p')) // 60 AS bigint) AS slot_minutes FROM bookings""")
def _(t):
    return t("bookings").select(
        "id", status_label(F.col("status")).alias("status_label"),
        capitalize(F.col("status")).alias("capitalized"),
        date_label(F.col("booking_date")).alias("date_label"),
        money_label(F.col("price")).alias("price_label"),
        slot_minutes(F.col("booking_time")).alias("slot_minutes"))


# A missing name or date gives no path.
@query("asset_paths", "providers_core", """
SELECT id, 'proofs/' || id || '/' || epoch_ms(CAST(joined_date AS timestamp)) || '-' || replace(business_name, '#', '') || '.png' AS path
FROM providers_core""")
def _(t):
    return t("providers_core").select("id", asset_path(
        F.lit("proofs"), F.col("id"), F.col("joined_date").cast("timestamp"),
        F.concat(F.col("business_name"), F.lit(".png"))).alias("path"))


@query("bookings_in_scope", "bookings", """
SELECT 'customer' AS role, id FROM bookings WHERE customer_id = 'C7' UNION ALL
SELECT 'provider', id FROM bookings WHERE provider_id = 'P3' UNION ALL
SELECT 'admin', id FROM bookings""")
def _(t):
    seen = {"customer": "C7", "provider": "P3", "admin": None, "guest": "C7"}
    parts = [
        filters.scope_bookings(t("bookings"), role, user).select(F.lit(role).alias("role"), "id")
        for role, user in seen.items()]
    return reduce(DataFrame.unionByName, parts)


@query("one_customers_bookings", "bookings providers_core profiles", f"""
SELECT {_FIELDS}, CASE WHEN p.id IS NOT NULL THEN business_name ELSE 'Unknown Service' END AS provider_name,
 f.phone AS provider_phone, category AS provider_category, {_STATUS_LABEL.format('b.status')} AS status_label,
 {_TAB.format('b.status')} AS tab
FROM bookings b LEFT JOIN providers_core p ON b.provider_id = p.id LEFT JOIN profiles f ON p.id = f.id WHERE customer_id = 'C7'""")
def _(t):
    return B.customer_bookings(t("bookings"), t("providers_core"), t("profiles"), customer_id="C7")


@query("one_providers_bookings", "bookings profiles", "SELECT * FROM work WHERE provider_id = 'P3'",
       ctes=f"work AS ({_WORK})")
def _(t):
    return B.provider_bookings(t("bookings"), t("profiles"), provider_id="P3")


# --- provider counters ----------------------------------------------------------------------

_STATS = """
SELECT id, coalesce(total_jobs, 0) AS total_jobs, coalesce(completed_jobs, 0) AS completed_jobs,
 CAST(coalesce(monthly_earnings, 0) AS double) AS monthly_earnings, CAST(coalesce(rating, 0) AS double) AS avg_rating,
 coalesce(reviews_count, 0) AS reviews FROM providers_stored"""


@query("provider_stats", "providers_stored", _STATS)
def _(t):
    return B.provider_stats(t("providers_stored"))


@query("provider_tiles", "providers_stored", f"""
SELECT id, CAST(1 AS bigint) AS tile, 'Total Jobs' AS label, CAST(total_jobs AS varchar) AS value, 'Lifetime jobs' AS change FROM stats UNION ALL
SELECT id, 2, 'Completed', CAST(completed_jobs AS varchar), 'Finished tasks' FROM stats UNION ALL
SELECT id, 3, 'Monthly Earnings', {money_sql('monthly_earnings')}, 'Current month' FROM stats UNION ALL
SELECT id, 4, 'Avg Rating', CASE WHEN avg_rating = 0 THEN '0.0' ELSE regexp_replace(format('{{:.2f}}', avg_rating), '\\.?0+$', '') END,
 reviews || ' reviews' FROM stats""", ctes=f"stats AS ({_STATS})")
def _(t):
    return B.provider_tiles(B.provider_stats(t("providers_stored")))


@query("provider_defaults", "providers_stored", """
SELECT id, coalesce(total_jobs, 0) AS total_jobs, coalesce(completed_jobs, 0) AS completed_jobs,
 CAST(coalesce(rating, 0) AS double) AS rating, coalesce(reviews_count, 0) AS reviews_count, price_unit,
 CAST(coalesce(monthly_earnings, 0) AS double) AS monthly_earnings, verified, is_available, status FROM providers_stored""")
def _(t):
    filled = fill_defaults(conform(t("providers_stored"), "providers"), "providers")
    return filled.select(
        "id", "total_jobs", "completed_jobs", "rating", "reviews_count", "price_unit",
        "monthly_earnings", "verified", "is_available", "status")


# The rating in hundredths is rounded half up in whole numbers.
_ROLLUP = f"""
SELECT provider_id, count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
 CAST(coalesce(sum(price) FILTER (WHERE status = 'completed' AND strftime(booking_date, '%Y-%m') = '{ROLLUP_MONTH}'), 0) AS double) AS monthly_earnings,
 CASE WHEN count(rating) = 0 THEN 0.0::double ELSE ((CAST(sum(rating) AS bigint) * 200 + count(rating)) // (2 * count(rating)))::double / 100 END AS rating,
 count(rating) AS reviews_count FROM bookings WHERE provider_id IS NOT NULL GROUP BY provider_id"""


@query("provider_rollup", "bookings", _ROLLUP)
def _(t):
    return rollups.provider_rollup(t("bookings"), ROLLUP_MONTH)


_DRIFT_COUNTERS = ("total_jobs", "completed_jobs", "monthly_earnings", "rating", "reviews_count")
_DRIFT_PAIRS = ", ".join(
    f"CAST(coalesce(p.{c}, 0) AS double) AS stored_{c}, CAST(coalesce(r.{c}, 0) AS double) AS rebuilt_{c}" for c in _DRIFT_COUNTERS)


@query("counter_drift", "providers_stored bookings", f"""
SELECT * FROM (SELECT p.id, {_DRIFT_PAIRS} FROM providers_stored p LEFT JOIN rebuilt r ON p.id = r.provider_id)
WHERE {" OR ".join(f"stored_{c} <> rebuilt_{c}" for c in _DRIFT_COUNTERS)}""",
       ctes=f"rebuilt AS ({_ROLLUP})")
def _(t):
    rebuilt = rollups.provider_rollup(t("bookings"), ROLLUP_MONTH)
    found = rollups.counter_drift(t("providers_stored"), rebuilt)
    return found.select("id", *[F.col(c).cast("double").alias(c) for c in found.columns if c != "id"])


@query("revenue_rollup", "bookings providers_core profiles", """
SELECT month, category, area, CAST(GROUPING(month, category, area) AS bigint) AS level, count(*) AS bookings,
 CAST(coalesce(sum(price) FILTER (WHERE status = 'completed'), 0) AS double) AS revenue
FROM (SELECT strftime(booking_date, '%Y-%m') AS month, p.category, f.area, b.price, b.status
 FROM bookings b LEFT JOIN providers_core p ON b.provider_id = p.id LEFT JOIN profiles f ON b.provider_id = f.id)
GROUP BY ROLLUP (month, category, area)""")
def _(t):
    return rollups.revenue_rollup(t("bookings"), t("providers_core"), t("profiles"))


# --- notifications --------------------------------------------------------------------------

_FEED = """
SELECT provider_id, 1000 + row_number() OVER (PARTITION BY provider_id ORDER BY created_at DESC NULLS FIRST, id) - 1 AS id,
 'booking' AS type,
 CASE WHEN status = 'pending' THEN 'New Booking Request' ELSE 'Booking ' || upper(status[1]) || status[2:] END AS title,
 CASE WHEN status = 'pending' THEN coalesce(nullif(customer_name, ''), 'A customer') || ' has requested '
   || coalesce(nullif(description, ''), 'a service') || ' on ' || date || ' at ' || coalesce(time, 'null')
  ELSE 'Booking ' || id || ' is currently ' || status || '.' END AS message,
 status <> 'pending' AS read, id AS booking_id, status = 'pending' AS action_required FROM work"""
_FEED_CTES = f"work AS ({_WORK}),\nfeed AS ({_FEED})"


def _feed(t):
    work = B.provider_bookings(t("bookings"), t("profiles"), ordered=False)
    return N.notifications(work)


@query("notifications", "bookings profiles", "SELECT * FROM feed", ctes=_FEED_CTES)
def _(t):
    return _feed(t)


@query("unread_counts", "bookings profiles", """
SELECT provider_id, count(*) FILTER (WHERE NOT read) AS unread FROM feed GROUP BY provider_id""",
       ctes=_FEED_CTES)
def _(t):
    work = B.provider_bookings(t("bookings"), t("profiles"), ordered=False)
    return N.unread_count(N.booking_notices(work))


@query("notifications_marked_read", "bookings profiles", """
SELECT provider_id, id, read OR contains(message, '1-URGENT') AS read FROM feed WHERE type = 'booking'""",
       ctes=_FEED_CTES)
def _(t):
    feed = filters.filter_notifications(_feed(t), "bookings")
    seen = feed.where(F.contains("message", F.lit("1-URGENT")))
    return N.mark_read(feed, seen).select("provider_id", "id", "read")


_OTHERS = """others AS (
SELECT 'P' || (event_id % 5) AS provider_id, 9000 + event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'review' ELSE 'system' END AS type,
 event_type AS title, 'note ' || event_id AS message, event_id % 3 = 0 AS read, CAST(NULL AS varchar) AS booking_id, FALSE AS action_required
FROM events WHERE event_type = 'error')"""
_MERGED = f"{_FEED_CTES},\n{_OTHERS},\nmerged AS (SELECT * FROM feed UNION ALL BY NAME SELECT * FROM others)"


def _merged(t):
    """The feed with reviews and system messages made from error events."""
    events = t.table("events").where("event_type = 'error'")
    others = events.select(
        F.concat(F.lit("P"), F.col("event_id") % 5).alias("provider_id"), (F.col("event_id") + 9000).alias("id"),
        F.when(F.col("event_id") % 2 == 0, "review").otherwise("system").alias("type"),
        F.col("event_type").alias("title"), F.concat(F.lit("note "), "event_id").alias("message"),
        (F.col("event_id") % 3 == 0).alias("read"))
    work = B.provider_bookings(t("bookings"), t("profiles"))
    return N.notifications(work, others).withColumn(
        "action_required", F.coalesce("action_required", F.lit(False)))


@query("notifications_merged", "bookings profiles", "SELECT * FROM merged", ctes=_MERGED)
def _(t):
    return _merged(t)


@query("notification_reviews", "bookings profiles", "SELECT * FROM merged WHERE type = 'review'", ctes=_MERGED)
def _(t):
    return filters.filter_notifications(_merged(t), "reviews")


@query("notification_messages", "bookings profiles", "SELECT * FROM merged WHERE type = 'system'", ctes=_MERGED)
def _(t):
    return filters.filter_notifications(_merged(t), "system")


@query("notifications_all_read", "bookings profiles", "SELECT provider_id, id, TRUE AS read FROM feed", ctes=_FEED_CTES)
def _(t):
    return N.mark_read(_feed(t)).select("provider_id", "id", "read")


# --- phones and quality rules ---------------------------------------------------------------

_CANON = phone_sql("phone")


@query("normalize_phones", "customer_applications", f"""
SELECT app_id, {_CANON} AS canonical,
 CASE WHEN length(d) = 10 THEN '91' || d ELSE d END AS msisdn
FROM (SELECT app_id, phone, regexp_replace({_CANON}, '[^0-9]', '', 'g') AS d FROM customer_applications)""")
def _(t):
    phone = F.col("phone")
    return t("customer_applications").select(
        "app_id", normalize_phone(phone).alias("canonical"), msisdn(phone).alias("msisdn"))


@query("profiles_by_phone", "profiles customer_applications", f"""
SELECT id, phone, role FROM profiles WHERE phone IN (SELECT {_CANON} FROM customer_applications)""")
def _(t):
    wanted = t("customer_applications").select(normalize_phone(F.col("phone")).alias("phone"))
    return filters.lookup(t("profiles"), "phone", wanted).select("id", "phone", "role")


@query("phone_not_canonical", "customer_applications", f"""
SELECT app_id, phone, {_CANON} AS canonical FROM customer_applications WHERE phone <> {_CANON}""")
def _(t):
    return Q.phone_not_canonical(t("customer_applications")).select("app_id", "phone", "canonical")


@query("duplicate_phones", "customer_applications", f"""
SELECT phone, count(*) AS rows FROM (SELECT {_CANON} AS phone FROM customer_applications) GROUP BY phone HAVING count(*) > 1""")
def _(t):
    apps = t("customer_applications").withColumn("phone", normalize_phone(F.col("phone")))
    return Q.duplicate_keys(apps, "phone")


@query("enum_violations", "booking_status_events", """
SELECT event_id, booking_id, status FROM booking_status_events
WHERE status NOT IN ('pending', 'accepted', 'in-progress', 'completed', 'cancelled')""")
def _(t):
    return Q.enum_violations(t("booking_status_events"), "bookings").select(
        "event_id", "booking_id", "status")


@query("orphan_bookings", "booking_requests providers_core", """
SELECT request_id, provider_id FROM booking_requests WHERE provider_id NOT IN (SELECT id FROM providers_core)""")
def _(t):
    return Q.orphans(t("booking_requests"), t("providers_core"), "provider_id").select(
        "request_id", "provider_id")


@query("quality_report", "profiles providers_core bookings", f"""
SELECT 'profiles.role' AS rule, count(*) AS violations FROM profiles WHERE role NOT IN ('admin', 'provider', 'customer') UNION ALL
SELECT 'providers.status', count(*) FROM providers_core WHERE status NOT IN ('pending', 'active', 'suspended') UNION ALL
SELECT 'bookings.status', count(*) FROM bookings WHERE status NOT IN ('pending', 'accepted', 'in-progress', 'completed', 'cancelled') UNION ALL
SELECT 'profiles.id unique', count(*) FROM (SELECT id FROM profiles WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL
SELECT 'profiles.phone unique', count(*) FROM (SELECT phone FROM profiles WHERE phone IS NOT NULL GROUP BY phone HAVING count(*) > 1) UNION ALL
SELECT 'providers.id unique', count(*) FROM (SELECT id FROM providers_core GROUP BY id HAVING count(*) > 1) UNION ALL
SELECT 'bookings.id unique', count(*) FROM (SELECT id FROM bookings GROUP BY id HAVING count(*) > 1) UNION ALL
SELECT 'providers.id references profiles', count(*) FROM providers_core p ANTI JOIN profiles f ON p.id = f.id UNION ALL
SELECT 'bookings.customer_id references profiles', count(*) FROM (SELECT * FROM bookings WHERE customer_id IS NOT NULL) b ANTI JOIN profiles f ON b.customer_id = f.id UNION ALL
SELECT 'bookings.provider_id references providers', count(*) FROM (SELECT * FROM bookings WHERE provider_id IS NOT NULL) b ANTI JOIN providers_core p ON b.provider_id = p.id UNION ALL
SELECT 'profiles.phone canonical', count(*) FROM profiles WHERE phone <> {_CANON}""")
def _(t):
    return Q.table_report(t("profiles"), t("providers_core"), t("bookings"))


@query("transition_audit", "booking_status_events", f"""
SELECT event_id, booking_id, previous_status, status, {time_sql('ts')} AS ts FROM (
 SELECT *, lag(status) OVER w AS previous_status, row_number() OVER w AS n FROM booking_status_events
 WINDOW w AS (PARTITION BY booking_id ORDER BY ts, event_id))
WHERE n > 1 AND (previous_status, status) NOT IN
 (('pending', 'accepted'), ('pending', 'cancelled'), ('accepted', 'in-progress'), ('in-progress', 'completed'))""")
def _(t):
    return Q.transition_audit(t("booking_status_events"))
