"""Matching one-time codes: each attempt against the latest code issued to its phone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions import normalize_phone
from bazaarflow.operators.ordered import OrderedScan

TTL = "5 minutes"
RESET_PURPOSE = "forgot_password"


def match_codes(
    issues: DataFrame, attempts: DataFrame, *, ttl: str = TTL, kind: str = "verify",
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every attempt: ok, expired, invalid, purpose_mismatch, no_account, not_requested.

    Both inputs have event_id, phone, code, purpose and ts. ``kind`` is how a code is used, or
    give attempts a ``kind`` column when uses are mixed:

    verify  the purpose must equal the issue's, if that has one
    login   the purpose is not looked at
    reset   the issue must be for a password reset, and the phone must have a profile

    The latest issue of a phone replaces earlier ones, a code is good up to and including its
    expiry, and a code that matched is gone: later attempts are not_requested, even past expiry.
    With verify, an attempt past expiry is the last one too if its phone came in canonical form;
    in another form the code stays, and stays expired.
    """
    judged = judge_timeline(code_timeline(issues, attempts, kind, profiles), ttl)
    return judged.where(~F.col("is_issue")).select("event_id", "phone", "ts", "outcome")


def code_timeline(
    issues: DataFrame, attempts: DataFrame, kind: str, profiles: DataFrame | None,
) -> DataFrame:
    """Issues and attempts of all phones as one set of rows."""
    issued = issues.select(
        "event_id", normalize_phone(F.col("phone")).alias("phone"), "code", "purpose", "ts",
        F.lit(None).cast("string").alias("kind"), F.lit(True).alias("has_account"),
        F.lit(False).alias("as_kept"), F.lit(True).alias("is_issue"))
    use = F.coalesce("kind", F.lit(kind)) if "kind" in attempts.columns else F.lit(kind)
    canonical = normalize_phone(F.col("phone"))
    tried = attempts.select(
        "event_id", canonical.alias("phone"), "code", "purpose", "ts", use.alias("kind"),
        F.col("phone").eqNullSafe(canonical).alias("as_kept"), F.lit(False).alias("is_issue"))
    if profiles is None:
        tried = tried.withColumn("has_account", F.lit(True))
    else:
        accounts = profiles.where(F.col("phone").isNotNull()).select(
            F.col("phone").alias("_account"))
        tried = tried.join(accounts, F.col("phone") == F.col("_account"), "left").withColumn(
            "has_account", F.col("_account").isNotNull()).drop("_account")
    return issued.unionByName(tried).withColumn("carried", F.lit(False))


def judge_timeline(timeline: DataFrame, ttl: str, path: str | None = None) -> DataFrame:
    """A timeline with each row's current ``issue``, the ``outcome`` and whether it ``uses_up`` the issue.

    Two ordered scans per phone: the first finds each attempt's current issue, the second
    whether an earlier attempt already used that issue up. Rows go by time, after those marked
    ``carried``. An issue's ``place`` identifies it and grows with the order.
    """
    # An issue and an attempt with equal time and id: the code is issued first.
    order = [F.col("carried").desc(), F.col("ts"), F.col("event_id"), F.col("is_issue").desc()]
    issued = F.when(F.col("is_issue"), F.struct(
        F.struct((~F.col("carried")).alias("new"), "ts", "event_id").alias("place"),
        "event_id", "ts", "code", "purpose"))
    scan = OrderedScan(timeline, ["phone"], order, "codes", path).latest(issued, "issue")

    held = F.col("issue")
    alive = F.col("ts") <= held["ts"] + F.expr(f"INTERVAL {ttl}")
    same_code = F.col("code").eqNullSafe(held["code"])
    same_purpose = (
        F.when(F.col("kind") == "login", F.lit(True))
        .when(F.col("kind") == "reset", held["purpose"].eqNullSafe(RESET_PURPOSE))
        .otherwise(
            held["purpose"].isNull() | (held["purpose"] == "")
            | held["purpose"].eqNullSafe(F.col("purpose"))))
    has_account = F.col("has_account") | (F.col("kind") != "reset")
    fits = ~F.col("is_issue") & held.isNotNull() & alive & same_code & same_purpose & has_account

    late = ~F.col("is_issue") & held.isNotNull() & ~alive & F.col("as_kept") & (F.col("kind") == "verify")
    ends = F.coalesce(fits | late, F.lit(False))
    used = scan.latest(F.when(ends, held["place"]), "_used_issue", before_row=True).rows()
    gone = F.col("_used_issue").eqNullSafe(held["place"])
    outcome = (
        F.when(F.col("is_issue"), None)
        .when(held.isNull() | gone, "not_requested")
        .when(~alive, "expired")
        .when(~same_code, "invalid")
        .when(~same_purpose, "purpose_mismatch")
        .when(~has_account, "no_account")
        .otherwise("ok"))
    return used.withColumns({"outcome": outcome, "uses_up": ends & ~gone}).drop("_used_issue")
