"""Customer registration and provider onboarding over batches of applications.

Each application has a unique ``app_id``; an optional ``ts`` orders a batch before the id does.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions import (
    is_unfit_number, normalize_phone, number_or_zero, parse_list, split_name,
)
from bazaarflow.operators.latest import first_per_key

MAX_FILE_BYTES = 3 * 1024 * 1024
DEFAULT_CATEGORY = "General"


class Registered(NamedTuple):
    profiles: DataFrame
    rejected: DataFrame


class Onboarded(NamedTuple):
    new_profiles: DataFrame
    upgraded_profiles: DataFrame
    providers: DataFrame
    rejected: DataFrame


def _batch_order(apps: DataFrame) -> list[Column]:
    return [F.col(c).asc() for c in ("ts", "app_id") if c in apps.columns]


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def existing_accounts(
    requests: DataFrame, profiles: DataFrame, *, same_role: bool = False,
) -> DataFrame:
    """Requests whose phone already has an account, of the same ``role`` when asked.

    Password resets go ahead only for these; registration codes are refused for them.
    """
    canonical = requests.withColumn("phone", normalize_phone(F.col("phone")))
    keys = ["phone", "role"] if same_role else ["phone"]
    return canonical.join(profiles.select(*keys), keys, "left_semi")


def register_customers(
    apps: DataFrame, profiles: DataFrame, id_prefix: str = "CA-",
) -> Registered:
    """New customer profiles; an application whose phone is taken is rejected.

    Within a batch the first application of a phone wins. It is picked before the profiles are
    joined, while each task can still drop its own repeats, and the losers are found by
    application id: a phone repeated very often is never gathered in one place.
    """
    canonical = apps.withColumn("phone", normalize_phone(F.col("phone")))
    first = first_per_key(canonical, ["phone"], _batch_order(apps))
    winners = first.join(profiles.select("phone"), "phone", "left_anti")
    created = winners.select(
        F.concat(F.lit(id_prefix), F.col("app_id").cast("string")).alias("id"),
        "first_name", "last_name", "phone", F.lit("customer").alias("role"), "area",
        F.lit(True).alias("phone_verified"),
        _optional(apps, "ts", "timestamp").alias("created_at"))
    losers = canonical.join(winners.select("app_id"), "app_id", "left_anti").select(
        "app_id", "phone", F.lit("phone_exists").alias("reason"))
    return Registered(created, losers)


def classify_applications(apps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Provider applications with ``outcome`` new, upgrade or a reason for rejection.

    A phone that belongs to a provider or an admin is refused, another person's is upgraded, an
    unknown one is new. Only a batch's first application of a phone that carries a name, and
    numbers that can be stored, is taken: after it the phone belongs to a provider. It is picked
    before any join, while each task can still drop its own repeats.
    """
    owners = profiles.where(F.col("phone").isNotNull()).select(
        "phone", F.col("id").alias("_owner_id"), F.col("role").alias("_owner_role"))
    canonical = apps.withColumn("phone", normalize_phone(F.col("phone")))
    named = canonical.where(F.col("full_name").isNotNull() & ~_unfit_numbers(apps))
    first = first_per_key(named, ["phone"], _batch_order(apps)).select(
        "app_id", F.lit(True).alias("_first"))
    owned = canonical.join(owners, "phone", "left")
    outcome = (
        F.when(F.col("_owner_role") == "provider", "already_provider")
        .when(F.col("_owner_role") == "admin", "admin_phone")
        .when(F.col("full_name").isNull(), "missing_name")
        .when(_unfit_numbers(apps), "number_too_long")
        .when(F.col("_first").isNull(), "already_provider")
        .when(F.col("_owner_id").isNotNull(), "upgrade")
        .otherwise("new"))
    return owned.join(first, "app_id", "left").withColumn("outcome", outcome).drop("_first")


def _unfit_numbers(apps: DataFrame) -> Column:
    found = [is_unfit_number(F.col(c).cast("string")) for c in ("experience", "price_min") if c in apps.columns]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def onboard_providers(
    apps: DataFrame, profiles: DataFrame, id_prefix: str = "PA-",
) -> Onboarded:
    """Profiles to insert, profiles to update, provider rows to insert and refusals."""
    judged = classify_applications(apps, profiles)
    first, last = split_name(F.col("full_name"))
    new_id = F.concat(F.lit(id_prefix), F.col("app_id").cast("string"))
    photo = _optional(apps, "profile_photo_url")
    moment = _optional(apps, "ts", "timestamp")

    new_profiles = judged.where(F.col("outcome") == "new").select(
        new_id.alias("id"), first.alias("first_name"), last.alias("last_name"), "phone",
        F.lit("provider").alias("role"), F.lit(True).alias("phone_verified"),
        photo.alias("profile_photo_url"), moment.alias("created_at"))
    upgraded = judged.where(F.col("outcome") == "upgrade").select(
        F.col("_owner_id").alias("id"), first.alias("first_name"), last.alias("last_name"),
        "phone", F.lit("provider").alias("role"), photo.alias("profile_photo_url"),
        moment.alias("updated_at"))

    listed = parse_list(F.col("categories"))
    top_category = F.get(listed, F.lit(0))
    taken = judged.where(F.col("outcome").isin("new", "upgrade"))
    rows = taken.select(
        F.coalesce("_owner_id", new_id).alias("id"), F.col("full_name").alias("business_name"),
        F.when(F.size(listed) > 0, top_category).otherwise(DEFAULT_CATEGORY).alias("category"),
        number_or_zero(F.col("experience")).alias("experience"),
        number_or_zero(F.col("price_min")).alias("base_price"), listed.alias("skills"),
        parse_list(F.col("areas_served")).alias("areas_served"),
        _optional(apps, "id_proof_type").alias("id_proof_type"),
        _optional(apps, "id_proof_url").alias("id_proof_url"),
        _optional(apps, "about_bio").alias("about_bio"),
        F.coalesce(_optional(apps, "emergency_available", "boolean"), F.lit(False))
        .alias("emergency_available"),
        F.lit("pending").alias("status"))
    rejected = judged.where(~F.col("outcome").isin("new", "upgrade")).select(
        "app_id", "phone", F.col("outcome").alias("reason"))
    return Onboarded(new_profiles, upgraded, rows, rejected)


def merge_profiles(profiles: DataFrame, onboarded: Onboarded) -> DataFrame:
    """The profile table after onboarding: upgrades applied, new profiles added.

    An upgrade always replaces the photo, with null when the application had none.
    """
    changed = ("first_name", "last_name", "role", "profile_photo_url")
    update = onboarded.upgraded_profiles.select(
        "id", F.struct(*[c for c in changed]).alias("_new"))
    merged = profiles.join(update, "id", "left")
    for name in changed:
        if name in profiles.columns:
            merged = merged.withColumn(
                name, F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col(name)))
    return merged.drop("_new").unionByName(onboarded.new_profiles, allowMissingColumns=True)


def application_issues(apps: DataFrame) -> DataFrame:
    """Applications with the form rules they fail, as an array (empty when complete).

    Reads full_name, phone, password_given, otp_verified, categories (JSON list), agree_terms,
    id_proof_type, id_proof_bytes and photo_bytes; a null size means no file was attached.
    """
    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    def not_true(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    rules = {
        "name": blank("full_name"),
        "phone": blank("phone"),
        "password": not_true("password_given"),
        "otp": not_true("otp_verified"),
        "category": F.size(parse_list(F.col("categories"))) == 0,
        "terms": not_true("agree_terms"),
        "id_proof_type": blank("id_proof_type"),
        "id_proof_file": F.col("id_proof_bytes").isNull(),
        "profile_photo": F.col("photo_bytes").isNull(),
        "id_proof_size": F.col("id_proof_bytes") > MAX_FILE_BYTES,
        "photo_size": F.col("photo_bytes") > MAX_FILE_BYTES,
    }
    failed = F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()])
    return apps.withColumn("issues", F.array_compact(failed))
