"""Rules the tables should satisfy, each as the DataFrame of rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions import normalize_phone
from bazaarflow.operators.ordered import OrderedScan
from bazaarflow.schemas import ENUMS, STATUS_GRAPH


def enum_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows whose checked column holds a value outside its list; null passes, as in a CHECK."""
    column, allowed = ENUMS[table]
    return df.where(~F.col(column).isin(*allowed))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a unique column that occur more than once; null is not a value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    keys = parent.select(F.col("id").alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(keys, foreign_key, "left_anti")


def phone_not_canonical(profiles: DataFrame) -> DataFrame:
    """Profiles whose stored phone no login lookup can match."""
    phone = F.col("phone")
    return profiles.where(phone != normalize_phone(phone)).withColumn(
        "canonical", normalize_phone(phone))


def transition_audit(events: DataFrame) -> DataFrame:
    """Status events that do not follow the booking's previous event on the status graph.

    The first event of a booking has nothing to follow and passes.
    """
    scan = OrderedScan(events, ["booking_id"], [F.col("ts"), F.col("event_id")], "transitions")
    steps = scan.previous(["status"], "_before").rows().withColumn(
        "previous_status", F.col("_before")["status"])
    allowed = reduce(lambda a, b: a | b, [
        F.col("previous_status").eqNullSafe(a) & F.col("status").eqNullSafe(b)
        for a, b in STATUS_GRAPH])
    return steps.where(F.col("_before").isNotNull() & ~allowed).select(
        "event_id", "booking_id", "previous_status", "status", "ts")


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules, all counted in one pass."""
    counted = df.agg(*[F.count_if(broken).alias(f"n{i}") for i, broken in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations"))
        for i, rule in enumerate(rules)])))


def _not_listed(table: str) -> Column:
    column, allowed = ENUMS[table]
    return ~F.col(column).isin(*allowed)


def _orphan_count(child: DataFrame, parent: DataFrame, foreign_key: str) -> DataFrame:
    """The number of orphans; children are counted per key before they meet the parents."""
    keys = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count(F.lit(1)).alias("n"))
    return orphans(keys, parent, foreign_key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def table_report(
    profiles: DataFrame, providers: DataFrame, bookings: DataFrame,
) -> DataFrame:
    """Number of rows that break each table rule.

    Rules about single rows take one pass per table; keys and references move partial counts only.
    """
    phone = F.col("phone")
    by_row = [
        _rules(profiles, {
            "profiles.role": _not_listed("profiles"), "profiles.phone canonical": phone != normalize_phone(phone)}),
        _rules(providers, {"providers.status": _not_listed("providers")}),
        _rules(bookings, {"bookings.status": _not_listed("bookings")}),
    ]
    counted = {
        "profiles.id unique": duplicate_keys(profiles, "id"),
        "profiles.phone unique": duplicate_keys(profiles, "phone"),
        "providers.id unique": duplicate_keys(providers, "id"),
        "bookings.id unique": duplicate_keys(bookings, "id"),
    }
    parts = by_row + [
        rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        for rule, rows in counted.items()]
    references = {
        "providers.id references profiles": (providers, profiles, "id"),
        "bookings.customer_id references profiles": (bookings, profiles, "customer_id"),
        "bookings.provider_id references providers": (bookings, providers, "provider_id"),
    }
    parts += [
        _orphan_count(*tables).select(F.lit(rule).alias("rule"), "violations") for rule, tables in references.items()]
    return reduce(DataFrame.unionByName, parts)
