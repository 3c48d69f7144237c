"""Physical plans: what is pushed down, what is not shuffled, and what hot keys do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import admin, bookings as B, lifecycle as L, onboarding as O, quality as Q
from bazaarflow.sources.tables import overwrite_all, read_table
from tests import golden


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans"))
    overwrite_all({"profiles": golden.profiles(spark), "providers": golden.providers(spark),
                   "bookings": golden.bookings(spark)}, folder)
    return {n: read_table(spark, f"{folder}/{n}", n, defaults=False) for n in ("profiles", "providers", "bookings")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kpis_read_few_columns_and_never_join(stored):
    text = plan(admin.platform_kpis(stored["profiles"], stored["providers"], stored["bookings"]))
    assert "Join" not in text and "description" not in text and "first_name" not in text
    assert "struct<status:string,price:decimal(38,10)>" in text


def test_recent_is_a_top_n(stored):
    newest = B.recent_bookings(stored["bookings"], stored["providers"], stored["profiles"])
    assert "TakeOrderedAndProject(limit=8" in plan(newest)


def test_top_per_provider_limits_before_the_shuffle(stored):
    text = plan(B.recent_by_provider(stored["bookings"], stored["profiles"]))
    assert text.count("WindowGroupLimit") == 2
    partial, shuffle = text.index("Partial"), text.index("Exchange hashpartitioning(provider_id")
    assert shuffle < partial  # the plan prints consumers first


def test_onboarding_picks_first_applications_before_any_join(spark, tmp_path):
    path = str(tmp_path / "apps")
    spark.createDataFrame(
        [(1, "A", "6000000001", "1", "[]", "[]", "1")],
        "app_id long, full_name string, phone string, experience string, categories string, "
        "areas_served string, price_min string").write.parquet(path)
    judged = O.classify_applications(spark.read.parquet(path), golden.profiles(spark))
    text = plan(judged)
    below = text[text.rindex("WindowGroupLimit"):]
    assert "Partial" in below and "Join" not in below.split("FileScan")[0]


def test_status_fold_aggregates_before_the_shuffle(spark, stored):
    events = spark.range(100).select(
        F.col("id").alias("event_id"), F.lit("TF-1").alias("booking_id"),
        F.lit("accepted").alias("status"), F.current_timestamp().alias("ts"))
    text = plan(L.apply_status(stored["bookings"], events).rows)
    assert "partial_max_by" in text and "Window" not in text


@pytest.fixture
def small_skew(spark):
    """Settings under which AQE sees skew in small tables."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def hot(spark):
    """Two thirds of 60,000 bookings on one provider and one customer."""
    jobs = spark.range(60000).select(
        F.concat(F.lit("TF-"), "id").alias("id"), F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 500)).otherwise("p1").alias("provider_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), F.col("id") % 1000)).otherwise("c1").alias("customer_id"),
        F.lit("customer").alias("role"), F.lit("10:00 AM").alias("booking_time"), F.lit("work").alias("description"),
        F.lit("No. 12, Long Street, Old Town, Tiruchirappalli").alias("address"), F.lit(False).alias("is_emergency"),
        F.lit("pending").alias("status"), F.current_date().alias("booking_date"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("ts")).repartition(8)
    sellers = spark.range(500).select(
        F.concat(F.lit("p"), "id").alias("id"), F.lit("Shop").alias("business_name"), F.lit(1).alias("base_price"),
        F.lit("active").alias("status"), F.lit("Plumber").alias("category"))
    people = spark.range(1500).select(
        F.when(F.col("id") < 500, F.concat(F.lit("p"), "id")).otherwise(F.concat(F.lit("c"), F.col("id") - 500)).alias("id"),
        F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("+91 9000000000").alias("phone"))
    return jobs, sellers, people


FACT_JOINS = {
    "join_provider": lambda jobs, sellers, people: B.join_provider(jobs, sellers),
    "customer_bookings": lambda jobs, sellers, people: B.customer_bookings(jobs, sellers, people),
    "provider_bookings": lambda jobs, sellers, people: B.provider_bookings(jobs, people),
    "booking_ledger": lambda jobs, sellers, people: B.booking_ledger(jobs, sellers, people),
    "screen_requests": lambda jobs, sellers, people: L.screen_requests(jobs, sellers, people),
    "orphans": lambda jobs, sellers, people: Q.orphans(jobs, sellers.where("id <> 'p1'"), "provider_id"),
}


@pytest.mark.parametrize("name", FACT_JOINS)
def test_no_task_holds_the_hot_key(spark, small_skew, hot, name):
    """Either AQE splits the hot key's partition, or the join has sliced it."""
    joined = FACT_JOINS[name](*hot)
    joined.collect()
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "skewed" in text or "_slice" in text


def test_the_report_reads_each_table_few_times(stored):
    text = plan(Q.table_report(stored["profiles"], stored["providers"], stored["bookings"]))
    assert text.count("FileScan parquet") <= 13 and "Cartesian" not in text
