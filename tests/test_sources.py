from __future__ import annotations

import json

import pytest

from bazaarflow.schemas import BOOKINGS, PROFILES, PROVIDERS, conform, fill_defaults
from bazaarflow.session import shared_dir
from bazaarflow.sources.tables import (
    overwrite_all, read_legacy_json, read_table, save_bucketed, source_counts, write_json, write_table,
)
from tests import golden


def test_read_fills_defaults_and_leaves_credentials_out(spark, tmp_path):
    path = str(tmp_path / "profiles")
    spark.createDataFrame([("u1", "hash", None)], "id string, password string, phone_verified boolean").write.parquet(path)
    row = read_table(spark, path, "profiles", defaults=True).first().asDict()
    assert "password" not in row and row["phone_verified"] is False and row["created_at"] is None
    assert read_table(spark, path, "profiles").first()["phone_verified"] is None


def test_insert_defaults(spark):
    seeded = conform(spark.createDataFrame([("p1", "Shop")], "id string, business_name string"), "providers")
    row = fill_defaults(seeded, "providers", "2024-01-02 03:04:05").first()
    assert (row["status"], row["price_unit"], row["is_available"], row["rating"], row["total_jobs"]) == (
        "pending", "/hr", True, 0, 0)
    assert str(row["joined_date"]) == "2024-01-02"


def test_reload_in_order_and_read_back(spark, tmp_path):
    folder = str(tmp_path)
    tables = {"bookings": golden.bookings(spark), "profiles": golden.profiles(spark), "providers": golden.providers(spark)}
    overwrite_all(tables, folder)
    overwrite_all(tables, folder)
    counts = source_counts({n: read_table(spark, f"{folder}/{n}", n) for n in tables})
    assert {tuple(r) for r in counts.collect()} == {("bookings", 8), ("profiles", 6), ("providers", 6)}
    back = read_table(spark, f"{folder}/bookings", "bookings")
    assert back.schema.names == BOOKINGS.names and back.where("is_emergency is null").count() == 0
    may = read_table(spark, f"{folder}/bookings", "bookings", months=("2024-05", "2024-05"))
    assert {r["id"] for r in may.collect()} == {"TF-7", "TF-8"}
    assert "created_month" in may._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    with pytest.raises(ValueError):
        overwrite_all({"orders": golden.bookings(spark)}, folder)


def test_filters_reach_the_scan_of_a_written_table(spark, tmp_path):
    folder = str(tmp_path)
    overwrite_all({"providers": golden.providers(spark)}, folder)
    plan = read_table(spark, f"{folder}/providers", "providers").where(
        "status = 'active'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,active)" in plan and "business_name" not in plan


def test_legacy_json(spark, tmp_path):
    good, bad = tmp_path / "users.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "1", "phone": "x", "password": "h"}, {"id": "2"}], indent=2))
    bad.write_text("[{")
    assert {r["id"] for r in read_legacy_json(spark, str(good), PROFILES).collect()} == {"1", "2"}
    assert read_legacy_json(spark, str(bad), PROFILES).count() == 0
    absent = read_legacy_json(spark, str(tmp_path / "none.json"), PROFILES)
    assert absent.count() == 0 and absent.schema == PROFILES


def test_values_that_do_not_fit_are_set_aside(spark, tmp_path):
    rows = spark.createDataFrame([("a", "4.5"), ("b", "123.4"), ("c", None)], "id string, rating string")
    unfit = write_table(rows, str(tmp_path / "p"), "providers")
    assert [r["id"] for r in unfit.collect()] == ["b"]
    assert {r["id"] for r in read_table(spark, str(tmp_path / "p"), "providers").collect()} == {"a", "c"}


def test_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    sellers = golden.providers(spark)
    write_json(sellers, path)
    back = spark.read.schema(PROVIDERS).json(path)
    assert back.count() == 6 and back.exceptAll(sellers).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    save_bucketed(golden.bookings(spark), "jobs_by_provider", "provider_id", 4)
    save_bucketed(golden.providers(spark), "providers_by_id", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("jobs_by_provider").join(
            spark.table("providers_by_id").withColumnRenamed("id", "provider_id").select("provider_id", "category"),
            "provider_id", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_large_month_is_split_into_several_sorted_files(spark, tmp_path):
    """Most bookings in one month: the rebalance cuts it up, and each file is sorted by provider."""
    jobs = conform(spark.range(60000).selectExpr(
        "concat('TF-', id) AS id", "concat('P', id % 977) AS provider_id", "concat('note ', id) AS description",
        "CASE WHEN id % 10 = 0 THEN timestamp '2024-01-05' ELSE timestamp '2024-02-05' END AS created_at"), "bookings")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        write_table(jobs.repartition(8), str(tmp_path / "b"), "bookings")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "b" / "created_month=2024-02").glob("*.parquet"))
    assert len(files) >= 3
    ids = [r[0] for r in spark.read.parquet(str(files[0])).select("provider_id").collect()]
    assert ids == sorted(ids)
    assert read_table(spark, str(tmp_path / "b"), "bookings").count() == 60000
