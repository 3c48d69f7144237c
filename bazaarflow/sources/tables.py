"""Typed table reads, layout-aware writes and whole reloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bazaarflow.schemas import LOAD_ORDER, TABLES, conform, fill_defaults, fit_rows, unfit_rows
from bazaarflow.session import path_exists

MONTH = "created_month"


def read_table(
    spark: SparkSession, path: str, name: str, fmt: str = "parquet", defaults: bool = False,
    months: tuple[str, str] | None = None,
) -> DataFrame:
    """A table with its fixed schema; columns outside the schema are not read.

    Tables written by ``write_table`` have their column defaults already. ``defaults=True`` fills
    them on reading, for raw loads: a filter on a filled column cannot reach the file scan.
    ``months`` (first and last, yyyy-MM) reads only those folders of written bookings.
    """
    df = spark.read.schema(TABLES[name]).format(fmt).load(path)
    if months:
        df = df.where(F.col(MONTH).between(*months))
    df = df.select(*TABLES[name].names)
    return fill_defaults(df, name) if defaults else df


def write_table(
    df: DataFrame, path: str, name: str, inserted_at=None, mode: str = "overwrite",
) -> DataFrame:
    """Write a table with its defaults filled in; the result has the rows that do not fit it.

    Bookings are laid out by month of creation, so a date range reads only its months. The
    rebalance gathers a month's rows for few large files and still splits a month that is far
    larger than the others. Files are sorted by provider, so a read for one provider skips most
    of them by their statistics.
    """
    full = fill_defaults(conform(fit_rows(df, name), name), name, inserted_at)
    unfit = unfit_rows(df, name)
    if name != "bookings":
        full.write.mode(mode).parquet(path)
        return unfit
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("undated"))
    laid_out = full.withColumn(MONTH, month).hint("rebalance", F.col(MONTH)).sortWithinPartitions(
        MONTH, "provider_id")
    laid_out.write.mode(mode).partitionBy(MONTH).parquet(path)
    return unfit


def overwrite_all(tables: Mapping[str, DataFrame], folder: str, inserted_at=None) -> None:
    """Replace every given table below ``folder``, parents before children.

    The inputs must not be read from the tables being replaced.
    """
    unknown = set(tables) - set(LOAD_ORDER)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    for name in LOAD_ORDER:
        if name in tables:
            write_table(tables[name], f"{folder.rstrip('/')}/{name}", name, inserted_at)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a catalog table bucketed and sorted by ``key``.

    Two tables bucketed alike on their join keys are joined without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def read_legacy_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file (or folder of files) holding one array each; absent or unreadable means no rows.

    A file that does not parse reads as one row of nulls, which is dropped.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE").dropna("all")


def write_json(df: DataFrame, path: str) -> None:
    """Write line-delimited JSON files, one per partition."""
    df.write.mode("overwrite").json(path)


def source_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named source."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted
