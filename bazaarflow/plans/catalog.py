"""Registry of named queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.plans.output import comparable
from bazaarflow.plans.views import duckdb_ctes, stream_view, view


@dataclass(frozen=True)
class Source:
    """The test tables of one folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def table(self, name: str) -> DataFrame:
        """A given table as it is."""
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def stream(self, name: str, moment: str = "ts", files: int = 4) -> DataFrame:
        return stream_view(self.spark, self.folder, name, moment, files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str, sql: str, ctes: str = ""):
    """Register a query over ``Source`` with its SQL; ``views`` are the test views the SQL reads.

    ``ctes`` are further 'name AS (...)' texts between the views and the SQL.
    """
    def add(function: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: comparable(function(Source(spark, folder)))
        parts = duckdb_ctes(*views.split()) + ([ctes.strip()] if ctes else [])
        ORACLE[name] = "WITH " + ",\n".join(parts) + "\n" + sql.strip()
        return function

    return add


# DuckDB texts for column functions that several queries check.

def phone_sql(c: str) -> str:
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    core = f"CASE WHEN length({digits}) > 10 AND {digits} LIKE '91%' THEN right({digits}, 10) ELSE {digits} END"
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '' WHEN length({core}) = 10 THEN '+91 ' || ({core}) ELSE {c} END"


def money_sql(c: str) -> str:
    return "'₹' || regexp_replace(format('{:,.2f}', CAST(" + c + r" AS double)), '\.?0+$', '')"


def time_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def name_sql(first: str, last: str, present: str) -> str:
    return f"CASE WHEN {present} IS NOT NULL THEN concat_ws(' ', {first}, {last}) ELSE 'Unknown' END"
