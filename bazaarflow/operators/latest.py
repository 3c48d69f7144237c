"""First-of-key, last-of-key and top-of-key picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_event(events: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The latest event of each key by (ts, event_id).

    An aggregate, not a window: each task folds its rows before the shuffle, so a key with a
    third of all events sends one row per task.
    """
    picked = F.max_by(F.struct(*columns, "ts"), F.struct("ts", "event_id")).alias("_last")
    return events.groupBy(key).agg(picked).select(
        key, *[F.col("_last")[c].alias(c) for c in columns], F.col("_last")["ts"].alias("ts"))


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark turns the rank filter into a group limit before the shuffle, so each task passes on
    at most ``n`` rows of a key, however many it holds.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key combination."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
