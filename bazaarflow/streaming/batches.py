"""Folders of micro-batch results.

Each micro-batch writes the folder named by its id and nothing else. A batch that is run again
after a failure replaces its own folder, so every result is there exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from bazaarflow.session import child_names, discard, path_exists

BATCH = "batch_id"

# A table a stream is joined to. A DataFrame keeps the files it was made from; a function is
# called for every batch, so that it can read the table again.
Table = DataFrame | Callable[[], DataFrame]


def as_of_now(table: Table) -> DataFrame:
    return table if isinstance(table, DataFrame) else table()


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")


def read_batches(
    spark: SparkSession, folder: str, schema: T.StructType, ids: Iterable[int] | None = None,
) -> DataFrame:
    """Batches of a folder with their ``batch_id``; no folder yet means no rows.

    With ``ids`` only those folders are looked at, and the others are not even listed.
    """
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    if ids is None:
        paths = [folder] if path_exists(spark, folder) else []
    else:
        paths = [p for i in ids if path_exists(spark, p := f"{folder}/{BATCH}={i}")]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", folder).parquet(*paths)


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.split("=")[1]) for n in child_names(spark, folder) if n.startswith(f"{BATCH}=")]


class Snapshots:
    """Batch folders of which every ``every``-th is summed up in a snapshot.

    A state is the last snapshot and the batches after it. Batches that two snapshots have
    passed, and the snapshots before, are deleted, so what is there, and what is listed, has one size
    for ever. ``combine`` turns rows of a snapshot and of later batches, with their batch_id, into the state.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType,
        combine: Callable[[DataFrame], DataFrame], every: int,
    ):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.combine, self.every = combine, every

    def _last_snapshot(self, before: int) -> int:
        """The newest snapshot that holds nothing of batch ``before`` or later; 0 for none."""
        return max(0, (before - 1) // self.every * self.every)

    def state(self, before: int) -> DataFrame:
        """The state after all batches before ``before``."""
        last = self._last_snapshot(before)
        base = read_batches(self.spark, f"{self.folder}/snapshot", self.schema, [last] if last else [])
        after = range(last + 1 if last else 0, before)
        recent = read_batches(self.spark, f"{self.folder}/changes", self.schema, after)
        return self.combine(base.unionByName(recent))

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """Write a batch's changes and, when it is due, the snapshot after it."""
        write_batch(changes, f"{self.folder}/changes", batch_id)
        if batch_id and batch_id % self.every == 0:
            last = self._last_snapshot(batch_id)
            base = read_batches(self.spark, f"{self.folder}/snapshot", self.schema, [last] if last else [])
            recent = read_batches(
                self.spark, f"{self.folder}/changes", self.schema, range(last + 1 if last else 0, batch_id + 1))
            write_batch(self.combine(base.unionByName(recent)), f"{self.folder}/snapshot", batch_id)
            for old in range(max(0, last - self.every), last):
                discard(self.spark, f"{self.folder}/changes/{BATCH}={old}")
            discard(self.spark, f"{self.folder}/snapshot/{BATCH}={last - self.every}")

    def newest(self) -> int:
        """The last batch written; lists the folder, whose size is bounded."""
        return max(batch_ids(self.spark, f"{self.folder}/changes"), default=-1)

    def current(self) -> DataFrame:
        return self.state(self.newest() + 1)


def start(stream: DataFrame, write, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Start a stream whose batches go to ``write(df, batch_id)``.

    ``once`` stops after the input that is there now.
    """
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
