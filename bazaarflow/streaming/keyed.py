"""Keyed state of a stream in hash buckets that double as the keys grow.

A batch reads the buckets of its own keys and appends what it changes to them. A bucket's name is the
last bits of its keys' hash; once a bucket holds too many keys, all names get more bits. A batch of
a few keys thus reads about the same, however many keys there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bazaarflow.sources.versions import Layout, Manifest, Store
from bazaarflow.streaming.batches import BATCH

STATE = "state"
FIRST_BITS = 4
CELL_KEYS = 1 << 20
FOLDERS = 16
PUSHED_KEYS = 1000
VACUUM_EVERY = 20


class KeyedState:
    """The newest row of each key below ``path``, written by one stream.

    ``schema`` has the text column ``key``; ``keep`` says which rows are still of use when a bucket is
    summed up, which happens once it lies in ``folders`` folders. Buckets aim at ``cell_keys`` keys.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, keep: Column | None = None,
        cell_keys: int = CELL_KEYS, folders: int = FOLDERS,
    ):
        self.spark, self.path, self.key, self.keep = spark, path, key, keep
        self.schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        self.cell_keys, self.folders = cell_keys, folders
        self._values = [f.name for f in schema.fields if f.name != key]

    def _store(self, bits: int) -> Store:
        return Store(self.spark, self.path, {STATE: Layout(self.schema, lambda: self._cell(bits), (self.key,))})

    def _cell(self, bits: int) -> Column:
        return F.lpad(F.bin(F.xxhash64(self.key).bitwiseAND((1 << bits) - 1)), bits, "0")

    def _bits(self, manifest: Manifest) -> int:
        return len(next(iter(manifest.tables.get(STATE, {})), "0" * FIRST_BITS))

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self._values, BATCH), F.col(BATCH)).alias("_last")
        return rows.groupBy(self.key).agg(last).select(self.key, "_last.*")

    def _summed_up(self, rows: DataFrame) -> DataFrame:
        newest = self._newest(rows)
        return newest if self.keep is None else newest.where(self.keep)

    def applied(self, batch: int) -> bool:
        return batch <= self._store(FIRST_BITS).manifest().applied.get(STATE, -1)

    def of(self, keys: DataFrame) -> DataFrame:
        """The state of ``keys``, a column of unique keys; reads their buckets only.

        What goes through the driver is names of buckets, and the keys themselves where they are few
        enough to be a filter of the file scan.
        """
        manifest = self._store(FIRST_BITS).manifest()
        bits = self._bits(manifest)
        cells = sorted(r[0] for r in keys.select(self._cell(bits)).distinct().collect())
        rows = self._store(bits).read(STATE, cells, manifest)
        few = [r[0] for r in keys.limit(PUSHED_KEYS + 1).collect()]
        if len(few) <= PUSHED_KEYS:
            rows = rows.where(F.col(self.key).isin(few))
        return self._newest(rows.join(keys, self.key, "left_semi"))

    def add(self, changes: DataFrame, batch: int) -> bool:
        """Publish the new rows of a batch's keys, one each; False, and no change, where the batch was added before."""
        base = self._store(FIRST_BITS).manifest()
        bits, held = self._bits(base), base.tables.get(STATE, {})
        many = [c for c, f in held.items() if len(f) >= self.folders]
        wider = bits + self._bits_short(self._store(bits).read(STATE, many, base), bits) if many else bits
        rows = changes.select(self.key, *self._values, F.lit(batch).cast("long").alias(BATCH))

        def write(change) -> None:
            if wider > bits:
                change.replace(STATE, self._summed_up(change.read(STATE)))
            elif many:
                change.rewrite(STATE, self._summed_up(change.read(STATE, many)), many)
            change.append(STATE, rows)

        store = self._store(wider)
        done = store.publish(STATE, batch, write)
        if batch % VACUUM_EVERY == VACUUM_EVERY - 1:
            store.vacuum()
        return done

    def _bits_short(self, rows: DataFrame, bits: int) -> int:
        """How many more bits bring the fullest bucket among ``rows`` down to its size."""
        sizes = rows.groupBy(self._cell(bits).alias("_cell")).agg(F.approx_count_distinct(self.key).alias("_keys"))
        largest = sizes.agg(F.max("_keys")).first()[0] or 0
        return max(0, math.ceil(math.log2(largest / self.cell_keys))) if largest else 0

    def current(self) -> DataFrame:
        """The state of all keys."""
        manifest = self._store(FIRST_BITS).manifest()
        return self._newest(self._store(self._bits(manifest)).read(STATE, manifest=manifest))
