"""Connected components of an edge table, and a fixed-size filter of a key column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bazaarflow.session import materialise

FILTER_BITS = 1 << 23
_ROUNDS = 60


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter with one hash over a long column: bits / 64 words, whatever the table's size."""
    place = F.pmod(F.col(column), F.lit(bits))
    rows = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(
        F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}) % 64 as int))")).alias("m")).collect()
    words = np.zeros(bits // 64, np.int64)
    for row in rows:
        words[row["w"]] = row["m"]
    return words.view(np.uint64)


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one batch as stars: each node with the smallest node of its part."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in list(parent)]
        stars = [s for s in stars if s[0] != s[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's smallest node.

    Batches of edges are folded into stars first. Then large-star and small-star steps alternate
    until nothing changes: every node links its larger neighbours, then its smaller ones, to the
    smallest node it knows. The edges of a round are written to the shared folder; only their number
    and a checksum come to the driver.
    """
    current = materialise(edges.select("u", "v").mapInArrow(_forests, "u long, v long").distinct(), "components")
    state = None
    for _ in range(_ROUNDS):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u != v").distinct()
        # every edge now runs from the larger node u to the smaller node v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        current = materialise(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v"))).distinct(), "components")
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("c")).first()
        if (row["n"], row["c"]) == state:
            break
        state = row["n"], row["c"]
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
