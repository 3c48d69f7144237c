"""Hard negatives: rows of another label whose score lies in a window below a positive's.

Distinct vectors of one label are range-sorted into shards of bounded size, each an R-tree. Anchors are
dealt out in blocks and shards in groups; a task holds one block and reads its group's shards one by
one, keeping the best so far, so what leaves it does not grow with the shards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.llm import rtree
from bazaarflow.session import materialise

SHARD_ROWS = 8192
BLOCK = 2048
GROUPS = 16
_SHARD = "dim int, label int, low_id long, vectors binary, ids string"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components."""
    infinite = F.array(F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("nan"))).cast("array<double>")
    return F.coalesce(
        ~F.exists(vector, lambda x: x.isNull()) & ~F.arrays_overlap(vector.cast("array<double>"), infinite), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def shards_of(points: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """R-tree shards of rows (id, label, vector), in packed order.

    Of rows with one label and vector only the ``keep`` smallest ids can be wanted, so a vector that
    many rows share is one point. Points are range-sorted by label and first coordinate, the
    outermost slabs of the packing; a shard is cut from a task's sorted rows.
    """
    same = W.partitionBy("label", "vector").orderBy("id")
    least = points.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= keep)
    distinct = least.groupBy("label", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    order = ["dim", "label", "lead", "spread"]
    placed = distinct.select(
        F.size("vector").alias("dim"), "label", F.get("vector", F.lit(0)).alias("lead"),
        F.xxhash64("vector").alias("spread"), "vector", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            for dim, label, vector, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and ((dim, label) != key or len(held) == shard_rows):
                    yield _shard(key, held)
                    held = []
                key = dim, label
                held.append((vector, ids))
        if held:
            yield _shard(key, held)

    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.select("dim", "label", "vector", "ids").mapInArrow(run, _SHARD)


def _shard(key: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
    points = np.array([v for v, _ in held], np.int64).reshape(len(held), key[0])
    order = rtree.packed_order(points)
    ids = [held[i][1] for i in order]
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids[0][0]], pa.int64()),
         pa.array([points[order].tobytes()]), pa.array([json.dumps(ids)])],
        ["dim", "label", "low_id", "vectors", "ids"])


def search_shards(shards: DataFrame, asks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(ask, tag, id, score): per ask and window the ``k`` best rows of its own label, or of any other.

    ``asks`` has ask (a key), own (an id that is no answer, or null), dim, label, vector and windows
    (array of tag, low, high). Score descending, ties by id.
    """
    spark = shards.sparkSession
    asks = materialise(asks, "negatives-asks")
    blocks = max(1, -(-asks.count() // BLOCK))
    no = F.lit(None)
    dealt_asks = asks.select(
        "dim", F.pmod(F.xxhash64("ask"), F.lit(blocks).cast("long")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"), F.lit(0).alias("kind"), "ask", "own", "label",
        F.to_json("vector").alias("vector"), F.to_json("windows", {"ignoreNullFields": "false"}).alias("windows"),
        no.cast("binary").alias("vectors"), no.cast("string").alias("ids"))
    dealt_shards = shards.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("label", "low_id"), F.lit(GROUPS)).cast("int").alias("group"), F.lit(1).alias("kind"),
        F.col("low_id").alias("ask"), no.cast("long").alias("own"), "label", no.cast("string").alias("vector"),
        no.cast("string").alias("windows"), "vectors", "ids")
    place = ["dim", "block", "group"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows but much work: not to be merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, []

        def answers() -> pa.RecordBatch:
            rows = [(ask, best.window.tag, i, s) for ask, _, _, _, bests in waiting for best in bests
                    for s, i in zip(best.scores, best.ids)]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["ask", "tag", "id", "score"])

        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if (at := (row["dim"], row["block"], row["group"])) != key:
                    if waiting:
                        yield answers()
                    key, waiting = at, []
                if row["kind"] == 0:
                    windows = [rtree.Window(w["tag"], w["low"], w["high"]) for w in json.loads(row["windows"])]
                    waiting.append((row["ask"], row["own"], row["label"], json.loads(row["vector"]),
                                    [rtree.Best(w, k) for w in windows]))
                elif some := [a for a in waiting if (a[2] == row["label"]) == same_label]:
                    _compete(row, some)
        if waiting:
            yield answers()

    found = dealt_asks.unionByName(dealt_shards).repartition(partitions, *place).sortWithinPartitions(
        *place, "kind", "label", "ask").mapInArrow(run, "ask long, tag long, id long, score long")
    best = W.partitionBy("ask", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _compete(shard: dict, asks: list[tuple]) -> None:
    ids = json.loads(shard["ids"])
    points = np.frombuffer(shard["vectors"], np.int64).reshape(len(ids), shard["dim"])
    tree = rtree.build(points)
    ids = [ids[i] for i in tree.order]
    queries = np.array([a[3] for a in asks], np.int64).reshape(len(asks), shard["dim"])
    tree, queries = rtree.exact(tree, queries)
    low, high = rtree.intervals(tree, queries)
    for n, (_, own, _, _, bests) in enumerate(asks):
        rtree.search(tree, low[n], high[n], queries[n], bests, ids, own)


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low_percent: int = 30,
    high_percent: int = 90, scale: int = 256, flip_every: int = 7, labels: int = 10, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per anchor and positive, the first rows of other labels whose score lies in the positive's window.

    Anchors are rows whose id is divisible by ``every``. Every component x becomes floor(scale * x); a
    score is the integer inner product with the anchor; higher scores come first, ties by smaller id.
    Labels of ids divisible by ``flip_every`` become (label + 1) modulo ``labels`` first (none with 0). An
    anchor's positives are its first other rows of its label; rows that share the anchor's id are not
    among them. A negative's score is at least ``low_percent`` and at most ``high_percent`` of the
    positive's, so a positive below zero has none. Columns: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
    different length do not meet; repeated rows count once; other columns are ignored; an empty table
    gives no rows. Scores beyond 64 bits are an error.
    """
    label = F.col(label_col).cast("int")
    if flip_every:
        label = F.when(F.col(id_col) % flip_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    vector = F.col(vector_col)
    present = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector)
    points = rows.where(present).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), scaled(vector, scale).alias("vector"))
    shards = materialise(shards_of(points, max(positives + 1, negatives)), "negatives-shards")

    anchors = points.where(F.col("id") % every == 0).distinct().select(
        F.xxhash64("id", "label", "vector").alias("ask"), F.col("id").alias("own"), F.size("vector").alias("dim"),
        "label", "vector")
    anchors = materialise(anchors, "negatives-anchors")
    window = "array<struct<tag:bigint,low:bigint,high:bigint>>"
    every_score = F.array(F.struct(
        F.lit(0).cast("long").alias("tag"), F.lit(None).cast("long").alias("low"),
        F.lit(None).cast("long").alias("high"))).cast(window)
    near = materialise(search_shards(
        shards, anchors.withColumn("windows", every_score), positives, True), "negatives-positives")
    # low <= 100 * score <= high, in whole numbers
    bounds = near.where(F.col("score") >= 0).select(
        "ask", F.struct(
            F.col("id").alias("tag"), F.expr(f"(score * {low_percent} + 99) div 100").alias("low"),
            F.expr(f"(score * {high_percent}) div 100").alias("high")).alias("w"))
    windows = bounds.groupBy("ask").agg(F.collect_list("w").cast(window).alias("windows"))
    asking = anchors.withColumn("own", F.lit(None).cast("long")).join(windows, "ask")
    found = search_shards(shards, asking, negatives, False)
    named = anchors.select("ask", F.col("own").alias("anchor_id"))
    return found.select("ask", F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(
        near.select("ask", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["ask", "positive_id"]).join(named, "ask").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
