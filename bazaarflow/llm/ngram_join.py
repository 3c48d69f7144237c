"""Near duplicates by a Jaccard join on n-grams of words, with prefix filtering.

N-grams are ordered rare first, by corpus counts of their words. Two sets that reach the similarity
share an n-gram in their prefixes, so sets meet on prefix n-grams. Equal sets are one class before that. A
first pass verifies, for every set, the neighbours it meets most often; sets that are connected then need no
further comparison. The second pass meets all pairs that are not connected yet, with length,
positional and suffix filters (the last on bit maps of the whole sets), and verifies each
remaining pair once, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.llm.blobs import pack_arrays, unpack_arrays
from bazaarflow.llm.graph import bit_filter, components, in_filter
from bazaarflow.llm.tables import keep_rows, releasing, text_key
from bazaarflow.llm.words import SMALL_CHUNK, Words, chunks, mix, window_hashes, window_starts, word_hashes, words_of
from bazaarflow.session import materialise

COUNTERS = 1 << 21
SEGMENTS = 32
NEIGHBOURS = 2
MAP_WORDS = 8


def count_words(rows: DataFrame) -> np.ndarray:
    """The frequency class of every counter: 8 log2(1 + words in it), over all texts.

    Words share COUNTERS counters by hash, so the table has one size for every corpus; COUNTERS bytes come
    to the driver.
    """
    size = COUNTERS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                hashes = word_hashes(words_of(part.column(0), lower=True))
                place = np.sort((hashes & np.uint64(COUNTERS - 1)).astype(np.int64))
                first = np.flatnonzero(np.diff(place, prepend=-1))
                total[place[first]] += np.diff(np.append(first, len(place)))
        blobs = [pack_arrays(s, level=1) for s in np.split(total, SEGMENTS)] if total.any() else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["segment", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for blob in frame["counts"]:
            total += unpack_arrays(blob)[0]
        classes = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        return pd.DataFrame({"segment": [int(frame["segment"].iloc[0])], "classes": [classes.tobytes()]})

    found = rows.select("text").mapInArrow(releasing(count), "segment int, counts binary").groupBy("segment").applyInPandas(
        add, "segment int, classes binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for row in found:
        out[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(row["classes"], np.uint8)
    return out


def ngram_sets(words: Words, size: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of every text and where each text's begin; rare first with ``classes``.

    A text with fewer words is one n-gram of all its words; without words it has none.
    """
    hashes = word_hashes(words)
    count = np.diff(words.first)
    at = window_starts(words, size)
    grams = window_hashes(hashes, size)[at]
    doc = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((count > 0) & (count < size))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        more = count[short] > k
        word = hashes[np.minimum(words.first[short] + k, max(len(hashes) - 1, 0))] if len(short) else whole
        whole = np.where(more, mix(whole * np.uint64(31) + word + np.uint64(k)), whole)
    if classes is None:
        order_of = np.zeros(len(grams), np.uint64)
        short_order = np.zeros(len(short), np.uint64)
    else:
        rarity = classes[hashes & np.uint64(COUNTERS - 1)].astype(np.uint64)
        least = np.full(len(at), 255, np.uint64)
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            least = np.minimum(least, rarity[at + k])
            total += rarity[at + k]
        order_of = least << np.uint64(16) | total
        short_order = np.zeros(len(short), np.uint64)
    doc = np.concatenate([doc, short])
    grams = np.concatenate([grams, whole])
    order_of = np.concatenate([order_of, short_order])
    order = np.lexsort((grams, order_of, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


_MAP = [f"map{k}" for k in range(MAP_WORDS)]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def describe_sets(rows: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, key, n, d1, d2, prefix, map) of every row; d1 and d2 are a digest of the set.

    A set of n shares at least percent * n / 100 with every set it links to, so one of the
    n - ceil(percent * n / 100) + 1 rarest n-grams is among them. ``map`` has 64 * MAP_WORDS bits,
    each the parity of the n-grams that hash to it: two maps differ in no more bits than the sets
    in n-grams.
    """
    shared = rows.sparkSession.sparkContext.broadcast(classes)  # COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                grams, first = ngram_sets(words_of(part.column(2), lower=True), size, shared.value)
                n = np.diff(first)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
                        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                bounds = np.concatenate([[0], np.cumsum(length)])
                taken = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], length)
                bits = 64 * MAP_WORDS
                doc = np.repeat(np.arange(len(n)), n)
                place = doc * bits + (mix(grams) >> np.uint64(40)).astype(np.int64) % bits
                parity = np.bincount(place, minlength=len(n) * bits) & 1
                maps = np.packbits(parity.astype(bool).reshape(len(n), bits), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(n, pa.int32()),
                    *[pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums],
                    _lists(grams[taken], bounds), *[pa.array(maps[:, k]) for k in range(MAP_WORDS)]],
                    ["doc_id", "key", "n", "d1", "d2", "prefix", *_MAP])

    return rows.mapInArrow(releasing(run), (
        "doc_id long, key long, n int, d1 long, d2 long, prefix array<long>, " + ", ".join(f"{m} long" for m in _MAP)))


def needed_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest overlap with which sets of n and m reach the similarity."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def _verified(pairs: DataFrame, classes_of: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link, checked on the full sets of their classes' first rows.

    Only texts whose key passes a fixed-size filter of the keys in question are turned into sets.
    """
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = materialise(classes_of.join(nodes, "node").select("node", "doc_id", "key"), "ngram-wanted")
    bits = bit_filter(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_filter(bits, batch.column(1).to_numpy().astype(np.int64))
            batch = batch.filter(pa.array(hit))
            for part in chunks(batch, "text", SMALL_CHUNK):
                grams, first = ngram_sets(words_of(part.column(2), lower=True), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _lists(grams, first)], ["doc_id", "key", "grams"])

    found = rows.mapInArrow(releasing(run), "doc_id long, key long, grams array<long>")
    same = found["doc_id"].eqNullSafe(wanted["doc_id"]) & (found["key"] == wanted["key"])
    sets = found.join(wanted, same).select("node", "grams").dropDuplicates(["node"])
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), "u")
    full = left.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v")
    overlap = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - overlap
    return full.where(100 * overlap >= percent * union).select("u", "v")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``row_key``, ``n_shingles`` and ``component_id``.

    Texts are lower-cased (A-Z) and cut into words; a text's set has its distinct shingles of
    ``size`` words, a shorter text is one shingle. Two rows link when 100 * intersection >=
    percent * union; ``component_id`` is the smallest id reachable by links, the row's own included.
    Rows without words link with nothing. Null ids count as larger than all others; rows may
    repeat ids and texts; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), text.alias("text"))
    described = materialise(describe_sets(rows, count_words(rows), size, percent), "ngram-sets")

    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    classes = materialise(
        described.where("n > 0").groupBy("d1", "d2", "n").agg(first_row, *[F.max(m).alias(m) for m in _MAP]).select(
            F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", "f.doc_id", "f.key", *_MAP), "ngram-classes")
    same = described["doc_id"].eqNullSafe(classes["doc_id"]) & (described["key"] == classes["key"])
    met = described.select("doc_id", "key", "prefix").join(
        classes.select("node", "n", "doc_id", "key"), same).dropDuplicates(["node"]).select(
        "node", "n", F.posexplode("prefix").alias("place", "gram"))
    several = met.groupBy("gram").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = materialise(met.join(several.select("gram"), "gram", "left_semi"), "ngram-prefixes")

    first = materialise(_first_links(shared, classes, rows, size, percent), "ngram-links")
    other = _other_links(shared, _near_labels(first), classes, rows, size, percent)
    joined = components(first.union(other))

    placed = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "root").select("d1", "d2", "n", "component_id")
    full, empty = described.where("n > 0"), described.where("n = 0")
    columns = [F.col("doc_id").alias(id_col), F.col("key").alias("row_key"), F.col("n").cast("long").alias("n_shingles")]
    return full.join(named, ["d1", "d2", "n"]).select(*columns, "component_id").union(
        empty.select(*columns, F.col("doc_id").alias("component_id")))


def _first_links(shared: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of each set to the most typical sets in the lists of its n-grams.

    The text that many were copied from has most n-grams in common with others, so it is what its
    copies are compared with first. This pass only saves work for the next one: what it leaves out
    is met there.
    """
    weight = shared.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    typical = shared.join(weight, "node").groupBy("gram").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("least"), "n")).alias("t")).select(
        "gram", (-F.col("t.least")).alias("v"), F.col("t.n").alias("m"))
    often = shared.join(typical, "gram").where(
        (F.col("v") != F.col("node")) & _similar_size(F.col("n"), F.col("m"), percent)).groupBy(
        "node", "v", "n", "m").agg(F.count(F.lit(1)).alias("times"))
    enough = F.col("times") >= _needed_prefix(F.col("n"), F.col("m"), percent) / 2
    best = W.partitionBy("node").orderBy(F.desc("times"), "v")
    pairs = often.where(enough).withColumn("r", F.row_number().over(best)).where(F.col("r") <= NEIGHBOURS)
    pairs = _close_maps(pairs.select(F.col("node").alias("u"), "v", "n", "m"), classes, percent)
    return _verified(materialise(pairs, "ngram-first-pairs"), classes, rows, size, percent)


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node within two links. Equal roots are connected, others may be."""
    both = links.union(links.select("v", "u"))
    one = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    two = both.join(one, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
    return materialise(
        two.join(one, F.col("u") == F.col("node")).select("node", F.least("label", "least").alias("root")), "ngram-labels")


def _similar_size(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= percent * m) & (m * 100 >= percent * n)


def _map_distance(left: str, right: str) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{left}{m}").bitwiseXOR(F.col(f"{right}{m}"))) for m in _MAP])


def _close_maps(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs whose maps differ in no more bits than linked sets can differ in n-grams."""
    maps = classes.select("node", *_MAP)
    both = pairs.join(maps.select(F.col("node").alias("u"), *[F.col(m).alias(f"a{m}") for m in _MAP]), "u").join(
        maps.select(F.col("node").alias("v"), *[F.col(m).alias(f"b{m}") for m in _MAP]), "v")
    most = F.col("n") + F.col("m") - 2 * needed_overlap(F.col("n"), F.col("m"), percent)
    return both.where(_map_distance("a", "b") <= most).select("u", "v")


def _needed_prefix(n: Column, m: Column, percent: int) -> Column:
    """How many n-grams two prefixes must share at least.

    The prefix that ends at the rarer n-gram has all its common n-grams in the other prefix too;
    what the sets share beyond is at most the rest of that set.
    """
    rest = F.ceil(percent * F.greatest(n, m) / 100 - 1e-9) - 1
    return F.greatest(needed_overlap(n, m, percent) - rest, F.lit(1))


def _other_links(
    shared: DataFrame, part: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int,
) -> DataFrame:
    """Links among the sets that are not connected yet."""
    placed = shared.join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.join(
        placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
            "low < high").select("gram"), "gram").join(classes.select("node", *_MAP), "node")
    a = mixed.select(
        "gram", F.col("node").alias("u"), "n", F.col("place").alias("i"), F.col("root").alias("ru"),
        *[F.col(m).alias(f"a{m}") for m in _MAP])
    b = mixed.select(
        "gram", F.col("node").alias("v"), F.col("n").alias("m"), F.col("place").alias("j"), F.col("root").alias("rv"),
        *[F.col(m).alias(f"b{m}") for m in _MAP])
    n, m = F.col("n"), F.col("m")
    overlap = needed_overlap(n, m, percent)
    ordered = (n < m) | ((n == m) & (F.col("u") < F.col("v")))
    # Where this n-gram is the first in common, what follows it must be enough.
    room = (F.col("i") + overlap <= n) & (F.col("j") + overlap <= m)
    near = _map_distance("a", "b") <= n + m - 2 * overlap
    met = a.join(b, "gram").where(
        (F.col("ru") != F.col("rv")) & ordered & _similar_size(n, m, percent) & room & near)
    pairs = met.select("u", "v").distinct()
    return _verified(materialise(pairs, "ngram-pairs"), classes, rows, size, percent)


def drop_near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, in its own columns.

    Of several rows with that id the one with the smallest content hash stays.
    """
    groups = near_duplicates(docs, size, percent, id_col, text_col)
    kept = groups.where(F.col("n_shingles") > 0).groupBy("component_id").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row_key")).alias("f")).select("f.id", "f.row_key")
    kept = kept.union(groups.where(F.col("n_shingles") == 0).select(id_col, "row_key").distinct())
    return keep_rows(docs.withColumn(id_col, F.col(id_col).cast("long")), kept, id_col, text_col)
