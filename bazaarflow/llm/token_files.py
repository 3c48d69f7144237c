"""Files of token ids, compressed by a Re-Pair grammar per shard, that can be read anywhere.

A file set is a folder of Parquet files whose rows are shards: documents in ascending id order, up to
about ``SHARD_IDS`` ids. A shard's ``body`` holds rules, expansion lengths and symbols (``grammar``);
the other columns say which documents and how many ids it has, so readers skip shards unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bazaarflow.llm import grammar
from bazaarflow.llm.blobs import pack_arrays, unpack_arrays
from bazaarflow.llm.merges import batch_encoder
from bazaarflow.llm.tables import text_key
from bazaarflow.llm.words import chunks

SHARD_IDS = 1 << 19
_TEXT_BYTES = 1 << 20
_FILE = ("part long, shard long, first_doc long, last_doc long, docs long, ids long, before long, "
         "names binary, body binary")


def write_tokens(
    docs: DataFrame, out: str, path: str, end_id: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", shard_ids: int = SHARD_IDS,
) -> None:
    """Encode every text and write the ids, in ascending order of the document id, to folder ``out``.

    ``path`` is the tokenizer's file; ``end_id`` is added to every document. Rows are range-sorted
    by id and, where ids are equal, by their text and then as they are read: one id may hold any
    share of the rows. Null ids come first; a null text counts as empty; a document of any length is
    whole in one shard. Repeated rows are written as often as they come; other columns are ignored;
    an empty table gives a folder without rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(path)
        part = TaskContext.get().partitionId()
        base = max(len(encoder.words.tokens), 1 + (end_id or 0))
        names: list[int | None] = []
        held: list[np.ndarray] = []
        totals: list[np.ndarray] = []
        gathered = shard = before = 0

        def close() -> pa.RecordBatch:
            nonlocal names, held, totals, gathered, shard, before
            ids, counts = np.concatenate(held), np.concatenate(totals)
            known = [n for n in names if n is not None]
            absent = np.array([n is None for n in names], np.uint8)
            row = [part, shard, known[0] if known else None, known[-1] if known else None, len(names), len(ids),
                   before, pack_arrays(np.array([n or 0 for n in names], np.int64), absent),
                   grammar.to_bytes(grammar.compress(ids, counts, base))]
            names, held, totals, gathered, shard, before = [], [], [], 0, shard + 1, before + len(ids)
            kinds = [pa.int64()] * 7 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in _FILE.split(", ")])

        for batch in batches:
            for some in chunks(batch, "text", _TEXT_BYTES):
                ids, cuts = encoder.encode(some.column(1))
                if end_id is not None:
                    ids = np.insert(ids, cuts[1:], end_id)
                    cuts = cuts + np.arange(len(cuts))
                names += some.column(0).to_pylist()
                held.append(ids)
                totals.append(np.diff(cuts))
                gathered += len(ids)
                if gathered >= shard_ids:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ordered = rows.withColumns({"tie": text_key("text"), "row": F.monotonically_increasing_id()}).orderBy(
        F.col("doc").asc_nulls_first(), "tie", "row").select("doc", "text")
    ordered.mapInArrow(run, _FILE).write.mode("overwrite").parquet(out)


def read_tokens(
    spark: SparkSession, out: str, between: tuple[int, int] | None = None, keep_ids: bool = True,
) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens, ids_crc32 and ids.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned crc32 of the ids
    as little-endian unsigned 32-bit integers, which is also what ``ids`` holds (null without
    ``keep_ids``). ``between`` (first and last id) reads only shards that may hold such documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, before, names, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shard = grammar.from_bytes(body)
                ids = grammar.expand_all(shard).astype("<u4")
                docs, absent = unpack_arrays(names)
                ends = np.cumsum(shard.totals)
                starts = ends - shard.totals
                pieces = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64(), mask=absent.astype(bool)), pa.array(offset + before + starts),
                    pa.array(shard.totals), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    pa.array(pieces if keep_ids else [None] * len(pieces), pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    shards = spark.read.schema(_FILE).parquet(out)
    # One row per task that wrote the files, whatever their size.
    sizes = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    if between:
        shards = shards.where((F.col("last_doc") >= between[0]) & (F.col("first_doc") <= between[1]))
    placed = shards.join(F.broadcast(offsets), "part").select("offset", "before", "names", "body")
    found = placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found.where(F.col("doc_id").between(*between)) if between else found


def read_slices(spark: SparkSession, out: str, slices: DataFrame) -> DataFrame:
    """Parts of documents: (doc_id, begin, end, ids) for rows (doc_id, begin, end) of ``slices``.

    Random access: of each document only the symbols that cover the part are expanded. Documents
    that several rows share an id are all answered; unknown ids give no row. Slices are grouped per
    shard after a join on the id, so no task holds more than a shard and what is asked of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, docs, places, begins, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                shard = grammar.from_bytes(body)
                ids = [grammar.slice_document(shard, p, b, e).astype("<u4").tobytes()
                       for p, b, e in zip(places, begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()),
                     pa.array(ids, pa.binary())], ["doc_id", "begin", "end", "ids"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, names in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, absent = unpack_arrays(names)
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n), pa.array([shard] * n), pa.array(docs, mask=absent.astype(bool)),
                     pa.array(np.arange(n))], ["part", "shard", "doc_id", "place"])

    shards = spark.read.schema(_FILE).parquet(out)
    known = shards.select("part", "shard", "names").mapInArrow(
        listed, "part long, shard long, doc_id long, place long")
    asked = slices.select("doc_id", "begin", "end").join(known, "doc_id").groupBy("part", "shard").agg(
        *[F.collect_list(c).alias(c) for c in ("doc_id", "place", "begin", "end")])
    return shards.select("part", "shard", "body").join(asked, ["part", "shard"]).select(
        "body", "doc_id", "place", "begin", "end").mapInArrow(
        run, "doc_id long, begin long, end long, ids binary")
