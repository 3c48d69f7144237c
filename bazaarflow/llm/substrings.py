"""Repeated word windows by super-k-mers.

The minimiser of a window is the smallest hash of the runs of MINIMISER words in it. Consecutive
windows with one minimiser travel as one packed string, the super-k-mer, to the minimiser's bucket,
so equal windows meet in one bucket while most words travel only a few times. A bucket sorts its
windows and finds for each whether its words begin earlier somewhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.blobs import pack_arrays, unpack_arrays
from bazaarflow.llm.tables import text_key
from bazaarflow.llm.words import Words, chunks, find_words, window_hashes, window_starts, word_hashes, words_of

WINDOW = 20
MINIMISER = 3
FLUSH_BYTES = 1 << 23
WINDOWS_AT_ONCE = 4_000_000
_LAST_ID = np.iinfo(np.int64).max


def _canonical(words: Words) -> tuple[bytes, np.ndarray]:
    """All words each followed by one space, and where each begins (one entry more at the end)."""
    size = words.ends - words.starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(begin[-1], 32, np.uint8)
    inside = np.repeat(words.starts - begin[:-1], size - 1)
    target = np.delete(np.arange(begin[-1]), begin[1:] - 1)
    out[target] = words.data[target + inside]
    return out.tobytes(), begin


def super_kmers(words: Words, window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of every super-k-mer.

    Window and word of one number begin together.
    """
    at = window_starts(words, window)
    if not at.size:
        return at, at, np.zeros(0, np.uint64)
    runs = window_hashes(word_hashes(words), size)
    reach = window - size + 1  # runs in a window
    least, width = runs, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[at], least[at + reach - width])
    cut = np.ones(len(at), bool)
    cut[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(cut)
    return at[first], np.diff(np.append(first, len(at))), least[first]


class _Packer:
    """Super-k-mers of a task, by bucket; equal ones are folded to the earliest before they travel."""

    def __init__(self, buckets: int, window: int, size: int):
        self.buckets, self.window, self.size = buckets, window, size
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.known: dict[bytes, list] = {}
        self.repeated: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, ids: list, keys: list, words: Words) -> None:
        text, begin = _canonical(words)
        first, count, minimiser = super_kmers(words, self.window, self.size)
        doc = np.searchsorted(words.first, first, "right") - 1
        start = first - words.first[doc]
        bucket = (minimiser % np.uint64(self.buckets)).astype(int)
        low, high = begin[first], begin[first + count + self.window - 1] - 1
        base = len(self.docs)
        self.docs += zip(ids, keys)
        known = self.known
        columns = (doc + base, start, count, bucket, low, high)
        for d, s, n, b, x, y in zip(*[c.tolist() for c in columns]):
            piece = text[x:y]
            old = known.get(piece)
            if old is None:
                known[piece] = [d, s, n, b]
            else:
                self._meet(old, d, s, n)
        self.bytes += len(text)

    def _meet(self, old: list, d: int, s: int, n: int) -> None:
        """Two equal super-k-mers of one task: the earlier one stays, the other is repeated."""
        a, b = self._order(old[0], old[1]), self._order(d, s)
        if b < a:
            self.repeated.append((old[0], old[1], n))
            old[0], old[1] = d, s
        elif a < b:
            self.repeated.append((d, s, n))

    def _order(self, d: int, start: int) -> tuple[int, int, int]:
        doc, key = self.docs[d]
        return (_LAST_ID if doc is None else doc), start, key

    def flush(self) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for piece, (d, s, n, b) in self.known.items():
            by_bucket.setdefault(b, []).append((d, s, n, piece))
        if self.repeated:  # what is known already goes along with any bucket
            by_bucket.setdefault(min(by_bucket), [])
        buckets, blobs = [], []
        for bucket, entries in by_bucket.items():
            marks = self.repeated if bucket == min(by_bucket) else []
            d = np.array([e[0] for e in entries] + [m[0] for m in marks], np.int64)
            used, local = np.unique(d, return_inverse=True)
            ids = [self.docs[i] for i in used.tolist()]
            blobs.append(pack_arrays(
                np.array([i or 0 for i, _ in ids], np.int64), np.array([i is None for i, _ in ids], np.uint8),
                np.array([k for _, k in ids], np.int64), local.astype(np.int32),
                np.array([e[1] for e in entries] + [m[1] for m in marks], np.int32),
                np.array([e[2] for e in entries] + [m[2] for m in marks], np.int32),
                np.array([len(marks)], np.int32), b"\n".join([e[3] for e in entries])))
            buckets.append(bucket)
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _packed(rows: DataFrame, buckets: int, window: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, window, size)
        for batch in batches:
            for part in chunks(batch, "text"):
                packer.add(part.column(0).to_pylist(), part.column(1).to_pylist(), words_of(part.column(2)))
                if packer.bytes >= FLUSH_BYTES and packer.known:
                    yield from packer.flush()
        if packer.known:
            yield from packer.flush()

    return rows.mapInArrow(run, "bucket int, blob binary")


def _windows(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of a blob's super-k-mers, in order, and its super-k-mer."""
    ends = np.append(np.flatnonzero(text == 10), len(text))
    words = find_words(text, np.concatenate([[0], ends[:-1] + 1, [len(text)]]))
    at = window_starts(words, window)
    of = np.searchsorted(words.first, at, "right") - 1
    return (window_hashes(word_hashes(words), window)[at], window_hashes(word_hashes(words, 1), window)[at], of)


def _repeated_windows(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """The ranges of windows of one bucket that begin earlier elsewhere.

    Windows are sorted in passes over disjoint ranges of their hash, so a bucket of any size is
    sorted in bounded memory.
    """
    blobs = list(frame["blob"])
    counts = [unpack_arrays(b)[5:7] for b in blobs]
    total = sum(int(n[:len(n) - m[0]].sum()) for n, m in counts)
    passes = -(-total // WINDOWS_AT_ONCE) or 1
    out = []
    for turn in range(passes):
        columns = []
        for blob in blobs:
            ids, missing, keys, doc, start, count, marks, text = unpack_arrays(blob)
            ids = np.where(missing == 1, _LAST_ID, ids)
            kept = len(doc) - int(marks[0])
            if turn == 0 and marks[0]:
                d = doc[kept:]
                out.append(_ranges(ids[d], missing[d], keys[d], start[kept:], count[kept:]))
            doc, start, count = doc[:kept], start[:kept], count[:kept]
            if not len(doc):
                continue
            high, low, of = _windows(text, window)
            place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            if passes > 1:
                mine = high % np.uint64(passes) == turn
                high, low, of, place = high[mine], low[mine], of[mine], place[mine]
            d = doc[of]
            columns.append((high, low, ids[d], missing[d], keys[d], place))
        if not columns:
            continue
        high, low, ids, missing, keys, place = map(np.concatenate, zip(*columns))
        order = np.argsort(high, kind="stable")
        same = high[order][1:] == high[order][:-1]
        shared = np.zeros(len(high), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        some = np.flatnonzero(shared)
        if not some.size:
            continue
        some = some[np.lexsort((keys[some], place[some], ids[some], low[some], high[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (high[some][1:] != high[some][:-1]) | (low[some][1:] != low[some][:-1])
        earliest = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        later = ~((ids[some] == ids[earliest]) & (place[some] == place[earliest]) & (keys[some] == keys[earliest]))
        some = some[later]
        some = some[np.lexsort((place[some], keys[some], ids[some]))]
        cut = np.ones(len(some), bool)
        cut[1:] = ((ids[some][1:] != ids[some][:-1]) | (keys[some][1:] != keys[some][:-1])
                   | (place[some][1:] > place[some][:-1] + 1))
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(some)) - 1 if len(some) else first
        begin = some[first]
        out.append(_ranges(ids[begin], missing[begin], keys[begin], place[begin], place[some[last]] - place[begin] + 1))
    return pd.concat(out) if out else _ranges(*[np.zeros(0, np.int64)] * 5)


def _ranges(ids, missing, keys, start, count) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64") if not np.any(missing) else pd.array(
            [None if m else int(i) for i, m in zip(ids, missing)], "Int64"),
        "key": keys.astype(np.int64), "start": start.astype(np.int64), "windows": count.astype(np.int64)})


def repeated_ranges(rows: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """(doc_id, key, ranges): the ranges (start, windows) of each row's repeated windows.

    ``rows`` has doc_id, key (a hash of the text) and text. There are as many buckets as shuffle
    partitions.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(rows, buckets, window, size)
    found = packed.groupBy("bucket").applyInPandas(
        lambda frame: _repeated_windows(frame, window), "doc_id long, key long, start long, windows long")
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))


def _covered(count: int, ranges, window: int) -> np.ndarray:
    steps = np.zeros(count + 1, np.int64)
    for r in ranges:
        steps[r["start"]] += 1
        steps[min(count, r["start"] + r["windows"] + window - 1)] -= 1
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    size: int = MINIMISER, keep_text: bool = True,
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, on request, ``kept_text``.

    A word goes when a window of ``window`` words that covers it begins earlier too: in a row with
    a smaller id (a null id is the largest), or earlier in the same document. All windows are
    judged on the input. Kept words are joined by one space. Null and empty texts have no words;
    rows with equal id and text have equal results and do not remove each other's words; rows with
    one id and different texts are one document to the order of windows; other columns are ignored;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), text.alias("text"))
    marks = repeated_ranges(rows, window, size).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    joined = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_id"]) & (rows["key"] == marks["_key"]), "left").select(
        "doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FLUSH_BYTES):
                counts, removed, digests, texts = [], [], [], []
                for text, ranges in zip(part.column(1), part.column(2)):
                    words = text.as_py().encode().split()
                    counts.append(len(words))
                    if ranges.is_valid:
                        words = list(compress(words, ~_covered(len(words), ranges.as_py(), window)))
                    removed.append(counts[-1] - len(words))
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return (out if keep_text else out.drop("kept_text")).withColumnRenamed("doc_id", id_col)
