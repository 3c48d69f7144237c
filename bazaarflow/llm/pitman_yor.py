"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling.

A word's restaurant is the word before it (nothing at the start of a text), found by a hash of
``CONTEXT_BITS``. Restaurants of words that end alike (the last two bytes, in 256 classes) share a
parent, all classes share the unigram restaurant, and its base is uniform over the training vocabulary
and one unknown word. Counts, tables and probabilities of a word depend on other words only through
totals per restaurant, so words are dealt to buckets, every sweep seats all buckets in parallel, and
the totals (a table of fixed size) are what sweeps exchange. A word with a large share of all tokens is
dealt out by class, and what its parts must know of each other is among the totals.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.blobs import pack_arrays, unpack_arrays
from bazaarflow.llm.language import held_out
from bazaarflow.llm.words import chunks, mix, word_hashes, words_of
from bazaarflow.session import materialise

BURN_IN = 2
SAMPLES = 3
FLUSH_BYTES = 1 << 23
ONE_BY_ONE = 256
CONTEXT_BITS = 20
HOT_SHARE = 4  # a word is hot from 1 / (HOT_SHARE * buckets) of all tokens
SLICES = 64
UNITS = (1 << 26, 1 << 30)  # a bucket's share of a document's score and base score is sent in whole parts of this size
END = np.uint64(0x454E444F46544558)
CLASSES = 256
# Discounts and strengths that are tried, from the parents down: unigram, class, word.
DISCOUNTS = (0.4, 0.55, 0.7, 0.85)
STRENGTHS = (0.2, 2.0, 20.0, 200.0)


class Params(NamedTuple):
    """Discount and strength of the unigram, class and word restaurants."""

    discounts: tuple[float, float, float] = (0.7, 0.7, 0.55)
    strengths: tuple[float, float, float] = (20.0, 2.0, 0.2)


class Totals(NamedTuple):
    """Customers and tables of every restaurant, from all words, and what is known of each hot word."""

    c2: np.ndarray
    t2: np.ndarray
    c1: np.ndarray
    t1: np.ndarray
    c0: int
    t0: int
    words: int  # V
    tokens: int
    hot_c0: np.ndarray
    hot_n: np.ndarray  # how often it occurs


class Counts(NamedTuple):
    """A bucket's words (sorted) and their training counts by context, in order of word, class and context."""

    words: np.ndarray
    of: np.ndarray  # the pair's word
    context: np.ndarray
    count: np.ndarray


class Seating(NamedTuple):
    t2: np.ndarray
    c1: np.ndarray
    t1: np.ndarray
    c0: np.ndarray  # own tables of the classes in this bucket; all buckets' for a hot word
    t0: np.ndarray


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and text of every token, and tokens per text; each text ends with END."""
    words = words_of(column, lower=True)
    count = np.diff(words.first)
    n = len(count)
    doc = np.repeat(np.arange(n, dtype=np.int32), count + 1)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    token = np.full(len(doc), END, np.uint64)
    hashes = word_hashes(words)
    last = np.zeros(len(words.starts), np.uint64)
    if len(last):
        last[:] = words.data[words.ends - 1]
        longer = words.ends - words.starts > 1
        last[longer] |= words.data[words.ends[longer] - 2].astype(np.uint64) << np.uint64(8)
    ending = mix(last + np.uint64(1)) & np.uint64(CLASSES - 1)
    own = hashes >> np.uint64(64 - (CONTEXT_BITS - 8)) << np.uint64(8)
    is_word = np.ones(len(doc), bool)
    is_word[first[1:] - 1] = False
    token[is_word] = hashes
    context = np.zeros(len(doc), np.int32)
    after = np.flatnonzero(is_word) + 1
    context[after] = (own | ending).astype(np.int32)
    return token, context, doc, count + 1


def _hot_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """The words with at least 1 / (HOT_SHARE * buckets) of all tokens; at most twice as many come back.

    A task reports the words that have half that share of what it has just read, so no word of that
    share is missed.
    """
    least = 1 / (2 * HOT_SHARE * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                token = _tokens(part.column(0))[0]
                cell = (token & np.uint64(0xFFFF)).astype(np.int64)
                heavy = np.bincount(cell, minlength=1 << 16) >= least * len(token)  # a word has no more than its cell
                words, count = np.unique(token[heavy[cell]], return_counts=True)
                some = count >= least * len(token)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(words[some], np.uint64(0)).view(np.int64)), pa.array(np.append(count[some], len(token)))],
                    ["word", "n"])

    seen = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.broadcast(seen.where("word = 0").select(F.col("n").alias("total")))  # one row
    rows = seen.where("word <> 0").join(total).where(F.col("n") >= least * F.col("total")).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _gather(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Counts of (word, context, document), packed by bucket for some documents at a time.

    Rows are (bucket, part, blob). A negative bucket's blob has the documents of the part themselves:
    doc_id and whether it is null, held_out and n_tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                held.append((part, _tokens(part.column(2))))
                size += part.column(2).nbytes
                if size >= FLUSH_BYTES:
                    yield from _flush(held, task, buckets, hot)
                    held, size, task = [], 0, task + 1
                    _release()
        if held:
            yield from _flush(held, task, buckets, hot)
        held = []
        _release()

    return docs.mapInArrow(run, "bucket int, part long, blob binary")


def _flush(held: list[tuple], part: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches([p for p, _ in held]).select([0, 1]).combine_chunks()
    n = rows.num_rows
    token = np.concatenate([t[0] for _, t in held])
    context = _by_class(np.concatenate([t[1] for _, t in held]))
    base = np.cumsum([0, *[p.num_rows for p, _ in held[:-1]]]).astype(np.int32)
    doc = np.concatenate([t[2] + b for b, (_, t) in zip(base, held)])
    tokens = np.concatenate([t[3] for _, t in held])
    flags = rows.column(1).to_numpy().astype(np.uint8)
    spread = np.where(_find(hot, token) >= 0, (context >> (CONTEXT_BITS - 8)).astype(np.uint64), np.uint64(0))
    bucket = ((token % np.uint64(buckets) + spread) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((context, token, bucket))  # stable: documents stay in order
    token, context, doc, bucket = token[order], context[order], doc[order], bucket[order]
    new_word = np.ones(len(token), bool)
    new_word[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
    new_pair = new_word.copy()
    new_pair[1:] |= context[1:] != context[:-1]
    new = new_pair.copy()
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(token)))
    cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
    numbers, blobs = [], []
    for b in range(buckets):
        a = at[cuts[b]:cuts[b + 1]]
        if not a.size:
            continue
        pairs = a[new_pair[a]]
        per_word = np.diff(np.append(np.flatnonzero(new_word[pairs]), len(pairs)))
        per_pair = np.diff(np.append(np.flatnonzero(new_pair[a]), len(a)))
        blobs.append(pack_arrays(
            np.diff(token[a[new_word[a]]], prepend=np.uint64(0)), per_word.astype(np.int32), _steps(context[pairs]),
            per_pair.astype(np.int32), doc[a].astype(np.uint16 if n < 1 << 16 else np.int32),
            times[cuts[b]:cuts[b + 1]].astype(np.int32), flags))
        numbers.append(b)
    ids = rows.column(0).combine_chunks()
    numbers.append(-1 - part % buckets)
    blobs.append(pack_arrays(
        ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
        flags, tokens.astype(np.int64)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array([part] * len(numbers), pa.int64()), pa.array(blobs, pa.binary())],
        ["bucket", "part", "blob"])


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, their bytes by significance: the high ones are nearly all zero."""
    return _planes(np.diff(values, prepend=np.int32(0)).astype(np.int32))


def _values(steps: np.ndarray) -> np.ndarray:
    """What ``_steps`` was made of."""
    return np.cumsum(_whole(steps, np.int32), dtype=np.int32)


def _planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).ravel()


def _whole(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _by_class(context: np.ndarray) -> np.ndarray:
    """A context's place when contexts are ordered by class."""
    return (context & (CLASSES - 1)) << (CONTEXT_BITS - 8) | context >> 8


def _from_class(place: np.ndarray) -> np.ndarray:
    return (place & ((1 << CONTEXT_BITS - 8) - 1)) << 8 | place >> (CONTEXT_BITS - 8)


def _entries(blob: bytes) -> tuple[np.ndarray, ...]:
    """Words; each pair's word, context and entries; each entry's document and times; the documents' flags."""
    steps, per_word, context, per_pair, doc, times, flags = unpack_arrays(blob)
    words = np.cumsum(steps, dtype=np.uint64)
    context = _from_class(_values(context))
    return words, np.repeat(np.arange(len(words)), per_word), context, per_pair, doc.astype(np.int64), times, flags


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Counts:
    """Add up (word, context, count) lists."""
    token, context, count = map(np.concatenate, zip(*parts))
    words, of = np.unique(token, return_inverse=True)
    key, at = np.unique(of << CONTEXT_BITS | _by_class(context), return_inverse=True)
    total = np.bincount(at, count, len(key)).astype(np.int64)
    return Counts(words, key >> CONTEXT_BITS, _from_class((key & ((1 << CONTEXT_BITS) - 1)).astype(np.int32)), total)


def _pack_counts(c: Counts) -> bytes:
    per_word = np.bincount(c.of, minlength=len(c.words)).astype(np.int32)
    return pack_arrays(np.diff(c.words, prepend=np.uint64(0)), per_word, _steps(_by_class(c.context)), c.count.astype(np.int64))


def _unpack_counts(blob: bytes) -> Counts:
    steps, per_word, context, count = unpack_arrays(blob)
    return Counts(np.cumsum(steps, dtype=np.uint64), np.repeat(np.arange(len(per_word), dtype=np.int32), per_word),
                  _from_class(_values(context)), count)


def _collected(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's parts as one row: its pairs with their training counts, and each part's entries by pair."""
    if frame["bucket"].iloc[0] < 0:
        return pd.DataFrame({"bucket": frame["bucket"], "counts": None, "parts": [[p] for p in frame["part"]],
                             "entries": [[b] for b in frame["blob"]]})
    frame = frame.sort_values("part")
    lists, rest = [], []
    for blob in frame["blob"]:
        words, of, context, per_pair, doc, times, flags = _entries(blob)
        pair = np.repeat(np.arange(len(of)), per_pair)
        lists.append((words[of], context, np.bincount(pair, times * (flags[doc] == 0), len(of)).astype(np.int32)))
        rest.append((per_pair, doc, times, len(flags)))
    merged = _merge(lists)
    key = merged.of << CONTEXT_BITS | _by_class(merged.context)
    entries = []
    for (token, context, _), (per_pair, doc, times, n) in zip(lists, rest):
        place = np.searchsorted(key, np.searchsorted(merged.words, token) << CONTEXT_BITS | _by_class(context))
        entries.append(pack_arrays(
            _steps(place.astype(np.int32)), per_pair, doc.astype(np.uint16 if n < 1 << 16 else np.int32),
            times, np.array([n], np.int64)))
    del lists, rest, key
    _release()
    return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "counts": [_pack_counts(merged)],
                         "parts": [frame["part"].tolist()], "entries": [entries]})


def seat(count: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of one dish in each restaurant after its customers come in one by one.

    A customer opens a table with odds weight : customers - discount * tables. From ONE_BY_ONE on, customers
    come in groups of an eighth of those seated, who see the odds of the group's middle.
    """
    tables = (count > 0).astype(np.int64)
    many = np.flatnonzero(count > 1)
    many = many[np.argsort(-count[many], kind="stable")]  # those who still come are always the first ones
    least, weight = -count[many], weight[many]
    taken = np.ones(len(many))
    seated = 1
    while n := int(np.searchsorted(least, -seated)):
        w = weight[:n]
        if seated < ONE_BY_ONE:
            odds = w / (seated - discount * taken[:n] + w)
            taken[:n] += random.random(n) < odds
            seated += 1
        else:
            group = seated // 8
            some = np.minimum(-least[:n] - seated, group)
            odds = w / (seated + (some - 1) / 2 - discount * taken[:n] + w)
            taken[:n] += random.binomial(some, np.clip(odds, 0, 1))
            seated += group
    tables[many] = taken
    return tables


def _release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


class Bucket:
    """The words of one bucket in all restaurants."""

    def __init__(self, counts: Counts, number: int, buckets: int, hot: np.ndarray, params: Params = Params()):
        self.counts, self.number, self.params = counts, number, params
        last = counts.context & (CLASSES - 1)
        new = np.ones(len(last), bool)
        new[1:] = (counts.of[1:] != counts.of[:-1]) | (last[1:] != last[:-1])
        self.up = (np.cumsum(new) - 1).astype(np.int32)
        self.middle_of, self.last = counts.of[new], last[new]
        # Where one customer sits, the table is certain; sweeps draw only for the others.
        self.once = (counts.count > 0).astype(np.int64)
        many = np.flatnonzero(counts.count > 1)
        self.many = many[np.argsort(-counts.count[many], kind="stable")]
        self.alone = np.bincount(self.up[counts.count == 1], minlength=len(self.last))
        self.total = np.bincount(counts.of, counts.count, len(counts.words)).astype(np.int64)
        self.hot = _find(hot, counts.words)
        self.is_hot, self.hots = self.hot >= 0, len(hot)
        # A hot word is in many buckets; one of them speaks for it.
        self.speaks = ~self.is_hot | (counts.words % np.uint64(buckets) == np.uint64(number))

    def start(self) -> Seating:
        c1 = np.bincount(self.up, self.once, len(self.last)).astype(np.int64)
        t1 = (c1 > 0).astype(np.int64)
        c0 = np.bincount(self.middle_of, t1, len(self.total)).astype(np.int64)
        return Seating(self.once, c1, t1, c0, (c0 > 0).astype(np.int64))

    def totals(self, s: Seating, wide: tuple[np.ndarray, np.ndarray] | None = None) -> Totals:
        """The bucket's share of the totals; c2 and t2 are added to ``wide``.

        Where ``wide`` has no place for c2, t2 gets only the tables beyond those there were at the start.
        """
        add = lambda at, value, n: np.bincount(at, value, n).astype(np.int64)
        c2, t2 = wide or np.zeros((2, 1 << CONTEXT_BITS), np.int64)
        if len(c2):
            c2 += add(self.counts.context, self.counts.count, len(c2))
            t2 += add(self.counts.context, s.t2, len(t2))
        else:
            more = self.many[s.t2[self.many] > 1]
            np.add.at(t2, self.counts.context[more], s.t2[more] - 1)
        own = add(self.middle_of, s.t1, len(self.total))
        here = np.flatnonzero(self.is_hot)
        # Of a hot word the bucket that speaks for it gives the tables, all others only what they add.
        return Totals(
            c2, t2, add(self.last, s.c1, CLASSES), add(self.last, s.t1, CLASSES), int(own.sum()),
            int(s.t0[self.speaks].sum()), 0, int(self.counts.count.sum()),
            add(self.hot[here], own[here], self.hots), add(self.hot[here], self.total[here], self.hots),
        )._replace(words=int((self.total[~self.is_hot] > 0).sum()))

    def sweep(self, s: Seating, all_: Totals, turn: int) -> Seating:
        """Each word's customers leave a restaurant and are seated anew, from the leaves to the root."""
        random = np.random.default_rng((self.number, turn, 20060717))
        (d0, d1, d2), (b0, b1, b2) = self.params
        c0 = np.where(self.is_hot, all_.hot_c0[np.maximum(self.hot, 0)], s.c0) if self.hots else s.c0
        p0 = unigram(c0, s.t0, all_, self.params)
        up = self.up[self.many]
        rest = s.c1[up] - s.t2[self.many]  # the parent without this restaurant's customers
        p1 = lower(rest, np.minimum(s.t1[up], rest), all_.c1, all_.t1, self.last[up], p0[self.middle_of[up]], d1, b1)
        seated = seat(self.counts.count[self.many], (b2 + d2 * all_.t2[self.counts.context[self.many]]) * p1, d2, random)
        t2 = self.once.copy()
        t2[self.many] = seated
        c1 = self.alone + np.bincount(up, seated, len(self.last)).astype(np.int64)
        t1 = (c1 > 0).astype(np.int64)
        many = np.flatnonzero(c1 > 1)
        of = self.middle_of[many]
        rest = np.maximum(c0[of] - s.t1[many], 0)
        p0 = unigram(rest, np.minimum(s.t0[of], rest), all_, self.params)
        t1[many] = seat(c1[many], (b1 + d1 * all_.t1[self.last[many]]) * p0, d1, random)
        own = np.bincount(self.middle_of, t1, len(s.t0)).astype(np.int64)
        c0 = np.where(self.is_hot, c0, own)
        base = (b0 + d0 * all_.t0) / (all_.words + 1)
        t0 = seat(c0, np.full(len(c0), base), d0, random)
        if self.is_hot.any():  # every bucket draws the same for a hot word
            alike = np.random.default_rng((turn, 20060718))
            every = seat(all_.hot_c0, np.full(self.hots, base), d0, alike)
            t0[self.is_hot] = every[self.hot[self.is_hot]]
        return Seating(t2, c1, t1, c0, t0)

    def probability(self, s: Seating, all_: Totals) -> np.ndarray:
        """The predictive probability of every pair's word in its context; of words not learned, the unknown word's."""
        (_, d1, d2), (_, b1, b2) = self.params
        p0 = unigram(s.c0, s.t0, all_, self.params)
        p1 = lower(s.c1, s.t1, all_.c1, all_.t1, self.last, p0[self.middle_of], d1, b1)
        return lower(self.counts.count, s.t2, all_.c2, all_.t2, self.counts.context, p1[self.up], d2, b2)

    def fit(self, all_: Totals) -> np.ndarray:
        """Log likelihood of every token when it alone is taken away, by level, discount and strength."""
        s = self.start()
        c0 = np.where(self.is_hot, all_.hot_c0[np.maximum(self.hot, 0)], s.c0) if self.hots else s.c0
        out = np.zeros((3, len(DISCOUNTS), len(STRENGTHS)))
        uniform = np.full(len(c0), 1 / (all_.words + 1))
        p0 = unigram(np.maximum(c0 - 1, 0), (c0 > 1).astype(int), all_, self.params)
        p1 = lower(np.maximum(s.c1 - 1, 0), (s.c1 > 1).astype(int), all_.c1, all_.t1, self.last, p0[self.middle_of],
                   self.params.discounts[1], self.params.strengths[1])
        levels = (
            (c0[self.speaks], np.full(1, all_.c0), np.full(1, all_.t0), np.zeros(int(self.speaks.sum()), int), uniform[self.speaks]),
            (s.c1, all_.c1, all_.t1, self.last, p0[self.middle_of]),
            (self.counts.count, all_.c2, all_.t2, self.counts.context, p1[self.up]))
        for level, (count, customers, tables, at, parent) in enumerate(levels):
            alone, more = count == 1, count > 1
            # Of a dish had once nothing is left: such tokens differ by restaurant and parent only.
            times = np.bincount(at[alone], minlength=len(tables))
            where = np.flatnonzero(times)
            times, others, kept = times[where], customers[where] - 1, tables[where] - 1
            count, at, up = count[more], at[more], parent[more]
            given = np.log(parent[alone]).sum()
            for j, b in enumerate(STRENGTHS):
                alike = given - (times * np.log(b + others)).sum()
                for i, d in enumerate(DISCOUNTS):
                    p = (count - 1 - d + (b + d * tables[at]) * up) / (b + customers[at] - 1)
                    out[level, i, j] = (count * np.log(p)).sum() + (times * np.log(b + d * kept)).sum() + alike
        return out


def unigram(c: np.ndarray, t: np.ndarray, all_: Totals, params: Params) -> np.ndarray:
    d, b = params.discounts[0], params.strengths[0]
    return (c - d * t + (b + d * all_.t0) / (all_.words + 1)) / (b + all_.c0)


def lower(
    c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, at: np.ndarray, parent: np.ndarray,
    d: float, b: float,
) -> np.ndarray:
    """The probability in restaurant ``at`` of a dish with c customers at t tables."""
    return (c - d * t + (b + d * tables[at]) * parent) / (b + customers[at])


class Model:
    """What every task is told: fixed in size, but for the number of hot words, which the buckets bound."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot, self.params = buckets, hot, Params()
        self.history: list[bytes] = []
        self._open: list[Totals] = []

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": []}

    def totals(self, turn: int) -> Totals:
        """The totals after a sweep; later ones are kept as what they add to the first ones."""
        for packed in self.history[len(self._open):]:
            t, first = _unpack_totals(packed), self._open[0] if self._open else None
            self._open.append(t._replace(c2=first.c2, t2=first.t2 + t.t2, words=first.words) if first else t)
        return self._open[turn]

    def bucket(self, counts: bytes, number: int) -> Bucket:
        return Bucket(_unpack_counts(counts), number, self.buckets, self.hot, self.params)

    def seatings(self, bucket: Bucket) -> Iterator[tuple[Seating, Totals]]:
        """The seating after each sweep, with its totals; drawn again from the same seeds whenever it is needed."""
        seating = bucket.start()
        for turn in range(len(self.history)):
            totals = self.totals(turn)
            yield seating, totals
            seating = bucket.sweep(seating, totals, turn)
        yield seating, None


def _add_up(table: DataFrame, model: Model) -> Totals:
    """The totals after one more sweep, without c2 and the first tables of t2 but for the first time.

    Every task adds up its own buckets, and slices of the sums are added up.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)
    first = not model.history

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        none = np.zeros(0, np.int64)
        wide = (np.zeros(1 << CONTEXT_BITS, np.int64) if first else none), np.zeros(1 << CONTEXT_BITS, np.int64)
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket = shared.value.bucket(blob.as_py(), number)
                for seating, _ in shared.value.seatings(bucket):
                    pass
                own = bucket.totals(seating, wide)._replace(c2=none, t2=none)
                total = own if total is None else _sum([total, own])
                del bucket, seating, own
                _release()
        if total is not None:
            total = total._replace(c2=wide[0], t2=wide[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(range(SLICES), pa.int32()), pa.array([_pack_totals(_cut(total, k)) for k in range(SLICES)])],
                ["slice", "totals"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = _sum([_unpack_totals(b) for b in frame["totals"]])
        return pd.DataFrame({"slice": [int(frame["slice"].iloc[0])], "totals": [_pack_totals(total)]})

    kind = "slice int, totals binary"
    rows = table.select("bucket", "counts").mapInArrow(run, kind).groupBy("slice").applyInPandas(add, kind).collect()
    parts = [_unpack_totals(r["totals"]) for r in sorted(rows, key=lambda r: r["slice"])]
    if not parts:
        wide = np.zeros(1 << CONTEXT_BITS, np.int64)
        return Totals(wide, wide, wide[:CLASSES], wide[:CLASSES], 0, 0, 0, 0, wide[:0], wide[:0])
    total = Totals(np.concatenate([p.c2 for p in parts]), np.concatenate([p.t2 for p in parts]), *parts[0][2:])
    return total._replace(words=total.words + int((total.hot_n > 0).sum()))


def _cut(t: Totals, k: int) -> Totals:
    """A slice of the wide tables; the first one has the rest."""
    size = (1 << CONTEXT_BITS) // SLICES
    wide = [a[k * size:(k + 1) * size] for a in (t.c2, t.t2)]
    if k == 0:
        return Totals(*wide, *t[2:])
    none = np.zeros(0, np.int64)
    return Totals(*wide, none, none, 0, 0, 0, 0, none, none)


def _sum(parts: list[Totals]) -> Totals:
    return Totals(*[sum(values) for values in zip(*parts)])


def _pack_totals(t: Totals) -> bytes:
    return pack_arrays(t.c2, t.t2, t.c1, t.t1, t.hot_c0, t.hot_n, np.array([t.c0, t.t0, t.words, t.tokens], np.int64))


def _unpack_totals(blob: bytes) -> Totals:
    c2, t2, c1, t1, hot_c0, hot_n, rest = unpack_arrays(blob)
    return Totals(c2, t2, c1, t1, *rest.tolist(), hot_c0, hot_n)


def _fitted(table: DataFrame, model: Model) -> Params:
    """The discount and strength of each level under which tokens, each left out in turn, are likeliest."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = shared.value.totals(0)
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shared.value.bucket(blob.as_py(), number).fit(totals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(found.size), pa.int32()), pa.array(found.ravel())], ["choice", "likelihood"])

    rows = table.select("bucket", "counts").mapInArrow(run, "choice int, likelihood double").groupBy("choice").agg(
        F.sum("likelihood").alias("likelihood")).collect()  # one row per choice
    if not rows:
        return model.params
    found = np.zeros(3 * len(DISCOUNTS) * len(STRENGTHS))
    for r in rows:
        found[r["choice"]] = r["likelihood"]
    best = found.reshape(3, -1).argmax(axis=1)
    return Params(tuple(DISCOUNTS[i // len(STRENGTHS)] for i in best), tuple(STRENGTHS[i % len(STRENGTHS)] for i in best))


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def _score_parts(bucket: Bucket, mean: np.ndarray, totals: Totals, entries: Iterator[bytes]) -> Iterator[bytes]:
    """Per part: score, base score and known tokens of its documents, from this bucket's words."""
    count = np.where(bucket.is_hot, totals.hot_n[np.maximum(bucket.hot, 0)], bucket.total) if bucket.hots else bucket.total
    floor = totals.tokens + 0.1 * (totals.words + 1)
    of = bucket.counts.of
    values = (np.log10(mean), np.log10((count + 0.1) / floor)[of], (count > 0).astype(float)[of])
    for blob in entries:
        place, per_pair, doc, times, n = unpack_arrays(blob)
        pair = np.repeat(_values(place), per_pair)
        doc = doc.astype(np.int64)
        sums = [np.bincount(doc, value[pair] * times, int(n[0])) for value in values]
        some = np.flatnonzero(np.bincount(doc, minlength=int(n[0])))
        yield pack_arrays(
            _steps(some.astype(np.int32)), *[_planes(np.rint(s[some] * unit).astype(np.int64)) for s, unit in zip(sums, UNITS)],
            _planes(sums[2][some].astype(np.int32)), level=1)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10,
    burn_in: int = BURN_IN, samples: int = SAMPLES,
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows that are not held out (``language.held_out``). Texts are
    lower-cased (A-Z), cut into words and closed by an end token. ``score`` is the log10
    probability of the text under the predictive probabilities averaged over ``samples`` Gibbs
    sweeps; ``base_score`` that of an add-0.1 unigram model. Discounts and strengths are those under which
    the training tokens, each left out in turn, are likeliest. Null and empty texts are the end token
    alone; a text of any length is scored whole. Ids may be null or repeated; rows are scored one by
    one; other columns are ignored; without training rows every word has probability one in the
    base; an empty table gives no rows. Per document and bucket of words the score is rounded to 2**-26, the
    base score to 2**-30.
    """
    spark = docs.sparkSession
    buckets = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, parts).alias("held_out"),
        F.col(text_col).alias("text"))
    model = Model(buckets, _hot_words(source, buckets))
    table = materialise(_gather(source, buckets, model.hot).groupBy("bucket").applyInPandas(
        _collected, "bucket int, counts binary, parts array<long>, entries array<binary>"), "lm-buckets")
    counted = table.where("bucket >= 0")
    model.history.append(_pack_totals(_add_up(counted, model)))
    model.params = _fitted(counted, model)
    for _ in range(burn_in + samples):
        model.history.append(_pack_totals(_add_up(counted, model)))
    totals = model.totals(-1)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value.totals(-1)
        for batch in batches:
            for row in range(batch.num_rows):  # one bucket's entries at a time
                number, counts, part, entries = (batch.column(i)[row] for i in range(4))
                bucket = shared.value.bucket(counts.as_py(), number.as_py())
                mean = np.zeros(len(bucket.counts.of))
                for turn, (seating, totals) in enumerate(shared.value.seatings(bucket)):
                    if totals is not None and turn > burn_in:
                        mean += bucket.probability(seating, totals) / samples
                for at, sums in zip(part, _score_parts(bucket, mean, last, (e.as_py() for e in entries))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at.as_py()]), pa.array([sums])], ["part", "sums"])
                del bucket, mean, seating, totals
                _release()

    sums = counted.select("bucket", "counts", "parts", "entries").mapInArrow(score, "part long, sums binary")

    def collect(key, rows: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        ids, absent, flags, tokens = unpack_arrays(rows["blob"].iloc[0])
        out = [np.zeros(len(ids)) for _ in range(3)]
        for blob in blobs["sums"]:
            place, total, base, known = unpack_arrays(blob)
            place = _values(place)
            out[0][place] += _whole(total, np.int64) / UNITS[0]
            out[1][place] += _whole(base, np.int64) / UNITS[1]
            out[2][place] += _whole(known, np.int32)
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64").copy() if not absent.any() else pd.Series(
                pd.array(ids.tolist(), "Int64")).mask(absent.astype(bool)), "held_out": flags.astype(bool),
            "n_tokens": tokens, "n_known": out[2].astype(np.int64), "base_score": out[1], "score": out[0]})

    listed = table.where("bucket < 0").select(F.col("parts")[0].alias("part"), F.col("entries")[0].alias("blob"))
    scored = listed.groupBy("part").cogroup(sums.groupBy("part")).applyInPandas(
        collect, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the held-out and the training rows."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
