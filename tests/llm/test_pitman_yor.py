from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bazaarflow.llm import pitman_yor as Y
from tests.llm import edges


def base_scores(rows):
    tokens = [((text or "").encode().lower().split() + [None]) for _, text in rows]
    out_of = [zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0 for doc, _ in rows]
    count = Counter(t for words, h in zip(tokens, out_of) if not h for t in words)
    n, v = sum(count.values()), len(count)
    return [(doc, h, len(words), sum(w in count for w in words), n, sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in words))
            for (doc, _), words, h in zip(rows, tokens, out_of)]


def compare(df, rows):
    got = edges.brief((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in df.collect())
    for a, b in zip(got, edges.brief(base_scores(rows)), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_base_and_perplexity(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").repartition(3)
    scored = Y.score_texts(docs)
    compare(scored, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in scored.collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert {r["held_out"] for r in Y.perplexity(scored).collect()} == {True, False}


def test_edges(spark):
    docs = edges.documents(spark)
    compare(Y.score_texts(docs), [r[:2] for r in edges.rows()])
    assert all(r["score"] < 0 for r in Y.score_texts(docs).collect())
    assert Y.score_texts(edges.empty(spark)).count() == 0


def counted(rows):
    words, contexts, counts = zip(*rows)
    return Y._merge([(np.array(words, np.uint64), np.array(contexts, np.int32), np.array(counts, np.int64))])


def sampled(counts, sweeps, params=Y.Params()):
    """The only bucket of a corpus after some sweeps: its seatings, each with its totals."""
    bucket = Y.Bucket(counts, 0, 1, np.zeros(0, np.uint64), params)
    seating, out = bucket.start(), []
    for turn in range(sweeps + 1):
        out.append((seating, bucket.totals(seating)))
        seating = bucket.sweep(*out[-1], turn)
    return bucket, out


def with_unseen(rows, words, contexts):
    """Every word and an unknown one in every context, most of them without a customer."""
    seen = {(w, c): n for w, c, n in rows}
    return counted([(w, c, seen.get((w, c), 0)) for w in (*words, 99) for c in contexts])


def test_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, in seen and unseen contexts, after some sweeps."""
    chance = np.random.default_rng(3)
    contexts = (0, 257, 513, 770, 1026)
    rows = [(w, c, int(chance.integers(1, 200))) for w in range(1, 9) for c in contexts[:4] if chance.random() < .7]
    bucket, drawn = sampled(with_unseen(rows, range(1, 9), contexts), 4)
    for seating, totals in drawn[1:]:
        p = bucket.probability(seating, totals)
        assert (p > 0).all() and totals.words == 8
        for context in contexts:
            assert p[bucket.counts.context == context].sum() == pytest.approx(1)


class Restaurants:
    """A plain sampler: customers sit at tables one by one, each table sends one customer to the parent."""

    def __init__(self, rows, vocabulary, params, random):
        self.params, self.random, self.size = params, random, vocabulary
        self.rooms = {}
        self.rows = rows
        for word, context, n in rows:
            for _ in range(n):
                self.add(word, 2, context)

    def room(self, level, key):
        return self.rooms.setdefault((level, key if level == 2 else key % 256 if level == 1 else 0), {})

    def p(self, word, level, key):
        if level < 0:
            return 1 / (self.size + 1)
        d, b = self.params.discounts[level], self.params.strengths[level]
        room = self.room(level, key)
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(word, [])
        return (sum(own) - d * len(own) + (b + d * t) * self.p(word, level - 1, key)) / (b + c)

    def add(self, word, level, key):
        if level < 0:
            return
        d, b = self.params.discounts[level], self.params.strengths[level]
        room = self.room(level, key)
        tables = room.setdefault(word, [])
        new = (b + d * sum(map(len, room.values()))) * self.p(word, level - 1, key)
        at = self.random.choices(range(len(tables) + 1), [n - d for n in tables] + [new])[0]
        if at == len(tables):
            tables.append(1)
            self.add(word, level - 1, key)
        else:
            tables[at] += 1

    def remove(self, word, level, key):
        if level < 0:
            return
        tables = self.room(level, key)[word]
        at = self.random.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            self.remove(word, level - 1, key)

    def sweep(self):
        for word, context, n in self.rows:
            for _ in range(n):
                self.remove(word, 2, context)
                self.add(word, 2, context)


def test_against_a_plain_sampler(monkeypatch):
    monkeypatch.setattr(Y, "CONTEXT_BITS", 10)
    rows = [(1, 5, 9), (2, 5, 3), (3, 5, 1), (1, 261, 2), (4, 261, 6), (2, 7, 5), (5, 7, 1), (1, 7, 1), (4, 9, 2), (6, 9, 1)]
    contexts, words = (5, 261, 7, 9, 11), range(1, 7)
    params = Y.Params((0.6, 0.5, 0.5), (2.0, 1.0, 0.5))
    plain = Restaurants(rows, 6, params, random.Random(5))
    bucket, drawn = sampled(with_unseen(rows, words, contexts), 220, params)
    ours = np.mean([bucket.probability(s, t) for s, t in drawn[20:]], axis=0)
    theirs = np.zeros(len(ours))
    for turn in range(420):
        plain.sweep()
        if turn >= 20:
            theirs += [plain.p(int(bucket.counts.words[w]), 2, int(c)) for w, c in zip(bucket.counts.of, bucket.counts.context)]
    apart = np.abs(np.log(ours / (theirs / 400)))  # ours seats all of a sweep by the totals of the one before
    assert apart.mean() < 0.06 and apart.max() < 0.3


def bigram_perplexity(rows, discount=0.8):
    """An interpolated bigram of words with one discount, over an add-0.1 unigram, on the held-out rows."""
    uni, pairs, learn, test = Counter(), Counter(), [], []
    for doc, text in rows:
        words = (text or "").encode().lower().split() + [None]
        (test if zlib.crc32(str(doc).encode()) % 10 == 0 else learn).append(list(zip([0, *words], words)))
    for text in learn:
        pairs.update(text)
        uni.update(w for _, w in text)
    n, v = sum(uni.values()), len(uni)
    seen, kinds = Counter(), Counter()
    for (before, _), k in pairs.items():
        seen[before] += k
        kinds[before] += 1

    def p(before, word):
        base = (uni[word] + .1) / (n + .1 * (v + 1))
        if not seen[before]:
            return base
        return (max(pairs[before, word] - discount, 0) + discount * kinds[before] * base) / seen[before]

    tokens = [pair for text in test for pair in text]
    return 10 ** (-sum(math.log10(p(*pair)) for pair in tokens) / len(tokens))


def test_beats_an_interpolated_word_bigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    found = {r["held_out"]: r["perplexity"] for r in Y.perplexity(Y.score_texts(docs)).collect()}
    assert found[True] < 960 < bigram_perplexity([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_buckets_and_hot_words_do_not_matter(spark, folder, monkeypatch):
    docs = spark.read.parquet(folder + "/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sums = []
    try:
        for partitions, share in (("8", 4), ("24", 4), ("8", 1e-6)):
            monkeypatch.setattr(Y, "HOT_SHARE", share)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            scored = Y.score_texts(docs)
            compare(scored, rows)
            sums.append(sum(r["score"] for r in scored.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sums[1:] == pytest.approx(sums[:1] * 2, rel=1e-2)  # other seeds, the same model


def test_hot_words_are_found_whatever_task_reads_them(spark):
    docs = spark.createDataFrame(
        [(f"the the the w{i} x{i}",) for i in range(300)] + [(f"y{i} z{i}",) for i in range(300)], "text string").repartition(6)
    found = Y._hot_words(docs, 8)
    words = docs.where("text LIKE 'the%'").limit(1).toArrow().column("text").combine_chunks()
    assert set(Y._tokens(words)[0][:1].tolist()) <= set(found.tolist()) and Y.END in found and len(found) <= 64


def test_seating():
    chance = np.random.default_rng(1)
    count = np.array([0, 1, 2, 1000, 100_000])
    tables = Y.seat(count, np.full(5, 2.0), 0.5, chance)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= np.maximum(count, 0)).all() and tables[4] > tables[3] > 1
    mean = np.mean([Y.seat(np.array([400]), np.array([1.0]), 0.0, chance)[0] for _ in range(400)])
    assert mean == pytest.approx(sum(1 / (1 + j) for j in range(400)), rel=0.06)  # Chinese restaurant without discount
