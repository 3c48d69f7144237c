from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bazaarflow.llm import grammar, merges, token_files
from tests.llm import edges

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def random_texts(seed, n):
    chance = random.Random(seed)
    letters = "aAbBéÉ's'tt'r  \t\n<|endoftext|>ΣσİıßﬁＡ1²½!?-_😀éñ​Å中文\x1c\x85ºª­µ×÷ÀÿXyz.,;"
    return ["".join(chance.choice(letters) for _ in range(chance.randint(0, 30))) for _ in range(n)]


def encoded(encoder, texts):
    ids, cuts = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_batch_encoding_is_the_librarys(library):
    texts = [*random_texts(5, 3000), "", None, "<|endoftext|>", "<|ENDOFTEXT|> a<|endoftext|>b", "don't WE'LL I'VE",
             "a" * 3000, "ÀÉÎ×÷ßÿ à1é2", "x" * 32 + " " + "y" * 33, "one\x0btwo\x0cthree"]
    got = encoded(merges.BatchEncoder(PATH), texts)
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(merges.BatchEncoder(PATH), [None, ""]) == [[], []]


def test_known_tokens_and_lost_slots_change_nothing(library, monkeypatch):
    monkeypatch.setattr(merges, "KNOWN_TOKENS", 200)
    monkeypatch.setattr(merges, "SLOT_BITS", 4)
    encoder = merges.BatchEncoder(PATH)
    for seed in range(6):
        texts = random_texts(seed, 150)
        assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_grammar_expands_to_what_it_was_made_of(monkeypatch):
    monkeypatch.setattr(grammar, "LEAST_COUNT", 2)
    chance = np.random.default_rng(1)
    for bits in (3, 17):
        monkeypatch.setattr(grammar, "_BUCKET_BITS", bits)
        for _ in range(200):
            n = chance.integers(0, 400)
            ids = chance.integers(0, chance.integers(1, 6), n).astype(np.int32)
            cuts = np.sort(chance.integers(0, n + 1, chance.integers(0, 6)))
            totals = np.diff(np.concatenate([[0], cuts, [n]]))
            shard = grammar.from_bytes(grammar.to_bytes(grammar.compress(ids, totals, 10)))
            assert np.array_equal(grammar.expand_all(shard), ids)
            assert shard.counts.sum() == len(shard.symbols)
            assert np.array_equal(shard.lengths, grammar.symbol_lengths(shard, shard.left)
                                  + grammar.symbol_lengths(shard, shard.right))
            for d in range(len(totals)):
                whole = ids[totals[:d].sum():totals[:d + 1].sum()]
                begin, end = sorted(chance.integers(0, len(whole) + 2, 2))
                assert np.array_equal(grammar.slice_document(shard, d, begin, end), whole[begin:end])


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([7, 8, 9, 3], np.int32), 500)
    shard = grammar.compress(ids, np.array([2000]), 10)
    assert len(shard.symbols) < 200 and shard.lengths.max() >= 8
    apart = grammar.compress(np.tile(np.array([7, 8], np.int32), 500), np.full(1000, 1), 10)
    assert len(apart.left) == 0  # no pair spans two documents


def test_files_on_spark(spark, library, tmp_path):
    out = str(tmp_path / "ids")
    rows = edges.rows()
    token_files.write_tokens(edges.documents(spark), out, PATH, end_id=1, shard_ids=5000)
    got = token_files.read_tokens(spark, out).orderBy("start").collect()
    ids = {}
    for doc, text, *_ in rows:
        ids.setdefault(doc, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert found in ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(found), zlib.crc32(bytes(r["ids"])))
        start += len(found)
    assert start == sum(len(x) for several in ids.values() for x in several)
    some = token_files.read_tokens(spark, out, between=(5, 7)).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 6, 7] and {r["start"] for r in some} <= {r["start"] for r in got}
    asked = spark.createDataFrame([(9, 100, 120), (13, 0, 3), (13, 2, 400), (99, 0, 1)], "doc_id long, begin long, end long")
    for r in token_files.read_slices(spark, out, asked).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][0][r["begin"]:r["end"]]
    assert token_files.read_slices(spark, out, asked).count() == 3


def test_an_empty_table(spark, tmp_path):
    token_files.write_tokens(edges.empty(spark), str(tmp_path / "none"), PATH, end_id=1)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0
