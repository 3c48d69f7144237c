from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bazaarflow.llm import packing
from tests.llm import edges

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    chance = random.Random(4)
    letters = "aAbBéÉ's'tt'r    \t\n<|endoftext|>\0\x1cΣσ中 \x85\xa0　   1²!?-_😀"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", "a ", "  a", "x<|endoftext|> y"]
    for tokens in (packing.TokenIds(PATH, RANKS), packing.TokenIds(PATH)):
        for text in texts:
            ids = np.frombuffer(tokens.encode(text), "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_character_is_encoded_alike(library):
    tokens = packing.TokenIds(PATH, RANKS)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} ", f"1{c}2{c}", f"{c}{c} x", f"'{c}s"):
            assert np.frombuffer(tokens.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, texts, library, window):
    """Every id in one piece, sequences gapless and short enough."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, pieces in documents.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            own = ids[at:at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(own))
            assert r["ids"] is None or bytes(r["ids"]) == own
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    return sum(r["length"] for r in rows) / (window * len(sequences))


def test_pieces(spark, library, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(20)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, PATH, ranks_path=RANKS).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert check(rows, texts, library, 1024) > 0.97


def test_small_windows_and_few_open(spark, library):
    texts = {i: "word " * (i % 37) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    rows = packing.pack(docs, PATH, window=16, open_windows=3, keep_ids=False).collect()
    assert check(rows, texts, library, 16) > 0.95


def test_best_fit_and_the_fullest():
    def piece(n):
        return (0, 0, n, b"\1\0\0\0" * n)

    opened = packing.OpenWindows(10, 2)
    assert not list(opened.add(piece(6))) and not list(opened.add(piece(8)))
    assert not list(opened.add(piece(1)))  # into the window with 2 left, not the one with 4
    assert sorted(opened.free) == [1, 4]
    emitted = list(opened.add(piece(5)))  # fits nowhere: the fullest is filled up and goes
    assert [sum(len(p[3]) // 4 for p in window) for window in emitted] == [10, 10]


def test_edges(spark, library):
    rows = packing.pack(edges.documents(spark), PATH).collect()
    tokens = sorted((r["doc_tokens"], r["start"]) for r in rows if r["doc_id"] in (3, 4))
    assert tokens == [(1, 0), (1, 0)]
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == sum(
        r["doc_tokens"] for r in rows if r["doc_id"] is None and r["start"] == 0)
    assert packing.pack(edges.empty(spark), PATH).count() == 0
