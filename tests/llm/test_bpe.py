from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bazaarflow.llm import bpe
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
    letters = "aAbBéÉ's'tt'r  \t\n<|endoftext|>ΣσİıßﬁＡ1²½!?-_😀éñ​Å中文\x1c\x85ºª­µ"
    return ["".join(chance.choice(letters) for _ in range(chance.randint(0, 30))) for _ in range(n)]


def test_encodes_and_decodes_as_the_library(library):
    texts = [*random_texts(3, 4000), "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't we'll I'VE"]
    encoder = bpe.ForcedBoundaryEncoder(PATH)
    for text, (numbers, decoded) in zip(texts, encoder.encode_many([t.encode() for t in texts])):
        ids = library.encode(text, add_special_tokens=False).ids
        assert numbers.decode() == " ".join(map(str, ids)), text
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False), text


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    encoder = bpe.ForcedBoundaryEncoder(PATH)
    for start in range(0, 600, 100):
        texts = random_texts(start, 100)
        for text, (numbers, _) in zip(texts, encoder.encode_many([t.encode() for t in texts])):
            assert numbers.decode() == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_no_merge_crosses_a_boundary():
    encoder = bpe.ForcedBoundaryEncoder(PATH)
    for token in list(encoder.pre_tokens("éèunbelievable中"))[:1]:
        for left, right in zip(encoder.fragments(token), encoder.fragments(token)[1:]):
            assert left[-1] + right[0] not in encoder.joined


def test_digests_on_spark(spark, library):
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"])
           for r in bpe.digest_texts(edges.documents(spark), PATH).collect()}
    want = set()
    for doc, text, *_ in edges.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((doc, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == want
    assert bpe.digest_texts(edges.documents(spark), PATH).count() == len(edges.rows())
    assert bpe.digest_texts(edges.empty(spark), PATH).count() == 0


def test_ids_and_text(spark, library):
    for r in bpe.encode_texts(edges.documents(spark).where("doc_id in (1, 3, 14)"), PATH).collect():
        text = {row[0]: row[1] for row in edges.rows()}[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
