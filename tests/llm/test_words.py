from __future__ import annotations

import numpy as np
import pyarrow as pa

from bazaarflow.llm import words as W
from bazaarflow.llm.blobs import pack_arrays, unpack_arrays

TEXTS = ["a bb  ccc", None, "", " \t", "x", "été\nnoir\x0bA", "a bb", "trailing "]


def test_words_are_those_of_split():
    found = W.words_of(pa.array(TEXTS, pa.string()))
    raw = found.data.tobytes()
    for d, text in enumerate(TEXTS):
        own = [raw[a:b] for a, b in zip(found.starts[found.first[d]:found.first[d + 1]], found.ends[found.first[d]:found.first[d + 1]])]
        assert own == (text or "").encode().split()


def test_hashes_depend_on_the_word_alone():
    one = W.words_of(pa.array(["ab cd ab", "zz ab"]), lower=True)
    other = W.words_of(pa.array(["", "long prefix AB"]), lower=True)
    assert len(set(W.word_hashes(one)[[0, 2, 4]].tolist()) | {W.word_hashes(other)[2].item()}) == 1
    assert (W.word_hashes(one, 0) != W.word_hashes(one, 1)).all()


def test_windows_stay_in_their_text():
    found = W.words_of(pa.array(["a b c d", "e f", "", "g h i"]))
    assert W.window_starts(found, 3).tolist() == [0, 1, 6]
    hashes = W.window_hashes(W.word_hashes(found), 3)
    assert len(hashes) == 7 and len(set(hashes.tolist())) == 7


def test_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_ROWS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (1, 1, 1, 1, 50, 1, 1)] + [None])], ["t"])
    parts = list(W.chunks(batch, "t", 20))
    assert sum(p.num_rows for p in parts) == 8 and max(p.num_rows for p in parts) <= 3
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert list(W.chunks(batch.slice(0, 0), "t")) == []


def test_blobs_round_trip():
    arrays = [np.array([1, 2], np.uint64), np.array([], np.int64), np.array([5], np.int32), np.array([7], np.uint16)]
    back = unpack_arrays(pack_arrays(*arrays, b"text"))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back)) and back[-1].tobytes() == b"text"
