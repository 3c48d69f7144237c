from __future__ import annotations

import hashlib
import random

import pytest

from bazaarflow.llm import substrings as S
from tests.llm import edges


def brute(rows, window):
    """Rows with equal id and text are one; rows of one id are ordered by start."""
    words = {(doc, text or ""): (text or "").encode().split() for doc, text in rows}
    order = lambda doc: (doc is None, doc or 0)
    first = {}
    for (doc, text), tokens in words.items():
        for i in range(len(tokens) - window + 1):
            at = (*order(doc), i)
            key = tuple(tokens[i:i + window])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, text in rows:
        tokens = words[doc, text or ""]
        gone = [False] * len(tokens)
        for i in range(len(tokens) - window + 1):
            if first[tuple(tokens[i:i + window])] != (*order(doc), i):
                gone[i:i + window] = [True] * window
        kept = b" ".join(t for t, g in zip(tokens, gone) if not g)
        out.append((doc, len(tokens), sum(gone), hashlib.sha256(kept).hexdigest()))
    return edges.brief(out)


def result(df, **options):
    return edges.brief(S.remove_repeats(df, keep_text=False, **options).collect())


@pytest.mark.parametrize("letters", ["a b", "a b c d e"])
def test_dense_repeats(spark, letters):
    chance = random.Random(2)
    rows = [(i, " ".join(chance.choice(letters.split()) for _ in range(chance.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, "x" * 5000), (102, "z " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, window=6, size=2) == brute(rows, 6)


def test_passes_and_flushes_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(70))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 20)
    monkeypatch.setattr(S, "FLUSH_BYTES", 2000)
    assert result(df) == want
    import pandas as pd

    packer = S._Packer(1, 20, 3)
    from bazaarflow.llm.words import words_of
    import pyarrow as pa

    packer.add([r[0] for r in rows], [0] * len(rows), words_of(pa.array([r[1] for r in rows])))
    blobs = pd.DataFrame({"blob": [b for batch in packer.flush() for b in batch.column(1).to_pylist()]})
    whole = S._repeated_windows(blobs, 20).sort_values(["doc_id", "start"]).values.tolist()
    monkeypatch.setattr(S, "WINDOWS_AT_ONCE", 50)
    many = S._repeated_windows(blobs, 20)

    def places(ranges):
        return sorted((d, s + k) for d, _, s, n in ranges for k in range(n))

    assert places(many.values.tolist()) == places(whole)


def test_whole_table(spark, folder):
    df = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert result(df) == brute(rows, 20)


def test_edges(spark):
    rows = [r[:2] for r in edges.rows()]
    assert result(edges.documents(spark)) == brute(rows, 20)
    assert result(edges.documents(spark), window=4, size=2) == brute(rows, 4)
    assert S.remove_repeats(edges.empty(spark)).count() == 0
    texts = {r["doc_id"]: r["kept_text"] for r in S.remove_repeats(edges.documents(spark), window=4, size=2).collect()}
    assert texts[1] == "The quick brown fox jumps over the lazy dog" and texts[2] == "the QUICK"
