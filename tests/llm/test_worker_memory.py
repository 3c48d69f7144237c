"""What the Python workers of the pipeline's steps hold during a task and keep after it."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from bazaarflow.llm import ngram_join, sanitise, tables, words


class Given:
    """Stands in for a DataFrame and keeps the function that tasks would run."""

    run = None

    def mapInArrow(self, run, schema):
        self.run = self.run or run
        return self

    def __getattr__(self, name):
        return lambda *args, **kwargs: self


def tasks():
    bits = np.full(1 << 17, ~np.uint64(0))
    for build in (sanitise.scan_patterns, lambda d: sanitise._document_counts(d, bits), lambda d: sanitise._occurrences(d, bits),
                  lambda d: ngram_join.count_words(d)):
        given = Given()
        try:
            build(given)
        except TypeError:  # count_words goes on with the rows it collects
            pass
        yield given.run


def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "key", "text"])


def test_a_worker_gives_memory_back_after_its_task(spark, monkeypatch):
    given = []
    monkeypatch.setattr(tables, "release_memory", lambda: given.append(1))
    for n, run in enumerate(tasks(), 1):
        for _ in run(iter([batch(["write to bob@example.org today"])])) if n < 4 else run(iter([batch(["a"]).select(["text"])])):
            assert len(given) == n - 1
        assert len(given) == n
    stopped = next(iter(tasks()))(iter([batch(["a"]), batch(["b"])]))
    next(stopped)
    stopped.close()
    assert len(given) == 5


def test_scratch_of_a_task_is_small(spark, monkeypatch):
    monkeypatch.setattr(words, "_powers", {})
    run = list(tasks())[1]
    texts = [" ".join(f"word{i % 7}x{k}" for k in range(300)) for i in range(1000)]
    given = batch(texts)
    assert given.nbytes > 4 * words.SMALL_CHUNK
    tracemalloc.start()
    try:
        for _ in run(iter([given])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20
