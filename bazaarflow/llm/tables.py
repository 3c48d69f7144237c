"""Helpers for tables of documents."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text_col: str) -> Column:
    """A hash of the text, which with the id names a row; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text key are in ``kept`` (columns id and row_key)."""
    key, = fresh(docs, "_key")
    keyed = docs.withColumn(key, text_key(text_col))
    same = keyed[id_col].eqNullSafe(kept["id"]) & (keyed[key] == kept["row_key"])
    return keyed.join(kept, same, "left_semi").drop(key)


def release_memory() -> None:
    """Give freed memory back to the system: the driver, or a Python worker, lives on after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, then ``release_memory``: its worker idles beside others or serves other tasks."""

    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released
