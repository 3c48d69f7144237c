"""Words of many texts at once, on the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D. All functions work on one flat byte
array with offsets, so a batch costs a few numpy passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SMALL_CHUNK = 1 << 18  # for tasks that run beside much else
CHUNK_ROWS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Where the words are: ``data[starts[i]:ends[i]]``; text ``d`` has words first[d]:first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0]:ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text and at most CHUNK_ROWS rows each.

    Scratch arrays of a slice stay small that way.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        for start in range(begin, end, CHUNK_ROWS):
            yield batch.slice(start, min(CHUNK_ROWS, end - start))


def find_words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = _SPACE[data]
    word = ~blank[1:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (blank[2:] | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def words_of(column: pa.Array, *, lower: bool = False) -> Words:
    return find_words(*text_bytes(column), lower=lower)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, the same on every machine."""
    powers, inverses = _power_table(seed, len(words.data))
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[seed][words.data] * powers[:len(words.data)], out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * inverses[words.starts])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` consecutive words from each word on; ignores where texts end."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    base = np.uint64(_BASES[1])
    for k in range(size):
        total = total * base + hashes[k:k + n]
    return mix(total)


def window_starts(words: Words, size: int) -> np.ndarray:
    """The words from which ``size`` words of the same text follow."""
    count = np.diff(words.first)
    inside = np.maximum(count - size + 1, 0)
    shift = np.repeat(words.first[:-1] - (np.cumsum(inside) - inside), inside)
    return np.arange(inside.sum()) + shift


def _power_table(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _powers or len(_powers[seed][0]) < size:
        count = 1 << size.bit_length()
        base = _BASES[seed]
        _powers[seed] = _powers_of(base, count), _powers_of(pow(base, -1, 1 << 64), count)
    return _powers[seed]


def _powers_of(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    filled = 1
    while filled < count:
        step = min(filled, count - filled)
        out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64) & _MASK)
        filled += step
    return out
