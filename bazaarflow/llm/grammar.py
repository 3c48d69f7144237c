"""Re-Pair grammars of token-id shards.

Every round counts all adjacent pairs of a shard, gives each pair that occurs often enough a
nonterminal, and replaces it wherever it does not overlap a more frequent one. Rounds go on until
one shortens the shard by less than ``LEAST_GAIN``. No pair spans two documents, so a document has
its own run of symbols. With the rules go the lengths of their expansions, so the symbol that
covers a place is found by a sum over lengths, and only what is asked for is expanded.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from bazaarflow.llm.blobs import pack_arrays, unpack_arrays

LEAST_COUNT = 8
LEAST_GAIN = 0.001
_BUCKET_BITS = 17


class Shard(NamedTuple):
    """``ids``, ``totals`` (ids of each document), ``counts`` (symbols of each document) and the grammar.

    Symbol ``base + r`` stands for ``left[r]`` followed by ``right[r]`` and expands to
    ``lengths[r]`` ids; rules only use symbols before them, those of one round only earlier rounds'.
    """

    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    rounds: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    totals: np.ndarray


def compress(ids: np.ndarray, totals: np.ndarray, base: int) -> Shard:
    """The grammar of documents with ``totals`` ids each (all below ``base``), one after another."""
    symbols = ids.astype(np.int32)
    closes = np.zeros(len(symbols), bool)  # the last symbol of a document
    closes[np.cumsum(totals)[totals > 0] - 1] = True
    left, right, lengths = [], [], []
    rounds = [0]
    while len(symbols) > 1:
        chosen, rule, first = _choose(symbols, closes, len(rounds))
        if len(chosen) <= LEAST_GAIN * len(symbols):
            break
        a, b = symbols[first], symbols[first + 1]
        sizes = _sizes(np.concatenate([a, b]), base, lengths)
        left.append(a)
        right.append(b)
        lengths.append(sizes[:len(a)] + sizes[len(a):])
        symbols[chosen] = base + rounds[-1] + rule
        closes[chosen] = closes[chosen + 1]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, closes = symbols[keep], closes[keep]
        rounds.append(rounds[-1] + len(a))
    ends = np.flatnonzero(closes) + 1
    counts = np.zeros(len(totals), np.int64)
    counts[totals > 0] = np.diff(ends, prepend=0)
    return Shard(base, _joined(left, np.int32), _joined(right, np.int32), _joined(lengths, np.int64),
                 np.array(rounds, np.int64), symbols, counts, totals.astype(np.int64))


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _sizes(symbols: np.ndarray, base: int, lengths: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    ruled = symbols >= base
    if ruled.any():
        out[ruled] = np.concatenate(lengths)[symbols[ruled] - base]
    return out


def _choose(symbols: np.ndarray, closes: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of frequent pairs, no two of which overlap; each one's rule; and a place of each rule's pair.

    Pairs are counted in buckets; a bucket speaks for one of its pairs, and the others, if they are
    frequent, get their turn in a later round with another hash.
    """
    a, b = symbols[:-1], symbols[1:]
    odd = np.uint32((0x9E3779B1 + 0x3C6EF372 * turn) & 0xFFFFFFFF | 1)
    hashed = a.view(np.uint32) * odd
    hashed += b.view(np.uint32)
    hashed *= np.uint32(0x85EBCA77)
    hashed >>= np.uint32(32 - _BUCKET_BITS)
    size = 1 << _BUCKET_BITS
    often = np.bincount(hashed, minlength=size) >= LEAST_COUNT
    places = np.flatnonzero(often[hashed] & ~closes[:-1])
    bucket = hashed[places]
    speaker = np.zeros(size, np.int64)
    speaker[bucket] = places
    stands = speaker[bucket]
    same = (a[places] == a[stands]) & (b[places] == b[stands])
    places, bucket = places[same], bucket[same]
    weight = np.bincount(bucket, minlength=size)[bucket]
    # Of overlapping places the more frequent one goes first, of equals the one at an odd place.
    rank = np.where(weight >= LEAST_COUNT, weight << 1 | (places & 1), -1)
    apart = np.diff(places) > 1
    taken = rank >= 0
    if len(places) > 1:
        taken[1:] &= rank[1:] > np.where(apart, -1, rank[:-1])
        taken[:-1] &= rank[:-1] > np.where(apart, -1, rank[1:])
    places, bucket = places[taken], bucket[taken]
    left = np.bincount(bucket, minlength=size) >= LEAST_COUNT // 2
    kept = left[bucket]
    places, bucket = places[kept], bucket[kept]
    return places, (np.cumsum(left) - 1)[bucket], speaker[left]


def to_bytes(shard: Shard) -> bytes:
    symbols = shard.symbols.astype(np.uint32)
    return pack_arrays(
        np.array([shard.base], np.int64), shard.left, shard.right, shard.lengths, shard.rounds,
        (symbols & 0xFFFF).astype(np.uint16), (symbols >> 16).astype(np.uint16), shard.counts, shard.totals, level=1)


def from_bytes(blob: bytes) -> Shard:
    base, left, right, lengths, rounds, low, high, counts, totals = unpack_arrays(blob)
    symbols = (low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)).astype(np.int32)
    return Shard(int(base[0]), left, right, lengths, rounds, symbols, counts, totals)


def symbol_lengths(shard: Shard, symbols: np.ndarray) -> np.ndarray:
    return _sizes(symbols, shard.base, [shard.lengths])


def expand_all(shard: Shard) -> np.ndarray:
    """All ids of the shard: every rule is expanded once, round by round, then all symbols at once."""
    base, rules = shard.base, len(shard.left)
    begin = np.concatenate([[0], np.cumsum(shard.lengths)])
    pool = np.empty(begin[-1] + base, np.int32)  # the rules' expansions, then each id as itself
    pool[begin[-1]:] = np.arange(base)

    def where(symbols: np.ndarray) -> np.ndarray:
        ruled = symbols >= base
        return np.where(ruled, begin[np.where(ruled, symbols - base, 0)], begin[-1] + symbols)

    def gather(symbols: np.ndarray) -> np.ndarray:
        size = symbol_lengths(shard, symbols)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(where(symbols) - (ends - size), size) + np.arange(total)]

    for low, high in zip(shard.rounds, shard.rounds[1:]):
        both = np.stack([shard.left[low:high], shard.right[low:high]], axis=1).ravel()
        pool[begin[low]:begin[high]] = gather(both)
    return gather(shard.symbols) if rules else shard.symbols.copy()


def slice_document(shard: Shard, document: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end (exclusive) of one document, expanding only the symbols that cover them."""
    first = int(shard.counts[:document].sum())
    symbols = shard.symbols[first:first + int(shard.counts[document])]
    begin, end = max(0, begin), min(end, int(shard.totals[document]))
    if begin >= end:
        return np.zeros(0, np.int32)
    ends = np.cumsum(symbol_lengths(shard, symbols))
    low, high = np.searchsorted(ends, [begin, end - 1], side="right")
    skipped = int(ends[low - 1]) if low else 0
    out: list[int] = []
    stack = [int(s) for s in symbols[low:high + 1][::-1]]
    begin, end = begin - skipped, end - skipped
    at = 0
    while stack and at < end:
        symbol = stack.pop()
        size = int(shard.lengths[symbol - shard.base]) if symbol >= shard.base else 1
        if at + size <= begin:
            at += size
        elif symbol < shard.base:
            out.append(symbol)
            at += 1
        else:
            stack += [int(shard.right[symbol - shard.base]), int(shard.left[symbol - shard.base])]
    return np.array(out, np.int32)
