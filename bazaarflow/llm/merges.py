"""Byte-pair encoding of many distinct pre-tokens at once, in numpy.

A text is cut into the tokenizer's pre-tokens on its bytes; each distinct one is encoded once, many
side by side: every step merges the best pair of every pre-token. Words of other scripts, of special
tokens or apostrophes, and long runs take ``bpe.ForcedBoundaryEncoder``, word by word.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from bazaarflow.llm import bpe
from bazaarflow.llm.words import find_words, text_bytes, word_hashes

KNOWN_TOKENS = 400_000
SLOT_BITS = 20
WIDTHS = (8, 16, 32)
_NONE = np.int32(2**31 - 1)
_SALT = np.uint64(0xA24BAED4963EE407)

# Byte classes: white space, letter, digit, other; a word with a byte that may not be here is irregular.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IRREGULAR = np.zeros(256, bool)
_IRREGULAR[:32] = True
_IRREGULAR[[9, 10, 11, 12, 13]] = False
_IRREGULAR[[39, 60, 127]] = True  # apostrophe, start of a special token, delete
_IRREGULAR[128:] = True


class PairTable:
    """Merge rank and result of a pair of symbols, by two hash tables without collisions."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left.astype(np.int64), right.astype(np.int64)
        keys = (self.left << 32 | self.right).astype(np.uint64)
        self.first, rest = self._table(keys, np.arange(len(keys)), np.uint64(0x9E3779B97F4A7C15))
        chance = np.random.default_rng(5)
        while True:
            self.factor = np.uint64(chance.integers(2**62, 2**63)) | np.uint64(1)
            self.second, lost = self._table(keys, rest, self.factor)
            if not lost.size:
                break

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys * factor >> np.uint64(44)).astype(np.int64)

    def _table(self, keys: np.ndarray, which: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        table = np.zeros(1 << 20, np.int32)
        slots = self._slot(keys[which], factor)
        table[slots] = which
        return table, which[table[slots] != which]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64)
        out = np.full(left.shape, _NONE)
        for table, factor in ((self.second, self.factor), (self.first, np.uint64(0x9E3779B97F4A7C15))):
            found = table[self._slot(keys, factor)]
            same = (self.left[found] == left) & (self.right[found] == right)
            out[same] = found[same]
        return out


class BatchEncoder:
    """The ids of whole texts, as the tokenizer file gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        self.words = bpe.ForcedBoundaryEncoder(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(
            np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        shown = self.words.shown
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + bpe.END] for b in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.slot_key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_place = np.full(1 << SLOT_BITS, -1, np.int32)
        self.checks = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another (int32), and where each text's ids begin and end."""
        data, offsets = text_bytes(column)
        tokens = _pre_tokens(data, offsets)
        if len(self.size) > KNOWN_TOKENS:
            self._forget()
        place = self._places(data, tokens)
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[place] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(tokens.starts, offsets)]

    def _places(self, data: np.ndarray, tokens: _Tokens) -> np.ndarray:
        """For each token its place among the known ones; encodes those that are not known yet.

        A slot keeps the latest token that fell into it; one that lost its slot is encoded again.
        """
        slots = (tokens.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = self.slot_place[slots].astype(np.int64)
        place[self.slot_key[slots] != tokens.keys] = -1
        missing = np.flatnonzero(place < 0)
        if missing.size:
            keys, first, which = np.unique(tokens.keys[missing], return_index=True, return_inverse=True)
            some = missing[first]
            flat, sizes = self._encode_tokens(data, tokens, some)
            new = len(self.size) + np.arange(len(some))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.checks = np.concatenate([self.checks, tokens.checks[some]])
            self.flat = np.concatenate([self.flat, flat])
            self.slot_key[slots[some]] = keys
            self.slot_place[slots[some]] = new
            # Two tokens for one slot: the key that was written last is the one whose place is there.
            self.slot_key[slots[some]] = tokens.keys[some[self.slot_place[slots[some]] - new[0]]]
            place[missing] = new[which]
        if not np.array_equal(self.checks[place], tokens.checks):
            raise ArithmeticError("two words share a 64-bit hash")
        return place

    def _encode_tokens(self, data: np.ndarray, tokens: _Tokens, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the tokens numbered ``some``, one after another, and how many each has."""
        starts, ends = tokens.starts[some], tokens.ends[some]
        length = ends - starts
        slow = np.flatnonzero(tokens.irregular[some] | (length > WIDTHS[-1]))
        sizes = np.zeros(len(some), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if slow.size:
            raws = [data[starts[i]:ends[i]].tobytes() for i in slow]
            found = self.words.learn(dict.fromkeys(raws))
            ids = [np.array(found[raw][0].split(), np.int32) for raw in raws]
            sizes[slow] = [len(x) for x in ids]
            parts.append((slow, np.concatenate(ids)))
        low = 0
        quick = ~tokens.irregular[some]
        for width in WIDTHS:
            rows = np.flatnonzero(quick & (length > low) & (length <= width))
            low = width
            if rows.size:
                symbols = self._merged(tokens.lowered, starts[rows], length[rows], width)
                used = symbols >= 0
                sizes[rows] = used.sum(axis=1)
                parts.append((rows, symbols[used]))
        out = np.empty(sizes.sum(), np.int32)
        begin = np.cumsum(sizes) - sizes
        for rows, ids in parts:
            inner = np.cumsum(sizes[rows]) - sizes[rows]
            out[np.repeat(begin[rows] - inner, sizes[rows]) + np.arange(len(ids))] = ids
        return out, sizes

    def _merged(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
        """One row of symbols per token, -1 after its end."""
        columns = np.arange(width)
        inside = columns < length[:, None]
        raw = data[np.minimum(starts[:, None] + columns, len(data) - 1)]
        symbols = np.where(inside, self.inner[raw], np.int32(-1))
        rows = np.arange(len(starts))
        symbols[rows, length - 1] = self.last[raw[rows, length - 1]]
        done = np.full_like(symbols, -1)
        ranks = self.pairs.ranks(symbols[:, :-1], symbols[:, 1:])
        while True:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(best)), best]
            live = rank < _NONE
            done[rows[~live], :symbols.shape[1]] = symbols[~live]
            if not live.any():
                return done
            rows, symbols, ranks, best, rank = rows[live], symbols[live], ranks[live], best[live], rank[live]
            line = np.arange(len(rows))
            symbols[line, best] = self.result[rank]
            tail = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, tail + (tail > best[:, None]), 1)
            if symbols.shape[1] == 1:
                done[rows, :1] = symbols
                return done
            tail = tail[:-1]
            ranks = np.take_along_axis(ranks, tail + (tail >= best[:, None]), 1)
            some = np.flatnonzero(best < symbols.shape[1] - 1)
            at = best[some]
            ranks[some, at] = self.pairs.ranks(symbols[some, at], symbols[some, at + 1])
            some = np.flatnonzero(best > 0)
            at = best[some] - 1
            ranks[some, at] = self.pairs.ranks(symbols[some, at], symbols[some, at + 1])


class _Tokens:
    """Pre-tokens of regular words and whole irregular words, in order."""

    def __init__(self, lowered, starts, ends, irregular, keys, checks):
        self.lowered, self.starts, self.ends, self.irregular = lowered, starts, ends, irregular
        self.keys, self.checks = keys, checks


def _pre_tokens(data: np.ndarray, offsets: np.ndarray) -> _Tokens:
    words = find_words(data, offsets)
    n = len(data)
    lowered = _LOWER[data]
    odd = _IRREGULAR[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    after = data[lead + 1] if n else np.zeros(0, np.uint8)
    letter = (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[letter], after[letter]
    odd[lead] = odd[lead + 1] = False
    capital = lead[after < 0x9F] + 1
    lowered[capital] += 0x20
    total = np.zeros(n + 1, np.int64)
    np.cumsum(odd, out=total[1:])
    strange = total[words.ends] > total[words.starts]
    kind = _CLASS[lowered]
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    if strange.any():
        keep = np.zeros(n + 1, np.int32)
        np.add.at(keep, words.starts[strange], 1)
        np.add.at(keep, words.ends[strange], -1)
        cut[np.cumsum(keep) > 0] = False
    cut[words.starts] = True
    cut[:n] &= kind != 0
    starts = np.flatnonzero(cut[:n])
    word = np.searchsorted(words.starts, starts, side="right") - 1
    ends = np.empty(len(starts), np.int64)
    if len(starts):
        ends[:-1] = starts[1:]
        ends[-1] = n
        ends = np.minimum(ends, words.ends[word])
    irregular = strange[word] if len(starts) else np.zeros(0, bool)
    place = words._replace(data=lowered, starts=starts, ends=ends)
    keys, checks = word_hashes(place, 0), word_hashes(place, 1)
    if irregular.any():  # case matters to special tokens
        own = words._replace(data=data, starts=starts[irregular], ends=ends[irregular])
        keys[irregular] = word_hashes(own, 0) ^ _SALT
        checks[irregular] = word_hashes(own, 1) ^ _SALT
    return _Tokens(lowered, starts, ends, irregular, keys, checks)


@lru_cache(2)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)
