"""Encoding with a word-end BPE by forced boundaries, and decoding.

A byte pair that occurs inside no vocabulary token can never be merged, so a text may be cut
between the two bytes: the fragments are encoded on their own and the ids are concatenated. White
space is in no token, which cuts a text into words; inside words, the pairs missing from the
vocabulary give the other cuts. A word's result is kept for the words like it that follow.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.words import chunks

CACHED_WORDS = 200_000
END = "</w>"


class ForcedBoundaryEncoder:
    """Encodes as the tokenizer file does with add_special_tokens=False.

    Results are kept by word and by pre-token as (ids as decimals, decoded tokens), each joined by
    one space; unknown ones are resolved many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for i, t in tokens.items()}
        self.numbers = {i: b"%d" % i for i in tokens}
        plain = (t.removesuffix(END) for t in vocab)
        self.joined = {t[i:i + 2] for t in plain for i in range(len(t) - 1)}
        self.inner = Tokenizer(BPE(vocab=vocab, merges=merges))
        self.last = Tokenizer(BPE(vocab=vocab, merges=merges, end_of_word_suffix=END))
        # Byte-level files write every byte as one printable character.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        # Latin-1 words without white space or control characters are split here, all others by the library.
        latin = [chr(c) for c in range(33, 256) if c not in range(127, 161)]
        letters = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "L"))
        numbers = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "N"))
        self.simple = re.compile("[!-~\u00a1-\u00ff]+")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")
        self.pre: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.blank = False

    def pre_tokens(self, word: str) -> list[str]:
        """The byte-level pre-tokens of a run without white space or special tokens."""
        if self.simple.fullmatch(word):
            found = self.split.findall(word.lower())
            if word.isascii():
                return found
            return [t if t.isascii() else "".join(map(self.shown.__getitem__, t.encode())) for t in found]
        normal = self.whole.normalizer.normalize_str(word)
        return [t for t, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def fragments(self, token: str) -> list[str]:
        """The pieces of one pre-token between forced boundaries."""
        cuts = [i for i in range(1, len(token)) if token[i - 1:i + 1] not in self.joined]
        return [token[a:b] for a, b in zip([0, *cuts], [*cuts, len(token)])] if cuts else [token]

    def _encode_tokens(self, tokens: set[str]) -> None:
        """Encode pre-tokens that are not known yet, by their fragments."""
        parts = {t: self.fragments(t) for t in tokens}
        ends = list({p[-1] for p in parts.values()})
        middles = list({f for p in parts.values() if len(p) > 1 for f in p[:-1]})
        end_ids = {f: e.ids for f, e in zip(ends, self.last.encode_batch_fast(ends, add_special_tokens=False))}
        ids = {f: e.ids for f, e in zip(middles, self.inner.encode_batch_fast(middles, add_special_tokens=False))}
        for token, p in parts.items():
            found = end_ids[p[-1]] if len(p) == 1 else [i for f in p[:-1] for i in ids[f]] + end_ids[p[-1]]
            self.pre[token] = self._result(found)

    def _result(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b" ".join([self.numbers[i] for i in ids]), b" ".join([self.tokens[i] for i in ids])

    def learn(self, raws: Iterable[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """The results of words that are not known yet."""
        out, split = {}, {}
        for raw in raws:
            word = raw.decode()
            if "<" in word and any(s in word for s in self.special):
                out[raw] = self._result(self.whole.encode(word, add_special_tokens=False).ids)
            else:
                split[raw] = self.pre_tokens(word)
        if len(self.pre) > CACHED_WORDS:
            self.pre = {}
        self._encode_tokens({t for tokens in split.values() for t in tokens}.difference(self.pre))
        pre = self.pre
        for raw, tokens in split.items():
            if len(tokens) == 1:
                out[raw] = pre[tokens[0]]
            else:
                found = [pre[t] for t in tokens]
                out[raw] = b" ".join([f[0] for f in found]), b" ".join([f[1] for f in found])
                self.blank |= not tokens
        return out

    def encode_many(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
        """Per text: all ids as decimals joined by one space, and the decoded text.

        The library's decode() for a file without a decoder joins the tokens by one space.
        """
        split = [(t or b"").split() for t in texts]
        new = self.learn(set().union(*split).difference(self.words))
        if len(self.words) + len(new) <= CACHED_WORDS:
            self.words.update(new)
        # Once full, what came early is kept and the rest serves these texts only.
        known = self.words
        for text in split:
            found = [known.get(w) or new[w] for w in text]
            if self.blank:  # some words are white space to the library
                found = [w for w in found if w[0]]
            yield b" ".join([w[0] for w in found]), b" ".join([w[1] for w in found])


def count_ids(numbers: bytes) -> int:
    return numbers.count(b" ") + 1 if numbers else 0


@lru_cache(2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: its id, ``ids`` (array of int) and the ``decoded`` text.

    Null text counts as empty and has no ids. Ids may be null or repeated; other columns are
    ignored; an empty table gives no rows. No shuffle: each task encodes what it reads.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in chunks(batch, text_col):
                ids, decoded = [], []
                for numbers, text in bpe.encode_many(part.column(1).cast(pa.binary()).to_pylist()):
                    ids.append([int(i) for i in numbers.split()])
                    decoded.append(text.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    ["id", "ids", "decoded"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: its id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    As ``encode_texts``, but ids and texts stay in the task and only their digests leave it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in chunks(batch, text_col):
                counts, ids, decoded = [], [], []
                for numbers, text in bpe.encode_many(part.column(1).cast(pa.binary()).to_pylist()):
                    counts.append(count_ids(numbers))
                    ids.append(hashlib.sha256(numbers).hexdigest())
                    decoded.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    ).withColumnRenamed("id", id_col)
