"""Language of texts by a linear-chain conditional random field over words.

Words are labelled, so a text may switch between languages. Features are hashed: byte trigrams with
the word's edges, prefixes and suffixes of four bytes, the whole word, and a lexicon feature (the
language in which the training sample has the word most often). Transitions are learned with the
feature weights by forward-backward on sequences put together from pieces of different documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.llm.words import Words, chunks, mix, word_hashes, words_of

UNKNOWN = "und"
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 3000
LANGUAGES = 1024  # more distinct labels than this are an error
CHUNK_LABELS = 64
BUCKETS = 1 << 17
LEXICON = 100_000
EPOCHS = 6
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Crf(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # (BUCKETS + 1 + labels) x labels; after the buckets come the lexicon features
    transitions: np.ndarray
    lexicon_keys: np.ndarray  # sorted word hashes
    lexicon_labels: np.ndarray


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram bucket of every byte of a word, and the prefix and suffix bucket of every word."""
    padded = np.full(len(words.data) + 6, 32, np.uint64)
    padded[3:-3] = words.data
    left = padded[2:-4].copy()
    right = padded[4:-2].copy()
    if len(words.starts):
        left[words.starts] = 32
        right[words.ends - 1] = 32
    tri = _bucket(left | padded[3:-3] << np.uint64(8) | right << np.uint64(16) | np.uint64(1 << 40))
    size = words.ends - words.starts
    prefix = np.zeros(len(size), np.uint64)
    suffix = np.zeros(len(size), np.uint64)
    for k in range(4):
        inside = size > k
        prefix |= np.where(inside, padded[words.starts + 3 + k], 0).astype(np.uint64) << np.uint64(8 * k)
        suffix |= np.where(inside, padded[words.ends + 2 - k], 0).astype(np.uint64) << np.uint64(8 * k)
    return tri, _bucket(prefix | np.uint64(2 << 40)), _bucket(suffix | np.uint64(3 << 40))


def _lexicon_feature(model: Crf, hashes: np.ndarray) -> np.ndarray:
    """The row of the lexicon feature of every word; the first one means unlisted."""
    if not len(model.lexicon_keys):
        return np.full(len(hashes), BUCKETS, np.int32)
    at = np.minimum(np.searchsorted(model.lexicon_keys, hashes), len(model.lexicon_keys) - 1)
    listed = model.lexicon_keys[at] == hashes
    return np.where(listed, BUCKETS + 1 + model.lexicon_labels[at], BUCKETS).astype(np.int32)


def emissions(model: Crf, words: Words) -> np.ndarray:
    """The score of every word for every label."""
    k = len(model.labels)
    n = len(words.starts)
    if not n:
        return np.zeros((0, k), np.float32)
    tri, prefix, suffix = _grams(words)
    hashes = word_hashes(words)
    out = model.weights[prefix] + model.weights[suffix] + model.weights[_bucket(hashes)]
    out += model.weights[_lexicon_feature(model, hashes)]
    bounds = np.empty(2 * n, np.int64)
    bounds[0::2], bounds[1::2] = words.starts, words.ends
    padded = np.append(tri, 0)
    for label in range(k):
        column = model.weights[:, label][padded]
        out[:, label] += np.add.reduceat(column, bounds)[::2]
    return out


def forward_backward(
    scores: np.ndarray, first: np.ndarray, transitions: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of every word's label; forward weights and scales for the pair posteriors.

    Sequence d is scores[first[d]:first[d + 1]]. All sequences advance together, longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(transitions)
    forward = np.zeros_like(local)
    backward = np.ones_like(local)
    scale = np.ones(len(local), local.dtype)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    state = None
    for t in range(longest):
        at = begin[:active[t]] + t
        state = local[at] if t == 0 else (state[:active[t]] @ step) * local[at]
        total = state.sum(axis=1)
        state = state / total[:, None]
        forward[at], scale[at] = state, total
    for t in range(longest - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        message = (local[at + 1] * backward[at + 1]) @ step.T
        backward[at] = message / message.sum(axis=1, keepdims=True)
    posterior = forward * backward
    posterior /= posterior.sum(axis=1, keepdims=True) if len(posterior) else 1
    return posterior, forward, local * backward


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> Crf:
    """Fit by Adam on the conditional log likelihood of pieced-together sequences."""
    names = sorted(set(labels))
    k = len(names)
    if not names:
        return Crf(
            [], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words = words_of(pa.array(texts, pa.string()), lower=True)
    of_text = np.array([names.index(x) for x in labels], np.int64)
    gold = np.repeat(of_text, np.diff(words.first))
    hashes = word_hashes(words)
    keys, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    pair, times = np.unique(at * k + gold, return_counts=True)
    order = np.lexsort((pair, -times, pair // k))
    top = pair[order][np.unique(pair[order] // k, return_index=True)[1]] % k  # ties go to the first label
    enough = np.flatnonzero(counts >= 3)
    enough = np.sort(enough[np.argsort(-counts[enough], kind="stable")[:LEXICON]])
    model = Crf(names, np.zeros((BUCKETS + 1 + k, k), np.float32), np.zeros((k, k), np.float32),
                keys[enough], top[enough])
    if k < 2 or not len(gold):
        return model

    random = np.random.default_rng(seed)
    tri, prefix, suffix = _grams(words)
    single = np.stack([prefix, suffix, _bucket(hashes), _lexicon_feature(model, hashes)], axis=1)
    length = words.ends - words.starts
    pieces = []
    for begin, end in zip(words.first[:-1], words.first[1:]):
        while begin < end:
            stop = min(end, begin + int(random.integers(5, 40)))
            pieces.append(np.arange(begin, stop))
            begin = stop
    momentum = [np.zeros_like(model.weights), np.zeros_like(model.transitions)]
    variance = [np.zeros_like(model.weights), np.zeros_like(model.transitions)]
    steps = 0
    for _ in range(epochs):
        shuffled = random.permutation(len(pieces))
        for start in range(0, len(pieces), 192):
            chosen = [pieces[i] for i in shuffled[start:start + 192]]
            at = np.concatenate(chosen)
            joined = [chosen[i:i + 3] for i in range(0, len(chosen), 3)]
            first = np.concatenate([[0], np.cumsum([sum(map(len, j)) for j in joined])])
            size = length[at]
            spans = np.repeat(words.starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            word = np.repeat(np.arange(len(at)), size)
            scores = model.weights[single[at]].sum(axis=1)
            for label in range(k):
                scores[:, label] += np.bincount(word, model.weights[tri[spans], label], len(at))
            posterior, forward, beta = forward_backward(scores, first, model.transitions)
            error = posterior.copy()
            error[np.arange(len(at)), gold[at]] -= 1
            error /= len(joined)
            slope = np.zeros_like(model.weights)
            for label in range(k):
                slope[:, label] = np.bincount(tri[spans], error[word, label], len(slope))
                for column in range(4):
                    slope[:, label] += np.bincount(single[at, column], error[:, label], len(slope))
            inner = np.setdiff1d(np.arange(len(at)), first[1:] - 1)
            step, begun, ended = np.exp(model.transitions), forward[inner], beta[inner + 1]
            begun /= ((begun @ step) * ended).sum(axis=1, keepdims=True)
            turn = step * (begun.T @ ended)  # the pair posteriors, summed without one table per word
            np.subtract.at(turn, (gold[at[inner]], gold[at[inner + 1]]), 1)
            steps += 1
            for i, (value, g) in enumerate(((model.weights, slope + 1e-4 * model.weights),
                                            (model.transitions, (turn / len(joined)).astype(np.float32)))):
                momentum[i] += 0.1 * (g - momentum[i])
                variance[i] += 0.01 * (g * g - variance[i])
                move = momentum[i] / (1 - 0.9 ** steps)
                value -= 0.05 * move / (np.sqrt(variance[i] / (1 - 0.99 ** steps)) + 1e-6)
    return model


def training_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_TEXTS, languages: int = LANGUAGES,
) -> tuple[list[str], list[str]]:
    """At most ``per_language`` pieces of at most SAMPLE_CHARS characters for every label, chosen by a
    hash of the id: the model's bounded sample. More than ``languages`` labels are a ValueError."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if rows.select(lang_col).distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"{lang_col} has more than {languages} labels; none is left out of the model, so raise "
                         f"languages (each takes {BUCKETS * 4 >> 10} kB of weights) or clean the column")
    span = F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), span).cast("int") + 1
    piece = F.substring(F.col(text_col), begin, F.lit(SAMPLE_CHARS))
    ranked = rows.select(
        F.col(lang_col).alias("l"), F.col(id_col).alias("i"), F.xxhash64(id_col).alias("h"),
        F.row_number().over(W.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col, text_col)).alias("r"),
        piece.alias("t")).where(F.col("r") <= per_language)
    found = sorted((r["l"], r["r"], r["t"]) for r in ranked.select("l", "r", "t").collect())
    return [t for _, _, t in found], [label for label, _, _ in found]


def held_out(id_col: str, parts: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == 0


def predict(
    docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text",
    carried: list[Column] | None = None,
) -> DataFrame:
    """One row per input row: the carried columns, ``lang_pred`` and ``score``.

    Words without a letter take part in the chain but not in the vote; ``score`` is the mean
    posterior of the winning label over the voting words. Ties go to the label that sorts first.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything where
    nothing could be learned. Ids may be null or repeated; an empty table gives no rows.
    """
    carried = carried or [F.col(id_col)]
    source = docs.select(*carried, F.col(text_col).alias("_text"))
    fields = source.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS, LANGUAGES and LEXICON
    size = (1 << 21) * CHUNK_LABELS // max(len(model.labels), CHUNK_LABELS)  # a word takes memory per label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in chunks(batch, "_text", size):
                column = part.column(part.num_columns - 1)
                words = words_of(column, lower=True)
                n = part.num_rows
                letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])
                voting = letters[words.ends] > letters[words.starts]
                votes = np.zeros((n, max(len(crf.labels), 1)))
                doc = np.repeat(np.arange(n), np.diff(words.first))
                if crf.labels:
                    posterior, _, _ = forward_backward(emissions(crf, words), words.first, crf.transitions)
                    for label in range(len(crf.labels)):
                        votes[:, label] = np.bincount(doc, posterior[:, label] * voting, n)
                count = np.bincount(doc, voting, n)
                best = votes.argmax(axis=1)
                plain = np.zeros(n, bool)  # any ASCII letter: surely a letter
                plain[doc[voting]] = True
                names, scores = [], []
                for d in range(n):
                    lettered = plain[d] and (
                        _has_ascii_letter(words, d) or any(c.isalpha() for c in column[d].as_py()))
                    known = lettered and bool(crf.labels)
                    names.append(crf.labels[best[d]] if known else UNKNOWN)
                    scores.append(float(min(1.0, votes[d, best[d]] / count[d])) if known else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in range(part.num_columns - 1)], pa.array(names, pa.string()),
                     pa.array(scores, pa.float64())], [*[f.name for f in fields], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def _has_ascii_letter(words: Words, doc: int) -> bool:
    data = words.data[words.offsets[doc]:words.offsets[doc + 1]]
    return bool(((data >= 97) & (data <= 122)).any())


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 5,
) -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of every row, as ``predict`` defines them.

    The model is fitted on a bounded sample of every language among the rows that are not held out and
    have a text and a language; a prediction sees nothing but the text.
    """
    out = held_out(id_col, parts)
    model = train(*training_sample(docs.where(~out), id_col, text_col, lang_col))
    return predict(docs, model, id_col, text_col, [F.col(id_col), out.alias("held_out")])
