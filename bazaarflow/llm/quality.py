"""Quality of documents by hierarchical empirical Bayes.

A document classifier gives each text a log likelihood ratio of being good. Its prior is the rate
of good documents of the path it comes from. That rate is a posterior itself: the path's documents
shrink toward the host's rate and the host's toward the global one, by as much as the spread between
paths and hosts warrants. All rates come from grouped sums over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.llm.tables import keep_rows, release_memory, releasing, text_key
from bazaarflow.llm.words import SMALL_CHUNK, Words, chunks, find_words, mix, text_bytes, word_hashes
from bazaarflow.session import materialise

SAMPLE_ROWS = 2000
SAMPLE_CHARS = 50_000
KINDS = ("good", "poor", "toxic")
BUCKETS = 1 << 18
CLEAR = 4.0
LIMIT = 30.0
SALTS = 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = True
_NO_SITE = "\0"


class DocumentModel(NamedTuple):
    buckets: np.ndarray  # weight of a hashed feature that is present
    dense: np.ndarray  # weights of the standardised dense features
    mean: np.ndarray
    spread: np.ndarray
    bias: float


def _bucket(x: np.ndarray, family: int) -> np.ndarray:
    return (mix(x ^ np.uint64(family << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every word's features, and the dense features of every document."""
    words = find_words(data, offsets, lower=True)
    n = len(offsets) - 1
    count = np.diff(words.first)
    doc = np.repeat(np.arange(n), count)
    hashes = word_hashes(words)
    size = words.ends - words.starts
    heads = []
    for length in (4, 5, 6):
        longer = size > length
        cut = words._replace(starts=words.starts[longer], ends=words.starts[longer] + length)
        heads.append((doc[longer], _bucket(word_hashes(cut), length)))
    docs = np.concatenate([doc, *[d for d, _ in heads]])
    buckets = np.concatenate([_bucket(hashes, 1), *[b for _, b in heads]])

    def per_byte(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    repeated = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        repeated[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    marks = np.concatenate([[0], np.cumsum(_MARK[words.data])])
    marked = marks[words.ends] > marks[words.starts]
    total = np.maximum(count, 1)
    per_word = [np.bincount(doc, x, n) / total for x in (repeated, marked, size)]
    letters = np.maximum(per_byte(_LETTER), 1)
    bytes_of = np.maximum(np.diff(offsets), 1)
    dense = np.stack([
        *per_word, per_byte(_UPPER) / letters, per_byte(_MARK) / bytes_of, np.log1p(count)], axis=1)
    return docs, buckets, dense


def _clear(doc: np.ndarray, bucket: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which buckets have log odds that are clearly not zero."""
    n_good, n_bad = max(good.sum(), 1), max((~good).sum(), 1)
    in_good = np.bincount(bucket[good[doc]], minlength=BUCKETS)
    in_bad = np.bincount(bucket[~good[doc]], minlength=BUCKETS)
    odds = np.log((in_good + 0.5) / (n_good - in_good + 0.5)) - np.log((in_bad + 0.5) / (n_bad - in_bad + 0.5))
    error = np.sqrt(1 / (in_good + 0.5) + 1 / (in_bad + 0.5))
    return np.abs(odds / error) >= CLEAR


def _fit(
    doc: np.ndarray, bucket: np.ndarray, chosen: np.ndarray, dense: np.ndarray, good: np.ndarray,
) -> DocumentModel:
    """Balanced logistic regression on the chosen buckets and the dense features.

    ``doc`` and ``bucket`` list the hashed features in these buckets, ``dense`` has a row per document.
    """
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    z = np.clip((dense - mean) / spread, -8, 8)
    n_good, n_bad = max(good.sum(), 1), max((~good).sum(), 1)
    weights, extra, bias = np.zeros(BUCKETS), np.zeros(dense.shape[1]), 0.0
    importance = np.where(good, 0.5 / n_good, 0.5 / n_bad)
    state = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(extra) + 1), np.zeros(len(extra) + 1)]
    for step in range(1, 401):
        margin = np.bincount(doc, weights[bucket], len(good)) + z @ extra + bias
        slope = (1 / (1 + np.exp(-np.clip(margin, -LIMIT, LIMIT))) - good) * importance
        g = np.bincount(bucket, slope[doc], BUCKETS) + 1e-5 * weights
        h = np.append(z.T @ slope + 1e-5 * extra, slope.sum())
        for value, m, v in ((g, 0, 1), (h, 2, 3)):
            state[m] += 0.1 * (value - state[m])
            state[v] += 0.01 * (value * value - state[v])
        a, b = 1 - 0.9 ** step, 1 - 0.99 ** step
        weights -= 0.05 * (state[0] / a) / (np.sqrt(state[1] / b) + 1e-9) * chosen
        move = 0.05 * (state[2] / a) / (np.sqrt(state[3] / b) + 1e-9)
        extra, bias = extra - move[:-1], bias - move[-1]
    return DocumentModel(weights.astype(np.float32), extra, mean, spread, float(bias))


def fit_documents(labelled: DataFrame, per_class: int = SAMPLE_ROWS) -> DocumentModel | None:
    """The document classifier, from rows (id, text, good, kind); None where a class is missing.

    The sample is bounded: of each kind, ``per_class`` rows chosen by a hash of the id, and of each
    row a piece of at most SAMPLE_CHARS characters.
    """
    span = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("id", F.lit(7)), span).cast("int") + 1
    pieces = labelled.withColumn("text", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)))
    sample = pieces.withColumn("r", F.row_number().over(
        W.partitionBy("kind").orderBy(F.xxhash64("id", F.lit(5)), "id", "text"))).where(F.col("r") <= per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                docs, buckets, dense = _features(*text_bytes(part.column(0)))
                found = np.unique(docs * BUCKETS + buckets)
                cuts = np.searchsorted(found, np.arange(1, part.num_rows) * BUCKETS)
                lists = [x.tolist() for x in np.split(found % BUCKETS, cuts)]
                yield pa.RecordBatch.from_arrays([
                    part.column(1), pa.array(lists, pa.list_(pa.int32())),
                    pa.array(dense.tolist(), pa.list_(pa.float64())), part.column(2)],
                    ["good", "buckets", "dense", "r"])

    rows = sample.select("text", "good", F.xxhash64("id", "r", "kind").alias("r")).mapInArrow(
        releasing(run), "good boolean, buckets array<int>, dense array<double>, r long").toArrow().sort_by("r")
    good = rows["good"].to_numpy().astype(bool)
    if not len(good) or good.all() or not good.any():
        return None
    lists = rows["buckets"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    dense = rows["dense"].combine_chunks().flatten().to_numpy().reshape(len(good), -1)
    doc, bucket = np.repeat(np.arange(len(good), dtype=np.int32), sizes), lists.flatten().to_numpy()
    chosen = _clear(doc, bucket, good)
    use = chosen[bucket]
    doc, bucket = doc[use], bucket[use]
    del rows, lists, sizes, use
    release_memory()
    return _fit(doc, bucket, chosen, dense, good)


def document_evidence(docs: DataFrame, model: DocumentModel | None, text_col: str, carried: list[Column]) -> DataFrame:
    """The carried columns and ``evidence``, the text's log likelihood ratio; 0 without a model."""
    if model is None:
        return docs.select(*carried, F.lit(0.0).alias("evidence"))
    source = docs.select(*carried, F.col(text_col).alias("_text"))
    fields = source.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch, "_text", SMALL_CHUNK):
                docs_of, buckets, dense = _features(*text_bytes(part.column(part.num_columns - 1)))
                weighty = m.buckets[buckets] != 0
                pairs = np.unique(docs_of[weighty] * BUCKETS + buckets[weighty])
                margin = np.bincount(pairs // BUCKETS, m.buckets[pairs % BUCKETS], part.num_rows).astype(float)
                margin += np.clip((dense - m.mean) / m.spread, -8, 8) @ m.dense + m.bias
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in range(part.num_columns - 1)],
                     pa.array(np.clip(margin, -LIMIT, LIMIT), pa.float64())],
                    [*[f.name for f in fields], "evidence"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(releasing(run), f"{kinds}, evidence double")


def _strength(groups: DataFrame, parent: Column) -> float:
    """The prior weight of the parent's rate, by the method of moments; one row to the driver.

    The spread between groups beyond what their sizes explain is the prior's variance.
    """
    n, rate = F.col("n"), F.col("s") / F.col("n")
    row = groups.agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.count(F.lit(1)).alias("g"),
        F.sum(n * (rate - parent) ** 2).alias("between"),
        F.sum(n * parent * (1 - parent)).alias("within")).first()
    if not row["n"] or row["g"] < 2:
        return 1e6
    usual = row["within"] / row["n"]
    extra = (row["between"] - (row["g"] - 1) * usual) / max(row["n"] - row["n2"] / row["n"], 1e-9)
    return float(np.clip(usual / extra - 1, 1.0, 1e6)) if extra > 0 and usual > 0 else 1e6


def site_rates(evidence: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate) from rows with host, path, evidence and label.

    A labelled document counts as its label, any other as its posterior under the global rate.
    """
    known = evidence.agg(F.avg("label").alias("m")).first()["m"]
    start = float(np.clip(0.5 if known is None else known, 0.01, 0.99))
    belief = F.coalesce(F.col("label"), 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(start / (1 - start)))))))
    paths = materialise(evidence.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(belief).alias("s")), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = float(np.clip(total["s"] / total["n"], 1e-3, 1 - 1e-3)) if total["n"] else start
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    weight = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("s") + weight * overall) / (F.col("n") + weight)).alias("host_rate"))
    placed = paths.join(hosts, "host")
    weight = _strength(placed, F.col("host_rate"))
    return placed.select("host", "path", "host_rate", (
        (F.col("s") + weight * F.col("host_rate")) / (F.col("n") + weight)).alias("path_rate"))


def _site(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(_NO_SITE))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, ``row_key``, ``evidence``, ``host_rate``, ``path_rate``, ``score``, ``keep``.

    ``labels`` has the id, ``quality`` and ``toxic``; good means quality 1 and not toxic. A label
    with both values null is no label; a null quality counts as good, a null toxic as not toxic;
    of several labels of one id the worst counts. ``host`` defaults to the column ``source`` and
    ``path`` to ``lang`` within it; nulls are a site of their own. ``score`` is the posterior
    probability of being good, ``keep`` whether it reaches ``threshold``. Null text is empty; ids
    may be null or repeated, and equal rows have equal results; without usable labels all evidence
    is 0 and everything is kept; an empty table gives no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), text_key(text_col).alias("row_key"),
        _site(host).alias("host"), _site(path).alias("path"))
    good = (F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    given = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    marked = labels.where(F.col(id_col).isNotNull() & given).groupBy(F.col(id_col).alias("id")).agg(
        F.min(good).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    marked = marked.withColumn(
        "kind", F.when(F.col("good"), KINDS[0]).when(F.col("toxic") == 0, KINDS[1]).otherwise(KINDS[2]))
    model = fit_documents(_labelled_sample(rows, marked))
    evidence = document_evidence(rows, model, "text", [F.col(c) for c in ("id", "row_key", "host", "path")])
    truth = marked.select("id", F.col("good").cast("double").alias("label"))
    scored = materialise(evidence.join(truth, "id", "left"), "quality-evidence")

    rates = site_rates(scored)
    salt = F.pmod(F.xxhash64("id", "row_key"), F.lit(SALTS)).cast("int")
    spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = scored.withColumn("salt", salt).join(spread, ["host", "path", "salt"])
    prior = F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    keep = score >= threshold if model is not None else F.lit(True)
    return joined.select(
        F.col("id").alias(id_col), "row_key", "evidence", "host_rate", "path_rate",
        score.alias("score"), keep.alias("keep"))


def _labelled_sample(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Texts of a bounded choice of the labelled ids that have rows: twice SAMPLE_ROWS of each kind, lowest hash first."""
    present = marked.join(rows.select("id"), "id", "left_semi")
    chosen = reduce(DataFrame.unionByName, [
        present.where(F.col("kind") == kind).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(2 * SAMPLE_ROWS)
        for kind in KINDS])
    return rows.select("id", "text").join(F.broadcast(chosen.select("id", "good", "kind")), "id")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``score_documents`` rejects, in their own columns."""
    scored = score_documents(docs, labels, id_col, text_col, **options).where("keep")
    return keep_rows(docs, scored.select(F.col(id_col).alias("id"), "row_key").distinct(), id_col, text_col)
