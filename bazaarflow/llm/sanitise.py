"""Personal data: pattern spans, and terms that disclose a protected value.

The protected entities are the values found by pattern. A term's disclosure of an entity is
estimated from the corpus: PMI(term, entity) over the entity's information content, that is the
share of the entity's information that a reader gets from the term alone. Terms over one threshold
are generalised, over a higher one removed, wherever they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.llm.graph import bit_filter, in_filter
from bazaarflow.llm.tables import fresh, releasing, text_key
from bazaarflow.llm.words import SMALL_CHUNK, Words, chunks, find_words, text_bytes, word_hashes
from bazaarflow.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.8, 0.95
SUPPORT = 3
REACH = 8
ALIKE = 0.75
SALTS = 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ can only match with the whole run of local characters before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every email, ip, card and phone, by start and kind.

    Each kind's matches are leftmost and do not overlap; a match that fails its check is dropped.
    """
    spans = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:" + (re.sub("[^0-9]", "", value) if kind in (2, 3) else value.lower())


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words without the ASCII punctuation around them."""
    words = find_words(data, offsets, lower=True)
    starts, ends = words.starts.copy(), words.ends.copy()
    while (loose := np.flatnonzero((starts < ends) & _PUNCTUATION[words.data[np.minimum(starts, len(words.data) - 1)]])).size:
        starts[loose] += 1
    while (loose := np.flatnonzero((starts < ends) & _PUNCTUATION[words.data[ends - 1]])).size:
        ends[loose] -= 1
    return words._replace(starts=starts, ends=ends)


def _is_term(words: Words) -> np.ndarray:
    """Terms have at least four bytes and begin with a letter."""
    first = words.data[np.minimum(words.starts, max(len(words.data) - 1, 0))] if len(words.data) else words.data
    return (words.ends - words.starts >= 4) & ((first >= 97) & (first <= 122) | (first >= 128))


def _neighbours(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Per span with terms nearby: entity, a hash of its surroundings, and the hashes of their words and terms."""
    found = []
    for start, kind, end in spans:
        before, after = text[max(0, start - 40 * REACH):start], text[end:end + 40 * REACH]
        around = [*before.split()[-REACH:], *after.split()[:REACH]]
        if not around:
            continue
        column = pa.array([" ".join(around)])
        words = terms_of(*text_bytes(column))
        context = int.from_bytes(hashlib.blake2b(" ".join(around).encode(), digest_size=8).digest(), "little", signed=True)
        hashes = word_hashes(words)
        terms = np.unique(hashes[_is_term(words)]).view(np.int64)
        if terms.size:
            found.append({
                "entity": _entity(kind, text[start:end]), "context": context,
                "around": np.unique(hashes).view(np.int64), "terms": terms})
    return found


def scan_patterns(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, key, text): its pattern spans, their digest and the terms around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_type = pa.list_(pa.struct([
            ("entity", pa.string()), ("context", pa.int64()), ("around", pa.list_(pa.int64())),
            ("terms", pa.list_(pa.int64()))]))
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            counts, spans_out, base, digest, near = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                spans = pattern_spans(text)
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                spans_out.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                base.append(_as_text(spans))
                digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
                near.append(_neighbours(text, spans))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)],
                pa.array(digest, pa.string()), pa.array(base, pa.string()),
                pa.array(spans_out, span_type), pa.array(near, near_type)],
                ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found", "near"])

    return docs.mapInArrow(releasing(run), (
        "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "base string, found array<struct<start:long,kind:int,end:long>>, "
        "near array<struct<entity:string,context:long,around:array<long>,terms:array<long>>>"))


def _found_terms(
    column: pa.Array, bits: np.ndarray,
) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts, their terms and hashes, which of them pass the filter, and in which text."""
    data, offsets = text_bytes(column)
    words = terms_of(data, offsets)
    hashes = word_hashes(words)
    at = np.flatnonzero(in_filter(bits, hashes) & _is_term(words))
    return data, words, hashes, at, np.searchsorted(words.first, at, "right") - 1


def _document_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(term, n_term): in how many documents each term that passes the filter stands.

    Tasks add up their own documents first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                _, _, hashes, at, doc = _found_terms(part.column(2), bits)
                found = hashes[at].view(np.int64)
                order = np.lexsort((found, doc))
                found, doc = found[order], doc[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                terms, times = np.unique(found[new], return_counts=True)
                total.update(dict(zip(terms.tolist(), times.tolist())))
            if len(total) > 200_000:
                yield _counted(total)
                total = Counter()
        yield _counted(total)

    return _readable(docs, bits).mapInArrow(releasing(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _readable(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Nothing passes an empty filter, so no text needs to be read for it."""
    return docs if bits.any() else docs.where(F.lit(False))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["term", "n"])


def _occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, key, term, spans) of the terms that pass the filter, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                data, words, hashes, at, doc = _found_terms(part.column(2), bits)
                if not at.size:
                    continue
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                offsets = words.offsets
                frame = pd.DataFrame({
                    "doc": doc, "term": hashes[at].view(np.int64),
                    "start": points[words.starts[at]] - points[offsets[doc]],
                    "end": points[words.ends[at]] - points[offsets[doc]]})
                groups = frame.groupby(["doc", "term"], sort=False).agg(list).reset_index()
                keys = part.take(pa.array(groups["doc"]))
                yield pa.RecordBatch.from_arrays([
                    keys.column(0), keys.column(1), pa.array(groups["term"], pa.int64()),
                    pa.array(groups["start"].tolist(), pa.list_(pa.int64())),
                    pa.array(groups["end"].tolist(), pa.list_(pa.int64()))],
                    ["doc_id", "key", "term", "starts", "ends"])

    return _readable(docs, bits).mapInArrow(releasing(run), "doc_id long, key long, term long, starts array<long>, ends array<long>")


def _surroundings(scan: DataFrame) -> DataFrame:
    """(entity, context, around, terms): every different surrounding of an entity once."""
    return scan.select(F.explode("near").alias("x")).select("x.*").groupBy("entity", "context").agg(
        F.min_by(F.struct("around", "terms"), F.struct("around", "terms")).alias("x")).select(
        "entity", "context", "x.around", "x.terms")


def _candidates(surroundings: DataFrame, support: int) -> DataFrame:
    """(entity, term) pairs that stand together in ``support`` surroundings, near copies counted."""
    return surroundings.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support).select("entity", "term")


def _alike(a: frozenset[int], b: frozenset[int]) -> bool:
    """Near copies share more than ALIKE of the words of the larger one."""
    return len(a & b) > ALIKE * max(len(a), len(b))


def _apart(support: int, last: bool):
    """Of each run of rows with one (entity, term, salt): up to ``support`` rows no two of which are alike.

    Rows come sorted, so only the rows kept of one run are held. The ``last`` time the salt is not part of
    the run, and one row is left of a run that has ``support`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            entity, term, salt = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for row, key in enumerate(zip(entity, term, [0] * len(salt) if last else salt)):
                if key != now:
                    now, kept = key, []
                if len(kept) == support:
                    continue
                around = frozenset(batch.column(4)[row].as_py())
                if any(_alike(around, other) for other in kept):
                    continue
                kept.append(around)
                if not last or len(kept) == support:
                    out.append(row)
            yield batch.take(pa.array(out, pa.int64()))

    return run


def _independent(surroundings: DataFrame, pairs: DataFrame, support: int) -> DataFrame:
    """The (entity, term) pairs with ``support`` surroundings no two of which are near copies.

    Copies of one passage with small changes are no independent evidence, so they count once. The
    surroundings of a pair are first thinned in SALTS parts by their hash.
    """
    parts = int(surroundings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "entity string, term long, salt int, context long, around array<long>"
    rows = surroundings.select("entity", F.explode("terms").alias("term"), "context", "around").join(
        pairs.select("entity", "term"), ["entity", "term"], "left_semi").select(
        "entity", "term", F.pmod("context", F.lit(SALTS)).cast("int").alias("salt"), "context", "around")
    order = ["entity", "term", "salt", "context"]
    thinned = rows.repartition(parts, "entity", "term", "salt").sortWithinPartitions(*order).mapInArrow(
        releasing(_apart(support, False)), kind)
    found = thinned.repartition(parts, "entity", "term").sortWithinPartitions(*order).mapInArrow(
        releasing(_apart(support, True)), kind)
    return found.select("entity", "term")


def term_disclosure(scan: DataFrame, counts: DataFrame, near: DataFrame) -> DataFrame:
    """(entity, term, disclosure): the share of the entity's information that the term gives, for the pairs ``near``.

    Counts are documents; N is all of them. An entity in every document has no information.
    """
    total = scan.agg(F.count(F.lit(1)).alias("n"))
    entity = scan.select("doc_id", "key", F.explode(F.array_distinct("near.entity")).alias("entity")).groupBy(
        "entity").agg(F.count(F.lit(1)).alias("n_entity"))
    both = scan.select("doc_id", "key", F.explode(F.array_distinct(F.flatten(F.transform(
        "near", lambda x: F.transform(x["terms"], lambda t: F.struct(
            x["entity"].alias("entity"), t.alias("term"))))))).alias("p")).groupBy("p.entity", "p.term").agg(
        F.count(F.lit(1)).alias("n_both"))
    scored = near.join(both, ["entity", "term"]).join(entity, "entity").join(counts, "term").join(F.broadcast(total))
    pmi = F.log2(F.col("n") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    information = F.log2(F.col("n") / F.col("n_entity"))
    return scored.where("n > n_entity").select("entity", "term", (pmi / information).alias("disclosure"))


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), text.alias("text"))


def _term_spans(rows: DataFrame, scan: DataFrame, support: int, generalise: float) -> DataFrame:
    """(doc_id, key, terms): start, end and disclosure of the terms over the threshold."""
    surroundings = _surroundings(scan)
    near = materialise(_candidates(surroundings, support), "pii-near")
    counts = _document_counts(rows, bit_filter(near, "term"))
    pairs = materialise(
        term_disclosure(scan, counts, near).where(F.col("disclosure") >= generalise), "pii-pairs")
    risky = materialise(pairs.join(_independent(surroundings, pairs, support), ["entity", "term"]).groupBy("term").agg(
        F.max("disclosure").alias("disclosure")), "pii-terms")
    hits = _occurrences(rows, bit_filter(risky, "term"))
    return hits.join(risky, "term").select(
        "doc_id", "key", "disclosure", F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy(
        "doc_id", "key").agg(F.sort_array(F.collect_set(F.struct(
            F.col("s.starts").alias("start"), F.col("s.ends").alias("end"), "disclosure"))).alias("terms"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
    generalise: float = GENERALISE,
) -> DataFrame:
    """One row per input row: pattern counts, ``base_sha256`` of the pattern spans, and all ``spans``.

    A term is looked at when it stands within REACH words of one entity in at least ``support``
    surroundings that are not near copies (see ``_independent``); it is a span where its disclosure
    reaches ``generalise``. Offsets are code points. Null text is empty and has no
    spans; ids may be null or repeated (equal rows have equal results); other columns are ignored;
    an empty table gives no rows.
    """
    rows = _with_key(docs, id_col, text_col)
    scan = materialise(scan_patterns(rows), "pii-scan")
    terms = _term_spans(rows, scan, support, generalise)
    joined = scan.join(terms, _same_row(scan, terms), "left").select(
        scan["doc_id"], "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found", "terms")
    extra = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    every = F.array_sort(F.concat("found", extra))
    names = F.array(*[F.lit(k) for k in KINDS])
    merged = F.array_join(F.transform(every, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return joined.select(
        F.col("doc_id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("terms").isNull(), F.col("base")).otherwise(merged).alias("spans"))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """``docs`` with pattern spans replaced by their kind, and disclosing terms generalised to
    ``[TERM]`` or, from ``remove`` on, taken out. Other columns stay; null text stays null."""
    rows = _with_key(docs, id_col, text_col)
    scan = materialise(scan_patterns(rows), "pii-scan")
    id_, key_, marks, key = fresh(docs, "_id", "_key", "_terms", "_row")
    terms = _term_spans(rows, scan, support, generalise).select(
        F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("terms").alias(marks))
    keyed = docs.withColumn(key, text_key(text_col))
    same = keyed[id_col].cast("long").eqNullSafe(terms[id_]) & (keyed[key] == terms[key_])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([_replace(t, m, remove) for t, m in zip(texts, found)], dtype=object)

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return releasing(run)(batches)

    return keyed.join(terms, same, "left").withColumn(
        text_col, replaced(F.col(text_col), F.col(marks))).select(*docs.columns)


def _replace(text: str | None, terms, remove: float) -> str | None:
    if text is None:
        return None
    spans = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in pattern_spans(text)]
    if terms is not None:
        spans += [(t["start"], t["end"], "" if t["disclosure"] >= remove else "[TERM]") for t in terms]
    if not spans:
        return text
    out, at = [], 0
    for start, end, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start < at:
            if end > at:  # the rest of an overlapping span goes with the one before
                at = end
            continue
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])
