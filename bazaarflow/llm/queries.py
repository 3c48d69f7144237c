"""The registered queries of the operators, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import (
    bpe, conversations, exact_dedup, language, nearest, negatives, ngram_join, packing, pitman_yor, quality,
    sanitise, substrings, token_files,
)
from bazaarflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(
        docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False,
        ranks_path=tokenizer_path("byte_bpe_50k.tiktoken")).drop("ids")


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.find_spans(table(spark, sf_dir, "documents"))


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_documents(docs, labels).drop("row_key")


@query()
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (
  SELECT doc_id, p AS i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows WHERE c = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM placed WHERE n > 1),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query(r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
runs AS (
  SELECT doc_id, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
shingles AS (
  SELECT DISTINCT doc_id, s FROM runs WHERE c = 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r
  FROM shingles JOIN sized USING (doc_id) JOIN (SELECT s, count(*) AS df FROM shingles GROUP BY s) USING (s)),
prefixes AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - (90 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
  FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
links AS (
  SELECT x, y FROM pairs JOIN shingles a ON a.doc_id = x JOIN shingles b ON b.doc_id = y AND b.s = a.s
  GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 90 * (nx + ny - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN sized USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
""")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90).drop("row_key")


@query()
def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, out, keep_ids=False).drop("ids")


@query(r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k
  FROM conversations),
bits AS (SELECT range AS byte, range AS c FROM range(256)),
crc_steps(byte, c, n) AS (
  SELECT byte, c, 0 FROM bits
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_steps WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE n = 8),
hashed AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(unicode(x) AS bigint))),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS fate
  FROM given, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE fate <> 0),
rows AS (
  SELECT conv_id, turn, role, text, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS times
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
faults AS (
  SELECT *, left(role, 1) AS x, CASE WHEN core = '' THEN 'blank' WHEN times > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM rows),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
due(state, nxt, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts AS (
  SELECT state, state AS nxt, 0 AS cost, '' AS edits, '' AS put FROM due
  UNION ALL SELECT state, nxt, 2, 'I', name || ':' || chr(10) FROM due
  UNION ALL SELECT a.state, b.nxt, 4, 'II', a.name || ':' || chr(10) || b.name || ':' || chr(10) FROM due a JOIN due b ON b.state = a.nxt),
edits AS (
  SELECT conv_id, i, state, state AS nxt, 3 AS cost, 'D' AS edit, '' AS put FROM faults, due
  UNION ALL SELECT conv_id, i, state, nxt, 2 + CAST(fault = 'truncated' AS integer), 'R', name || ':' || text || chr(10)
    FROM faults, due WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, state, CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CAST(fault = 'truncated' AS integer), 'K',
    role || ':' || text || chr(10) FROM faults, due
    WHERE fault NOT IN ('blank', 'duplicate') AND ((x = 'u' AND nxt = 2) OR (x = 'a' AND nxt = 3) OR (x = 's' AND state = 0))),
labels(conv_id, i, state, b) AS (
  SELECT conv_id, 0, 0, {'cost': 0, 'audit': '', 'put': ''} FROM counted
  UNION ALL
  SELECT l.conv_id, l.i + 1, e.nxt, min({'cost': l.b.cost + s.cost + e.cost, 'audit': l.b.audit || s.edits || e.edit, 'put': l.b.put || s.put || e.put})
  FROM labels l JOIN inserts s ON s.state = l.state
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.i = l.i + 1 AND e.state = s.nxt
  GROUP BY l.conv_id, l.i, e.nxt),
best AS (
  SELECT l.conv_id, min({'cost': l.b.cost + s.cost, 'audit': l.b.audit || s.edits, 'put': l.b.put || s.put}) AS b
  FROM labels l JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.n = l.i JOIN inserts s ON s.state = l.state
  WHERE s.nxt IN (0, 3) GROUP BY l.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS bigint) AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(CASE WHEN b.put = '' THEN '' ELSE left(b.put, length(b.put) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM g.conv_id
""")
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


@query("""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS bigint) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.x) = len(b.x) WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS integer) AS rank, s.id AS negative_id, positive_score,
  s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
