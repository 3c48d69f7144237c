"""Exact duplicates by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.llm.tables import fresh

SALTS = 32


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null counts as empty.

    Pure ASCII takes the built-in lower(), which does the same there and is faster.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest
    id stays. Three stages compare full contents: the map side of the first aggregation folds the
    copies in each task, its reduce side folds the copies that share digest and salt, and a window
    combines the at most ``salts`` winners of every content. Rows then look their content up by
    digest and salt, without their text; two contents under one SHA-256 would fail the job rather
    than mix.

    Null text counts as empty and equals other empty texts. A null id never beats another id; a
    group of null ids only keeps null. Repeated ids each get a row; all rows with the kept id are
    ``kept``. Other columns are ignored; an empty table gives no rows.
    """
    normal = ascii_lower(F.col(text_col))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), salt.alias("_salt"), normal.alias("_text"))
    digest = F.unhex(F.sha2("_text", 256))

    salted = rows.select("*", digest.alias("_digest")).groupBy("_digest", "_salt", "_text").agg(
        F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_copies"))
    content = W.partitionBy("_digest", "_text")
    combined = salted.select(
        "_digest", "_salt",
        F.max("_best").over(content).alias("keep_id"),
        F.sum("_copies").over(content).alias("group_size"),
        F.row_number().over(content.orderBy("_salt")).alias("_place"))
    one_content = W.partitionBy("_digest")
    winners = combined.withColumn(
        "_contents", F.sum((F.col("_place") == 1).cast("int")).over(one_content)
    ).select(
        "_digest", "_salt", "keep_id",
        F.when(F.col("_contents") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two contents share a SHA-256 digest"))).alias("group_size"))

    members = rows.select("_id", "_salt", digest.alias("_digest"))
    return members.join(winners, ["_digest", "_salt"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per content, the one with the largest id, in its own columns.

    Rows that repeat both id and content are one row: the copies are folded on (id, digest).
    """
    best = duplicate_classes(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("keep_id"), "text_sha256").distinct()
    digest, copy = fresh(docs, "_digest", "_copy")
    marked = docs.withColumn(digest, F.sha2(ascii_lower(F.col(text_col)), 256))
    kept = marked.join(
        best, marked[id_col].eqNullSafe(best["keep_id"]) & (marked[digest] == best["text_sha256"]), "left_semi")
    copies = W.partitionBy(id_col, digest).orderBy(text_col)
    return kept.withColumn(copy, F.row_number().over(copies)).where(F.col(copy) == 1).drop(digest, copy)
