"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` writes
every stage's result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.llm import exact_dedup, ngram_join, packing, quality, sanitise
from bazaarflow.llm.queries import table, tokenizer_path
from bazaarflow.session import materialise

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and disclosing terms; n_chars follows the new text."""
    return sanitise.sanitise(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 1024 tokens, one row per piece."""
    return packing.pack(
        docs, tokenizer_path("byte_bpe_50k.json"), ranks_path=tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", sanitise_texts),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # classifier, near duplicates, sanitising and packing are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{number}")
    return docs
