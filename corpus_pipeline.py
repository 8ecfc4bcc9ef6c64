"""Training-corpus pipeline over the ``documents`` table.

Stages, each over all its predecessor kept, each written as parquet and read
again by the next:

1. ``language_id``: documents in which no language can be told go: NULL texts,
   texts without a letter, and texts no closer to their language than their own
   letters in any order are (random letters, a word over and over).
2. ``simhash_dedup``: of each near-duplicate component one document stays, that
   of the smallest id.
3. ``secret_scan``: secrets are replaced by a mask; documents stay. ``n_chars``
   follows the text.
4. ``packing``: the pieces of all documents in sequences of 2048 tokens.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm import language_id, packing, secrets, simhash
from gustline.llm.common import col, stage_in, table, unstage
from gustline.llm.queries import SEQUENCE_TOKENS, WORD_VOCAB


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    profiles = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.recognised(docs, profiles)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    scanned = secrets.scan(docs)
    masked = secrets.redact(scanned.withColumn("_hit", F.size("secrets") > 0))
    chars = F.when(F.col("_hit"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.select(*[chars.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    pieces = packing.pack(docs, WORD_VOCAB, SEQUENCE_TOKENS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [
    ("language_id", identify_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# Learned profiles, SimHash components and token ids have no SQL form: tested
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is removed once the next one's
    has been written; that of the last but one stays for the result."""
    docs, earlier = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        folder = f"pipeline-{name}-{uuid.uuid4().hex}"
        docs = stage_in(step(spark, docs, sf_dir), folder)
        if earlier:
            unstage(spark, earlier)
        earlier = folder
    return STAGES[-1][1](spark, docs, sf_dir)
