"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of `documents`, the last one row per packed piece with its token ids. No stage changes its input, an
empty table passes every stage empty, and columns with other names than those of `documents` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltlake.llm import checks, digest_index, language_id, pattern_packing, secret_scan, simhash
from voltlake.llm.common import saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, empty ones and texts without a letter. A missing `lang` is filled
    with the model's prediction, a given one stays; rows that repeat share their fate."""
    return language_id.recognised(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty are equal) the row with the largest doc_id stays, once where it repeats; a text
    whose rows all lack an id keeps one of them."""
    return digest_index.distinct_documents(docs, digest_index.new_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts that links of at most three differing bits connect, the one with the least doc_id stays; texts
    without a word have fingerprint zero and are linked with each other and all within three bits of it."""
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in their text is replaced by a mark and n_chars follows. Null and empty texts
    stay as they are, rows that repeat change alike."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its ids and its place in a sequence of at most 2048 tokens. Null counts as
    empty, whose one token is the end; rows that repeat are packed as often as they come."""
    return pattern_packing.packed(docs, checks.vocabulary("word_bpe_49k.json"), with_ids=True, cache=300_000)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The language model, XXH64 and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
