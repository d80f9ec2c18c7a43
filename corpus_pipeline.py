"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import byte_bpe, decontaminate, near_copies, ppm_language, secret_scan
from refloom.llm.common import table, temporary, tidied

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts that are null or have no letter go. The model is fitted on a bounded sample of docs itself; where docs name no
    language that could be learned, no text is rejected for that."""
    names = docs.columns
    model = ppm_language.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(ppm_language.LETTER))
    rows = docs.select("doc_id", "text", F.struct(*(F.col(n) for n in names)).alias("_row"))
    found = ppm_language.identify(rows, model, carry=("_row",))
    return found.where(F.col("lang_pred") != ppm_language.UNDETERMINED).select(*(F.col("_row")[n].alias(n) for n in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, once. Rows without an id can't be named as copies and stay.

    Near-duplicates share 0.8 of their five-word shingles: operator 9's anchors propose pairs, bands those that lie beyond its reach, and the whole sets decide.
    Rows with one id are the same document only if their shingles are the same too; of those the first by text stays.
    """
    rows = near_copies.grouped(docs)
    node, least = F.col(near_copies.NODE), F.col(near_copies.LEAST)
    kept = rows.where((F.col("doc_id") == least["id"]) & (node == least[near_copies.NODE]))
    row = F.struct(*(F.col(n) for n in docs.columns))
    first = F.min_by(row, F.struct("text", F.to_json(row))).alias("_row")
    kept = kept.groupBy("doc_id", near_copies.NODE).agg(first)
    return kept.select(*(F.col("_row")[n].alias(n) for n in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mask; n_chars follows the text."""
    done = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number and digest, and the digest of what they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, offsets=False, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", tidied(identify_language)),
    ("simhash_near_dedup", tidied(drop_near_duplicates)),
    ("benchmark_decontamination", tidied(drop_benchmark_leaks)),
    ("secret_scans", tidied(redact_secrets)),
    ("byte_bpe", tidied(tokenize)),
]

#: The models and hashes have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
