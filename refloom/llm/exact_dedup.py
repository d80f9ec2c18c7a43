"""Operator 12: exact deduplication by composable polynomial fingerprints, each equality confirmed chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import cut, small_batches, spread_join, text_slices, whole

#: Bytes of a chunk. A longer text is cut, and its chunks are hashed by different tasks.
CHUNK_BYTES = 1 << 20
#: The prime modulus of all lanes, and the base of each: products of a byte and a power stay far below 64 bits.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_540_483_477, 1_812_433_253, 1_664_525_013)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = [f"f{k}" for k in range(len(BASES))]
#: Groups of copies up to which their fingerprints are broadcast; beyond, both sides are shuffled.
BROADCAST_GROUPS = 200_000


@cache
def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base ** (n - 1) ... base ** 0 modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[len(out) - n :]


def polynomial(data: np.ndarray, base: int, prime: int = PRIME, chunk: int = CHUNK_BYTES) -> int:
    """The fingerprint of up to `chunk` bytes: the sum of (byte + 1) * base ** (bytes after it), modulo the prime."""
    powers = _powers(base, chunk, prime)
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), powers[len(powers) - len(data) :])) % prime


def shifted(fingerprint: int, after: int, base: int, prime: int = PRIME) -> int:
    """A part's share in the fingerprint of a whole that has `after` more bytes: shares add up modulo the prime."""
    return fingerprint * pow(base, after, prime) % prime


def fingerprinted(pieces: DataFrame, prime: int = PRIME, chunk: int = CHUNK_BYTES, data: bool = False) -> DataFrame:
    """Adds each piece's share in its text's fingerprint. pieces: key, n_bytes, no, sha, data (binary, the piece number `no` of the text's chunks).

    Returns key, n_bytes, no, sha, the lanes, and data where it is wanted.
    """
    kept = ["key", "n_bytes", "no", "sha"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, raw in text_slices(batches, "data"):
            ends = np.minimum((rows.column(2).to_numpy() + 1) * chunk, rows.column(1).to_numpy())
            after = (rows.column(1).to_numpy() - ends).tolist()
            parts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            lanes = [pa.array([shifted(polynomial(x, base, prime, chunk), n, base, prime) for x, n in zip(parts, after, strict=True)], pa.int64()) for base in BASES]
            more = [rows.column(4)] if data else []
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(4)), *lanes, *more], [*kept, *LANES, *(["data"] if data else [])])

    lanes = ", ".join(f"{c} long" for c in LANES)
    return pieces.select(*kept, "data").mapInArrow(work, f"key long, n_bytes long, no int, sha string, {lanes}" + ", data binary" * data)


def _pieces(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts (columns id, text) as chunks, normalised: those of one chunk, with the id as key, and those of several, written with a row number as key."""
    text = F.translate("text", UPPER, LOWER)
    size = F.octet_length("text").cast("long")  # lower-casing A to Z keeps it
    one = docs.where(size <= chunk).select(F.col("id").alias("key"), size.alias("n_bytes"), F.lit(0).alias("no"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("data"))
    long = docs.where(size > chunk).select("id", F.monotonically_increasing_id().alias("key"), size.alias("n_bytes"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("all"))
    cuts = F.transform(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {chunk} AS int)")), lambda k: F.substring("all", k * chunk + 1, F.lit(chunk)))
    several = long.select("id", "key", "n_bytes", "sha", F.posexplode(cuts).alias("no", "data"))  # numbered before it is cut, or each chunk had its own
    return one, cut(several)


def fingerprints(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all texts (columns id, text; no null text), and their chunks.

    Returns (texts, chunks). texts: row, id, n_bytes, sha, lanes; written. chunks: n_bytes, lanes of the whole text, no, data.
    A text of several chunks is spread over tasks by chunk; a sum of shares composes its fingerprint.
    """
    one, several = _pieces(docs, chunk)
    spread = several.repartition("key", "no")
    sums = [F.pmod(F.sum(c), F.lit(prime)).alias(c) for c in LANES]
    names = several.where("no = 0").select("key", "id")
    whole_texts = cut(fingerprinted(spread, prime, chunk).groupBy("key").agg(F.max("n_bytes").alias("n_bytes"), F.max("sha").alias("sha"), *sums).join(names, "key"))
    texts = fingerprinted(one, prime, chunk).select(F.col("key").alias("id"), "n_bytes", "sha", *LANES).unionByName(whole_texts.select("id", "n_bytes", "sha", *LANES))
    chunks = fingerprinted(one, prime, chunk, data=True).select("n_bytes", *LANES, "no", "data")
    chunks = chunks.unionByName(several.select("key", "no", "data").join(whole_texts.select("key", "n_bytes", *LANES), "key").select("n_bytes", *LANES, "no", "data"))
    return cut(texts.withColumn("row", F.monotonically_increasing_id())), chunks


def _repeated(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have: n (rows), last (id and row of the one that stays). Written."""
    last = F.max(F.struct("id", "row")).alias("last")
    return cut(texts.groupBy(*keys).agg(F.count("*").alias("n"), last).where("n > 1"))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """rows with their group's columns: by broadcast while groups are few, else by a shuffle that broadcasts the large groups alone."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups.drop("n")), keys, how)
    return spread_join(rows, groups, keys, "n", total, how)


def unequal(chunks: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Fingerprints (keys) of groups that hold different texts.

    Chunks of one place in texts with one fingerprint are all equal if the least is the greatest. Both are found in one sorted pass over what a task
    has, so of a group's copies in a task two chunks at most travel, and no task holds a group.
    """
    same = _joined(chunks, groups.select(*keys, "n"), keys, total, "inner")
    bounds = same.groupBy(*keys, "no").agg(F.min("data").alias("least"), F.max("data").alias("most"))
    return bounds.where("least <> most").select(*keys).distinct()


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK_BYTES, prime: int = PRIME) -> DataFrame:
    """Every row's id_column, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text).

    Texts are equal when identical after lower-casing A to Z; null counts as empty. Of equal texts the row with the largest id stays (a null id is less than
    any); of rows that share this id, too, one stays. An empty table gives no rows.

    1. Each text has a length and four fingerprints modulo a prime. Those of long texts are composed: chunks are hashed in parallel, and a chunk's share is its
       fingerprint times the base to the number of bytes after it.
    2. Fingerprints are counted with partial sums; a text without an equal one needs nothing more.
    3. The texts of a group are compared chunk by chunk. Groups that hold different texts are divided by SHA-256, which the result has anyway.

    A smaller prime makes collisions likely and results no less right. SHA-256 reads a text in one task, as its definition asks.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    texts, chunks = fingerprints(source, prime, chunk)
    keys = ["n_bytes", *LANES]
    total = max(texts.count(), 1)
    groups = _repeated(texts, keys)
    mixed = cut(unequal(chunks, groups, keys, total))
    if not mixed.isEmpty():  # a collision: as rare as the prime makes it
        part = F.when(F.col("mixed"), F.col("sha")).otherwise("")
        marked = _joined(texts, groups.join(mixed.withColumn("mixed", F.lit(True)), keys, "left").select(*keys, "n", F.coalesce("mixed", F.lit(False)).alias("mixed")), keys, total, "left")
        texts, keys = marked.withColumn("part", F.coalesce(part, F.lit(""))).drop("mixed"), [*keys, "part"]
        groups = _repeated(texts, keys)
    found = _joined(texts, groups.withColumn("size", F.col("n")), keys, total, "left")
    keep_id = F.when(F.col("last").isNull(), F.col("id")).otherwise(F.col("last.id"))
    stays = F.coalesce(F.col("last.row") == F.col("row"), F.lit(True))
    return found.select(F.col("id").alias(id_column), keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"))
