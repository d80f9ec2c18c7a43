import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import exact_dedup
from refloom.llm.exact_dedup import BASES, PRIME, polynomial, shifted

LOWERED = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def plain(rows):
    """Sorted (id, keep_id, group_size, kept, sha) by a dictionary of whole texts; of rows that share id and text one stays."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWERED)].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def more(texts):
    long = "Long Text ÄÖ " * 300
    return [*texts, (200, "ABC é"), (201, "abc é"), (202, "abc É"), (203, long), (204, long.lower().replace("äö", "ÄÖ")), (205, long + "x"), (206, long[:-1] + "."), (207, "\x00"), (208, "\x00\x00")]


@pytest.mark.parametrize(("chunk", "prime"), [(1 << 20, PRIME), (64, PRIME), (64, 2), (1 << 20, 3)])
def test_equals_a_dictionary_of_texts(spark, docs, more, chunk, prime):
    """Texts of one and of many chunks; a tiny prime makes nearly all texts of one length collide."""
    extra = spark.createDataFrame([r for r in more if r[0] and r[0] >= 200], "doc_id long, text string")
    rows = docs.select("doc_id", "text", "n_bytes" if "n_bytes" in docs.columns else F.lit(1).alias("n_bytes"), F.lit("x").alias("key"), F.lit("x").alias("sha"))
    rows = rows.unionByName(extra, allowMissingColumns=True)
    assert rows_of(exact_dedup.deduplicate(rows, chunk=chunk, prime=prime)) == plain(more)


def test_collisions_are_found(spark):
    """Anagrams have one fingerprint modulo 2; the comparison of chunks tells them apart."""
    rows = [(k, "".join(x)) for k, x in enumerate(["abab", "baba", "abab", "aabb", "cccc", "abab"])]
    texts, chunks = exact_dedup.fingerprints(spark.createDataFrame(rows, "id long, text string"), prime=2)
    keys = ["n_bytes", *exact_dedup.LANES]
    groups = exact_dedup._repeated(texts, keys)
    assert exact_dedup.unequal(chunks, groups, keys, 6).count() >= 1
    assert rows_of(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), prime=2)) == plain(rows)


def test_shuffled_path_equals_the_broadcast_one(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    assert rows_of(exact_dedup.deduplicate(docs)) == plain(texts)


def test_shares_compose():
    data = np.frombuffer(np.random.default_rng(3).bytes(100_000), np.uint8)
    for base in BASES:
        expected = 0
        for x in data.tolist():
            expected = (expected * base + x + 1) % PRIME
        assert polynomial(data, base) == expected
        parts = np.split(data, [7, 40_000, 40_001, 99_999])
        after = np.cumsum([len(p) for p in parts[::-1]])[::-1] - [len(p) for p in parts]
        assert sum(shifted(polynomial(p, base), int(n), base) for p, n in zip(parts, after, strict=True)) % PRIME == expected


def test_huge_texts_and_one_hot_group(spark):
    """Texts over a slice and over a chunk, a third of all rows equal, an empty table."""
    huge = "aBcdefgh" * 700_000
    rows = [(k, "the same text") for k in range(200)] + [(200 + k, f"own {k}") for k in range(400)] + [(900, huge), (901, huge.lower()), (902, huge + "!"), (903, None), (904, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(exact_dedup.deduplicate(docs)) == plain(rows)
    assert rows_of(exact_dedup.deduplicate(docs.limit(0))) == []
