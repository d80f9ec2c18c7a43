"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from refloom.llm import near_copies
from tests.llm.conftest import sentence
from tests.llm.test_dedup import split


def five_words(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(sets):
    label = {s: n for n, s in enumerate(dict.fromkeys(sets))}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in combinations(list(label), 2):
            if alike(a, b):
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label
    return label


def kept_ids(rows):
    """Ids left by brute force: a row for each group, named by its smallest id, and all rows without an id."""
    label = groups([five_words(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            g = label[five_words(t)]
            least[g] = min(i, least.get(g, i))
    return Counter(least.values()) + Counter(i for i, _ in rows if i is None)


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = sentence(rng, 1)
    return " ".join(words)


def near_rows():
    """Copies with 0 to 6 words replaced, around the limit; a large group of copies of one text that are mostly unlike each other."""
    rng = random.Random(3)
    rows = []
    for n in (8, 40, 100, 300):
        for k in range(7):
            base = sentence(rng, n)
            rows += [base, edited(rng, base, min(k * n // 100 + 1, n))]
    base = sentence(rng, 150)
    rows += [base, *(edited(rng, base, 1 + k % 6) for k in range(80))]
    return list(enumerate(rows))


def test_stage_agrees_with_brute_force(spark, docs, texts):
    rows = near_rows()
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "")
    assert Counter(r.doc_id for r in found.collect()) == kept_ids(rows)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert Counter(r.doc_id for r in found.collect()) == kept_ids(texts)


def test_near_copies_beyond_a_few_bits_go(spark):
    """A pair at a likeness of over 0.8 whose SimHash fingerprints differ in more than four bits; and unlike texts with one id stay."""
    rng = random.Random(11)
    base = sentence(rng, 120)
    rows = [(1, base), (2, edited(rng, base, 2)), (3, sentence(rng, 30)), (3, sentence(rng, 30))]
    assert alike(*(five_words(t) for _, t in rows[:2]))
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 3]


def test_bands_meet():
    """Sets of random hashes at a likeness of 0.8: none of a thousand pairs is missed, and a band meets in 0.8 ** 4 of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (4, 8, 40, 400):
        sets = [rng.integers(0, 1 << 63, 5 * n // 4, np.uint64) for _ in range(500)]
        keys = near_copies.band_keys([s for x in sets for s in (x, x[: n])])
        same = keys[::2] == keys[1::2]
        assert same.any(axis=1).all() and abs(same.mean() - 0.8**4) < 0.03


def test_hot_shingles_in_tiles(spark, monkeypatch):
    """Prefix shingles that more sets have than a tile holds: the same pairs."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(40), rng.randint(4, 12))) for _ in range(60)]
    frame = spark.createDataFrame([(k, k, [x * 7919 for x in s]) for k, s in enumerate(sets)], "node long, label long, shingles array<long>")
    expected = {(i, j) for i, j in combinations(range(60), 2) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    for tile in (3, 2048):
        pairs = {(r.a, r.b) for r in near_copies.apart(frame, tile).collect()}
        assert expected <= pairs
        assert {(r.a, r.b) for r in near_copies.alike(near_copies.apart(frame, tile), frame.withColumn("shingles", F.sort_array("shingles"))).collect()} == expected


def test_sets_that_share_64_bits_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 5), (5, 7, 3)], f"doc_id long, {near_copies.NODE} long, {near_copies.CHECK} long")
    found = {r[0]: r[1] for r in near_copies.told_apart(rows).collect()}
    assert found[1] == found[2] == 7 and found[4] == 8 and len({found[1], found[3], found[5], found[4]}) == 4


def test_of_equal_ids_the_first_text_stays(spark):
    """Two texts with one id and one shingle set differ in letter case: which of them stays doesn't depend on the rows' order."""
    text = " ".join(f"WORD{k}" for k in range(20))
    rows = [(1, text, "b"), (1, text.lower(), "a"), (1, text.lower(), "c")]
    for order in (rows, rows[::-1]):
        found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3), "").collect()
        assert [(r.doc_id, r.text, r.source) for r in found] == [(1, text, "b")]
