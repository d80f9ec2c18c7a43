"""Substring, suffix and SimHash deduplication against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import bwt, common, lz_dedup, simhash, suffix_dedup


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def windows_removed(texts, window):
    """Words left of each row: those that no window covers which also starts in a row with a smaller id."""
    first = {}
    for i, t in texts:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = Counter()
    for i, t in texts:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize(("window", "anchor"), [(50, 16), (12, 5)])
def test_lz_dedup(docs, texts, window, anchor):
    found = lz_dedup.deduplicate(docs, window, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in found) == windows_removed(texts, window)


def test_factors_are_matches_with_their_sources(docs, texts):
    """Each factor stands word by word at its place in a source with a smaller id; factors don't overlap and cover all that is removed."""
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(split(t))
    n = 0
    for r in lz_dedup.deduplicate(docs, 12, 5).collect():
        own = next((w for w in by[r.doc_id] if len(w) == r.n_words), [])
        for f in r.factors:
            n += 1
            assert f.source < r.doc_id and any(own[f.start : f.end] == w[f.place : f.place + f.end - f.start] for w in by[f.source])
        assert all(a.end <= b.start for a, b in zip(r.factors, r.factors[1:])) and sum(f.end - f.start for f in r.factors) == r.n_removed
    assert n > 20


def test_factors_go_on_over_block_edges():
    """Matches along one shift are one factor; from each position the one that reaches furthest goes on."""
    assert lz_dedup.greedy_factors([0, 30, 60], [50, 90, 110], [1, 1, 1], [5, 35, 65]) == [(0, 110, 1, 5)]
    assert lz_dedup.greedy_factors([0, 10, 40, 200], [50, 70, 95, 260], [1, 2, 3, 4], [0, 0, 7, 9]) == [(0, 50, 1, 0), (50, 95, 3, 17), (200, 260, 4, 9)]
    assert lz_dedup.greedy_factors([0, 0], [50, 80], [1, 2], [0, 3]) == [(0, 80, 2, 3)] and lz_dedup.greedy_factors([], [], [], []) == []


def test_lz_dedup_without_rows(no_docs):
    assert lz_dedup.deduplicate(no_docs).count() == 0


def test_same_id_with_other_texts(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (1, "y " + long), (2, long + " z")]
    found = lz_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in found) == {(1, 80, 0): 1, (1, 81, 0): 1, (2, 81, 80): 1}


def bytes_removed(texts, width):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = Counter()
    for (i, _), b in zip(texts, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    return out


@pytest.mark.parametrize(("width", "anchor", "part"), [(400, 100, 750_000), (400, 100, 2_000), (60, 20, 300)])
def test_suffix_dedup(docs, texts, width, anchor, part):
    """Small parts salt nearly all anchors, so that windows are compared between parts."""
    found = suffix_dedup.deduplicate(docs, width, anchor, part_bytes=part).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == bytes_removed(texts, width)


def test_suffix_dedup_without_rows(no_docs):
    assert suffix_dedup.deduplicate(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=6), st.integers(2, 9))
def test_repeated_windows(strings, width):
    raw = [s.encode() for s in strings]
    seen = Counter(s[k : k + width] for s in raw for k in range(len(s) - width + 1))
    starts, repeated, leader = bwt.repeated_windows(raw, width)
    for s, a in zip(raw, starts.tolist(), strict=True):
        assert [bool(x) for x in repeated[a : a + len(s)]] == [k <= len(s) - width and seen[s[k : k + width]] > 1 for k in range(len(s))]
    assert leader.sum() == sum(n > 1 for n in seen.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_window_minima(values, width):
    v = np.array(values, np.uint64)
    assert common.window_minima(v, width).tolist() == [k + int(v[k : k + width].argmin()) for k in range(len(v) - width + 1)]


def test_rolling_hashes_depend_on_the_run_alone():
    v = np.arange(50, dtype=np.uint64) % 7
    h = common.rolling(v, 5, lz_dedup.WINDOW_BASE)
    assert (h[:30] == h[7:37]).all() and len(set(h[:7].tolist())) == 7


def fingerprint(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(values, ids, threshold):
    """Smallest id of each row's component."""
    f = np.array(values, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= threshold
    label = np.array([np.inf if i is None else i for i in ids])
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            return [None if x == np.inf else int(x) for x in new]
        label = new


@pytest.mark.parametrize("threshold", [4, 2])
def test_simhash(docs, texts, threshold):
    values = [fingerprint(t) for _, t in texts]
    expected = Counter((i, v, c) for (i, _), v, c in zip(texts, values, joined(values, [i for i, _ in texts], threshold), strict=True))
    found = simhash.near_duplicates(docs, threshold=threshold).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == expected


def test_simhash_without_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize(("tile", "scheme", "clusters"), [(2048, None, 12), (8, None, 12), (2048, (5, 2), 12), (8, (6, 3), 12), (2048, None, 60), (2048, (6, 3), 60)])
def test_near_links_join_all_that_are_near(spark, tile, scheme, clusters):
    """Clusters around random centres, of two sizes and by all schemes; with small tiles every hot anchor is cut. All pairs within the threshold are joined."""
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(clusters):
        centre = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(40):
            x = centre
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_links(fps, 4, tile, scheme).collect()]
    assert all((a ^ b).bit_count() <= 12 for a, b in links)
    label = {x: x for x in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    expected = joined(values, range(len(values)), 4)
    assert [values.index(root(x)) for x in values] == expected


def test_schemes_leave_one_bit():
    """However up to four bits that differ fall into the blocks, some choice of blocks has one of them at most; larger tables get longer values."""
    from itertools import combinations_with_replacement

    for scheme in simhash.SCHEMES:
        wanted = simhash.choices(scheme)
        assert sorted(sum((list(range(s, s + w)) for s, w in {b for c in wanted for b in c}), [])) == list(range(64))
        for places in combinations_with_replacement(sorted({b for c in wanted for b in c}), 4):
            assert any(sum(p in c for p in places) <= 1 for c in wanted)
    sizes = [simhash.scheme_for(n) for n in (0, 10**4, 10**7, 10**9, 10**11)]
    assert sizes[0] == simhash.SCHEMES[0] and sizes[-1] == simhash.SCHEMES[-1] and sizes == sorted(sizes) and simhash.scheme_for(10**11, 5) == simhash.SCHEMES[0]


def test_anchors_cover_two_bits():
    values = np.arange(0, 1 << 17, 1237, dtype=np.int64)
    code = np.flatnonzero([not simhash_syndrome(v) for v in range(1 << 15)])
    for v, row in zip(values.tolist(), np.stack(simhash.anchors_of(values, 17)).T, strict=True):
        near = {int(c) | (h << 15) for h in range(4) for c in code if (int(c) ^ v & 0x7FFF).bit_count() + (h ^ v >> 15).bit_count() <= 2 and (h ^ v >> 15).bit_count() < 2}
        assert {int(x) for x in row if x >= 0} == near


def simhash_syndrome(v):
    s = 0
    for bit in range(15):
        if v >> bit & 1:
            s ^= bit + 1
    return s




def one_id(n):
    """n texts of id 0 and as many of other ids, with passages that some of them share; a few rows are repeated."""
    rng = np.random.default_rng(n)
    words = lambda k: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, k).tolist())
    passages = [words(30) for _ in range(6)]
    rows = [(0 if k % 2 else k, f"{words(9)} {passages[k % 6]} {words(k % 5)}") for k in range(n)]
    return [*rows, *rows[:4], (None, rows[1][1]), (None, rows[1][1])]


def test_rows_that_share_an_id(spark):
    """Each text of an id has its own plan; results equal brute force."""
    rows = one_id(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lz_dedup.deduplicate(docs, 20, 6).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in found) == windows_removed(rows, 20)
    found = suffix_dedup.deduplicate(docs, 100, 30, part_bytes=2000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == bytes_removed(rows, 100)


def test_plans_join_on_the_text_too(spark):
    """No join of either operator is on the id alone, so rows that share an id don't meet each other."""
    docs = spark.createDataFrame(one_id(20), "doc_id long, text string")
    for found in (lz_dedup.deduplicate(docs, 20, 6), suffix_dedup.deduplicate(docs, 100, 30)):
        plan = found._jdf.queryExecution().analyzed().toString()
        joins = [line for line in plan.splitlines() if re.search(r"Join .*\(id#", line)]
        assert joins and all("s1#" in line and "s2#" in line for line in joins)


def test_texts_longer_than_a_slice(spark):
    """A periodic text of several regions, a long one that repeats a passage of another, and one without repeats."""
    rng = np.random.default_rng(1)
    unique = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 330_000).tolist())
    passage = unique[2_000_000:2_001_000]
    rows = [(1, unique), (2, "short " + passage), (3, "ab " * 1_500_000)]
    assert min(len(rows[0][1]), len(rows[2][1])) > common.SLICE_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert [(found[k].n_removed, found[k].n_spans) for k in (1, 2, 3)] == [(1000, 1), (1000, 1), (4_500_000, 1)]
    found = {r.doc_id: r for r in lz_dedup.deduplicate(docs).collect()}
    kept = [w for w in passage.split(" ")[1:-1]]
    assert found[1].n_removed == 0 and found[3].n_removed == 0 and found[2].n_removed == len(kept) and found[2].n_words == len(passage.split(" ")) + 1
