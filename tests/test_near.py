"""The index of strings that are alike, against all pairs."""

import difflib
import random
from collections import Counter

import pytest

from refloom.operators import near

THRESHOLDS = (0.45, 0.60, 0.80, 0.82, 0.85, 0.90, 0.92)


def misspelt(rng, text, n):
    letters = list(text)
    for _ in range(n):
        k = rng.randrange(len(letters) + 1)
        new = rng.choice("가나다라마바사아자차") if rng.random() < 0.3 else rng.choice("abcdefgh ")
        letters[k : k + 1] = rng.choice([[new], [new, *letters[k : k + 1]], []])
    return "".join(letters)


def strings(rng):
    """Titles of every length, with typos, lost, added and moved words, Hangul, astral letters, repeats; some share most of their letters."""
    stock = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = ["", "a", "b", "ab", "ba", "aaaa", "aaaaaa", "aaaaaaaaaaaa", "abababababab", "x" * 260, "x" * 240 + "y" * 20, "𝔸𝔹ℂ 𝔻", "𝔸𝔹ℂ 𝔼"]
    for _ in range(45):
        words = rng.choices(stock, k=rng.randint(1, 9))
        korean = "".join(rng.choice("한국문학연구사회정책교육경제역사철학방법이론") for _ in range(rng.randint(2, 14)))
        base = rng.choice([" ".join(words), korean, f"{korean} {words[0]}"])
        out += [base, misspelt(rng, base, rng.randint(0, 4)), " ".join(base.split()[1:] + base.split()[:1]), base + rng.choice(["", " a", " of the new study"])]
    return out


@pytest.mark.parametrize("threshold", THRESHOLDS)
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(int(threshold * 100))
    texts = strings(rng)
    rows = spark.createDataFrame([*((k, 0, t) for k, t in enumerate(texts)), (-1, 0, None)], "id long, block int, text string").repartition(3)
    alike = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= threshold}
    for tile in (5, 1000):
        pairs = near.near_pairs(rows, rows, threshold, tile=tile).collect()
        found = {(r.l, r.r) for r in pairs}
        assert len(found) == len(pairs) and alike <= found
    if threshold >= 0.8:
        assert len(found) < len(texts) ** 2 / 3
    expected = {(texts[i], texts[j]): round(difflib.SequenceMatcher(None, texts[i], texts[j]).ratio(), 9) for i, j in alike}
    distinct = rows.where("text <> ''").selectExpr("cast(block AS string) AS block", "text").distinct()
    for plan in (near.by_grams(distinct, distinct, threshold, 7), near.by_tiles(distinct, distinct, threshold, 20), near.alike(rows, rows, threshold)):
        pairs = plan.collect()
        assert {(r.a, r.b): round(r.similarity, 9) for r in pairs} == expected and len(pairs) == len(expected)


def test_blocks_and_order(spark):
    rows = spark.createDataFrame([(k, k % 2, "the same title of a work") for k in range(6)], "id long, block int, text string")
    assert {(r.l, r.r) for r in near.near_pairs(rows, rows, 0.9).where("l < r").collect()} == {(0, 2), (0, 4), (2, 4), (1, 3), (1, 5), (3, 5)}
    assert [(r.block, r.similarity) for r in near.alike(rows, rows, 0.9).orderBy("block").collect()] == [("0", 1.0), ("1", 1.0)]
    assert near.alike(rows.limit(0), rows, 0.9).count() == near.alike(rows, rows.limit(0), 0.9).count() == 0
    assert near.near_pairs(rows.limit(0), rows, 0.9).count() == near.near_pairs(rows, rows.limit(0), 0.9).count() == 0


def test_bounds_hold():
    """What a pair shares is never less than the bound says, for grams of every length."""
    rng = random.Random(4)
    texts = [t for t in strings(rng) if t]
    for x, y in zip(texts, texts[1:], strict=False):
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        for q in range(1, 7):
            a, b = (Counter(s[k : k + q] for k in range(len(s) - q + 1)) for s in (x, y))
            assert (a & b).total() >= near.least_shared(len(x) + len(y), q, ratio)


def test_grams_are_numbered():
    owner, gram = near.numbered_grams(["anan", "an", "", "nan"], 2)
    by = {k: {g for o, g in zip(owner.tolist(), gram.tolist(), strict=True) if o == k} for k in range(4)}
    assert [len(by[k]) for k in range(4)] == [3, 1, 0, 2] and by[1] < by[0] and by[3] < by[0]


def test_bounded_ratio(spark):
    rows = [("abcdef", "abcdxf"), ("abcdef", "zzzzzz"), ("", "a"), (None, "a"), ("x" * 300, "x" * 299)]
    frame = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    found = [r.s for r in frame.select(near.bounded_ratio(0.8)("a", "b").alias("s")).collect()]
    assert found == [difflib.SequenceMatcher(None, x or "", y).ratio() if x and difflib.SequenceMatcher(None, x, y).ratio() >= 0.8 else 0.0 for x, y in rows]


def test_common_subsequences_bound_the_similarity():
    """Their length is that of the plain table, and no similarity is beyond it."""
    rng = random.Random(7)
    texts = [t for t in strings(rng) if len(t) < 80]
    comparer = near.Comparer()
    for x, y in zip(texts, texts[2:], strict=False):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for k, d in enumerate(y):
                last, row[k + 1] = row[k + 1], last + 1 if c == d else max(row[k], row[k + 1])
        comparer.against(y)
        assert comparer.common(x) == row[-1]
        ratio = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        assert comparer.score(x, 1e-9) == ratio and comparer.score(x, ratio + 1e-9) == 0.0


@pytest.mark.parametrize("threshold", THRESHOLDS)
def test_rows_of_bits_lose_no_pair(threshold, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 0)
    for chunk, columns in ((64, 4096), (64, 50)):
        monkeypatch.setattr(near, "CHUNK", chunk)
        monkeypatch.setattr(near, "COLUMNS", columns)
        texts = strings(random.Random(7))
        rows, found = near.screened(texts, texts, threshold)
        alike = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= threshold}
        assert alike <= set(zip(rows.tolist(), columns_of := found.tolist(), strict=True)) and len(columns_of) < len(texts) ** 2


def test_random_letters_are_screened():
    """Random hexadecimal titles share letters and pairs of them; few pairs are left to compare all the same."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(600)]
    rows, found = near.screened(texts[:300], texts[300:], 0.8)
    assert len(rows) < 20
    near_one = texts[0][:10] + "z" + texts[0][11:40] + texts[0][45:]
    assert (0, 299) in set(zip(*(x.tolist() for x in near.screened(texts[:300], [*texts[301:], near_one], 0.8)), strict=True))


def test_nothing_asked_reads_nothing(spark):
    """Where no text is searched, the other side is not counted."""

    def broken(batches):
        raise ValueError("read")
        yield from batches

    none = spark.createDataFrame([("x", "")], "block string, text string")
    other = none.mapInArrow(broken, "block string, text string")
    assert near.alike(none, other, 0.9).count() == 0


def test_strings_that_hold_each_other_need_no_matching(monkeypatch):
    pairs = [("abcd", "xxabcdyy"), ("xxabcdyy", "abcd"), ("same", "same"), ("a" * 150, "b" * 3 + "a" * 150 + "ab" * 9)]
    expected = [difflib.SequenceMatcher(None, a, b, autojunk=junk).ratio() for a, b in pairs for junk in (True, False)]
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: 1 / 0)
    found = []
    for a, b in pairs:
        for junk in (True, False):
            comparer = near.Comparer(autojunk=junk)
            comparer.against(b)
            found.append(comparer.score(a, 0.1))
    assert found == expected


def test_popular_letters_still_count_where_they_are_left_out():
    a, b = "ab" * 20, "ab" * 150
    comparer = near.Comparer(autojunk=True)
    comparer.against(b)
    assert comparer.score(a, 0.01) == (r if (r := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.01 else 0.0)


def test_small_tiles_are_screened_by_letters_and_lose_no_pair():
    rnd = random.Random(3)
    left = ["".join(rnd.choice("abcd가나") for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    right = [t[:k] + rnd.choice("abz") + t[k:] for t in left for k in (0, 3)]
    for threshold in (0.45, 0.8, 0.92):
        kept = set(zip(*(x.tolist() for x in near.screened(left, right, threshold)), strict=True))
        assert kept >= {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold}
    few = near.screened(["0123456789abcdef" * 8, "가" * 128], ["0123456789abcdef" * 8, "z" * 128], 0.9)
    assert [x.tolist() for x in few] == [[0], [0]]


@pytest.mark.parametrize("threshold", THRESHOLDS)
def test_pairs_of_small_and_large_blocks_equal_all_pairs(spark, threshold, monkeypatch):
    """Copies, rows of equal number, null blocks, numbers and texts; blocks that go whole to a task and such as don't; few pairs and bits at a time."""
    monkeypatch.setattr(near, "PAIRS", 50)
    monkeypatch.setattr(near, "SIGNATURE", 64)
    rng = random.Random(11)
    stock = strings(rng)
    rows = [(rng.choice("aabcd"), rng.randrange(60), rng.choice(stock)) for _ in range(150)] + [("a", 61, "the same title of a work"), ("a", 62, "the same title of a work"), (None, 1, "x"), ("a", None, "x"), ("e", 1, None), ("f", 1, "alone")]
    expected = Counter()
    for block, l, x in rows:
        for other, r, y in rows:
            if block and block == other and None not in (l, r) and l < r and x and y and (s := difflib.SequenceMatcher(None, x, y).ratio()) >= threshold:
                expected[block, l, r, round(s, 9)] += 1
    frame = spark.createDataFrame(rows, "block string, number int, text string").repartition(3)
    for most in (0, 40, 1000):
        found = Counter((r.block, r.l, r.r, round(r.similarity, 9)) for r in near.later_pairs(frame, threshold, most).collect())
        assert found == expected


@pytest.mark.parametrize(("threshold", "lengths"), [(0.8, (64,)), (0.85, (63, 64, 65)), (0.93, (63, 64, 65, 70, 71))])
def test_pieces_lose_no_pair(threshold, lengths, monkeypatch):
    """Random and edited strings of several lengths, a few at a time; what is alike is met, and little else."""
    monkeypatch.setattr(near, "SMALL", 0)
    monkeypatch.setattr(near, "PIECED", 0)
    monkeypatch.setattr(near, "PIECE_TEXTS", 128)
    rng = random.Random(2)
    left = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (64, *lengths) for _ in range(60)]
    right = [misspelt(rng, t, rng.randint(0, 12)) for t in left] + ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(100)]
    right = [t for t in right if len(t) in lengths]
    used = []
    by_pieces = near._by_pieces
    monkeypatch.setattr(near, "_by_pieces", lambda *a: used.append(len(a[0])) or by_pieces(*a))
    found = set(zip(*(x.tolist() for x in near.screened(left, right, threshold)), strict=True))
    alike = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if difflib.SequenceMatcher(None, x, y).ratio() >= threshold}
    assert used and len(alike) > 20 and alike <= found and len(found) < 3 * len(alike)


def test_tiles_are_read_again_and_not_written_again(spark):
    """Many tiles: the pairs come from a product of rows that are whole tiles, so what is shuffled doesn't grow with the other side."""
    rows = spark.createDataFrame([("x", f"title {k * 7919 % 1000}") for k in range(120)], "block string, text string")
    pairs = near.by_tiles(rows, rows, 0.95, 50)
    assert "CartesianProduct" in pairs._jdf.queryExecution().executedPlan().toString()
    texts = {r.text for r in rows.collect()}
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in texts for b in texts if difflib.SequenceMatcher(None, a, b).ratio() >= 0.95}
