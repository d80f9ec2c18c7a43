"""Exact search of strings that are alike: all pairs whose sequence similarity reaches a threshold, without comparing all pairs.

The similarity of strings a and b is 2 M / S, with M matched characters in k matching runs and S characters in both. So at a similarity of t or more

* M >= t S / 2, and there are S - 2 M characters without a match, one at least between any two runs, so k <= 1 + S - 2 M;
* a run of n characters holds n - q + 1 substrings of length q (grams), so a and b share M - (q - 1) k grams, repeats counted, or more:
  shared >= S ((2 q - 1) t / 2 - (q - 1)) - (q - 1);
* a string is (2 - t) / t times as long as the other at most, so this is at least what S = 2 |a| / (2 - t) gives.

Grams are numbered (the second "an" of a string is another gram than its first), which makes a string a set. Two sets that share r members also share one among
the first n - r + 1 of either in any common order (a prefix filter); the rarest come first here. Longer grams are rarer, so a string is searched
with the longest grams that still must be shared; single characters always must, so no pair is lost. What meets is bounded again by where the first
common gram stands, and only then compared.

Where grams are not rare (short strings, few letters, low thresholds) most pairs share some, and a row for each costs more than the pair. Then tiles of both sides meet
in a task. There a gram is a row of bits, one for each text of the right side, and the rows of a text's grams are added up in binary, 64 pairs at a time: the sums count
what the text has in common with every other at most. Both ways find the same pairs; alike() takes the cheaper one.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.operators.shared import Written

#: Longest grams that are tried.
LONGEST = 6
#: Grams are counted in so many slots (a power of two) to order them; a coarse count costs work and not results.
SLOT_BITS = 18
#: Rows of a gram on either side that meet in one task; grams with more are cut into tiles.
TILE = 1000
#: Texts of the left and the right side in one tile, and the columns that their grams fall into.
TILE_TEXTS, COLUMNS = (16384, 65536), 4096
#: Texts of either side in a tile pair where there are enough of these for all cores.
LARGE_TILE = (131072, 65536)
#: Characters of a tile at most, but for a single text.
TILE_CHARACTERS = 1 << 25
#: Texts whose grams are numbered at a time.
CHUNK = 4096
#: Characters in a piece; pairs of a tile from which on pieces pay; the least score that leaves few pairs; texts of the right and of the left side that are scored at a time.
PIECE, PIECED, LEAST_SCORE, PIECE_TEXTS, PIECE_ROWS = 4, 1 << 29, 7, 16384, 16
#: Columns for runs of three letters, kinds of pieces that a table holds, letters that are told apart, and bits of a text's grams for pairs that pieces leave.
RUN_COLUMNS, PIECE_KINDS, PIECE_LETTERS, FINE_SIGNATURE = 8192, 1 << 16, 20_000, 2048
#: Pairs of a tile up to which a matrix product counts what they have in common, and its columns for pairs of letters and for letters.
SMALL, SMALL_COLUMNS, LETTER_COLUMNS = 4096, 2048, 128
#: Texts whose grams are made in one task.
TEXTS = 10_000
#: Occurrences of a gram in a text that are told apart in a row of bits.
REPEATS = 4
#: From so many characters on, a matcher leaves popular characters out.
LONG = 200
#: What two texts that meet in a gram cost, as a multiple of one pair in a tile.
GRAM_COST = 300
#: Rows of a block up to which it goes whole to one task; rows of such blocks in a task, pairs of them that are bounded at a time, and the bits of a text's grams.
BLOCK_ROWS, TASK_ROWS, PAIRS, SIGNATURE = 1000, 50_000, 1 << 18, 512


def least_shared(total: np.ndarray | float, q: int, threshold: float) -> np.ndarray | float:
    """Grams of length q, repeats counted, that two strings of `total` characters in all must share."""
    return np.ceil(total * ((2 * q - 1) * threshold / 2 - (q - 1)) - (q - 1) - 1e-9)


def least_common(total: np.ndarray, q: int, threshold: float) -> np.ndarray:
    """The same for known lengths: the matched characters are a whole number."""
    return ((2 * q - 1) * np.ceil(threshold * total / 2 - 1e-9) - (q - 1) * (total + 1)).astype(np.int64)


def gram_lengths(threshold: float) -> list[int]:
    """Lengths of grams that long strings must share at this threshold: 1, 2 and the two longest."""
    useful = [q for q in range(1, LONGEST + 1) if (2 * q - 1) * threshold / 2 - (q - 1) > 0.01]
    return sorted({*useful[:2], *useful[-2:]})


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit hash depends on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def numbered_grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, gram): hashes of each text's grams of length q, those that repeat numbered, with the text's place in the list."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.full(n, q, np.uint64)
    for k in range(q):
        gram = _mixed(gram + points[k : k + n])
    inside = owner[:n] == owner[q - 1 :]
    owner, gram = owner[:n][inside], gram[inside]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    place = np.arange(len(gram))
    new = np.ones(len(gram), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    number = place - np.maximum.accumulate(np.where(new, place, 0))
    return owner, _mixed(gram + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _searched_with(length: np.ndarray, lengths: list[int], threshold: float) -> np.ndarray:
    """For texts of these lengths, the longest grams of which two at least must be shared; else single characters."""
    best = np.ones(len(length), np.int64)
    for q in lengths:
        best = np.where(least_shared(2 * length / (2 - threshold), q, threshold) >= 2, q, best)
    return best


def _counts(rows: DataFrame, lengths: list[int], threshold: float, searched: bool) -> np.ndarray:
    """How often grams occur in column text, by the top bits of their hashes: a bounded array, counted in each task before anything moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            best = _searched_with(np.array([len(t) for t in texts]), lengths, threshold)
            for q in lengths:
                used = [t for t, b in zip(texts, best.tolist(), strict=True) if b == q] if searched else texts
                total += np.bincount(_slots(numbered_grams(used, q)[1]), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    found = rows.select("text").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row a slot at most
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(rows: DataFrame, counts, lengths: list[int], threshold: float, searched: bool) -> DataFrame:
    """A row for each gram in a text's prefix: id, block, q, gram, place (in the order of its grams), size (number of its grams), length (of the text).

    A text that is searched for has the grams of one length, the longest it must share; a text that is found has those of all lengths.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                texts = part.column(2).to_pylist()
                length = np.array([len(t) for t in texts], np.int64)
                for q in lengths:
                    used = np.flatnonzero((_searched_with(length, lengths, threshold) == q) if searched else length >= q)
                    owner, gram = numbered_grams([texts[k] for k in used.tolist()], q)
                    if not len(owner):
                        continue
                    order = np.lexsort((gram, counts.value[_slots(gram)], owner))
                    owner, gram = owner[order], gram[order]
                    own = length[used]
                    size = own - q + 1
                    place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                    shared = np.maximum(least_shared(2 * own / (2 - threshold), q, threshold), 1)
                    first = place < (size - shared + 1)[owner]
                    owner, gram, place = owner[first], gram[first], place[first]
                    rows_at = pa.array(used[owner])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows_at), part.column(1).take(rows_at), *(pa.array(x) for x in (np.full(len(owner), q, np.int32), gram.view(np.int64), place.astype(np.int32), size[owner].astype(np.int32), own[owner].astype(np.int32)))],
                        ["id", "block", "q", "gram", "place", "size", "length"],
                    )

    kind = rows.schema["block"].dataType.simpleString()
    return rows.where(F.length("text") > 0).select("id", "block", "text").mapInArrow(work, f"id long, block {kind}, q int, gram long, place int, size int, length int")


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, tile: int = TILE, known: np.ndarray | None = None) -> DataFrame:
    """Distinct block, l, r: pairs of ids of texts in one block that may be alike to `threshold` (over 0): all pairs that are, and few others.

    left, right: id (long), block (any type; only rows of one block are compared), text. Texts that share an id are each searched. known: _counts() of right. Null and empty texts are like nothing. A gram that many rows have is cut into tiles on
    both sides, so no task holds all of its rows.
    """
    spark = left.sparkSession
    lengths = gram_lengths(threshold)
    counts = spark.sparkContext.broadcast(_counts(right.where(F.col("text").isNotNull()), lengths, threshold, False) if known is None else known)
    a, b = (_prefixes(rows, counts, lengths, threshold, searched) for rows, searched in ((left, True), (right, False)))
    keys = ["block", "q", "gram"]
    tiles = [rows.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias(f"{side}_tiles")) for rows, side in ((a, "l"), (b, "r"))]
    hot = tiles[0].join(tiles[1], keys).where("l_tiles > 1 OR r_tiles > 1")

    def dealt(rows: DataFrame, side: str, other: str) -> DataFrame:
        """Each row in its own tile, once for each of the other side's tiles."""
        own = rows.join(hot, keys, "left").withColumn(f"{side}_tile", F.pmod(F.xxhash64("id"), F.coalesce(f"{side}_tiles", F.lit(1))).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_tiles", F.lit(1)) - 1)).alias(f"{other}_tile")
        return own.select(*keys, f"{side}_tile", copies, *(F.col(c).alias(f"{side}_{c}") for c in ("id", "place", "size", "length")))

    met = dealt(a, "l", "r").join(dealt(b, "r", "l"), [*keys, "l_tile", "r_tile"])
    total = F.col("l_length") + F.col("r_length")
    met = met.where(2 * F.least("l_length", "r_length") >= F.lit(threshold - 1e-9) * total)
    first = met.groupBy("block", "l_id", "r_id", "q", "l_size", "r_size", "l_length", "r_length").agg(*(F.min(c).alias(c) for c in ("l_place", "r_place")))
    rest = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place"))  # of what can be shared from the first common gram on
    q = F.col("q")
    needed = total * ((2 * q - 1) * (threshold / 2) - (q - 1)) - (q - 1) - 1e-9
    return first.where(rest >= needed).select("block", F.col("l_id").alias("l"), F.col("r_id").alias("r")).distinct()


class Comparer:
    """Similarities of many strings with one: their sequence similarity where it reaches a threshold, else 0.

    Two bounds come first: by length, and by the longest common subsequence, which all matched runs together are one of. Its length takes a few operations on
    whole numbers a character (a bit for each character of the one string), a small part of what matching takes.
    """

    def __init__(self, autojunk: bool = True):
        self.matcher, self.own, self.masks, self.ready = difflib.SequenceMatcher(autojunk=autojunk), None, {}, False

    def against(self, b: str) -> None:
        if b != self.own:
            self.own, self.masks, self.ready = b, {}, False

    def common(self, a: str) -> int:
        """Length of the longest common subsequence."""
        if not self.masks:
            for k, c in enumerate(self.own):
                self.masks[c] = self.masks.get(c, 0) | 1 << k
        every = (1 << len(self.own)) - 1
        left = every
        for c in a:
            met = left & self.masks.get(c, 0)
            left = (left + met | left - met) & every
        return len(self.own) - left.bit_count()

    def score(self, a: str, threshold: float) -> float:
        total = len(a) + len(self.own)
        if not a or not self.own or 2 * min(len(a), len(self.own)) / total < threshold:
            return 0.0
        if (not self.matcher.autojunk or len(self.own) < LONG) and (a in self.own or self.own in a):  # the one string is the longest run
            return 2 * min(len(a), len(self.own)) / total
        if 2 * self.common(a) / total < threshold:
            return 0.0
        if not self.ready:
            self.matcher.set_seq2(self.own)
            self.ready = True
        self.matcher.set_seq1(a)
        score = self.matcher.ratio()
        return score if score >= threshold else 0.0


def bounded_ratio(threshold: float) -> Column:
    """A function of two string columns: their sequence similarity where it reaches the threshold, else 0."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        out, comparer = [], Comparer()
        for x, y in zip(a, b, strict=True):
            comparer.against(y or "")
            out.append(comparer.score(x or "", threshold))
        return pd.Series(out)

    return compared


def _table(texts: list[str], q: int, columns: int) -> np.ndarray:
    """For each text, how many of its grams fall into each column."""
    owner, gram = numbered_grams(texts, q)
    at = owner * columns + (gram % np.uint64(columns)).astype(np.int64)
    return np.bincount(at, minlength=len(texts) * columns).astype(np.float32).reshape(len(texts), columns)


def _letters(texts: list[str]) -> np.ndarray:
    """For each text, how often it has each letter; of many kinds some share a column, which can only raise what two texts share."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = owner * LETTER_COLUMNS + points % LETTER_COLUMNS
    return np.bincount(at, minlength=len(texts) * LETTER_COLUMNS).astype(np.int32).reshape(len(texts), LETTER_COLUMNS)


def _screened_small(left: list[str], right: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """screened() by the letters that both have, and by products of counts of pairs of letters, which are at least the number of common ones; these
    only where the letters leave more than a few pairs."""
    la, lb = (np.array([len(t) for t in texts], np.int64) for texts in (left, right))
    total = la[:, None] + lb[None]
    fits = 2 * np.minimum(la[:, None], lb[None]) >= (threshold - 1e-9) * total
    rows, columns = np.nonzero(fits)
    if len(rows):
        letters = _letters([*left, *right])
        own, other = letters[: len(left)], letters[len(left) :]
        shared = np.concatenate([np.minimum(own[rows[k : k + CHUNK]], other[columns[k : k + CHUNK]]).sum(1) for k in range(0, len(rows), CHUNK)])
        kept = 2 * shared >= (threshold - 1e-9) * total[rows, columns]
        rows, columns = rows[kept], columns[kept]
    needed = least_shared(total[rows, columns], 2, threshold)
    if len(rows) > 2 * len(left) and (needed > 0).any():
        product = _table(left, 2, SMALL_COLUMNS) @ _table(right, 2, SMALL_COLUMNS).T
        kept = product[rows, columns] >= needed - 0.5
        rows, columns = rows[kept], columns[kept]
    return rows, columns


class Bits:
    """The grams of length q (1 or 2) of many texts as rows of bits: for each column of grams, a bit for each text.

    Grams that share a column, and repeats beyond REPEATS, can only raise a count.
    """

    def __init__(self, texts: list[str], q: int):
        self.q, self.n = q, len(texts)
        points = [np.unique(self._points(texts[k : k + CHUNK])) for k in range(0, self.n, CHUNK)]
        self.letters = np.unique(np.concatenate(points)) if points else np.zeros(0, np.uint32)
        kinds = (len(self.letters) + 1) ** q * REPEATS
        self.columns, self.seen = min(kinds, COLUMNS), None
        chunks = [self.placed(texts[k : k + CHUNK]) for k in range(0, self.n, CHUNK)]
        if kinds <= 1 << 22:  # every kind that occurs has its own column, if there are few
            seen = np.zeros(kinds, bool)
            for _, kind in chunks:
                seen[kind] = True
            if seen.sum() <= COLUMNS:
                self.seen, self.columns = np.where(seen, np.cumsum(seen) - 1, -1), int(seen.sum())
        self.rows = np.zeros((self.columns, -(-self.n // CHUNK) * CHUNK // 64), np.uint64)
        for k, (owner, kind) in enumerate(chunks):
            bits = np.zeros((self.columns, CHUNK), bool)
            bits[self.column(kind), owner] = True
            self.rows[:, k * CHUNK // 64 : (k + 1) * CHUNK // 64] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    @staticmethod
    def _points(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, kind) of the grams, sorted by owner; those with letters that no text has have kind -1."""
        points = self._points(texts)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        known = (self.letters[at] == points) if len(self.letters) else np.zeros(len(points), bool)
        n, base = max(len(points) - self.q + 1, 0), len(self.letters) + 1
        gram, fine = at[:n].astype(np.int64), known[:n]
        for k in range(1, self.q):
            gram, fine = gram * base + at[k : k + n], fine & known[k : k + n]
        inside = (owner[:n] == owner[self.q - 1 :][:n]) & fine
        kinds = base**self.q
        key = np.sort(owner[:n][inside] * kinds + gram[inside])
        place = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.minimum(place - np.maximum.accumulate(np.where(new, place, 0)), REPEATS - 1) if len(key) else place
        return key // kinds, key % kinds * REPEATS + number

    def column(self, kind: np.ndarray) -> np.ndarray:
        """Columns of kinds; -1 for those that no text has."""
        return self.seen[kind] if self.seen is not None else (_mixed(kind.astype(np.uint64)) % np.uint64(self.columns)).astype(np.int64)

    def sums(self, columns: list[int], first: int, last: int) -> list[np.ndarray]:
        """Binary digits, lowest first, of how many of the columns each text has: words first to last of the rows, added up three rows at a time."""
        levels = [[self.rows[c, first:last] for c in columns]]
        digits = []
        for level in levels:
            carried: list[np.ndarray] = []
            while len(level) > 2:
                a, b, c = level.pop(), level.pop(), level.pop()
                odd = a ^ b
                both = a & b
                both |= odd & c
                odd ^= c
                level.append(odd)
                carried.append(both)
            if len(level) == 2:
                carried.append(level[0] & level[1])
                level = [level[0] ^ level[1]]
            digits.append(level[0])
            if carried:
                levels.append(carried)
        return digits


def _at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """Places of the sums that are `least` (1 or more) or above."""
    if least >> len(digits):
        return np.zeros(0, np.int64)
    found = np.full(len(digits[0]), ~np.uint64(0))
    for k, d in enumerate(digits):
        found = found & d if least >> k & 1 else found | d
    words = np.flatnonzero(found)
    bits = np.unpackbits(found[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def _values(digits: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    return sum(((d[word] >> bit) & np.uint64(1)).astype(np.int64) << k for k, d in enumerate(digits))


def _added(rows: list[np.ndarray], spare: np.ndarray) -> list[np.ndarray]:
    """Binary digits, lowest first, of the sums of bits at each place. The rows are overwritten."""
    digits, level = [], list(rows)
    while level:
        carried = []
        while len(level) > 2:
            a, b, c = level.pop(), level.pop(), level.pop()
            np.bitwise_xor(a, b, out=spare)
            np.bitwise_and(a, b, out=a)
            np.bitwise_and(spare, c, out=b)
            np.bitwise_or(a, b, out=b)
            np.bitwise_xor(spare, c, out=a)
            carried.append(b)
            level.append(a)
        if len(level) == 2:
            a, b = level
            np.bitwise_and(a, b, out=spare)
            np.bitwise_xor(a, b, out=a)
            np.copyto(b, spare)
            carried.append(b)
            level = [a]
        digits.append(level[0])
        level = carried
    return digits


def _reached(digits: list[np.ndarray], least: int) -> np.ndarray:
    """A bit for each sum that is `least` (1 or more) or above."""
    found = np.full_like(digits[0], 0 if least >> len(digits) else ~np.uint64(0))
    for k, d in enumerate(digits):
        found = found & d if least >> k & 1 else found | d
    return found


class Runs:
    """Which of many texts have a run of three letters, and which have it with another letter before the last, as rows of bits."""

    def __init__(self, texts: list[str]):
        points = Bits._points(texts)
        self.letters = np.unique(points)
        self.base = len(self.letters) + 1
        code, owner = np.searchsorted(self.letters, points), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.columns = min(self.base**3, RUN_COLUMNS)
        self.words = -(-len(texts) // 64)
        self.plain, self.gapped = (self._rows(code, owner, last) for last in (2, 3))

    def column(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        run = (a * self.base + b) * self.base + c
        return run if self.base**3 <= RUN_COLUMNS else (_mixed(run.astype(np.uint64)) % np.uint64(self.columns)).astype(np.int64)

    def _rows(self, code: np.ndarray, owner: np.ndarray, last: int) -> np.ndarray:
        out = np.zeros((self.columns, self.words), np.uint64)
        n = max(len(code) - last, 0)
        inside = owner[:n] == owner[last:]
        at, column = owner[:n][inside], self.column(code[:n], code[1 : n + 1], code[last:])[inside]
        for k in range(0, self.words, 32):
            some = slice(*np.searchsorted(at, (k * 64, (k + 32) * 64)))
            bits = np.zeros((self.columns, 2048), bool)
            bits[column[some], at[some] - k * 64] = True
            out[:, k : k + 32] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, : self.words - k]
        return out

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Pieces of texts of one length, as numbers."""
        points = Bits._points(texts)
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        code = np.where(self.letters[at] == points, at, self.base - 1).astype(np.int64).reshape(len(texts), -1)
        four = code[:, : code.shape[1] // PIECE * PIECE].reshape(len(texts), -1, PIECE)
        return ((four[..., 0] * self.base + four[..., 1]) * self.base + four[..., 2]) * self.base + four[..., 3]

    def tables(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each kind of piece, bits of the texts that may have it but for one letter lost or added, and of those that may have it whole."""
        near, whole = (np.empty((len(kinds), self.words), np.uint64) for _ in range(2))
        b = self.base
        for k in range(0, len(kinds), 256):
            some = kinds[k : k + 256]
            w, x, y, z = some // b**3, some // b**2 % b, some // b % b, some % b
            first, second = self.plain[self.column(w, x, y)], self.plain[self.column(x, y, z)]
            whole[k : k + 256] = first & second
            near[k : k + 256] = first | second | self.plain[self.column(w, y, z)] | self.plain[self.column(w, x, z)] | self.gapped[self.column(w, x, y)]
        return near, whole


def piece_score(n: np.ndarray | int, other: np.ndarray | int, threshold: float) -> np.ndarray:
    """What the pieces of a string of n characters score at least in one of `other` characters that is alike.

    Strings of S characters in all that match in M leave S - 2 M of them over. Each of those falls into one piece at most: as a character that the piece loses, or as one
    that stands between those it keeps. A piece with none of them scores 2, with one 1, others 0.
    """
    total = n + other
    return 2 * (n // PIECE) - (total - 2 * np.ceil(threshold * total / 2 - 1e-9).astype(np.int64))


def _by_pieces(left: list[str], right: list[str], low: np.ndarray, high: np.ndarray, score: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs whose pieces may score as much as a text of that length must (score; LEAST_SCORE or more), and that lie in low to high."""
    length = np.array([len(t) for t in left], np.int64)
    for start in range(0, len(right), PIECE_TEXTS):
        runs = Runs(right[start : start + PIECE_TEXTS])
        here = np.flatnonzero((low < start + PIECE_TEXTS) & (high > start))
        for n in np.unique(length[here]).tolist():
            own = here[length[here] == n]
            step = max(PIECE_KINDS // (n // PIECE), 1)
            pieces = runs.pieces([left[k] for k in own.tolist()])
            parts = [np.arange(len(own))] if len(np.unique(pieces)) <= PIECE_KINDS else np.split(np.arange(len(own)), range(step, len(own), step))
            for part in parts:
                kinds, number = np.unique(pieces[part], return_inverse=True)
                number = number.reshape(len(part), -1)
                near, whole = runs.tables(kinds)
                rows = [np.empty((PIECE_ROWS, runs.words), np.uint64) for _ in range(number.shape[1])]
                spare, seen, other, more = (np.empty((PIECE_ROWS, runs.words), np.uint64) for _ in range(4))
                for k in range(0, len(part), PIECE_ROWS):
                    mine = number[k : k + PIECE_ROWS]
                    m = len(mine)
                    for p, row in enumerate(rows):
                        np.take(near, mine[:, p], axis=0, out=row[:m], mode="clip")
                    digits = _added([row[:m] for row in rows], spare[:m])
                    half = -(-score[n] // 2)  # a piece scores 2 at most
                    found = _reached(digits, half)
                    one, two = seen[:m], np.zeros((m, runs.words), np.uint64)
                    one.fill(0)
                    for p in range(0, mine.shape[1], 2):  # where score - 3 pieces or fewer count, three of them are whole: in two pairs of pieces at least
                        np.take(whole, mine[:, p], axis=0, out=other[:m], mode="clip")
                        if p + 1 < mine.shape[1]:
                            np.take(whole, mine[:, p + 1], axis=0, out=more[:m], mode="clip")
                            other[:m] |= more[:m]
                        np.bitwise_and(one, other[:m], out=more[:m])
                        two |= more[:m]
                        one |= other[:m]
                    found = found & two | _reached(digits, score[n] - 2)
                    flat = found.ravel()
                    word = np.flatnonzero(flat)
                    at, bit = np.nonzero(np.unpackbits(flat[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    i = own[part[k + word[at] // runs.words]]
                    j = start + word[at] % runs.words * 64 + bit
                    good = (j >= low[i]) & (j < high[i])
                    yield i[good], j[good]


def screened(left: list[str], right: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may be alike; no pair that is gets lost. Of pairs of letters as many are shared as least_common() says or more, or, where that is no
    bound, of letters."""
    if len(left) * len(right) <= SMALL:
        return _screened_small(left, right, threshold)
    own = np.array([len(t) for t in left], np.int64)
    order = np.argsort([len(t) for t in right], kind="stable")
    texts = [right[k] for k in order.tolist()]
    length = np.array([len(t) for t in texts], np.int64)
    low = np.searchsorted(length, np.maximum(np.ceil(own * threshold / (2 - threshold) - 1e-6), 1))
    high = np.searchsorted(length, np.floor(own * (2 - threshold) / threshold + 1e-6), "right")
    fits = (own > 0) & (low < high)
    kinds = np.unique(length)

    def least(n: int, q: int) -> int:
        """What a text of n characters shares with any text here that it may be like."""
        return int(least_common(n + kinds[(kinds >= n * threshold / (2 - threshold) - 1e-6) & (kinds <= n * (2 - threshold) / threshold + 1e-6)], q, threshold).min())

    leasts = {(n, q): least(n, q) for n in np.unique(own[fits]).tolist() for q in (1, 2)}
    by_pairs = np.array([leasts.get((n, 2), 0) > 0 for n in own.tolist()], bool)
    rows, columns = [], []
    scores = {n: int(piece_score(n, kinds[(kinds >= n * threshold / (2 - threshold) - 1e-6) & (kinds <= n * (2 - threshold) / threshold + 1e-6)], threshold).min()) for n in np.unique(own[fits]).tolist()}
    pieced = np.flatnonzero(fits & by_pairs & np.array([scores.get(n, 0) >= LEAST_SCORE for n in own.tolist()], bool))
    if len(pieced) and len(pieced) * len(right) >= PIECED and len(np.unique(Bits._points(texts))) <= PIECE_LETTERS:
        fits[pieced] = False
        mine = [left[k] for k in pieced.tolist()]
        (a, a_lost), (b, b_lost) = ((np.concatenate(x) for x in zip(*(_signatures(side[k : k + CHUNK], 2, FINE_SIGNATURE) for k in range(0, len(side), CHUNK)), strict=True)) for side in (mine, texts))
        for i, j in _by_pieces(mine, texts, low[pieced], high[pieced], scores):
            shared = np.bitwise_count(a[i] & b[j]).sum(1, dtype=np.int64) + np.minimum(a_lost[i], b_lost[j])
            kept = shared >= least_common(own[pieced[i]] + length[j], 2, threshold)
            if kept.any():
                rows.append(pieced[i[kept]])
                columns.append(order[j[kept]])
    for q, mine in ((2, np.flatnonzero(fits & by_pairs)), (1, np.flatnonzero(fits & ~by_pairs))):
        if not len(mine):
            continue
        bits = Bits(texts, q)
        for start in range(0, len(mine), CHUNK):
            some = mine[start : start + CHUNK]
            owner, kind = bits.placed([left[k] for k in some.tolist()])
            column = bits.column(kind)
            owner, column = owner[column >= 0], column[column >= 0]
            cut = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
            column = column.tolist()
            for k, i in enumerate(some.tolist()):
                need = leasts[int(own[i]), q]
                if cut[k + 1] - cut[k] < need:
                    continue
                first, last = int(low[i]) >> 6, -(-int(high[i]) // 64)
                digits = bits.sums(column[cut[k] : cut[k + 1]], first, last)
                places = _at_least(digits, need)
                if not len(places):
                    continue
                at = places + first * 64
                good = (at >= low[i]) & (at < high[i])
                at, places = at[good], places[good]
                at = at[_values(digits, places) >= least_common(own[i] + length[at], q, threshold)]
                if len(at):
                    rows.append(np.full(len(at), i))
                    columns.append(order[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def tiled(left: DataFrame, right: DataFrame, keep: tuple[str, ...], tile: int | tuple[int, int] = TILE_TEXTS) -> DataFrame:
    """Both sides' rows (block and keep) as block, l_tile, r_tile, side (0 left, 1 right) and keep: each row once for each tile of the other side in its block.

    Sorted within partitions by block, tiles and side, so that a task goes through its tile pairs one after the other; a block of any size falls into tile pairs of
    bounded size, which different tasks take.
    """
    size = tile if isinstance(tile, tuple) else (tile, tile)
    sizes = [rows.groupBy("block").agg(F.ceil(F.count("*") / n).cast("int").alias(f"{side}_tiles")) for rows, side, n in ((left, "l", size[0]), (right, "r", size[1]))]
    both = sizes[0].join(sizes[1], "block")

    def dealt(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        placed = rows.select("block", *keep).join(both, "block").withColumn(f"{own}_tile", F.pmod(F.xxhash64(*keep), F.col(f"{own}_tiles")).cast("int"))
        placed = placed.withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0), F.col(f"{other}_tiles") - 1)))
        return placed.select("block", "l_tile", "r_tile", F.lit(number).alias("side"), *keep)

    key = ["block", "l_tile", "r_tile"]
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a given number: few bytes in a tile, much work
    return dealt(left, 0, "l", "r").unionByName(dealt(right, 1, "r", "l")).repartition(parts, *key).sortWithinPartitions(*key, "side")


def tile_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table, pa.Table]]:
    """(block, rows of the left side, rows of the right side) of each tile pair in a stream that tiled() made."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[tuple[str, pa.Table, pa.Table]]:
        rows = pa.Table.from_batches(held)
        split = int(np.searchsorted(rows.column("side").to_numpy(), 1))
        if 0 < split < len(rows):
            yield last[0], rows.slice(0, split), rows.slice(split)

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and keys[a] != last:
                yield from done()
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield from done()


def _tile_sizes(pairs: float, widest: int, cores: int) -> tuple[int, int]:
    """Texts of the left and the right side in a tile pair, where the right side has up to `widest` in a block: wide on the right, and several pairs for each core if
    there are enough."""
    right = max(min(widest, LARGE_TILE[1]), 1)
    return int(min(max(pairs / (4 * cores) / right, CHUNK), LARGE_TILE[0])), right


def _tile_rows(rows: DataFrame, tiles: DataFrame, side: str, n: int) -> DataFrame:
    """block, texts: a row for each of the n tiles of a side (block, {side}_tiles, {side}_first: the number of its first), in a partition of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # of one tile
        if held:
            text = pa.chunked_array([b.column("text") for b in held]).combine_chunks()
            texts = pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([held[0].column("tile").slice(0, 1), held[0].column("block").slice(0, 1), texts], ["tile", "block", side])

    placed = rows.join(tiles, "block").select((F.col(f"{side}_first") + F.pmod(F.xxhash64("text"), F.col(f"{side}_tiles"))).cast("int").alias("tile"), "block", "text")
    made = placed.repartitionById(n, F.col("tile")).mapInArrow(work, f"tile int, block string, {side} array<string>")
    return made.repartitionById(n, F.col("tile")).drop("tile")


def by_tiles(left: DataFrame, right: DataFrame, threshold: float, tile: int | tuple[int, int] | None = None) -> DataFrame:
    """block, a, b, similarity of all pairs of distinct texts (columns block, text) that are alike, from tiles of both sides.

    Blocks of one tile on either side are dealt whole. Where there are more, each tile is one row, and a task meets each pair of tiles: a tile is read again for each
    tile of the other side, but never written again.
    """

    def compared(block: str, a: list[str], b: list[str], comparer: Comparer) -> Iterator[pa.RecordBatch]:
        rows, columns = screened(a, b, threshold)
        order = np.argsort(columns, kind="stable")
        out = []
        for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
            comparer.against(b[j])
            score = comparer.score(a[i], threshold)
            if score:
                out.append((a[i], b[j], score))
        if out:
            x, y, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(s, pa.float64())], ["block", "a", "b", "similarity"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer()
        for block, own, other in tile_groups(batches):
            yield from compared(block, own.column("text").to_pylist(), other.column("text").to_pylist(), comparer)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer()
        for batch in batches:
            for k in range(len(batch)):
                block, a, b = (batch.column(c)[k].as_py() for c in ("block", "l", "r"))
                yield from compared(block, a, b, comparer)

    spark, kind = left.sparkSession, "block string, a string, b string, similarity double"
    sides = [rows.groupBy("block").agg(F.count("*").alias(f"{side}_n"), F.sum(F.length("text")).alias(f"{side}_characters")) for rows, side in ((left, "l"), (right, "r"))]
    written = Written(spark)
    sizes = written.cut(sides[0].join(sides[1], "block"))
    if tile is None:
        all_pairs, widest = sizes.agg(F.sum(F.col("l_n").cast("double") * F.col("r_n")), F.max("r_n")).first()
        tile = _tile_sizes(all_pairs or 0.0, widest or 0, spark.sparkContext.defaultParallelism)
    most = tile if isinstance(tile, tuple) else (tile, tile)
    tiles = sizes.select("block", *(F.greatest(F.ceil(F.col(f"{side}_n") / n), F.ceil(F.col(f"{side}_characters") / TILE_CHARACTERS)).alias(f"{side}_tiles") for side, n in zip("lr", most, strict=True)))
    large = tiles.where("l_tiles > 1 OR r_tiles > 1")  # few: each has more texts than a tile
    numbered = written.cut(large.select("*", *((F.sum(f"{side}_tiles").over(Window.orderBy("block")) - F.col(f"{side}_tiles")).alias(f"{side}_first") for side in "lr")))
    n, m = numbered.agg(*(F.coalesce(F.sum(f"{side}_tiles"), F.lit(0)) for side in "lr")).first()
    if not n:
        written.drop()
        return tiled(left, right, ("text",), most).mapInArrow(whole, kind)
    pairs = _tile_rows(left, numbered, "l", n).join(_tile_rows(right, numbered, "r", m).hint("shuffle_replicate_nl"), "block")
    found = pairs.mapInArrow(met, kind)
    if numbered.count() == sizes.count():
        return found
    small = [rows.join(numbered, "block", "left_anti") for rows in (left, right)]
    return found.unionByName(tiled(*small, ("text",), most).mapInArrow(whole, kind))


def by_grams(left: DataFrame, right: DataFrame, threshold: float, tile: int = TILE, known: np.ndarray | None = None, parts: int = 0) -> DataFrame:
    """The same from the index of grams. A text's hash is its id: a collision makes one pair more to compare, and loses none. parts: tasks that pairs are dealt to,
    whatever their bytes (0: as they come)."""
    own, other = (rows.withColumn("id", F.xxhash64("text")) for rows in (left, right))
    pairs = near_pairs(own, other, threshold, tile, known)
    pairs = pairs.join(other.select("block", F.col("id").alias("r"), F.col("text").alias("b")), ["block", "r"]).join(own.select("block", F.col("id").alias("l"), F.col("text").alias("a")), ["block", "l"])
    pairs = pairs.repartition(parts, "a", "b") if parts else pairs
    return pairs.select("block", "a", "b", bounded_ratio(threshold)("a", "b").alias("similarity")).where(F.col("similarity") >= threshold)


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct block, a, b, similarity of texts a of left and b of right (columns block, text) in one block that are alike to the threshold.

    Each text is searched once, however many rows have it; null and empty texts are like nothing. The texts of either side are made once and written to the shared
    folder: counts and both ways read them there. From counts of grams and of texts by block follows which way costs less: by_grams() for texts whose grams are
    rare, by_tiles() for others. Results don't depend on it.
    """
    spark = left.sparkSession
    distinct = lambda rows: Written(spark).cut(rows.where("text <> ''").select(F.col("block").cast("string").alias("block"), "text").distinct())
    own = distinct(left)
    nothing = spark.createDataFrame([], "block string, a string, b string, similarity double")
    if own.isEmpty():  # the other side may be large
        return nothing
    other = own if right is left else distinct(right.join(own.select(F.col("block").alias("_own")).distinct(), F.col("block").cast("string") == F.col("_own"), "left_semi"))
    sizes = own.groupBy("block").agg(F.count("*").alias("n")).join(other.groupBy("block").agg(F.count("*").alias("m")), "block")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    if not pairs:
        return nothing
    lengths = gram_lengths(threshold)
    many = sizes.count() > 1  # a text may stand in several blocks: it is counted once
    texts = [Written(spark).cut(rows.select("text").distinct()) if many else rows for rows in (own, other)]
    n = [rows.count() for rows in texts]
    known, asked = (_counts(rows.repartition(max(spark.sparkContext.defaultParallelism, -(-k // TEXTS))), lengths, threshold, searched) for rows, k, searched in ((texts[1], n[1], False), (texts[0], n[0], True)))  # few bytes, much work
    if float(asked.astype(float) @ known) * GRAM_COST >= float(n[0]) * n[1]:
        return by_tiles(own, other, threshold)
    parts = [max(spark.sparkContext.defaultParallelism, -(-rows.count() // TEXTS)) for rows in (own, other)]
    return by_grams(*(rows.repartition(k) for rows, k in zip((own, other), parts, strict=True)), threshold, known=known, parts=sum(parts))


def _signatures(texts: list[str], q: int, size: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """`size` bits of each text, one set by each gram of length q, and how many grams found theirs set.

    Two texts share as many grams as they share bits and the smaller of those numbers at most.
    """
    owner, gram = numbered_grams(texts, q)
    bits = np.zeros((len(texts), size), bool)
    bits[owner, (gram % np.uint64(size)).astype(np.int64)] = True
    lost = np.bincount(owner, minlength=len(texts)) - bits.sum(1)
    return np.packbits(bits, axis=1).view(np.uint64), lost


def screened_later(texts: list[str], ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j < ends[i] of the texts that may be alike; no pair that is gets lost. Pairs of many small blocks are bounded together."""
    length = np.array([len(t) for t in texts], np.int64)
    q = 2 if 2 in gram_lengths(threshold) else 1
    made = [_signatures(texts[k : k + CHUNK], q) for k in range(0, len(texts), CHUNK)]
    signature, lost = (np.concatenate(x) for x in zip(*made, strict=True))
    after = ends - np.arange(len(texts)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    rows, columns, start = [], [], 0
    while start < len(texts):
        stop = max(int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1, start + 1)
        n = after[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        both = length[i] + length[j]
        fits = 2 * np.minimum(length[i], length[j]) >= (threshold - 1e-9) * both
        i, j, both = i[fits], j[fits], both[fits]
        shared = np.bitwise_count(signature[i] & signature[j]).sum(1, dtype=np.int64) + np.minimum(lost[i], lost[j])
        kept = shared >= least_common(both, q, threshold)
        rows.append(i[kept])
        columns.append(j[kept])
        start = stop
    return np.concatenate(rows), np.concatenate(columns)


def later_pairs(rows: DataFrame, threshold: float, most: int = BLOCK_ROWS) -> DataFrame:
    """block, l, r, similarity of rows (block, number, text) of one block with l before r whose texts are alike to the threshold: that of l's text with r's.

    Blocks of up to `most` rows go whole to one task, and many of them share a pass; texts of others are searched by alike(), and rows join them on the block and the text.
    Rows without a block, number or text are like nothing. rows are read more than once.
    """
    rows = rows.where("block IS NOT NULL AND number IS NOT NULL AND text <> ''").select("block", "number", "text")
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer()

        def starts(column: pa.Array) -> np.ndarray:
            """Places where a sorted column has another value than before."""
            return np.concatenate([[0], np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)) + 1])

        def found(part: pa.Table) -> pa.RecordBatch:
            block, number, texts = part.column(0).combine_chunks(), part.column(1).combine_chunks(), part.column(2).to_pylist()
            first = starts(block)
            ends = np.repeat(np.append(first[1:], len(texts)), np.diff(np.append(first, len(texts))))
            i, j = screened_later(texts, ends, threshold)
            turn = np.zeros(len(texts), np.int64)
            turn[starts(number)] = 1
            turn[first] = 1
            turn = np.cumsum(turn)
            later = turn[i] < turn[j]
            i, j = i[later], j[later]
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            score = np.zeros(len(i))
            for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                comparer.against(texts[b])
                score[k] = comparer.score(texts[a], threshold)
            good = score > 0
            i, j = i[good], j[good]
            return pa.RecordBatch.from_arrays([block.take(pa.array(i)), number.take(pa.array(i)), number.take(pa.array(j)), pa.array(score[good])], ["block", "l", "r", "similarity"])

        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            last = int(starts(held.column(0).combine_chunks())[-1]) if len(held) else 0
            if last:  # the last block may go on
                yield found(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield found(held)

    written = Written(rows.sparkSession)
    large = written.cut(rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > most).select("block"))
    none = large.isEmpty()
    small = rows if none else rows.join(large, "block", "left_anti")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    pairs = small.repartition(parts, "block").sortWithinPartitions("block", "number").mapInArrow(work, f"block {kinds['block']}, l {kinds['number']}, r {kinds['number']}, similarity double")
    if none:
        written.drop()
        return pairs
    long = rows.join(large, "block", "left_semi")
    met = alike(long, long, threshold).select(F.col("block").cast(kinds["block"]).alias("block"), "a", "b", "similarity")
    own, other = (long.select("block", F.col("number").alias(n), F.col("text").alias(t)) for n, t in (("l", "a"), ("r", "b")))
    return pairs.unionByName(own.join(met, ["block", "a"]).join(other, ["block", "b"]).where("l < r").select("block", "l", "r", "similarity"))
