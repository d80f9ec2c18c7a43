"""Operator 6: language identification by prediction by partial matching over byte context trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import bounded_sample, held_out, small_batches, text_slices

#: Longest context in bytes.
ORDER = 3
UNDETERMINED = "und"
LETTER = r"\p{L}"


def lowered(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def context_counts(sample: DataFrame) -> DataFrame:
    """Counts of all byte runs of 1 to ORDER + 1 bytes by language: lang, gram (length in the top bytes, then the run), n.

    Each slice is counted before anything is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches, limit=1 << 20):
            langs = np.array(rows.column(0).to_pylist(), object)
            owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
            wide = data.astype(np.int64)
            for lang in sorted(set(langs)):
                mine = (langs == lang)[owner]
                for length in range(1, ORDER + 2):
                    n = len(wide) - length + 1
                    if n <= 0:
                        continue
                    whole = mine[:n] & (owner[:n] == owner[length - 1 :])
                    gram = np.zeros(n, np.int64)
                    for k in range(length):
                        gram = gram << 8 | wide[k : k + n]
                    value, count = np.unique(gram[whole], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value | length << 40), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


#: Cells (places times languages) up to which code lengths are also kept as a matrix; and cells that scoring holds at a time.
MATRIX_CELLS, BLOCK_CELLS = 1 << 26, 1 << 22


@dataclass(frozen=True)
class Model:
    """Frozen statistics: code lengths in bits.

    symbols maps bytes to 0 ... width - 1, of which the last stands for all bytes that were never seen. first, second and third give the row of the longest known context for
    the last one, two and three symbols; row 0 is the empty context, and shorter has each context's next shorter one. places are the runs that some language has, as context
    times width plus symbol, ascending; parent is the place of the run without its first symbol, -1 in the empty context.

    What a language pays at a place differs from what it pays at the parent only if it knows the context. Those differences are kept (start, lang, bits), and what a language that
    knows a context pays for a run that no language has there (escape_start, escape_lang, escape_bits). So the model grows with what was learned from each language, not
    with languages times runs. base has the empty context's places for all languages. matrix, escape_matrix: the same summed up, for few languages.
    """

    languages: list[str]
    symbols: np.ndarray
    width: int
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    shorter: np.ndarray
    places: np.ndarray
    parent: np.ndarray
    base: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    bits: np.ndarray
    escape_start: np.ndarray
    escape_lang: np.ndarray
    escape_bits: np.ndarray
    matrix: np.ndarray | None
    escape_matrix: np.ndarray | None


def _rows(keys: list[np.ndarray], values: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each language (keys below n) as rows: where each key's entries start, their languages, their values."""
    key, lang = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))]), lang[order], np.concatenate(values)[order].astype(np.float32)


def build(lang: list[str], gram: np.ndarray, counted: np.ndarray, cells: int = MATRIX_CELLS) -> Model:
    """Escape method C: after a context with n bytes of d kinds, a kind with count c has c / (n + d), the others share d / (n + d).

    They share it as the next shorter context gives it, less what the longer one has. A context that a language never had is skipped. lang, gram, counted: what
    context_counts() gives, all of it.
    """
    languages = sorted(set(lang))
    if not languages:
        none, no_bits = np.zeros(1, np.int32), np.zeros((1, 0), np.float32)
        return Model([], np.zeros(256, np.int32), 1, none, none, none, none, np.zeros(1, np.int64), none - 1, no_bits, np.zeros(2, np.int64), none[:0], no_bits[0], np.zeros(2, np.int64), none[:0], no_bits[0], None, None)
    numbers = {x: k for k, x in enumerate(languages)}
    owner = np.array([numbers[x] for x in lang], np.int64)
    length, value = gram >> 40, gram & 0xFFFFFFFF
    seen = np.unique(value[length == 1])
    width = len(seen) + 1
    symbols = np.full(256, width - 1, np.int32)
    symbols[seen] = np.arange(len(seen))
    rest = 256 - len(seen)

    known = np.unique((length - 1) << 40 | value >> 8)  # contexts by length, then bytes; the empty one first
    order = known >> 40
    without_first = np.maximum(order - 1, 0) << 40 | known & ((1 << 8 * np.maximum(order - 1, 0)) - 1)
    shorter = np.minimum(np.searchsorted(known, without_first), len(known) - 1)
    shorter = np.where(known[shorter] == without_first, shorter, 0)
    row = np.searchsorted(known, (length - 1) << 40 | value >> 8)
    own_place = row * width + symbols[value & 255]
    places = np.unique(np.concatenate([own_place, np.arange(width)]))  # the empty context has all symbols
    at_row, at_symbol = places // width, places % width
    parent = np.where(at_row > 0, np.searchsorted(places, shorter[at_row] * width + at_symbol), -1)
    of_order = [np.flatnonzero(order[at_row] == k) for k in range(ORDER + 1)]

    base = np.zeros((width, len(languages)), np.float32)
    matrix = np.zeros((len(places), len(languages)), np.float32) if len(places) * len(languages) <= cells else None
    escape_matrix = np.zeros((len(known), len(languages)), np.float32) if matrix is not None else None
    keys, values, escape_keys, escape_values = [], [], [], []
    for k in range(len(languages)):
        mine = owner == k
        c = np.zeros(len(places))
        c[np.searchsorted(places, own_place[mine])] = counted[mine]
        n, kinds = np.bincount(at_row, c, len(known)), np.bincount(at_row, c > 0, len(known))
        p = np.zeros(len(places))
        escape = np.zeros(len(known))
        for o, here in enumerate(of_order):
            below = np.where(at_symbol[here] == width - 1, rest / 256, 1 / 256) if o == 0 else p[parent[here]]
            r, count = at_row[here], c[here]
            taken = np.bincount(r, np.where(count > 0, below, 0), len(known))
            full = kinds == (width if rest else len(seen))  # nothing is left for others
            share = np.where(full, 0, kinds / np.maximum(n + kinds, 1) / np.maximum(1 - taken, 1e-12))
            with np.errstate(invalid="ignore", divide="ignore"):
                seen_here = np.where(full[r], count / n[r], np.where(count > 0, count / (n[r] + kinds[r]), share[r] * below))
            p[here] = np.where(n[r] > 0, seen_here, below)
            here_rows = np.unique(r)
            escape[here_rows] = np.where((n > 0) & ~full, -np.log2(np.maximum(share, 1e-12)), 0)[here_rows]
        own = np.where(places % width == width - 1, p / max(rest, 1), p)  # each of the bytes that were never seen has its part
        cost = -np.log2(np.maximum(own, 1e-12))
        base[:, k] = cost[:width]
        knows = (n[at_row] > 0) & (at_row > 0)
        changed = np.flatnonzero(knows)
        keys.append(changed)
        values.append(cost[changed] - cost[parent[changed]])
        pays = np.flatnonzero(n > 0)
        escape_keys.append(pays)
        escape_values.append(escape[pays])
        if matrix is not None:
            matrix[:, k] = cost
            escape_matrix[:, k] = escape

    first, second, third = np.zeros(width, np.int32), np.zeros((width, width), np.int32), np.zeros((width, width, width), np.int32)
    for o, array in ((1, first), (2, second), (3, third)):
        if o > 1:
            array[:] = (first, second)[o - 2][None]
        rows = np.flatnonzero(order == o)
        array[tuple(symbols[known[rows] >> 8 * (o - 1 - i) & 255] for i in range(o))] = rows
    start, lang_at, bits = _rows(keys, values, len(places))
    escape_start, escape_lang, escape_bits = _rows(escape_keys, escape_values, len(known))
    return Model(languages, symbols, width, first, second.reshape(-1), third.reshape(-1), shorter.astype(np.int32), places, parent.astype(np.int32), base, start, lang_at, bits, escape_start, escape_lang, escape_bits, matrix, escape_matrix)


def _found(model: Model, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 for those that no language has."""
    at = np.minimum(np.searchsorted(model.places, keys), len(model.places) - 1)
    return np.where(model.places[at] == keys, at, -1)


def _add_entries(out: np.ndarray, text: np.ndarray, at: np.ndarray, start: np.ndarray, lang: np.ndarray, bits: np.ndarray) -> None:
    """Add the entries at places (or contexts) to the sums of texts and languages."""
    size = start[at + 1] - start[at]
    total = int(size.sum())
    if total:
        entry = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(total)
        out += np.bincount(np.repeat(text, size) * out.shape[1] + lang[entry], bits[entry], out.size).reshape(out.shape)


def code_lengths(model: Model, bounds: np.ndarray, data: np.ndarray, block: int = BLOCK_CELLS) -> np.ndarray:
    """Bits of each text under each language; the first bytes of a text have the shorter contexts that it offers. Works through blocks of bytes, so memory is bounded
    by a slice's bytes, not by bytes times languages."""
    w, s = model.width, model.symbols[data]
    row = np.zeros(len(s), np.int64)
    if len(s) > 3:
        row[3:] = model.third[(s[:-3].astype(np.int64) * w + s[1:-2]) * w + s[2:-1]]
    starts, ends = bounds[:-1], bounds[1:]
    row[starts[starts < ends]] = 0
    at = starts[starts + 1 < ends]
    row[at + 1] = model.first[s[at]]
    at = starts[starts + 2 < ends]
    row[at + 2] = model.second[s[at].astype(np.int64) * w + s[at + 1]]
    text = np.repeat(np.arange(len(starts)), ends - starts)
    out = np.zeros((len(starts), len(model.languages)))
    step = max(1, block // max(len(model.languages), 4))
    for a in range(0, len(s), step):
        r, symbol, own = row[a : a + step].copy(), s[a : a + step], text[a : a + step]
        first = int(own[0])
        sums = np.zeros((int(own[-1]) - first + 1, len(model.languages)))
        own = own - first
        place = _found(model, r * w + symbol)
        left = np.flatnonzero(place < 0)
        bits = np.zeros((len(r), len(model.languages)), np.float32) if model.matrix is not None else None
        while len(left):  # ORDER times at most: the empty context has every symbol
            if bits is not None:
                bits[left] += model.escape_matrix[r[left]]
            else:
                _add_entries(sums, own[left], r[left], model.escape_start, model.escape_lang, model.escape_bits)
            r[left] = model.shorter[r[left]]
            place[left] = _found(model, r[left] * w + symbol[left])
            left = left[place[left] < 0]
        if bits is not None:
            bits += model.matrix[place]
            texts = np.unique(own)
            sums[texts] += np.add.reduceat(bits, np.searchsorted(own, texts), axis=0, dtype=np.float64)
        else:
            counts = np.bincount(own * w + symbol, minlength=len(sums) * w).reshape(len(sums), w)
            sums += counts @ model.base
            above = model.parent[place] >= 0
            while above.any():
                _add_entries(sums, own[above], place[above], model.start, model.lang, model.bits)
                place = np.where(above, model.parent[place], place)
                above = model.parent[place] >= 0
        out[first : first + len(sums)] += sums
    return out


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = 300, longest: int = 1 << 20, sample_bytes: int = 16 << 20, max_languages: int = 2000) -> Model:
    """Fit on a bounded sample: per_language whole texts of each language at most, none of over `longest` bytes, none of the held-out fold, and of those so many as fit into the
    language's part of sample_bytes (one at least).

    That is the only bound: every run of 1 to ORDER + 1 bytes of the sample counts. More than max_languages languages are an error.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang"), lowered(text_column).alias("text"))
    rows = rows.where(~held_out("doc_id") & (F.octet_length("text") <= longest))
    counts = context_counts(bounded_sample(rows, "lang", per_language, max_classes=max_languages, total_bytes=sample_bytes)).toArrow()
    return build(counts.column("lang").to_pylist(), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id_column, the columns in carry, lang_pred, score (posterior of the prediction at equal priors, 0 to 1) and bits_per_byte.

    lang_pred is und with score 0 if the text is null or has no letter, or if nothing was learned. Equal code lengths: the first
    language by name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_column).alias("id"), *(F.col(c) for c in carry), lowered(text_column).alias("_text"), F.coalesce(F.col(text_column).rlike(LETTER), F.lit(False)).alias("_letters"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, bounds, data in text_slices(batches, "_text", limit=1 << 20):
            n = len(rows)
            letters = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            lengths = code_lengths(m, bounds, data) if m.languages else np.zeros((n, 1))
            best = lengths.argmin(1)
            low = lengths[np.arange(n), best]
            score = 1 / np.exp2(np.maximum(low[:, None] - lengths, -1000)).sum(1)
            names = [m.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
            size = np.maximum(np.diff(bounds), 1)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, low / size, 0.0))], names=schema.names)

    schema = T.StructType([source.schema["id"], *(source.schema[c] for c in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_column)
