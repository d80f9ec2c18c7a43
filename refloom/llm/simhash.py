"""Operator 9: SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import cut, small_batches, text_slices, texts_of
from refloom.llm.components import components

SEED = 42
#: Schemes: the 64 bits fall into so many blocks, of which so many together make a value. Of two fingerprints that differ in up to 4 bits, some choice of
#: blocks differs in one bit at most (with the first scheme, in up to 5 bits): longer values have smaller groups, and more choices.
SCHEMES = ((3, 1), (5, 2), (6, 3))
#: The lowest 15 bits of a value are covered by the Hamming code of that length, the others by themselves: every value has an anchor within 1 bit.
COVERED, COVER_RADIUS, VALUE_THRESHOLD = 15, 1, 1
#: Members of an anchor beyond this many are compared tile by tile.
TILE = 2048
#: Cost of a row at an anchor (dealing and sorting) as a multiple of one comparison.
ROW_COST = 300


def choices(scheme: tuple[int, int]) -> list[list[tuple[int, int]]]:
    """The (start, width) blocks of each value of a scheme."""
    blocks, chosen = scheme
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [[(edges[k], edges[k + 1] - edges[k]) for k in c] for c in combinations(range(blocks), chosen)]


def scheme_for(n: int, threshold: int = 4) -> tuple[int, int]:
    """The scheme that costs least for n distinct fingerprints of evenly spread bits: rows at anchors, and comparisons of nearest with all members."""

    def cost(scheme: tuple[int, int]) -> float:
        total = 0.0
        for blocks in choices(scheme):
            width = sum(w for _, w in blocks)
            rows = 1 + (width - COVERED) + COVERED // 2
            total += rows * ROW_COST + n * rows / 2.0 ** (width - 4)
        return total

    return min(SCHEMES[: 1 if threshold > 4 else None], key=cost)


def text_fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # on bytes: lower-cases A-Z, splits on the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """64-bit SimHash of every whole text, as id_column and fp (signed long with the same bits).

    A bit is 1 if it is set in over half of the shingles' XXH64, repeats included. Fewer words than a shingle: the whole sequence is one;
    no words, an empty or a null text: zero.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            found = np.array([text_fingerprint(t, shingle) for t in texts_of(bounds, data)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], ["id", "fp"])

    return source.mapInArrow(work, T.StructType([source.schema["id"], T.StructField("fp", T.LongType())])).withColumnRenamed("id", id_column)


def hamming_columns() -> np.ndarray:
    """Syndrome of each of the 15 covered bits: the numbers 1 to 15."""
    return np.arange(1, COVERED + 1, dtype=np.int64)


def anchors_of(values: np.ndarray, width: int) -> list[np.ndarray]:
    """All anchors within COVER_RADIUS + VALUE_THRESHOLD = 2 bits of each value, as arrays of the same length (-1: none); the nearest comes first.

    The nearest anchor flips the covered bit that the syndrome names. The others within 2 bits flip two covered bits whose syndromes
    add up to it, or one bit of the rest besides the nearest anchor's flip. Anchors that differ in two bits of the rest are nearest to no value
    within one bit, so no pair meets there and they are left out.
    """
    low = values & ((1 << COVERED) - 1)
    syndrome = np.zeros(len(values), np.int64)
    for bit, column in enumerate(hamming_columns()):
        syndrome ^= ((low >> bit) & 1) * column
    flip = np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    nearest = values ^ flip
    out = [nearest]
    for bit in range(COVERED, width):
        out.append(nearest ^ (1 << bit))
    for column in hamming_columns():  # the pair (column, syndrome ^ column), named once by its smaller member
        other = syndrome ^ column
        out.append(np.where((syndrome > 0) & (other > column), values ^ (1 << (int(column) - 1)) ^ (1 << np.maximum(other - 1, 0)), -1))
    return out


def anchor_rows(fps: DataFrame, scheme: tuple[int, int] = SCHEMES[0]) -> DataFrame:
    """One row (choice, anchor, fp, near) for each fingerprint and each anchor within reach of one of its values; near marks the nearest anchor."""
    wanted = choices(scheme)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 20_000):
                fp = batch.column(0).slice(k, 20_000).to_numpy(zero_copy_only=False)
                bits = fp.view(np.uint64)
                for number, blocks in enumerate(wanted):
                    values, width = np.zeros(len(fp), np.int64), 0
                    for start, size in blocks:
                        values |= (((bits >> np.uint64(start)) & np.uint64((1 << size) - 1)).astype(np.int64)) << width
                        width += size
                    found = np.stack(anchors_of(values, width))
                    used, near = found >= 0, np.zeros(found.shape, bool)
                    near[0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(found[used] | number << 40), pa.array(np.broadcast_to(fp, found.shape)[used]), pa.array(near[used])], ["anchor", "fp", "near"])

    return fps.select("fp").mapInArrow(work, "anchor long, fp long, near boolean")


def forest(values: np.ndarray, near: np.ndarray, member: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all near values with all members within threshold bits of them: each value to the first that it reaches in steps."""
    label = np.arange(len(values))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own, others = np.flatnonzero(near), np.flatnonzero(member)
    for k in range(0, len(own), 256):
        a, b = np.nonzero(np.bitwise_count(values[own[k : k + 256], None] ^ values[None, others]) <= threshold)
        a, b = own[a + k], others[b]
        left.append(np.minimum(a, b)[a != b])
        right.append(np.maximum(a, b)[a != b])
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def near_links(fps: DataFrame, threshold: int = 4, tile: int = TILE, scheme: tuple[int, int] | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp), enough to join all that are within threshold bits, 5 at most.

    Fingerprints are copied to every anchor within the covering radius plus the value's threshold. Of two values within one bit, each lies within the radius
    of its nearest anchor, which the other reaches too, so per anchor those that it is nearest to are compared with all its members. The scheme
    follows from the table's size, so groups stay small; every scheme finds all pairs. An anchor with over `tile` members is cut into tiles, each of
    which meets the nearest ones in a task of its own; no anchor is capped. Of a group that is linked anyway only a spanning forest is emitted.
    """
    if threshold > 5:
        raise ValueError("three blocks with one differing bit each cover 5 bits at most")
    rows = anchor_rows(fps, scheme or scheme_for(fps.count(), threshold))
    hot = cut(rows.groupBy("anchor").count().where(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("fp"), "tiles").cast("int")
    placed = rows.join(hot, "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own)
    placed = placed.withColumn("x", F.explode(F.when(F.col("near"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))))
    placed = placed.select("anchor", "x", "fp", "near", (F.col("x") == F.col("own")).alias("member"))
    parts = placed.repartition("anchor", "x").sortWithinPartitions("anchor", "x", "fp")

    def compared(key: np.ndarray, fp: np.ndarray, near: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """key: group number, ascending. Small groups are compared by shifted copies, large ones on their own."""
        size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]))
        small = np.repeat(size <= 48, size)
        starts = np.cumsum(size) - size
        k, f, e = key[small], fp[small], near[small]
        for shift in range(1, int(size[size <= 48].max(initial=1))):
            found = (k[shift:] == k[:-shift]) & (e[shift:] | e[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= threshold)
            if found.any():
                yield f[shift:][found], f[:-shift][found]
        for s, n in zip(starts[size > 48], size[size > 48], strict=True):
            yield forest(fp[s : s + n], near[s : s + n], member[s : s + n], threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool))
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
                new = (keys, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), *(batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4)))
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                starts = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))
                done = int(starts[-1]) + 1 if len(starts) else 0
            else:
                done = len(held[0])
            keys, fp, near, member = (x[:done] for x in held)
            held = tuple(x[done:] for x in held)
            if not len(keys):
                continue
            group = np.cumsum(np.concatenate([[False], (keys[1:] != keys[:-1]).any(axis=1)]))
            for a, b in compared(group, fp, near, member):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return parts.mapInArrow(work, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """Fingerprint and component of every row: id_column, fp, component_id (the smallest id reachable by links).

    Two rows are linked if their fingerprints differ in threshold bits at most. Equal fingerprints are one node, whatever their number,
    so repeated rows, ties and copies cost nothing. Rows with null ids take part but name no component; one has a null component if
    it reaches null ids only.
    """
    own = cut(fingerprints(docs, id_column, text_column, shingle))
    nodes = cut(own.groupBy("fp").agg(F.min(id_column).alias("least")))
    links = cut(near_links(nodes, threshold).distinct())
    reach = nodes.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = reach.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return own.join(grouped, "fp").select(id_column, "fp", "component_id")
