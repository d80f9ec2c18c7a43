"""Near-copies by exact Jaccard likeness of word shingles: operator 9's SimHash anchors and, for pairs beyond their reach, MinHash bands propose pairs;
the whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import changes, cut, mixed, rolling, small_batches, text_slices, texts_of
from refloom.llm.components import components
from refloom.llm.simhash import majority, near_links

SEED = 42
#: Words of a shingle; two texts are near-copies if their sets have 4 of 5 shingles of both in common.
SHINGLE, ALIKE = 5, (4, 5)
#: Bands of MinHash values. A pair at the limit of 0.8 meets in no band with a chance of (1 - 0.8 ** 4) ** 40 = 7e-10, one above it more rarely.
BANDS, ROWS = 40, 4
#: Bits that SimHash fingerprints of the shingle sets may differ in for a pair to be proposed. At a likeness of 0.8 they differ in 10 of 64 on average, which no
#: covering code reaches at bearable cost; so bands propose the rest.
BITS = 4
#: Shingles are counted in so many slots, as a power of two; the counts order them, so a coarse count costs work and not results.
SLOT_BITS = 18
WORD_BASE = 0x9E3779B97F4A7C15
NODE, CHECK, KEYS, PRINT, LEAST = "_near_node", "_near_check", "_near_keys", "_near_print", "_near_least"
#: Sets that meet in one task at a shingle of their prefixes; where more have it, they are cut into tiles.
TILE = 2048
_draw = np.random.default_rng(SEED)
MASKS, FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64), _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending. Fewer words than a shingle: the whole sequence is one; no words: none."""
    words = text.lower().split()  # on bytes, as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(rolling(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)), SHINGLE, WORD_BASE))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 32-bit key for each band of each set; no set may be empty."""
    values, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.zeros((len(sets), BANDS), np.uint32)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key ^ np.minimum.reduceat((values ^ MASKS[k]) * FACTORS[k], starts))
        keys[:, band] = key >> np.uint64(32)
    return keys


def coded(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with NODE and CHECK, 64 and 64 more bits of a hash of the text's shingle set, KEYS, its bands' keys as bytes (empty for a text without words), and PRINT, its SimHash fingerprint."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches, text_column, 1 << 20):
            sets = [shingles(t) for t in texts_of(bounds, data)]
            nodes, checks = (np.array([digest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64) for digest, seed in ((xxhash.xxh3_64_intdigest, SEED), (xxhash.xxh64_intdigest, SEED + 1)))
            used = [k for k, s in enumerate(sets) if len(s)]
            keys = [b""] * len(sets)
            for k, own in zip(used, band_keys([sets[k] for k in used]) if used else (), strict=True):
                keys[k] = own.tobytes()
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(nodes), pa.array(checks), pa.array(keys, pa.binary()), pa.array(prints)], [*rows.schema.names, NODE, CHECK, KEYS, PRINT])

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField(NODE, T.LongType()), T.StructField(CHECK, T.LongType()), T.StructField(KEYS, T.BinaryType()), T.StructField(PRINT, T.LongType())]))


def told_apart(rows: DataFrame) -> DataFrame:
    """rows, written, where each NODE is one set: of sets that share a NODE but differ in CHECK, all but one get another NODE. There is hardly ever one, so what has to be joined
    is next to nothing."""
    shared = cut(rows.groupBy(NODE).agg(F.min(CHECK).alias("_low"), F.max(CHECK).alias("_high")).where("_low <> _high").select(NODE, "_low"))
    if shared.isEmpty():
        return rows
    other = F.col("_low").isNotNull() & (F.col(CHECK) != F.col("_low"))
    return cut(rows.join(shared, NODE, "left").withColumn(NODE, F.when(other, F.xxhash64(NODE, CHECK)).otherwise(F.col(NODE))).select(*rows.columns))


def printed_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that the fingerprints propose: each with the first of its fingerprint, and the firsts of linked fingerprints. nodes: NODE, PRINT."""
    firsts = cut(nodes.groupBy(F.col(PRINT).alias("fp")).agg(F.min(NODE).alias("first")))
    equal = nodes.join(firsts, nodes[PRINT] == firsts["fp"]).select(F.col(NODE).alias("x"), F.col("first").alias("y"))
    linked = near_links(firsts.select("fp"), BITS).distinct().join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.unionByName(linked.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """band, key, node for each band of each node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([np.frombuffer(k, np.uint32) for k in batch.column(1).to_pylist()], np.int64).reshape(-1, BANDS)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array((keys | np.arange(BANDS) << 32).reshape(-1)), pa.array(node)], ["bucket", "node"])

    return nodes.select(NODE, KEYS).mapInArrow(work, "bucket long, node long")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, by the top SLOT_BITS bits of their hashes: a bounded array, counted in each task before anything moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(slots(batch.column(0).flatten().to_numpy()), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    found = sets.select("shingles").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row for each slot at most
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def apart(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs a, b with unlike labels that can be alike, all of them. sets: node, label, shingles.

    Prefix filter: in one order of all shingles, the rarest first, sets with a likeness of ALIKE share one of their first few: of n, the first n minus ALIKE of n,
    and one more. Where the first shingle that two sets share stands, what follows it bounds what they have in common. Copies of one text that have too
    little in common begin with shingles of their own, so a large group of them makes few pairs. A shingle that over `tile` prefixes have is cut into tiles, and each two
    of them meet in a task of their own.
    """
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, size, rest, found = [], [], [], []
            for k, own in enumerate(batch.column(2)):
                own = own.values.to_numpy()
                n = len(own) - -(-ALIKE[0] * len(own) // ALIKE[1]) + 1
                found.append(own[np.lexsort((own, counts.value[slots(own)]))[:n]])
                owner.append(np.full(n, k))
                size.append(np.full(n, len(own)))
                rest.append(len(own) - np.arange(n))
            if found:
                rows = np.concatenate(owner)
                node, label = (batch.column(i).to_numpy()[rows] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found), node, label, np.concatenate(size), np.concatenate(rest))], ["shingle", "node", "label", "size", "rest"])

    def pairs(node: np.ndarray, label: np.ndarray, size: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // len(node))
        for k in range(0, len(node), step):
            part = slice(k, k + step)
            low, high = np.minimum(size[part, None], size[None]), np.maximum(size[part, None], size[None])
            enough = sum(ALIKE) * np.minimum(rest[part, None], rest[None]) >= ALIKE[0] * (low + high)  # alike sets share so much of their sum
            a, b = np.nonzero((label[part, None] != label[None]) & (ALIKE[1] * low >= ALIKE[0] * high) & enough)
            a, b = node[a[a + k < b] + k], node[b[a + k < b]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ends = [*changes(columns[0]).tolist(), len(columns[0])]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                if e - s > 1:
                    yield from pairs(*(c[s:e] for c in columns[1:]))

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            last = int(changes(held[0])[-1])
            if last:
                yield from done([h[:last] for h in held])
                held = [h[last:] for h in held]
        yield from done(held)

    rows = sets.select("node", "label", "shingles").mapInArrow(prefixes, "shingle long, node long, label long, size long, rest long")
    hot = cut(rows.groupBy("shingle").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1"))
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.xxhash64("shingle", F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
        places = F.explode(F.when(F.col("tiles").isNull(), F.array("shingle")).otherwise(met))
        rows = rows.join(hot, "shingle", "left").withColumn("own", own).select(places.alias("shingle"), "node", "label", "size", "rest")
    return rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(work, "a long, b long").distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a Jaccard likeness of ALIKE at least. sets: node, shingles."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").where(ALIKE[1] * F.least(F.size("s_a"), F.size("s_b")) >= ALIKE[0] * F.greatest(F.size("s_a"), F.size("s_b")))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", shared.alias("n"), (F.size("s_a") + F.size("s_b")).alias("m")).where(ALIKE[1] * F.col("n") >= ALIKE[0] * (F.col("m") - F.col("n"))).select("a", "b")


def links(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """Links a, b between nodes, all with a likeness of ALIKE at least, enough to join all that have it. rows: what coded() gives, written.

    Pairs that the fingerprints propose come first, with the pairs of each bucket's one member that meets most others: near-copies of one text are joined by
    that text. Nodes that then share a bucket with one they are not joined with go through apart(), so no group costs its square.
    """
    nodes = cut(rows.where(F.length(KEYS) > 0).groupBy(NODE).agg(F.first(KEYS).alias(KEYS), F.first(PRINT).alias(PRINT)))
    buckets = cut(bucket_rows(nodes))
    full = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(buckets.join(full, "bucket"))
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    printed = cut(printed_pairs(nodes))
    used = met.select("node").unionByName(printed.select(F.col("a").alias("node"))).unionByName(printed.select(F.col("b").alias("node"))).distinct()
    texts = rows.join(used.withColumnRenamed("node", NODE), NODE, "left_semi").groupBy(NODE).agg(F.first(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, data in text_slices(batches):
            own = [shingles(t).view(np.int64) for t in texts_of(bounds, data)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = cut(texts.select(NODE, "text").mapInArrow(work, "node long, shingles array<long>"))
    centre = shared.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    stars = shared.join(centre, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    stars = cut(stars.unionByName(printed).distinct())
    first = cut(alike(stars, sets))
    labelled = shared.join(components(first), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    labelled = cut(labelled)
    unlike = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    left = labelled.join(cut(unlike), "bucket").select("node", "label").distinct()
    return first.unionByName(alike(cut(apart(sets.join(left, "node")).join(stars, ["a", "b"], "left_anti")), sets))


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with NODE and LEAST, the struct (id, node) of its group's first row by id; null if the group has no id.

    Equal sets are one node, whatever their number. Rows with null ids take part but name no group.
    """
    rows = told_apart(cut(coded(docs, text_column)))
    own = rows.groupBy(NODE).agg(F.min(id_column).alias("id"))
    joined = cut(own.join(components(links(rows, text_column)).withColumnRenamed("node", NODE), NODE, "left").withColumn("component", F.coalesce("component", NODE)))
    least = joined.groupBy("component").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", NODE))).alias(LEAST))
    return rows.drop(CHECK, KEYS, PRINT).join(joined.join(least, "component").select(NODE, LEAST), NODE)
