"""Operator 3: exact substring deduplication by suffix order, in parts that are bounded in size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.bwt import repeated_windows
from refloom.llm.common import KEY, changes, cut, rolling, signed, small_batches, text_slices, texts_of, whole, window_minima

WIDTH = 400
#: Bytes of an anchor: the lowest-hashed run of so many bytes in a window. A region is a run of windows with the same anchor.
ANCHOR = 100
ANCHOR_BASE, WINDOW_BASE, CORE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Bytes of regions that one part sorts, unless one region alone is longer.
PART_BYTES = 750_000
#: Parts that a task goes through one after the other, so that there are fewer and larger files.
PARTS_PER_TASK = 8
#: Windows of one region at most; one with more is cut.
REGION = 1 << 16
#: Windows of one core: those whose anchor lies in the same stretch of so many offsets.
CORE_STEP = 16


def signature(text: bytes) -> tuple[int, int]:
    """128 bits of a text, as two signed longs."""
    x = xxhash.xxh3_128_digest(text)
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def anchored(data: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window, its anchor's hash and position."""
    runs = rolling(data, anchor, ANCHOR_BASE)
    at = window_minima(runs, width - anchor + 1)
    return runs[at], at


def parsed_documents(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """A row for each document (columns id, s1, s2, text): id, s1, s2, n_bytes, anchors (hashes of its regions' anchors, repeats included)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            anchors = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < width:
                    anchors.append(np.zeros(0, np.int64))
                    continue
                hashes, at = anchored(data[a:b], width, anchor)
                starts = changes(hashes)
                several = at[starts] != at[np.append(starts[1:], len(at)) - 1]  # a region with an anchor in several places can repeat itself
                anchors.append(np.concatenate([hashes[starts], hashes[starts][several]]).view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(anchors)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.diff(bounds)), lists], ["id", "s1", "s2", "n_bytes", "anchors"])

    return docs.select(*KEY, "text").mapInArrow(work, "id long, s1 long, s2 long, n_bytes long, anchors array<long>")


def shared_regions(docs: DataFrame, live: DataFrame, width: int, anchor: int) -> DataFrame:
    """The regions of documents at anchors that occur more than once: anchor, d1, d2 (signature), id, s1, s2, start, size, offset, bytes.

    offset is the anchor's place in the region, -1 if it occurs there several times. Such a region has no bound (a periodic text is one), so it is cut
    into pieces of REGION windows, which are regions of the same anchor like any others.
    """
    schema = "anchor long, d1 long, d2 long, id long, s1 long, s2 long, start long, size long, offset int, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            out: list[tuple] = []
            for k, wanted in enumerate(rows.column(4).to_pylist()):
                text = data[bounds[k] : bounds[k + 1]]
                raw = text.tobytes()
                key = [rows.column(c)[k].as_py() for c in range(3)]
                hashes, at = anchored(text, width, anchor)
                starts = changes(hashes)
                ends = np.append(starts[1:], len(hashes))
                used = np.isin(hashes[starts], np.array(wanted, np.int64).view(np.uint64))
                for a, b in ((x, min(x + REGION, b)) for a, b in zip(starts[used].tolist(), ends[used].tolist(), strict=True) for x in range(a, b, REGION)):
                    part = raw[a : b - 1 + width]
                    single = at[a] == at[b - 1] and at[b - 1] - a <= width - anchor
                    out.append((int(hashes[a].view(np.int64)), *signature(part), *key, a, len(part), int(at[a] - a) if single else -1, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _schema(schema), strict=True)], names)

    return docs.join(live, KEY).select(*KEY, "text", "anchors").mapInArrow(work, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _reach(sides: list[bytes], groups: np.ndarray) -> np.ndarray:
    """For each side, the longest prefix that it shares with another one of its group."""
    longest = max(map(len, sides), default=0)
    order = sorted(range(len(sides)), key=lambda k: (groups[k], sides[k]))
    table = np.zeros((len(sides), longest + 1), np.uint8)
    sizes = np.array([len(sides[k]) for k in order], np.int64)
    table[:, :longest] = np.frombuffer(b"".join(sides[k].ljust(longest, b"\0") for k in order), np.uint8).reshape(len(sides), longest)
    table[1::2, longest] = 1  # a difference beyond the end
    same = (table[1:] != table[:-1]).argmax(axis=1)
    same = np.where(groups[order][1:] == groups[order][:-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1])), 0)
    out = np.zeros(len(sides), np.int64)
    out[order] = np.maximum(np.append(same, 0), np.concatenate([[0], same]))
    return out


def trimmed(regions: list[bytes], anchors: np.ndarray, offsets: np.ndarray, width: int, anchor: int) -> list[tuple[int, int]]:
    """The part of each region that can match another one with its anchor: as far to either side as some other agrees.

    Groups in which an anchor occurs twice in one region are left whole.
    """
    number = np.unique(anchors, return_inverse=True)[1]
    plain = ~np.isin(number, number[offsets < 0])
    out = [(0, len(r)) for r in regions]
    at = np.flatnonzero(plain).tolist()
    if at:
        left = _reach([regions[k][: offsets[k]][::-1] for k in at], number[at])
        right = _reach([regions[k][offsets[k] + anchor :] for k in at], number[at])
        for k, a, b in zip(at, left.tolist(), right.tolist(), strict=True):
            p = int(offsets[k])
            out[k] = (p - a, p + anchor + b) if a + b + anchor >= width else (0, 0)
    return out


FOUND = "kind int, id long, s1 long, s2 long, start long, end long, anchor long, core long, windows array<long>, open array<long>"


def _part(rows: list[dict], width: int, anchor: int) -> list[tuple]:
    """Repeats in one part. kind 0: windows start to end - 1 of a document are repeated. kind 1: windows of one core that are yet to be
    compared with other parts of a salted anchor; open has a 1 for each that isn't known to be repeated."""
    regions = [r["bytes"] for r in rows]
    ranges = trimmed(regions, np.array([r["anchor"] for r in rows]), np.array([r["offset"] for r in rows]), width, anchor)
    used = [k for k, (a, b) in enumerate(ranges) if b - a >= width]
    flags = {k: np.zeros(max(0, len(r) - width + 1), np.int8) for k, r in enumerate(regions)}  # 1: repeated, 2: repeated and first of its set
    if used:
        starts, repeated, leader = repeated_windows([regions[k][slice(*ranges[k])] for k in used], width)
        marks = repeated.astype(np.int8) + leader
        for k, s in zip(used, starts.tolist(), strict=True):
            a, b = ranges[k]
            n = b - a - width + 1
            flags[k][a : a + n] = marks[s : s + n]
    out: list[tuple] = []
    for k, r in enumerate(rows):
        mark = flags[k]
        if r["own"]:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (mark > 0).astype(np.int8), [0]])))
            out += [(0, *(r[c] for c in KEY), r["start"] + a, r["start"] + b, None, None, None, None) for a, b in edges.reshape(-1, 2).tolist()]
        if r["salted"]:
            text = np.frombuffer(r["bytes"], np.uint8)
            windows = rolling(text, width, WINDOW_BASE)
            # a core is what all windows with their anchor in one stretch of offsets have in common
            at = anchored(text, width, anchor)[1]
            stretch = (at - np.arange(len(at))) // CORE_STEP
            place = at - stretch * CORE_STEP
            inner = rolling(text, width - CORE_STEP + 1, CORE_BASE)
            emitted = np.flatnonzero(mark != 1)  # of windows that are repeated here, one stands for its set
            opens = np.where((mark == 0) & r["own"], r["start"] + np.arange(len(mark)), -1)
            keys = stretch[emitted] * (len(text) + 1) + place[emitted]
            order = np.argsort(keys, kind="stable")
            for mine in np.split(emitted[order], changes(keys[order])[1:]) if len(emitted) else ():
                g, c = int(stretch[mine[0]]), int(place[mine[0]])
                out.append((1, *(r[x] for x in KEY), None, None, r["anchor"], int(inner[c].view(np.int64)) ^ g, windows[mine].view(np.int64).tolist(), opens[mine].tolist()))
    return out


def _repeats(parts: DataFrame, width: int, anchor: int) -> DataFrame:
    """parts: part, anchor, id, s1, s2, start, offset, own, salted, bytes, sorted by part within partitions."""

    def emitted(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = _part(rows, width, anchor)
        for k in range(0, len(found), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[k : k + 5000], strict=True), _schema(FOUND), strict=True)], [f.name for f in _schema(FOUND)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != held[0]["part"]:
                    yield from emitted(held)
                    held = []
                held.append(row)
        if held:
            yield from emitted(held)

    return parts.mapInArrow(work, FOUND)


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repeated windows of documents (columns id, s1, s2, text, as signed() has them; no null ids).

    Returns (parsed, found): parsed as parsed_documents() has it; found has id, s1, s2, spans (array of first window, end).

    1. Equal texts are one; they are repeated as a whole, and one of them takes part further on.
    2. Equal windows have equal anchors, so only the regions of anchors that occur more than once matter. Equal regions are one, too, and
       repeated as a whole if there are several.
    3. Regions of anchors with several different ones are dealt to parts of bounded size by anchor; each part is sorted and expanded by
       repeated_windows().
    4. An anchor with more than a part's bytes is salted over several parts. Windows that are not repeated in their own part, and one of each
       set that is, are then compared between parts by their hashes: first by cores that up to CORE_STEP windows share, which drops
       nearly all that have no equal, then one by one.
    """
    spark = docs.sparkSession
    parsed = cut(parsed_documents(docs, width, anchor))
    long_enough = parsed.where(F.col("n_bytes") >= width)
    firsts = long_enough.groupBy("s1", "s2").agg(F.min("id").alias("id"))
    one_each = long_enough.join(firsts, ["s1", "s2", "id"], "left_semi").dropDuplicates(["s1", "s2", "id"])
    anchors = one_each.select(*KEY, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    live = anchors.join(shared, "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors"))
    regions = cut(shared_regions(docs, live, width, anchor))

    variants = regions.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start")).alias("pick"), F.first("size").alias("size"), F.min("offset").alias("offset"))
    itself = F.count_if((F.col("n") == 1) & (F.col("offset") < 0))
    groups = variants.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("size").alias("group_bytes"), F.count_if(F.col("n") == 1).alias("singles"), itself.alias("itself")).where("kinds > 1 AND singles > 0 OR itself > 0")
    groups = cut(groups.select("anchor", F.greatest(F.lit(1), F.ceil(F.col("group_bytes") / part_bytes)).alias("salts"), "group_bytes"))
    total = groups.agg(F.coalesce(F.sum("group_bytes"), F.lit(0))).first()[0]
    n_parts = int(2 * total // part_bytes) + 1
    salt = F.when(F.col("salts") > 1, F.pmod("d1", "salts")).otherwise(F.lit(-1))
    chosen = variants.join(groups, "anchor").select("anchor", "d1", "d2", "pick.*", (F.col("n") == 1).alias("own"), (F.col("salts") > 1).alias("salted"), F.pmod(F.xxhash64("anchor", salt), F.lit(n_parts)).alias("part"))
    rows = regions.join(chosen, ["anchor", "d1", "d2", *KEY, "start"]).select("part", "anchor", *KEY, "start", "offset", "own", "salted", "bytes")
    tasks = max(1, n_parts // PARTS_PER_TASK)
    found = cut(_repeats(rows.repartition(tasks, "part").sortWithinPartitions("part"), width, anchor)) if total else spark.createDataFrame([], FOUND)

    spans = found.where("kind = 0").select(*KEY, F.struct("start", "end").alias("span"))
    several = cut(variants.where("n > 1").select("anchor", "d1", "d2"))
    entire = regions.join(several, ["anchor", "d1", "d2"]).select(*KEY, F.struct("start", (F.col("start") + F.col("size") - width + 1).alias("end")).alias("span"))
    cores = found.where("kind = 1").select("anchor", "core", *KEY, "windows", "open")
    common = cores.groupBy("anchor", "core").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "core")
    windows = cores.join(common, ["anchor", "core"]).select("anchor", *KEY, F.explode(F.arrays_zip("windows", "open")).alias("x")).select("anchor", *KEY, "x.windows", "x.open")
    equal = windows.groupBy("anchor", "windows").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "windows")
    crossed = windows.where("open >= 0").join(equal, ["anchor", "windows"]).select(*KEY, F.struct(F.col("open").alias("start"), (F.col("open") + 1).alias("end")).alias("span"))
    return parsed, spans.unionByName(entire).unionByName(crossed).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))


def deduplicate(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row's id_column, n_bytes, n_removed, n_spans and kept (binary: the bytes left).

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in its own text too; overlapping repeats count.
    Strings are judged on the input, so no copy of a repeated string stays. Null texts are empty. A repeated row, or another row with
    an equal text, loses all if the text is that long. Null ids are ids like others.
    """
    small_batches(docs.sparkSession)
    text = whole(text_column)
    own = signed(F.coalesce(F.col(id_column).cast("long"), F.xxhash64(text, F.lit("no id"))), docs, text_column, F.col(id_column).cast("long").alias("own"))
    source = own.drop("own")
    parsed, found = repeats(source, width, anchor, part_bytes)
    several = cut(parsed.where(F.col("n_bytes") >= width).groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2"))  # written, so that the join with it can split a text with very many copies
    copies = parsed.join(several, ["s1", "s2"]).select(*KEY, F.lit(True).alias("entire")).distinct()
    plans = copies.join(found, KEY, "full").select(*KEY, F.struct("entire", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).alias("plan"))
    joined = own.join(plans, KEY, "left").select("own", "text", "plan")  # rows with one id can have several texts, each with its own plan

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            out: list[tuple] = []
            for i, p, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), texts_of(bounds, data), strict=True):
                runs: list[list[int]] = []
                if p and p["entire"]:
                    runs = [[0, len(text)]]
                elif p:
                    for a, b in sorted(zip(p["starts"], p["ends"], strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b - 1 + width)
                        else:
                            runs.append([a, b - 1 + width])
                edges = [0, *(x for run in runs for x in run), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((i, len(text), len(text) - len(left), len(runs), left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(work, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_column)
