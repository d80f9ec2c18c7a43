"""Operator 2: substring deduplication by relative Lempel-Ziv parsing against the blocks of all earlier documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import KEY, changes, cut, rolling, signed, small_batches, text_slices, texts_of, window_minima

WINDOW = 50
#: Words of an anchor. A block is a run of windows with the same anchor: the lowest-hashed anchor-long run of words in each of them.
ANCHOR = 16
WINDOW_BASE, ANCHOR_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchored(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchor-long runs, and for every window the position of its anchor."""
    runs = rolling(hashes, anchor, ANCHOR_BASE)
    return runs, window_minima(runs, window - anchor + 1)


def parsed_documents(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """A row for each document (columns id, s1, s2, text): id, s1, s2, n_words, anchors (hashes of its anchors)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            n, anchors = [], []
            for text in texts_of(bounds, data):
                words = text.split()
                runs, at = anchored(word_hashes(words), window, anchor) if len(words) >= window else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                n.append(len(words))
                anchors.append(np.unique(runs[at[changes(at)]]).view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(anchors)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(n, pa.int64()), lists], ["id", "s1", "s2", "n_words", "anchors"])

    return docs.select(*KEY, "text").mapInArrow(work, "id long, s1 long, s2 long, n_words long, anchors array<long>")


def reference_blocks(docs: DataFrame, live: DataFrame, window: int, anchor: int) -> DataFrame:
    """The blocks of documents at anchors that several documents have.

    live: id, s1, s2, anchors (hashes). Returns anchor, block (hash of the block's words), id, s1, s2, start (first window), windows (their hashes).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            wanted = rows.column(4).to_pylist()
            for k, text in enumerate(texts_of(bounds, data)):
                words = text.split()
                hashes = word_hashes(words)
                runs, at = anchored(hashes, window, anchor)
                starts = changes(at)
                ends = np.append(starts[1:], len(at))
                used = np.isin(runs[at[starts]], np.array(wanted[k], np.int64).view(np.uint64))
                starts, ends = starts[used], ends[used]
                if not len(starts):
                    continue
                windows = rolling(hashes, window, WINDOW_BASE)
                # a block's hash: that of its windows' hashes in turn
                blocks = [xxhash.xxh64_intdigest(windows[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                inside = np.concatenate([windows[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)), pa.array(inside.view(np.int64)))
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs[at[starts]].view(np.int64)), pa.array(np.array(blocks, np.uint64).view(np.int64)), *(pa.array([rows.column(c)[k].as_py()] * n, pa.int64()) for c in range(3)), pa.array(starts.astype(np.int32)), lists],
                    ["anchor", "block", *KEY, "start", "windows"],
                )

    joined = docs.join(live, KEY).select(*KEY, "text", "anchors")
    return joined.mapInArrow(work, "anchor long, block long, id long, s1 long, s2 long, start int, windows array<long>")


def greedy_factors(starts: list[int], ends: list[int], sources: list[int], places: list[int]) -> list[tuple[int, int, int, int]]:
    """Relative Lempel-Ziv parse of one document: (start, end, source, place in the source) of its factors from left to right; literals lie between them.

    Matches with one source along one shift are one longer match where they overlap or meet. From each position that is reached, the match goes on
    that reaches furthest to the right; where none begins, words are literals up to the next one.
    """
    longest: list[list[int]] = []
    by_shift = sorted(zip(sources, (p - a for p, a in zip(places, starts, strict=True)), starts, ends, strict=True))
    for source, shift, a, b in by_shift:
        if longest and longest[-1][2:] == [source, shift] and a <= longest[-1][1]:
            longest[-1][1] = max(longest[-1][1], b)
        else:
            longest.append([a, b, source, shift])
    longest.sort()
    out: list[tuple[int, int, int, int]] = []
    at, k = 0, 0
    while True:
        best = None
        while k < len(longest) and longest[k][0] <= at:
            if longest[k][1] > at and (best is None or longest[k][1] > best[1]):
                best = longest[k]
            k += 1
        if best is None:
            while k < len(longest) and longest[k][1] <= at:
                k += 1
            if k == len(longest):
                return out
            at = longest[k][0]
            continue
        out.append((at, best[1], best[2], at + best[3]))
        at = best[1]


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches of every document (columns id, s1, s2, text, as signed() has them) with documents of smaller ids, each of `window` words or more.

    Returns (parsed, firsts, found): parsed as parsed_documents() has it; firsts has s1, s2 and the smallest id with that text; found has id, s1, s2,
    spans (array of first word, end, smallest source id, first word there). greedy_factors() extends them over block edges and parses the document.

    1. Equal texts are one: only the first takes part, the others are duplicates as a whole.
    2. Each window has an anchor that depends on its words alone, so equal windows have equal anchors. An anchor that one document
       has is no reference; its windows are literals.
    3. The windows of one anchor form a block. A block that an earlier document has matches as a whole, at its place there; so do the next ones
       along the same shift, and together they are a factor.
    4. Where a block has no such source, a factor begins or ends in it: there alone its windows are looked up one by one among those of all
       blocks with this anchor.
    Blocks and windows are grouped with partial aggregation, then joined: a passage in very many documents is one row before the join. What is
    grouped is written first, so that both sides of the join are plain exchanges, and Spark splits the hot keys of the other side.
    """
    parsed = cut(parsed_documents(docs, window, anchor))
    known = parsed.where("id IS NOT NULL")
    firsts = cut(known.groupBy("s1", "s2").agg(F.min("id").alias("id")))
    anchors = known.where(F.col("n_words") >= window).join(firsts, ["s1", "s2", "id"], "left_semi").select(*KEY, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    live = anchors.join(shared, "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors"))
    blocks = cut(reference_blocks(docs, live, window, anchor))

    variants = cut(blocks.groupBy("anchor", "block").agg(F.min(F.struct("id", "start")).alias("first")))
    several = cut(variants.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    placed = blocks.join(variants, ["anchor", "block"])
    end = F.col("start") + F.size("windows") - 1 + window
    entire = placed.where("id > first.id").select(*KEY, F.struct(F.col("start"), end.alias("end"), F.col("first.id").alias("source"), F.col("first.start").alias("place")).alias("span"))
    edges = placed.where("id = first.id").join(several, "anchor", "left_semi").select("anchor", *KEY, F.posexplode("windows").alias("k", "w"), "start")
    at = F.col("start") + F.col("k")
    lowest = cut(edges.groupBy("anchor", "w").agg(F.min(F.struct("id", at.alias("place"))).alias("low"), F.max("id").alias("high")).where("low.id < high").select("anchor", "w", "low"))
    single = edges.join(lowest, ["anchor", "w"]).where("id > low.id").select(*KEY, F.struct(at.alias("start"), (at + window).alias("end"), F.col("low.id").alias("source"), F.col("low.place").alias("place")).alias("span"))
    found = entire.unionByName(single).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))
    return parsed, firsts, found


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id_column, n_words, n_removed, factors, kept_words (the words left, joined by one space).

    factors: the duplicate spans as an array of start, end (words), source (a smaller id) and place (first word there).

    Words are runs of other bytes than the six ASCII blanks. A word goes if a window of `window` words that covers it also starts in a
    row with a smaller id; windows are judged on the input. Null texts have no words. Rows with a null id neither lose words nor take
    any. Rows with the same id never take words from each other.
    """
    small_batches(docs.sparkSession)
    source = signed(F.col(id_column).cast("long"), docs, text_column)
    parsed, firsts, found = factors(source, window, anchor)
    copies = parsed.where((F.col("id").isNotNull()) & (F.col("n_words") >= window)).join(firsts.withColumnRenamed("id", "first"), ["s1", "s2"]).where("id > first").select(*KEY, F.col("first").alias("entire")).distinct()
    plans = copies.join(found, KEY, "full").select(*KEY, F.struct("entire", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), F.col("spans.source").alias("sources"), F.col("spans.place").alias("places")).alias("plan"))
    joined = source.join(plans, KEY, "left").select("id", "text", "plan")  # rows with one id can have several texts, each with its own plan

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            out: list[tuple] = []
            for i, p, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), texts_of(bounds, data), strict=True):
                words = text.split()
                keep = np.ones(len(words), bool)
                parts: list[tuple[int, int, int, int]] = []
                if p and p["entire"] is not None:
                    parts = [(0, len(words), p["entire"], 0)]
                elif p:
                    parts = greedy_factors(p["starts"], p["ends"], p["sources"], p["places"])
                for a, b, _, _ in parts:
                    keep[a:b] = False
                left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if parts else b" ".join(words)
                out.append((i, len(words), int((~keep).sum()), [dict(zip(("start", "end", "source", "place"), x, strict=True)) for x in parts], left.decode()))
            kinds = (*[pa.int64()] * 3, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "source", "place")])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_words", "n_removed", "factors", "kept_words"])

    return joined.mapInArrow(work, "id long, n_words long, n_removed long, factors array<struct<start:long,end:long,source:long,place:long>>, kept_words string").withColumnRenamed("id", id_column)
