"""Operator 7: shards of near-equal size from size-weighted sampled splitters."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import cut, whole

LEAST = -(1 << 63)


def _draws(expected: Column, salt: str) -> Column:
    """How often a record is drawn: its expected number, rounded up or down by a hash of its key."""
    chance = F.pmod(F.xxhash64("h", "id", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(expected + chance)


def _quantiles(rows: list[tuple], pieces: int) -> list[tuple[int, int]]:
    """Keys that cut a weighted sample (h, id, draws) into so many parts of about the same weight."""
    rows = sorted(rows)
    if not rows or pieces < 2:
        return []
    weight = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces)
    return sorted({(rows[k][0], rows[k][1]) for k in at.tolist()})


def _range_of(splitters: list[tuple[int, int]]):
    """Number of splitters at or before a key, as a column function of (h, id)."""
    heads = np.array([h for h, _ in splitters], np.int64)
    ids = np.array([i for _, i in splitters], np.int64)

    @F.pandas_udf("int")
    def ranged(h: pd.Series, i: pd.Series) -> pd.Series:
        key, own = h.to_numpy(), i.to_numpy()
        first, last = np.searchsorted(heads, key, "left"), np.searchsorted(heads, key, "right")
        out = first.copy()
        for a in np.unique(first[first < last]):
            here = (first == a) & (last > a)
            b = np.searchsorted(heads, heads[a], "right")
            out[here] = a + np.searchsorted(ids[a:b], own[here], "right")
        return pd.Series(out.astype(np.int32))

    return ranged


def _offsets(placed: DataFrame) -> pd.DataFrame:
    """Rows and bytes of the ranges, with those before each: one driver row a range, as many as splitters."""
    stats = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas().sort_values("part", ignore_index=True)
    stats["rows_before"] = stats["n"].cumsum() - stats["n"]
    stats["bytes_before"] = stats["bytes"].cumsum() - stats["bytes"]
    return stats


def shards(docs: DataFrame, count: int = 16, law: str = "bytes", id_column: str = "doc_id", text_column: str = "text", rows_per_range: int = 200, max_ranges: int = 8192, draws_per_range: int = 24) -> DataFrame:
    """Shard and slot of every row, by range partitioning on (hash of the text, id), so that equal texts stand together.

    law bytes: sizes near equal; law rows: counts at most one apart. Splitters are quantiles of a sample in which a record's chance grows
    with its size. Ranges that hold over twice their share (one text with very many copies, above all) are subdivided by splitters
    from a second sample: of hash and id inside a large group, of the hash alone elsewhere. A record's place follows from the exact totals of the ranges before its own and a running sum
    within it; the driver sees a row a range, max_ranges times three at most, and the samples, which are as bounded.

    A group of equal texts of up to a hundredth of a shard stays in one shard under law bytes; larger groups are cut where shards end.
    Returns id_column, size (UTF-8 bytes and 1; null as empty), text_crc32, law, shard (from 0), slot (from 0 without gaps in each
    shard). Null ids come first in a group; identical rows are interchangeable.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    text = whole(text_column)
    slim = cut(docs.select(F.col(id_column).alias("own_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h")))
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    share = max(total / ranges, 1.0)
    small_group = total / count / 100

    def sampled(rows: DataFrame, salt: str) -> list[tuple]:
        drawn = rows.select("h", "id", _draws(F.col("size") * F.lit(draws_per_range / share), salt).alias("draws")).where("draws > 0")
        return [tuple(r) for r in drawn.collect()]

    splitters = sorted({(h, LEAST) for h, _ in _quantiles(sampled(slim, "first"), ranges)})
    stats = _offsets(slim.withColumn("part", _range_of(splitters)("h", "id")))
    overfull = stats[(stats["bytes"] > 2 * share) & (stats["n"] > 1)]
    if len(overfull):
        pieces = dict(zip(overfull["part"].tolist(), np.ceil(overfull["bytes"] / share).astype(int).tolist(), strict=True))
        bounds = [(LEAST, LEAST), *splitters, (-LEAST - 1, -LEAST - 1)]
        inside = slim.withColumn("part", _range_of(splitters)("h", "id")).where(F.col("part").isin(*pieces))
        drawn = sorted(sampled(inside, "second"))
        keys = [r[:2] for r in drawn]
        wanted: list[tuple[int, int]] = []
        for part, k in pieces.items():
            wanted += _quantiles(drawn[bisect.bisect_left(keys, bounds[part]) : bisect.bisect_left(keys, bounds[part + 1])], k)
        # a group is cut by id only if it is a large one; a splitter inside a smaller group goes to the group's start
        several = [h for h, k in Counter(h for h, _ in wanted).items() if k > 1]
        large = {r.h for r in inside.where(F.col("h").isin(several)).groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > small_group).collect()} if several else set()
        splitters = sorted({*splitters, *(key if key[0] in large else (key[0], LEAST) for key in wanted)})
    placed = slim.withColumn("part", _range_of(splitters)("h", "id"))
    stats = _offsets(placed)
    before = slim.sparkSession.createDataFrame(stats[["part", "rows_before", "bytes_before"]], "part int, rows_before long, bytes_before long")

    order = Window.partitionBy("part").orderBy("h", "id", "crc", "size")
    group = Window.partitionBy("part", "h")
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
    if law == "rows":
        shard = F.floor(F.col("rank") * count / F.lit(max(n, 1)))
    else:
        ranked = ranked.withColumn("start", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        ranked = ranked.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
        small = F.col("group_bytes") <= small_group
        middle = F.when(small, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
        shard = F.floor(middle * count / F.lit(max(float(total), 1.0)))
    ranked = ranked.withColumn("shard", F.least(shard, F.lit(count - 1)).cast("int")).select("own_id", "size", "crc", "shard", "rank")
    firsts = {r.shard: r.first for r in ranked.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # `count` rows
    first = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(firsts.items()) for x in pair]), F.col("shard")) if firsts else F.lit(0)
    return ranked.select(F.col("own_id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", (F.col("rank") - first).alias("slot"))
