"""Operator 11: importance resampling towards a target by bucketed n-gram counts, through a dictionary of distinct features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import cut, numbered, small_batches, spread_join, text_slices, texts_of, whole

#: Words of a lower-cased text in UTF-8: digits, letters a to z, and all bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
#: A feature longer than this is never broadcast.
LONG_FEATURE = 200
#: A feature that makes up one of so many of all occurrences is joined by broadcast; there are so many of them at most.
FREQUENT = 100_000


def features_of(text: bytes, longest: int) -> tuple[int, Counter]:
    """Number of words, and how often each run of 1 to `longest` consecutive words occurs."""
    words = WORD.findall(text.lower())  # of bytes: A to Z alone
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
    return len(words), found


def counted_features(docs: DataFrame, longest: int = 1) -> DataFrame:
    """A row for each row of docs (columns id, text): id, n_words, n_features, features (array of feature and its count n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in text_slices(batches):
            found = [features_of(t, longest) for t in texts_of(bounds, data)]
            offsets = pa.array(np.cumsum([0, *(len(c) for _, c in found)]).astype(np.int32))
            counts = pa.array([n for _, c in found for n in c.values()], pa.int64())
            names = pa.array([f for _, c in found for f in c], pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([names, counts], ["feature", "n"]))
            words, total = pa.array([n for n, _ in found], pa.int64()), pa.array([c.total() for _, c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), words, total, lists], ["id", "n_words", "n_features", "features"])

    return docs.select("id", "text").mapInArrow(work, "id long, n_words long, n_features long, features array<struct<feature:string,n:long>>")


def dictionary(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, s, t (its counts in source and target, as counted_features() has them), bucket: each distinct feature once, hashed once."""
    flat = [d.select(F.explode("features").alias("x")).select("x.feature", *(F.col("x.n").alias(c) if c == own else F.lit(0).cast("long").alias(c) for c in "st")) for d, own in ((source, "s"), (target, "t"))]
    counts = flat[0].unionByName(flat[1]).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return counts.withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int"))


def gains(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the smoothed share in the target over that in the source. One row a bucket."""
    sums = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    source, target = (F.lit(float((x or 0) + buckets)) for x in sums.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * source / ((F.col("s") + 1).cast("double") * target)
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_column: Column, seed: int) -> Column:
    """Gumbel noise of a row in thousandths, from the first 8 hex digits of sha256(seed:id); a null id is written as nothing."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Every row's id_column, n_words, n_features, weight, score, rank (of those drawn; else null).

    Features are all runs of 1 to `longest` words of a text (A to Z lower-cased; digits, a to z and what lies beyond ASCII). A bucket's gain compares its share in
    the target with that in docs; weight is the floored mean of gains over a row's features, score is weight plus Gumbel noise. The `percent` highest scores
    are drawn from rows of least_words words, ties to smaller ids: sampling without replacement in proportion to exp(weight / 1000).

    1. Python counts each text's features; the counts are written once, with a row number.
    2. Features are counted globally by partial sums, and each distinct one is hashed once; buckets are sums over the dictionary.
    3. Gains return to rows by a join on the feature, whose very frequent ones are broadcast (spread_join), and are summed by row.
    4. Scores are ordered by ranges (numbered), not in one task.

    Null texts have no features: weight 0, never drawn. Repeated rows each count and may each be drawn; they are interchangeable. Null ids are
    drawn like others and precede in ties. An empty docs gives no rows; an empty target leaves what docs hold less of the higher gain. A text is
    held whole by one task, with its distinct features beside it.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    counted = cut(counted_features(own, longest).withColumn("row", F.monotonically_increasing_id()))
    wanted = counted_features(target.select(F.lit(None).cast("long").alias("id"), whole(target_column).alias("text")), longest)
    features = cut(dictionary(counted, wanted, buckets))
    total = features.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    known = features.where("s > 0").join(F.broadcast(gains(features, buckets)), "bucket").select("feature", "gain", F.when(F.octet_length("feature") <= LONG_FEATURE, F.col("s")).otherwise(0).alias("s"))
    single = counted.select("row", F.explode("features").alias("x")).select("row", "x.feature", "x.n")
    parts = spread_join(single, known, ["feature"], "s", max(total, 1), hot=FREQUENT).select("row", (F.col("gain") * F.col("n")).alias("sum"), *(F.lit(None).cast("long").alias(c) for c in ("id", "n_words", "n_features")))
    parts = parts.unionByName(counted.select("row", F.lit(0).cast("long").alias("sum"), "id", "n_words", "n_features"))
    rows = parts.groupBy("row").agg(F.sum("sum").alias("sum"), *(F.max(c).alias(c) for c in ("id", "n_words", "n_features")))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).cast("long")
    scored = rows.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("short", F.col("n_words") < least_words)
    placed = numbered(scored.drop("sum"), F.col("short"), F.desc("score"), F.col("id").asc_nulls_first(), F.col("row"))
    drawn = placed.agg(F.count_if(~F.col("short"))).first()[0] * percent // 100
    rank = F.when(~F.col("short") & (F.col("number") <= drawn), F.col("number"))
    return placed.select(F.col("id").alias(id_column), "n_words", "n_features", "weight", "score", rank.alias("rank"))
