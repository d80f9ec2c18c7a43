"""Operator 8: bottom-k sketches of shingle hashes, with DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import SPACES, whole

#: Hashes that a sketch keeps, and words of a shingle.
KEEP, SHINGLE = 96, 5


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of `shingle` words; fewer words make one run, none make no hash."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle))))

    # the words' hashes are bound once, as the only element of an array
    bound = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= shingle, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.get(bound, F.lit(0)))


def sketch(text: Column, keep: int = KEEP, shingle: int = SHINGLE) -> Column:
    """The `keep` lowest shingle hashes, ascending. A text with no more shingles has them all."""
    return F.slice(F.sort_array(shingle_hashes(text, shingle)), 1, keep)


def shown(sketched: Column) -> Column:
    """A sketch as text: 12 hex digits of each hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 16))), 12, "0")), "")


def union(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, keep)


def resemblance(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated share of all shingles that both have: that of the joint sketch. Two empty sketches are alike (1), one is unlike any other (0)."""
    joint = union(a, b, keep)
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(joint, a), b)) / F.size(joint))


def distinct_shingles(a: Column, keep: int = KEEP) -> Column:
    """Estimated number of distinct shingles; exact below `keep`."""
    share = (F.get(a, F.lit(keep - 1)).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    return F.when(F.size(a) < keep, F.size(a).cast("double")).otherwise((keep - 1) / share)


def containment(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the size of the union, over the size of a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, keep) * distinct_shingles(union(a, b, keep), keep) / distinct_shingles(a, keep)))


def merge(sketches: DataFrame, by: list[str], column: str = "sketch", keep: int = KEEP) -> DataFrame:
    """One sketch for each group of sketches, however many: duplicates go and each task keeps `keep` hashes of a group before the shuffle."""
    lowest = Window.partitionBy(*by).orderBy("_h")
    hashes = sketches.select(*by, F.explode(column).alias("_h")).distinct().withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= keep)
    return hashes.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _splitters(keys: DataFrame, rows: int, buckets: int, draws: int) -> list[tuple]:
    """Keys (known, id, head) that cut the rows into so many buckets of about the same size: quantiles of a sample of `draws` for each bucket."""
    if buckets < 2:
        return []
    chance = F.pmod(F.xxhash64("known", "id", "head", F.lit("splitter")), F.lit(1 << 40))
    sample = sorted(tuple(r) for r in keys.where(chance < F.lit(int((1 << 40) * min(1.0, draws * buckets / rows)))).collect())
    return sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else []


def _bucket_of(key: Column, splitters: list[tuple]) -> Column:
    """Number of splitters at or before a key: those of a coarse choice are counted, then those of one stretch of the rest."""
    if not splitters:
        return F.lit(0)
    step = math.isqrt(len(splitters)) + 1
    kind = "struct<known:boolean,id:bigint,head:string>"

    def listed(value: list, ddl: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), ddl)

    named = [dict(zip(("known", "id", "head"), s, strict=True)) for s in splitters]
    stretches = listed([{"s": named[k : k + step]} for k in range(0, len(named), step)], f"array<struct<s:array<{kind}>>>")
    coarse = F.size(F.filter(listed(named[::step], f"array<{kind}>"), lambda s: s <= key))
    fine = F.size(F.filter(F.get(stretches, F.greatest(coarse - 1, F.lit(0)))["s"], lambda s: s <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id", order: tuple[str, ...] = ("text",), rows_per_bucket: int = 1000, max_buckets: int = 16_384, draws: int = 16) -> DataFrame:
    """docs with next_<column> for each of columns: the value in the next row by ascending id (ties: by `order`); after the last comes the first.

    Rows fall into ranges of about the same number of rows, whatever the ids' spread: the splitters are quantiles of a sample of ids and, for rows that
    share an id, the first characters of the first column of `order`. Within a range a window looks ahead; a range's last row takes the first of the
    next range that has rows, for which the ranges' numbers, max_buckets at most, meet in one task. Null ids come first. The driver sees the sample of
    `draws` keys a range.
    """
    key = F.struct(F.col(id_column).isNotNull().alias("known"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("id"), F.substring(F.coalesce(F.col(order[0]).cast("string"), F.lit("")), 1, 12).alias("head"))
    n = docs.count()
    splitters = _splitters(docs.select(key.alias("k")).select("k.*"), n, min(max_buckets, n // rows_per_bucket), draws)
    ahead = Window.partitionBy("_bucket").orderBy(id_column, *order)
    rows = docs.withColumn("_bucket", _bucket_of(key, splitters))
    rows = rows.withColumns({f"_next_{c}": F.lead(F.struct(c), 1).over(ahead) for c in columns} | {"_row": F.row_number().over(ahead)})
    firsts = rows.where("_row = 1").select(F.col("_bucket").alias("_following"), *(F.struct(c).alias(f"_first_{c}") for c in columns))
    every = Window.orderBy("_bucket")
    numbers = rows.where("_row = 1").select("_bucket").withColumn("_following", F.coalesce(F.lead("_bucket").over(every), F.min("_bucket").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    linked = numbers.join(firsts, "_following").drop("_following")
    joined = rows.join(linked, "_bucket", "left")
    return joined.select(*docs.columns, *(F.coalesce(f"_next_{c}", f"_first_{c}")[c].alias(f"next_{c}") for c in columns))


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: int = KEEP, shingle: int = SHINGLE) -> DataFrame:
    """Each text's sketch beside that of its edited text and of the next row's.

    The edited text has the last half of the code points (rounded down) replaced by as many of the next text's first, or all it has. Returns
    id_column, n_chars, text, edited, sketch, edited_sketch, near_edited, near_next, n_shingles (estimate), kept_share (estimated share of
    the text's shingles that the edited one has). Null texts are empty; equal texts have equal sketches; rows with equal ids are
    ordered by text; one row alone is its own next.
    """
    own = docs.select(F.col(id_column), whole(text_column).alias("text"))
    own = own.withColumn("sketch", sketch(F.col("text"), keep, shingle))
    rows = with_next(own, ["text", "sketch"], id_column)
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) AS int))"), F.expr("left(next_text, cast(floor(length(text) / 2) AS int))")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), keep, shingle))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(id_column, "n_chars", "text", "edited", "sketch", "edited_sketch", resemblance(a, b, keep).alias("near_edited"), resemblance(a, c, keep).alias("near_next"), distinct_shingles(a, keep).alias("n_shingles"), containment(a, b, keep).alias("kept_share"))
