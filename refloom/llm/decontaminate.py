"""Operator 10: benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import cut, whole

#: Positions that a seed reads (1) and ignores (0). The two together hit every stretch of 13 tokens of which any 2 are replaced. Shorter items have
#: masks of ones at fixed places, see short_parts().
MASKS = ("111101001", "100110111")
SPAN = len(MASKS[0])
#: Tokens of the stretch that is compared around a hit, and the share of them that must agree.
STRETCH, AGREE = 13, 0.8
#: Benchmark seeds up to which their table is broadcast: 32 bytes each.
BROADCAST_SEEDS = 1_000_000
#: Alignments of one text that are compared in one row.
CHUNK = 2048
TEXT = ("h1", "h2")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def short_parts(n: int) -> tuple[int, list[int]]:
    """Seed width and places in an item of n tokens, under STRETCH: it falls into one more part than tokens may be replaced, so some part is whole."""
    parts = n - math.ceil(round(n * AGREE, 9)) + 1
    return n // parts, [n * k // parts for k in range(parts)]


def seeds(rows: DataFrame, keys: list[str], words: str, place: str, masks: tuple[str, ...]) -> DataFrame:
    """keys, place (of the seed's first token), seed: a hash for each mask at each position; rows with fewer tokens than a mask spans have none of it.

    The token array is zipped with itself, shifted by each of a mask's positions, so that hashing runs on plain columns in generated code; a
    function over the array would be interpreted for each token. Masks of one span share that.
    """
    found = None
    for span in sorted({len(m) for m in masks}):
        n = F.greatest(F.size(words) - (span - 1), F.lit(0))
        shifted = F.arrays_zip(*(F.slice(words, F.lit(k + 1), n).alias(f"t{k}") for k in range(span)))
        made = [F.xxhash64(F.lit(m), *(F.col(f"_t.t{k}") for k, bit in enumerate(m) if bit == "1")) for m in masks if len(m) == span]
        own = rows.select(*keys, F.posexplode(shifted).alias(place, "_t")).select(*keys, place, F.explode(F.array(*made)).alias("seed"))
        found = own if found is None else found.unionByName(own)
    return found


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias(TEXT[0]), F.xxhash64(F.lit(1), text).alias(TEXT[1])]


def leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """h1, h2, item, n_tokens, n_equal: the pairs of texts (text, h1, h2) and items (item, item_words) that overlaps() describes; equal texts are one.

    1. Seeds of both sides are joined by hash. A hit fixes an alignment of text and item.
    2. All alignments of a text come together, CHUNK in a row; each row meets the text once, splits it once, and gives each alignment the tokens
       beside the item alone.
    3. Those are compared with the item's tokens.
    """
    sized = items.withColumn("n", F.size("item_words"))
    item_seeds, masks = seeds(sized.where(F.col("n") >= STRETCH), ["item", "n"], "item_words", "item_at", MASKS), set(MASKS)
    for n in sorted(r.n for r in sized.where(F.col("n") < STRETCH).select("n").distinct().collect()):  # 12 lengths at most
        width, places = short_parts(n)
        masks.add("1" * width)
        item_seeds = item_seeds.unionByName(seeds(sized.where(F.col("n") == n), ["item", "n"], "item_words", "item_at", ("1" * width,)).where(F.col("item_at").isin(places)))
    item_seeds = item_seeds.distinct()
    small = item_seeds.count() <= BROADCAST_SEEDS
    hits = seeds(texts.select(*TEXT, tokens(F.col("text")).alias("words")), list(TEXT), "words", "at", tuple(sorted(masks))).join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    aligned = cut(hits.select(*TEXT, "item", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    aligned = aligned.withColumn("chunk", F.pmod(F.xxhash64("item", "shift"), F.ceil(F.count("*").over(Window.partitionBy(*TEXT)) / CHUNK)))
    rows = aligned.groupBy(*TEXT, "chunk").agg(F.collect_list(F.struct("item", "n", "shift")).alias("alignments"))
    hit = texts.join(aligned.select(*TEXT).distinct(), list(TEXT), "left_semi").groupBy(*TEXT).agg(F.first("text").alias("text"))

    def beside(words: Column, x: Column) -> Column:
        # beyond an end there is nothing, which agrees with nothing
        before = F.array_repeat(F.lit(None).cast("string"), F.least(x["n"], F.greatest(-x["shift"], F.lit(0))).cast("int"))
        return F.concat(before, F.slice(words, (F.greatest(x["shift"], F.lit(0)) + 1).cast("int"), F.greatest(x["n"] + F.least(x["shift"], F.lit(0)), F.lit(0)).cast("int")))

    # bound once, as the only element of an array: the text is split once for each row
    cut_out = F.get(F.transform(F.array(tokens(F.col("text"))), lambda w: F.transform("alignments", lambda x: F.struct(x["item"].alias("item"), beside(w, x).alias("own")))), F.lit(0))
    pairs = rows.join(hit, list(TEXT)).select(*TEXT, F.explode(cut_out).alias("x")).select(*TEXT, "x.item", "x.own").join(sized, "item")
    n, stretch = F.col("n"), F.least(F.lit(STRETCH), F.col("n"))
    equal = F.zip_with(F.slice("own", F.lit(1), n), F.col("item_words"), lambda t, w: F.when(t == w, 1).otherwise(0))

    def judged(e: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), n - stretch + 1), lambda s: F.aggregate(F.slice(e, s, stretch), F.lit(0), lambda x, y: x + y))
        return F.struct(F.array_max(sums).alias("best"), F.aggregate(e, F.lit(0), lambda x, y: x + y).alias("total"))

    agreed = pairs.select(*TEXT, "item", "n", stretch.alias("stretch"), F.explode(F.transform(F.array(equal), judged)).alias("_j")).where(F.col("_j.best") >= F.ceil(F.round(F.col("stretch") * AGREE, 9)))
    return agreed.groupBy(*TEXT, "item").agg(F.max("n").cast("long").alias("n_tokens"), F.max("_j.total").cast("long").alias("n_equal"))


def _items(benchmark: DataFrame, item_column: str, item_text: str, shortest: int) -> DataFrame:
    items = benchmark.select(F.col(item_column).alias("item"), tokens(whole(item_text)).alias("item_words")).where("item IS NOT NULL").distinct()
    return items.where(F.size("item_words") >= max(shortest, 1))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", shortest: int = 1) -> DataFrame:
    """Documents that hold a passage of a benchmark item, a row for each pair: id_column, item_column, n_tokens (of the item), n_equal (of the
    item's tokens that agree at the best alignment), share (of the two).

    A pair counts if, at some alignment, a stretch of 13 tokens in a row (the whole item, if it is shorter) agrees in 80 % of them at least:
    replaced tokens are tolerated, inserted or lost ones end a stretch. Items of fewer tokens than `shortest` are left out: one of one or two words is
    in many documents that don't come from it.

    The item side is broadcast only if it is counted and small; else both sides are shuffled by seed, and Spark splits hot seeds. Null ids and
    null texts are never found; rows with the same id are one document for the result; repeated items are found each.
    """
    own = docs.select(F.col(id_column).alias("id"), whole(text_column).alias("text")).where("id IS NOT NULL").select("id", "text", *text_key(F.col("text")))
    items = _items(benchmark, item_column, item_text, shortest)
    joined = own.select("id", *TEXT).distinct().join(leaks(own, items), list(TEXT))
    found = joined.groupBy("id", "item").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_equal").alias("n_equal"))
    return found.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "n_tokens", "n_equal", (F.col("n_equal") / F.col("n_tokens")).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", shortest: int = 5) -> DataFrame:
    """docs without the texts in which overlaps() finds an item. Texts are judged, not ids: another text with the same id stays, and one with a null id goes, too.

    Items under five tokens don't count here: they would take every document with a common phrase.
    """
    marked = docs.withColumns({f"_{k}": c for k, c in zip(TEXT, text_key(whole(text_column)), strict=True)})
    texts = marked.select(whole(text_column).alias("text"), *(F.col(f"_{k}").alias(k) for k in TEXT))
    bad = leaks(texts, _items(benchmark, item_column, item_text, shortest)).select(*(F.col(k).alias(f"_{k}") for k in TEXT)).distinct()
    return marked.join(bad, [f"_{k}" for k in TEXT], "left_anti").select(*docs.columns)
