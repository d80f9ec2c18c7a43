"""Edited entries beside the published list: greedy one-to-one alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.similarity import edits
from refloom.functions.text import collapse, solid_key, without_authors
from refloom.operators import near
from refloom.operators.shared import Written

# Accepted likeness, and the least that a title or a DOI inside the other string gives.
ACCEPT, TITLE_FOUND, DOI_FOUND = 0.45, 0.90, 0.99


#: From here on a pair is strong: all strong pairs are found first, and only entries that need more are compared with all lines.
STRONG = 0.90
#: Rows of either side in a tile, for strong pairs (found by bounds that cost little) and for all others.
STRONG_TILE, TILE = 1024, 192
#: Pairs that are sent on together.
BATCH = 8192
PAIR = ["doc_id", "seq", "pos", "score"]
#: Rows of either side up to which a list goes whole to one task, and rows of such lists in a task.
LIST_ROWS, TASK_ROWS = 1000, 100_000


def scored(left: DataFrame, right: DataFrame, threshold: float, tile: int) -> DataFrame:
    """doc_id, seq, pos, score of the pairs of a list that reach the threshold, from tiles of both sides.

    left: doc_id, seq, key, title_key, doi, place (1, 2, 3 ... in the list's order or more); right: doc_id, pos, key, low. A DOI or a long title that stands in the other
    string lifts the score. Of an entry's pairs in a tile as many are kept as its place says: each entry before it takes one line at most.
    """
    own = left.select(F.col("doc_id").cast("string").alias("block"), F.col("seq").alias("number"), "key", F.col("title_key").alias("more"), "doi", "place")
    other = right.select(F.col("doc_id").cast("string").alias("block"), F.col("pos").alias("number"), "key", F.col("low").alias("more"), F.lit("").alias("doi"), F.lit(0).alias("place"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = near.Comparer(autojunk=False)
        out: list[tuple[int, int, int, float]] = []

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, pa.float64()), strict=True)], PAIR)

        for doc, mine, theirs in near.tile_groups(batches):
            a, titles, dois, places = (mine.column(c).to_pylist() for c in ("key", "more", "doi", "place"))
            b, lows = (theirs.column(c).to_pylist() for c in ("key", "more"))
            seq, pos = mine.column("number").to_pylist(), theirs.column("number").to_pylist()
            scores: dict[tuple[int, int], float] = {}
            for i, (title, doi) in enumerate(zip(titles, dois, strict=True)):
                if len(title) >= 8:
                    scores |= {(i, j): TITLE_FOUND for j, key in enumerate(b) if title in key}
                if doi:
                    scores |= {(i, j): DOI_FOUND for j, low in enumerate(lows) if doi in low}
                if not a[i]:  # nothing equals nothing
                    scores |= {(i, j): 1.0 for j, key in enumerate(b) if not key}
            rows, columns = near.screened(a, b, threshold)
            order = np.argsort(columns, kind="stable")
            for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
                comparer.against(b[j])
                floor = scores.get((i, j), 0.0)
                score = comparer.score(a[i], max(threshold, floor))
                if score > floor:
                    scores[i, j] = score
            by_row: dict[int, list[tuple[float, int]]] = {}
            for (i, j), score in scores.items():
                by_row.setdefault(i, []).append((-score, pos[j]))
            out += [(int(doc), seq[i], p, -s) for i, found in by_row.items() for s, p in sorted(found)[: places[i]]]
            if len(out) >= BATCH:  # lists are small: many go into one batch
                yield written()
                out = []
        if out:
            yield written()

    return near.tiled(own, other, ("number", "key", "more", "doi", "place"), tile).mapInArrow(work, "doc_id long, seq long, pos long, score double")


def chosen_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, seq, pos, score: in the order of a list's entries, each takes the best line that is still free, the first of equals.

    The order is kept without going through a list one by one. All strong pairs are found first, by bounds; entries without one are compared with all lines. Then in
    rounds, over all lists at once:

    * of an entry's pairs only as many matter as there are open entries before it, and one more;
    * a pair is safe if no open entry before has a pair with its line. An entry never goes below its best safe pair, so what lies below is dropped, and frees lines for others;
    * an entry whose best pair is safe takes it; the line is gone for the rest;
    * an entry that may lose all its strong pairs holds up those after it in its list, for it could take any line. If it does lose them, it is compared
      with all lines that are left.

    The first open entry of each list is settled in every round; as a rule nearly all are in a few. Each round is written and read back.
    """
    inputs = Written(left.sparkSession)  # every round reads both sides: what they were made from is not made again
    left, right = inputs.cut(left), inputs.cut(right)
    written = Written(left.sparkSession)
    strong = written.cut(scored(left, right, STRONG, STRONG_TILE).withColumn("full", F.lit(False)))
    weak = left.join(strong.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_anti")
    pairs = written.cut(strong.unionByName(scored(weak, right, ACCEPT, TILE).withColumn("full", F.lit(True))))
    written.drop(keep=1)
    settled: DataFrame | None = None
    results = Written(left.sparkSession)
    while not pairs.isEmpty():
        entry, in_list = Window.partitionBy("doc_id", "seq"), Window.partitionBy("doc_id").orderBy("seq")
        open_before = pairs.select("doc_id", "seq").distinct().withColumn("turn", F.row_number().over(in_list))
        ranked = pairs.withColumn("rank", F.row_number().over(entry.orderBy(F.desc("score"), "pos"))).join(open_before, ["doc_id", "seq"]).where("rank <= turn")
        first = ranked.groupBy("doc_id", "pos").agg(F.min("seq").alias("first"))
        ranked = ranked.join(first, ["doc_id", "pos"]).withColumn("safe", F.col("first") == F.col("seq"))
        rows = ranked.groupBy("doc_id", "seq", "full", "turn").agg(F.min(F.when(F.col("safe"), F.col("rank"))).alias("floor"), F.count("*").alias("n"))
        threat = rows.where(~F.col("full") & F.col("floor").isNull() & (F.col("n") < F.col("turn"))).groupBy("doc_id").agg(F.min("seq").alias("threat"))
        judged = ranked.join(rows.select("doc_id", "seq", "floor"), ["doc_id", "seq"]).join(threat, "doc_id", "left")
        calm = F.col("threat").isNull() | (F.col("seq") < F.col("threat"))
        judged = written.cut(judged.where(~calm | F.col("floor").isNull() | (F.col("rank") <= F.col("floor"))).withColumn("taken", calm & F.col("safe") & (F.col("rank") == 1)).select(*PAIR, "full", "taken"))
        taken = judged.where("taken").select(*PAIR)
        settled = results.cut(taken if settled is None else settled.unionByName(taken))
        left_over = judged.join(taken.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti").join(taken.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").select(*PAIR, "full")
        left_over = written.cut(left_over)
        lost = judged.where("NOT full").select("doc_id", "seq").distinct().join(left_over.select("doc_id", "seq").unionByName(taken.select("doc_id", "seq")).distinct(), ["doc_id", "seq"], "left_anti")
        lost = written.cut(left.join(lost, ["doc_id", "seq"], "left_semi"))
        if not lost.isEmpty():
            free = right.join(settled.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
            left_over = written.cut(left_over.unionByName(scored(lost, free, ACCEPT, TILE).withColumn("full", F.lit(True))))
        pairs = left_over
        written.drop(keep=2)  # the pairs that are left, with or without the table of those that lost theirs
        results.drop(keep=1)
    written.drop()
    inputs.drop()
    return settled if settled is not None else left.sparkSession.createDataFrame([], "doc_id long, seq long, pos long, score double")


class Greedy:
    """Choices within one list that a task holds whole: those of chosen_pairs(), in the order of the entries."""

    def __init__(self) -> None:
        self.comparer = near.Comparer(autojunk=False)

    def _alike(self, a: list[str], b: list[str], threshold: float) -> dict[int, dict[int, float]]:
        out: dict[int, dict[int, float]] = {}
        rows, columns = near.screened(a, b, threshold)
        order = np.argsort(columns, kind="stable")
        for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
            self.comparer.against(b[j])
            score = self.comparer.score(a[i], threshold)
            if score:
                out.setdefault(i, {})[j] = score
        return out

    def chosen(self, a: list[str], titles: list[str], dois: list[str], b: list[str], lows: list[str]) -> list[tuple[int, int, float]]:
        """(entry, line, score): a, titles, dois of the entries in their order; b and lows of the lines in theirs."""
        strong = self._alike(a, b, STRONG)
        for i, (own, title, doi) in enumerate(zip(a, titles, dois, strict=True)):
            floors = [(TITLE_FOUND, [j for j, key in enumerate(b) if title in key] if len(title) >= 8 else []), (DOI_FOUND, [j for j, low in enumerate(lows) if doi in low] if doi else []), (1.0, [j for j, key in enumerate(b) if not key] if not own else [])]
            for floor, lines in floors:  # nothing equals nothing
                for j in lines:
                    scores = strong.setdefault(i, {})
                    scores[j] = max(scores.get(j, 0.0), floor)
        lone = [i for i in range(len(a)) if i not in strong]
        weak = {lone[k]: scores for k, scores in self._alike([a[i] for i in lone], b, ACCEPT).items()} if lone and b else {}
        free, out = set(range(len(b))), []
        for i in range(len(a)):
            scores = strong.get(i)
            if scores is None:
                scores = weak.get(i, {})
            elif not free & scores.keys():  # its strong ones are gone: all that are left count
                lines = sorted(free)
                scores = {lines[k]: score for k, score in self._alike([a[i]], [b[j] for j in lines], ACCEPT).get(0, {}).items()}
            best = min(((-score, j) for j, score in scores.items() if j in free), default=None)
            if best:
                free.discard(best[1])
                out.append((i, best[1], -best[0]))
        return out


def whole_lists(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """doc_id, kind, seq, pos, raw, agent, published, score of lists that a task holds whole. Both sides are shuffled once, together, and nothing is joined; n: their rows.

    left: doc_id, seq, key, title_key, doi, raw, agent; right: doc_id, pos, key, low, published.
    """
    own = left.select("doc_id", F.lit(0).alias("side"), F.col("seq").alias("number"), "key", F.col("title_key").alias("more"), "doi", "raw", F.col("agent").alias("shown"))
    other = right.select("doc_id", F.lit(1).alias("side"), F.col("pos").alias("number"), "key", F.col("low").alias("more"), F.lit("").alias("doi"), F.lit("").alias("raw"), F.col("published").alias("shown"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = Greedy()

        def aligned(rows: pa.Table) -> pa.RecordBatch:
            """The rows of whole lists, in order."""
            rows = rows.combine_chunks()
            docs, sides = rows.column("doc_id").to_numpy(), rows.column("side").to_numpy()
            key, more, doi = (rows.column(c).to_pylist() for c in ("key", "more", "doi"))
            starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])).tolist()
            mine: list[int | None] = []
            theirs: list[int | None] = []
            scores: list[float | None] = []
            for first, last in zip(starts, [*starts[1:], len(docs)], strict=True):
                cut = first + int(np.searchsorted(sides[first:last], 1))
                found = greedy.chosen(key[first:cut], more[first:cut], doi[first:cut], key[cut:last], more[cut:last]) if first < cut < last else []
                entries, lines = {i for i, _, _ in found}, {j for _, j, _ in found}
                alone, extra = [first + i for i in range(cut - first) if i not in entries], [cut + j for j in range(last - cut) if j not in lines]
                mine += [first + i for i, _, _ in found] + alone + [None] * len(extra)
                theirs += [cut + j for _, j, _ in found] + [None] * len(alone) + extra
                scores += [s for _, _, s in found] + [None] * (len(alone) + len(extra))
            own, other = pa.array(mine, pa.int64()), pa.array(theirs, pa.int64())
            kind = pa.array(["pair" if i is not None and j is not None else "agent_only" if j is None else "published_only" for i, j in zip(mine, theirs, strict=True)], pa.string())
            at = pa.array([j if i is None else i for i, j in zip(mine, theirs, strict=True)], pa.int64())
            taken = [rows.column(c).take(k).combine_chunks() for c, k in (("doc_id", at), ("number", own), ("number", other), ("raw", own), ("shown", own), ("shown", other))]
            return pa.RecordBatch.from_arrays([taken[0], kind, *taken[1:], pa.array(scores, pa.float64())], ["doc_id", "kind", "seq", "pos", "raw", "agent", "published", "score"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            docs = held.column("doc_id").to_numpy()
            last = int(np.searchsorted(docs, docs[-1])) if len(docs) else 0
            if last:  # the last list may go on
                yield aligned(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield aligned(held)

    parts = max(left.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    dealt = own.unionByName(other).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "side", "number")
    return dealt.mapInArrow(work, "doc_id long, kind string, seq long, pos long, raw string, agent string, published string, score double")


def align(items: DataFrame, published: DataFrame, ignore_authors: bool = False) -> DataFrame:
    """doc_id, kind (pair, agent_only, published_only), seq, pos, raw, agent, published, same, sim, diff.

    items: doc_id, seq, raw, formatted, title, doi. published: doc_id, pos, text. A pair is the same if both strings agree but for blanks, without
    the authors if those are ignored; else diff has the edits. Lists of up to LIST_ROWS rows on either side go whole to a task; for longer ones chosen_pairs() makes the
    greedy choice and all else is joins.
    """
    left = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), collapse(F.coalesce("raw", F.lit(""))).alias("raw"), collapse(F.coalesce("formatted", F.lit(""))).alias("agent"), solid_key(F.col("title")).alias("title_key"), F.trim(F.lower(F.coalesce("doi", F.lit("")))).alias("doi"))
    left = left.withColumn("key", solid_key(F.col("agent")))
    right = published.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": solid_key(F.col("text")), "low": F.lower("text"), "published": collapse(F.col("text"))})
    sizes = [rows.groupBy("doc_id").agg(F.count("*").alias("n")) for rows in (left, right)]
    counted = [size.agg(F.sum("n"), F.count_if((F.col("n") > LIST_ROWS) | F.col("doc_id").isNull())).first() for size in sizes]
    small, long = (left, right), None
    if any(more for _, more in counted):
        large = sizes[0].unionByName(sizes[1]).where(F.col("n") > LIST_ROWS).select("doc_id").distinct()
        large = Written(left.sparkSession).cut(large.unionByName(large.sparkSession.createDataFrame([(None,)], "doc_id long")))
        same_list = lambda rows: rows.alias("r").join(F.broadcast(large.alias("l")), F.expr("r.doc_id <=> l.doc_id"), "left_anti")
        small = tuple(same_list(rows) for rows in small)
        long = _joined(*(rows.alias("r").join(F.broadcast(large.alias("l")), F.expr("r.doc_id <=> l.doc_id"), "left_semi") for rows in (left, right)))
    rows = whole_lists(*small, sum(n or 0 for n, _ in counted))
    rows = rows if long is None else rows.unionByName(long)
    own, other = F.col("agent"), F.col("published")
    if ignore_authors:
        own, other = without_authors(own), without_authors(other)
    pair = F.col("kind") == "pair"
    rows = rows.withColumns({"same": pair & (own == other), "sim": F.when(pair, F.round("score", 3))})
    unlike = pair & ~F.col("same")  # the others send nothing to be compared
    rows = rows.withColumn("same", F.coalesce("same", F.lit(False))).withColumn("diff", F.when(unlike, edits(*(F.when(unlike, c).otherwise("") for c in (own, other)))))
    return rows.select("doc_id", "kind", "seq", "pos", "raw", "agent", "published", "same", "sim", "diff")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of whole_lists() for lists of any length."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    chosen = chosen_pairs(left.select("doc_id", "seq", "key", "title_key", "doi", place.alias("place")), right.select("doc_id", "pos", "key", "low"))
    pairs = chosen.join(left.select("doc_id", "seq", "raw", "agent"), ["doc_id", "seq"]).join(right.select("doc_id", "pos", "published"), ["doc_id", "pos"]).withColumn("kind", F.lit("pair"))
    lone = left.select("doc_id", "seq", "raw", "agent").join(chosen.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti").withColumn("kind", F.lit("agent_only"))
    extra = right.select("doc_id", "pos", "published").join(chosen.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").withColumn("kind", F.lit("published_only"))
    return pairs.unionByName(lone, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True).select("doc_id", "kind", "seq", "pos", "raw", "agent", "published", "score")


def corpus_rows(aligned: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of the comparison corpus: aligned ones with their parent's t, hid, org, user, style, src, pub."""
    rows = aligned.select("doc_id", "kind", "same", *(F.coalesce(c, F.lit("")).alias(c) for c in ("raw", "agent", "published")))
    return rows.join(parents.select("doc_id", "t", "hid", "org", "user", "style", "src", "pub"), "doc_id").drop("doc_id")


def rule_drafts(aligned: DataFrame) -> DataFrame:
    """A draft rule for each pair that differs: follow the published form."""
    return aligned.where("kind = 'pair' AND NOT same").select(
        "doc_id", "seq", F.lit("발행본 표기 차이").alias("topic"), F.concat(F.lit("발행본 표기를 따른다: "), F.substring("published", 1, 200)).alias("rule"), F.substring("published", 1, 300).alias("example")
    )


def change_kind(a: Column, b: Column) -> Column:
    """What a step from a to b changes: spacing, case, punctuation, number or wording."""
    spaceless = [F.regexp_replace(c, r"(?U)\s+", "") for c in (a, b)]
    both = F.concat(a, b)
    return (
        F.when(spaceless[0] == spaceless[1], "spacing").when(F.lower(a) == F.lower(b), "case").when(~both.rlike(r"[\p{L}\p{N}]"), "punctuation").when(~both.rlike(r"\p{L}"), "number").otherwise("wording")
    )


def repeated_changes(aligned: DataFrame, least: int = 2) -> DataFrame:
    """kind, a, b, n, lists: steps that published lines take again and again, in at least `least` pairs, with the number of lists that show them. They are what a rule can be
    drafted from; rule_drafts() has the single pairs."""
    steps = aligned.where("kind = 'pair' AND NOT same").select("doc_id", "seq", F.explode("diff").alias("d")).where("d.tag <> 'equal'")
    found = steps.select("doc_id", "seq", change_kind(F.col("d.a"), F.col("d.b")).alias("kind"), F.col("d.a").alias("a"), F.col("d.b").alias("b")).distinct()
    return found.groupBy("kind", "a", "b").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("lists")).where(F.col("n") >= least)
