"""From manuscripts to finished reference lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.operators import citations, link, parse, render, reports, segment


@dataclass(frozen=True)
class Result:
    """Tables of one run; all have doc_id. errors: documents without a reference list."""

    items: DataFrame
    cited: DataFrame
    not_listed: DataFrame
    not_cited: DataFrame
    health: DataFrame
    summary: DataFrame
    errors: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drop what process() keeps between its tables; an executor that is lost before only costs making it again."""
        for rows in self.kept:
            rows.unpersist()


def process(docs: DataFrame, this_year: int, authorities: dict[str, DataFrame] | None = None, rules: DataFrame | None = None) -> Result:
    """docs (doc_id, text): find and split the list, parse, look up, render, order, validate, cross-check, count. A failing document is an error row."""
    lists = segment.reference_lists(docs).persist(StorageLevel.DISK_ONLY)
    parsed = parse.parse(segment.entries(lists)).persist(StorageLevel.DISK_ONLY)
    kept = (lists, parsed)
    if authorities:
        checked = link.verify(parsed, authorities, ["doc_id", "seq"])
        parsed = parsed.join(checked.select("doc_id", "seq", "status"), ["doc_id", "seq"], "left")
    else:
        parsed = parsed.withColumn("status", F.lit(None).cast("string"))
    items = render.formatted(render.sorted_with_letters(parsed))
    items = items.withColumns({"issues": render.issues(), "changed": render.changed(), "group": render.group_label()})
    cited, not_listed, not_cited = citations.cross_check(lists, parsed)
    tipped = link.tips(items.select("doc_id", "seq", "type"), rules).groupBy("doc_id", "seq").agg(F.count("*").alias("n_tips")) if rules is not None else None
    counted = items.join(tipped, ["doc_id", "seq"], "left") if tipped is not None else items.withColumn("n_tips", F.lit(0))
    counted = counted.select("doc_id", "changed", (F.size("issues") > 0).alias("has_issues"), "status", F.lit(False).alias("severe"), F.lit(0).alias("n_suggestions"), F.coalesce("n_tips", F.lit(0)).alias("n_tips"))
    problems = not_listed.select("doc_id").unionByName(not_cited.select("doc_id"))
    return Result(items, cited, not_listed, not_cited, reports.health(parsed, this_year), reports.summary(counted, problems), lists.where("error IS NOT NULL").select("doc_id", "error"), kept)


def reverified(items: DataFrame, again: DataFrame) -> DataFrame:
    """items with those of `again` in their place: only the rows of its keys are made anew."""
    keys = ["doc_id", "seq"]
    return items.join(again.select(*keys), keys, "left_anti").unionByName(again, allowMissingColumns=True)
