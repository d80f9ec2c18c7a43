"""Citations in a text against its reference list."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import group, plain_year, rstrip, strip, sub
from refloom.operators.parse import before
from refloom.operators.render import field
from refloom.operators.shared import Written

# Citation patterns, and words that look like names but aren't.
CITED_YEAR = r"(?:1[89]\d{2}|20\d{2})[a-z]?"
IN_PARENS = r"(?U)\(([^()]{2,120}?(?:1[89]\d{2}|20\d{2})[^()]{0,40})\)"
NOT_A_CITATION = r"(?U)https?://|표\s*\d|그림\s*\d|Figure|Table"
NARRATIVE = (
    rf"(?U)([가-힣]{{2,5}})(\s*외)?\s*\(\s*({CITED_YEAR})",
    rf"(?U)([A-Z][A-Za-z\-']{{2,}})(?:\s+(?:et al\.?|and|&)\s*[A-Z]?[A-Za-z\-']*|와|과)?\s*\(\s*({CITED_YEAR})",
)
NAME = r"^([가-힣]{2,5}|[A-Z][A-Za-z\-']{2,}|[一-鿿]{2,6})$"
STOP_WORDS = ["그림", "부록", "제시", "발행", "개정", "조사", "연구", "분석", "결과", "이용", "적용", "기준", "Table", "Figure", "Appendix", "Chapter", "Section", "Vol", "No", "The", "In", "According"]


def citations(docs: DataFrame, body_column: str = "body", id_column: str = "doc_id") -> DataFrame:
    """id, name, year, snippet: each cited (name, year) of a text once, with the place where it comes first.

    Parenthetical citations come before narrative ones, Korean narrative ones before western ones; inside each, the order is that of the text.
    """
    body = F.coalesce(F.col(body_column), F.lit(""))

    def matches(number: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(number).alias("pass"), i.alias("pos"), m.alias("match")))

    # one pass over the texts finds all kinds; a row has the kind that it is of
    found = docs.select(id_column, F.explode(F.concat(*(matches(k, p) for k, p in enumerate((IN_PARENS, *NARRATIVE))))).alias("_m")).select(id_column, "_m.*")
    inside, match = F.col("pass") == 0, F.col("match")
    found = found.where(~inside | ~match.rlike(NOT_A_CITATION))
    segments = F.when(inside, F.split(F.expr("substring(match, 2, length(match) - 2)"), ";")).otherwise(F.array(F.lit("")))
    found = found.select(id_column, "pass", "pos", "match", F.posexplode(segments).alias("part", "segment"))
    segment = strip(F.col("segment"))
    told = [(group(match, pattern, 1), group(match, pattern, 4 - k)) for k, pattern in enumerate(NARRATIVE, 1)]  # the year is the last group
    found = found.withColumn("year", F.when(inside, group(segment, CITED_YEAR)).when(F.col("pass") == 1, told[0][1]).otherwise(told[1][1])).where(~inside | (F.col("year") != ""))
    named = strip(rstrip(strip(before(segment, CITED_YEAR)), ","))
    named = rstrip(strip(sub(named, r"(?U)\s*(외|et al\.?|&.*|와$|과$)\s*$", "")), ",")
    first = strip(F.get(F.split(named, "[,·]"), F.lit(0)))
    found = found.withColumn("name", F.when(inside, first).when(F.col("pass") == 1, told[0][0]).otherwise(told[1][0]))
    found = found.where(~inside | F.col("name").rlike(NAME)).select(id_column, "pass", "pos", "part", "name", "year", "match")
    found = found.withColumn("name", rstrip(strip(F.col("name")), ",")).withColumn("year", plain_year(F.col("year")))
    found = found.where((F.col("name") != "") & ~F.col("name").isin(STOP_WORDS))
    order = Window.partitionBy(id_column, "name", "year").orderBy("pass", "pos", "part")
    firsts = found.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return firsts.select(id_column, "name", "year", F.substring(strip(F.col("match")), 1, 90).alias("snippet"))


def entry_keys(entries: DataFrame, id_column: str = "doc_id", seq_column: str = "seq") -> DataFrame:
    """id, seq, name, year: the keys under which an entry can be cited. Each author by each year (of a translation both); without authors the
    title's first 12 characters. Western names are surnames in lower case."""
    years = F.array_distinct(F.filter(F.array(plain_year(F.col("year")), F.when(field("orig_year") != "", field("orig_year"))), lambda y: y.isNotNull()))
    west = F.transform("authors", lambda a: F.lower(strip(F.split_part(strip(a), F.lit(","), F.lit(1)))))
    other = F.transform("authors", lambda a: strip(sub(strip(a), r"(?U)\s*(외|편|공편|옮김|번역)\s*$", "")))
    named = F.filter("authors", lambda a: strip(a) != "")
    names = F.when(F.size("authors") == 0, F.array(F.substring(field("title"), 1, 12))).when(F.size(named) == 0, F.array().cast("array<string>")).when(field("lang") == "west", west).otherwise(other)
    return entries.select(id_column, seq_column, F.explode(F.array_distinct(names)).alias("name"), years.alias("years")).select(id_column, seq_column, "name", F.explode("years").alias("year"))


#: Names that one automaton holds at most; a longer list is searched with several.
NAMES = 50_000


def named_in(bodies: DataFrame, keys: DataFrame, value_column: str, id_column: str = "doc_id") -> DataFrame:
    """Distinct id and value of the keys (id, name, value) whose name is not empty and stands in their text (id, body), as written or in lower case.

    A text's names travel to it as one array, and one automaton finds all of them in a single pass over the text, so a text is neither copied nor read for each
    name. A list of over NAMES names takes a pass for each so many.
    """
    kinds = [bodies.schema[id_column].dataType.simpleString(), keys.schema[value_column].dataType.simpleString()]
    lists = keys.where("name <> ''").groupBy(id_column).agg(F.collect_set(F.struct("name", F.col(value_column).alias("value"))).alias("_all"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_all) - 1) div {NAMES}")), lambda k: F.slice("_all", k * NAMES + 1, F.lit(NAMES)))
    lists = lists.select(id_column, F.explode(parts).alias("_names"))
    sent = bodies.select(id_column, F.coalesce("body", F.lit("")).alias("_body")).join(lists, id_column).select(id_column, "_body", F.lower("_body").alias("_low"), "_names")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (body, low, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                values: dict[str, list] = {}
                for x in wanted:
                    values.setdefault(x["name"], []).append(x["value"])
                automaton = ahocorasick.Automaton()
                for n in values:
                    automaton.add_word(n, n)
                automaton.make_automaton()
                here = {v for n in {n for text in (body, low) for _, n in automaton.iter(text)} for v in values[n]}
                rows += [k] * len(here)
                found += here
            kind = batch.schema.field(3).type.value_type.field("value").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, kind)], [id_column, value_column])

    return sent.mapInArrow(work, f"{id_column} {kinds[0]}, {value_column} {kinds[1]}").distinct()


def names_in(bodies: DataFrame, names: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, name: the distinct names (id, name) that stand in their text."""
    return named_in(bodies, names.select(id_column, "name", F.col("name").alias("_value")), "_value", id_column).withColumnRenamed("_value", "name")


def cross_check(bodies: DataFrame, entries: DataFrame, id_column: str = "doc_id", seq_column: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cited, not_listed, not_cited).

    cited: citations() and matched, whether (name, year) or (name in lower case, year) is a key of the list. not_listed: those that aren't, with
    name_only_match: the name is a key with another year. not_cited: entries of which no key is cited and no name stands in the text, as written
    or in lower case; they keep id, seq, raw (120 characters), authors (60), year. What is cited is written to the shared folder, where all three read it.
    """
    found = citations(bodies, id_column=id_column)
    keys = entry_keys(entries, id_column, seq_column)
    distinct = keys.select(id_column, "name", "year").distinct().withColumn("_k", F.lit(True))
    lowered = distinct.select(id_column, F.col("name").alias("_low"), "year", F.col("_k").alias("_l"))
    hit = found.withColumn("_low", F.lower("name")).join(distinct, [id_column, "name", "year"], "left").join(lowered, [id_column, "_low", "year"], "left")
    hit = hit.withColumn("key", F.when(F.col("_k"), F.col("name")).when(F.col("_l"), F.col("_low")))
    # all three tables read what is cited: the texts are searched once
    cited = Written(bodies.sparkSession).cut(hit.select(id_column, "name", "year", "snippet", "key", F.col("key").isNotNull().alias("matched")))
    known = keys.select(id_column, "name").distinct()
    alone = known.select(id_column, F.col("name").alias("_own"), F.lit(True).alias("_n"))
    lone = cited.where(~F.col("matched")).withColumn("_low", F.lower("name"))
    lone = lone.join(alone.withColumnRenamed("_own", "name"), [id_column, "name"], "left").join(alone.select(id_column, F.col("_own").alias("_low"), F.col("_n").alias("_m")), [id_column, "_low"], "left")
    not_listed = lone.select(id_column, "name", "year", "snippet", (F.coalesce("_n", F.lit(False)) | F.coalesce("_m", F.lit(False))).alias("name_only_match"))

    used = keys.join(cited.where("matched").select(id_column, F.col("key").alias("name"), "year").distinct(), [id_column, "name", "year"], "left_semi").select(id_column, seq_column).distinct()
    rest = keys.join(used, [id_column, seq_column], "left_anti")
    told = named_in(bodies, rest.select(id_column, "name", seq_column), seq_column, id_column)
    unused = rest.select(id_column, seq_column).distinct().join(told, [id_column, seq_column], "left_anti")
    not_cited = entries.join(unused, [id_column, seq_column], "left_semi").select(id_column, seq_column, F.substring("raw", 1, 120).alias("raw"), F.substring(F.array_join("authors", ", "), 1, 60).alias("authors"), "year")
    return cited.drop("key"), not_listed, not_cited
