"""Stages that an outside service may take over. Without one, the rules of this package do the work.

A service is a function from a pandas batch to a pandas batch with the same keys. Rows are sent in batches, answers are joined by key, and what a
service leaves out or gets wrong keeps the value that the rules give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.operators import parse, segment

Service = Callable[[pd.DataFrame], pd.DataFrame]
# Rows of a call, and bounds of what is sent or taken back.
BATCH, MATCH_BATCH, LONGEST_SECTION, SHORTEST_ENTRY, LONGEST_STYLE = 12, 24, 60_000, 15, 30_000


def called(rows: DataFrame, service: Service, schema: str, batch: int = BATCH) -> DataFrame:
    """Answers of a service to rows, `batch` at a time. A batch that fails is asked once more, then its rows have no answer."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for _ in range(2):
                    try:
                        yield service(part)
                        break
                    except Exception:  # noqa: BLE001  the service's own errors are many; its rows fall back to the rules
                        continue

    return rows.mapInPandas(work, schema)


def entries(sections: DataFrame, service: Service | None = None) -> DataFrame:
    """doc_id, seq, raw of sections (doc_id, section): split by the service where it answers, else by rule.

    A service reads LONGEST_SECTION characters at a time (one entry that is longer goes whole); of a longer section it is sent parts that end where an entry ends, so none
    is lost.
    """
    ruled = segment.entries(sections)
    if service is None:
        return ruled
    kind = sections.schema["doc_id"].dataType.simpleString()
    short = sections.where(F.length("section") <= LONGEST_SECTION).select("doc_id", F.lit(0).cast("long").alias("part"), "section")
    # a longer section goes in parts, each of whole entries as the rules find them
    length = F.sum(F.length("raw") + 1).over(Window.partitionBy("doc_id").orderBy("seq"))
    placed = ruled.withColumn("part", F.floor((length - 1) / LONGEST_SECTION))
    long = sections.where(F.length("section") > LONGEST_SECTION).select("doc_id")
    parts = placed.join(long, "doc_id", "left_semi").groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda e: e["raw"]), "\n").alias("section"))

    def asked(frame: pd.DataFrame) -> pd.DataFrame:
        return service(frame[["doc_id", "section"]]).assign(part=frame["part"].iloc[0])[["doc_id", "part", "entries"]]

    answers = called(short.unionByName(parts), asked, f"doc_id {kind}, part long, entries array<string>", 1)
    split = answers.select("doc_id", "part", F.posexplode(F.filter("entries", lambda e: F.length(e) >= SHORTEST_ENTRY)).alias("pos", "raw"))
    # what has no answer keeps the rules' entries: a short section as a whole, a long one by part
    own = ruled.join(long, "doc_id", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(placed.join(long, "doc_id", "left_semi"))
    rest = own.join(split.select("doc_id", "part").distinct(), ["doc_id", "part"], "left_anti").select("doc_id", "part", F.col("seq").alias("pos"), "raw")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos"))
    return split.unionByName(rest).select("doc_id", place.alias("seq"), "raw")


def structured(raws: DataFrame, service: Service | None = None) -> DataFrame:
    """Fields of entries (doc_id, seq, raw) by rule; where the service answers, its type, title, container, year and authors count."""
    ruled = parse.parse(raws)
    if service is None:
        return ruled
    kind = raws.schema["doc_id"].dataType.simpleString()
    answers = called(raws.select("doc_id", "seq", "raw"), service, f"doc_id {kind}, seq int, type string, title string, container string, year string, authors array<string>")
    own = answers.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", *(F.col(c).alias(f"_{c}") for c in ("type", "title", "container", "year", "authors")))
    joined = ruled.join(own, ["doc_id", "seq"], "left")
    kept = {c: F.coalesce(f"_{c}", c) for c in ("title", "container", "year", "authors")}
    kept["type"] = F.coalesce(F.when(F.col("_type") == "book_chapter", "book").otherwise(F.col("_type")), "type")
    missed = F.col("_title").isNull() & F.col("_type").isNull()
    kept["notes"] = F.when(missed, F.array_append("notes", F.lit("no answer for this entry"))).otherwise(F.col("notes"))
    return joined.withColumns(kept).drop("_type", "_title", "_container", "_year", "_authors")


def custom_style(entries_: DataFrame, style: DataFrame, service: Service | None = None) -> DataFrame:
    """doc_id, seq, formatted, group, error in a user's own style, which only a service can read; without one each row has an error. error also tells of
    a style of which the service could read a part only."""
    if service is None:
        return entries_.select("doc_id", "seq", F.lit(None).cast("string").alias("formatted"), F.lit(None).cast("string").alias("group"), F.lit("a custom style needs a service").alias("error"))
    kind = entries_.schema["doc_id"].dataType.simpleString()
    sent = entries_.select("doc_id", "seq", "raw", "style_id").join(style.select("style_id", F.substring("text", 1, LONGEST_STYLE).alias("style"), (F.length("text") > LONGEST_STYLE).alias("_cut")), "style_id")
    found = called(sent.drop("_cut"), service, f"doc_id {kind}, seq int, formatted string, group string")
    note = F.when(F.col("_cut"), f"the service read the first {LONGEST_STYLE} characters of the style")
    return found.join(sent.select("doc_id", "seq", note.alias("error")), ["doc_id", "seq"], "left")


def changed_lines(items: DataFrame, service: Service | None = None) -> DataFrame:
    """items (doc_id, seq, formatted) after standards and directives: the service names only what changes, all else stays."""
    if service is None:
        return items.withColumn("conflict", F.lit(None).cast("string"))
    kind = items.schema["doc_id"].dataType.simpleString()
    delta = called(items.select("doc_id", "seq", "formatted"), service, f"doc_id {kind}, seq int, changed string, conflict string").dropDuplicates(["doc_id", "seq"])
    return items.join(delta, ["doc_id", "seq"], "left").withColumn("formatted", F.coalesce(F.nullif("changed", F.lit("")), "formatted")).drop("changed")


RuledService = Callable[[pd.DataFrame, str, str], pd.DataFrame]


def rule_lines(rules: DataFrame) -> str:
    """A store of rules (seq, rule, perhaps example) as the lines that a service reads. It is a dimension that people fill by hand."""
    example = F.coalesce(F.col("example"), F.lit("")) if "example" in rules.columns else F.lit("")
    line = F.concat(F.lit("- "), "rule", F.when(example != "", F.concat(F.lit(" (예: "), example, F.lit(")"))).otherwise(""))
    return "\n".join(r.line for r in rules.orderBy("seq").select(line.alias("line")).collect()) or "(없음)"


def applied_rules(items: DataFrame, standards: DataFrame, directives: DataFrame, service: RuledService | None = None) -> DataFrame:
    """items (doc_id, seq, formatted) with note and conflict after further standards and directives (seq, rule, example).

    The service is given BATCH references, numbered from 0, and both kinds of rules; it answers index, formatted, note and conflict for what it changed or could not change. Answers are
    merged by their place in the batch: places that aren't there count for nothing, the last of several for one place counts, an empty string changes nothing. All other
    references stay letter for letter, as do those of a batch that failed. Without a service or without rules nothing changes.
    """
    blank = items.withColumns({"note": F.lit(""), "conflict": F.lit("")})
    if service is None or (standards.isEmpty() and directives.isEmpty()):
        return blank
    texts = rule_lines(standards), rule_lines(directives)

    def asked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        answers = service(pd.DataFrame({"index": range(len(part)), "reference": part["formatted"]}), *texts)
        answers = answers[answers["index"].between(0, len(part) - 1)].drop_duplicates("index", keep="last")
        own = part.loc[answers["index"], ["doc_id", "seq"]].reset_index(drop=True)
        return own.assign(_new=answers["formatted"].fillna("").tolist(), _note=answers["note"].fillna("").tolist(), _conflict=answers["conflict"].fillna("").tolist())

    keys = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in ("doc_id", "seq"))
    delta = called(items.select("doc_id", "seq", "formatted"), asked, f"{keys}, _new string, _note string, _conflict string").dropDuplicates(["doc_id", "seq"])
    merged = blank.join(delta, ["doc_id", "seq"], "left")
    return merged.withColumns({"formatted": F.coalesce(F.nullif("_new", F.lit("")), "formatted"), "note": F.coalesce("_note", "note"), "conflict": F.coalesce("_conflict", "conflict")}).drop("_new", "_note", "_conflict")


def matched_rules(items: DataFrame, rules: DataFrame, service: Service | None = None) -> DataFrame:
    """doc_id, seq, rule_id: rules that fit an item, by the service (unknown ids are dropped) or by type."""
    if service is None:
        from refloom.operators.link import tips

        return tips(items, rules).select("doc_id", "seq", "rule_id").distinct()
    kind = items.schema["doc_id"].dataType.simpleString()
    answers = called(items.select("doc_id", "seq", "formatted", "type"), service, f"doc_id {kind}, seq int, rule_id string", MATCH_BATCH)
    return answers.join(rules.where("enabled").select("rule_id").distinct(), "rule_id", "left_semi").select("doc_id", "seq", "rule_id").distinct()


def english_titles(entries_: DataFrame, official: DataFrame, service: Service | None = None) -> DataFrame:
    """doc_id, seq, title_en of domestic entries: the official one, else the service's; entries with neither are left out. Sorted case-insensitively by
    whoever prints them."""
    own = entries_.where("lang = 'ko'").join(official.select("doc_id", "seq", "title_en"), ["doc_id", "seq"], "left")
    known = own.where("coalesce(title_en, '') <> ''").select("doc_id", "seq", "title_en")
    if service is None:
        return known
    kind = entries_.schema["doc_id"].dataType.simpleString()
    rest = own.where("coalesce(title_en, '') = ''").select("doc_id", "seq", "title")
    return known.unionByName(called(rest, service, f"doc_id {kind}, seq int, title_en string"))


def mined_rules(raws: DataFrame, least: int = 2) -> DataFrame:
    """journal, pattern, n: forms that a journal's references repeat: how the year stands, whether titles are quoted, whether a DOI is given."""
    year = F.when(F.col("raw").rlike(r"\(\d{4}[a-z]?\)\."), "year in parentheses with period").when(F.col("raw").rlike(r"\(\d{4}[a-z]?\)"), "year in parentheses").when(F.col("raw").rlike(r"\d{4}\.?$"), "year at the end")
    title = F.when(F.col("raw").rlike(r"""["“「『]"""), "quoted title")
    doi = F.when(F.col("raw").rlike(r"(?i)doi"), "DOI given")
    found = raws.select("journal", F.explode(F.filter(F.array(year, title, doi), lambda p: p.isNotNull())).alias("pattern"))
    return found.groupBy("journal", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def form(raw: Column) -> Column:
    """How a reference is written: links are <link>, years <year>, other numbers <n>, runs of words <words>; punctuation and brackets stay as they are."""
    link, year, number, words = "\x01", "\x02", "\x03", "\x04"  # stand-ins that no pattern takes for letters
    c = F.regexp_replace(raw, r"(?i)(?:https?://|doi:\s*)[^\s]+", link)
    c = F.regexp_replace(c, r"\b(?:18|19|20)[0-9]{2}[a-z]?\b", year)
    c = F.regexp_replace(c, "[0-9]+", number)
    c = F.regexp_replace(c, r"\p{L}+(?:[ '’-]+\p{L}+)*", words)
    for mark, name in ((link, "<link>"), (year, "<year>"), (number, "<n>"), (words, "<words>")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def mined_forms(raws: DataFrame, least: int = 2) -> DataFrame:
    """journal, form, n, share: how a journal's references are written, each form that occurs often enough with its share of the journal's references."""
    counts = raws.groupBy("journal", form(F.col("raw")).alias("form")).agg(F.count("*").alias("n"))
    total = counts.groupBy("journal").agg(F.sum("n").alias("_total"))
    return counts.join(total, "journal").where(F.col("n") >= least).select("journal", "form", "n", F.round(F.col("n") / F.col("_total"), 4).alias("share"))
