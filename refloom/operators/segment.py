"""From a manuscript's text to the lines of its reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import YEAR, squeeze, strip, sub

# Headings that open and end a reference list.
OPENING = r"참\s*고\s*문\s*헌|인\s*용\s*문\s*헌|References?|REFERENCES?|BIBLIOGRAPHY|Bibliography|Works\s+Cited"
CLOSING = r"부\s*록|국\s*문\s*초\s*록|영\s*문\s*초\s*록|Abstract|ABSTRACT|Appendix|APPENDIX|감사의\s*글|저자\s*소개|필자\s*소개"
HEADING_LINE = rf"^\s*(?:[<\[【]?\s*)?(?:\d+[.)]?\s*)?(?:{OPENING})(?:\s*[>\]】]?)\s*$"
LAST_HEADING = rf"(?smU)\A(.*){HEADING_LINE}(.*)\z"
LAST_MENTION = r"(?sU)\A(.*)(?:참\s*고\s*문\s*헌|References)(.*)\z"
END_HEADING = rf"(?mU)^\s*(?:[<\[【]?\s*)?(?:{CLOSING})(?:\s*[>\]】]?)\s*"
# Lines that go on with an entry, and lines that begin one.
CONTINUES = (r"^\s{4,}\S", r"^(https?://|www\.|doi[:.]|DOI[:.]|10\.\d{4})", "^(출처|Available|Retrieved|재인용)", "^[a-z]", r"^[\d\-–—,.\s]+$", r"^[&,;:：)\]]")
BEGINS = (
    r"^\[\d{1,3}\]\s*\S",
    r"^\d{1,3}[.)]\s+\S",
    r"^[가-힣]{2,15}\s*\(",
    r"^[가-힣]{2,6}\s*[,·․]\s*[가-힣]{2,6}",
    r"^[가-힣]{2,6}\s+외\b",
    r'^[가-힣]{2,6}\s+["“『「]',
    r"^[A-Z][A-Za-z\-']+,\s",
    r"^[A-Z][A-Za-z\-']+\s+(?:&|and|et al)",
    rf"^[A-Z][A-Za-z\-' ]{{1,40}}\(\s*{YEAR}",
    "^[一-鿿぀-ゟ゠-ヿ]{2,}",
    rf"""^[A-Za-z가-힣“"'].{{3,80}}[.。]\s*\({YEAR}""",
)
LINE_ENDS = "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85  ]"
SHORTEST = 15


def sections(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with body and section: what stands before and after the last heading line of a reference list.

    Without one, the last mention of the heading counts if it is past 30 % of the text; without that, all is body. The section ends at
    the first closing heading, if that is not among its first 50 characters.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.withColumn("_after", F.regexp_extract(text, LAST_HEADING, 2))  # a column of its own: made once
    headed = (F.col("_after") != "") | text.rlike(LAST_HEADING)
    early = F.regexp_extract(text, LAST_MENTION, 1)
    mentioned = text.rlike(LAST_MENTION) & (F.length(early) > F.length(text) * 0.3)
    section = F.when(headed, F.col("_after")).when(mentioned, F.regexp_extract(text, LAST_MENTION, 2)).otherwise("")
    body = F.when(headed, F.regexp_extract(text, LAST_HEADING, 1)).when(mentioned, early).otherwise(text)
    rows = rows.withColumn("body", body).withColumn("section", section).drop("_after")
    end = F.regexp_instr("section", F.lit(END_HEADING)) - 1
    return rows.withColumn("section", strip(F.when(end > 50, F.substring("section", F.lit(1), end)).otherwise(F.col("section"))))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    found = c.rlike(f"(?U){patterns[0]}")
    for p in patterns[1:]:
        found = found | c.rlike(f"(?U){p}")
    return found


def lines_of(docs: DataFrame, column: str, id_column: str = "doc_id") -> DataFrame:
    """id, pos, raw_line, line (trimmed): the lines that are not blank."""
    rows = docs.select(id_column, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), LINE_ENDS)).alias("pos", "raw_line"))
    return rows.withColumn("line", strip(F.col("raw_line"))).where("line <> ''")


def entry_array(section: Column) -> Column:
    """The entries of a list, in its order.

    Lines hold no line end, so one stands before each line that opens an entry, a blank before the others: the text is gone through once, in its own row.
    """
    split = F.transform(F.split(F.coalesce(section, F.lit("")), LINE_ENDS), lambda x: F.struct(x.alias("raw_line"), strip(x).alias("line")))

    def placed(x: Column, i: Column) -> Column:
        raw_line, line = x["raw_line"], x["line"]
        year = line.rlike(r"(?U)^[가-힣]{2,15}[.,]") & line.rlike(YEAR)
        opens = (i == 0) | (~_any(raw_line, CONTINUES) & (_any(line, BEGINS) | year))
        return F.concat(F.when(opens, "\n").otherwise(" "), line)

    joined = F.array_join(F.transform(F.filter(split, lambda x: x["line"] != ""), placed), "")
    number = r"(?U)^\s*(\[\d{1,3}\]|\d{1,3}[.)])\s*"
    raw = F.transform(F.split(F.substr(joined, F.lit(2)), "\n"), lambda x: strip(squeeze(sub(x, number, ""))))
    return F.filter(raw, lambda x: F.length(x) >= SHORTEST)


def entries(docs: DataFrame, section_column: str = "section", id_column: str = "doc_id") -> DataFrame:
    """One row for each entry of a reference list: id, seq (from 1), raw.

    A line opens an entry if it is the list's first or looks like a beginning and not like a continuation; others go on with the entry
    before. Numbers at the start are dropped, entries of under 15 characters too. Null and empty lists have no entries. Lists that share an id are each their own.
    """
    found = docs.select(id_column, F.posexplode(entry_array(F.col(section_column))).alias("_at", "raw"))
    return found.select(id_column, (F.col("_at") + 1).alias("seq"), "raw")


def is_list(n_entries: Column, n_dated: Column) -> Column:
    """Three or more entries, 60 % of them dated."""
    return (n_entries >= 3) & (n_dated >= 0.6 * n_entries)


DATED = r"\(?\d{4}"


def list_only(found: DataFrame, id_column: str = "doc_id", raw_column: str = "raw") -> DataFrame:
    """id, n_entries, n_dated, is_list: whether a whole text reads as a reference list: three or more entries, 60 % with a four-digit number."""
    dated = F.count_if(F.col(raw_column).rlike(DATED))
    return found.groupBy(id_column).agg(F.count("*").alias("n_entries"), dated.alias("n_dated")).withColumn("is_list", is_list(F.col("n_entries"), F.col("n_dated")))


def reference_lists(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, body, section, error: sections() with the whole text as list where no heading is found but the text reads as one, else an error. Each text is
    judged in its own row, and only where it has no section."""
    cut = sections(docs.select(id_column, F.col(text_column).alias("text")), "text")
    dated = F.transform(F.when(F.col("section") == "", entry_array(F.col("text"))), lambda x: x.rlike(DATED))
    rows = cut.withColumn("_dated", dated).withColumn("_whole", F.coalesce(is_list(F.size("_dated"), F.size(F.filter("_dated", lambda x: x))), F.lit(False)))
    whole = F.col("_whole")
    return rows.select(
        id_column,
        F.when(whole, "").otherwise(F.col("body")).alias("body"),
        F.when(whole, F.col("text")).otherwise(F.col("section")).alias("section"),
        F.when((F.col("section") == "") & ~whole, "no reference list found").alias("error"),
    )
