"""Result lists as RIS, BibTeX, text, CSV and archive rows. Each export is a DataFrame; any Spark writer stores it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import plain_year, sub
from refloom.operators.render import field, group_headers

# Types of the two formats, and characters that BibTeX escapes, the backslash first.
RIS_TYPES = {"journal": "JOUR", "book": "BOOK", "book_chapter": "CHAP", "thesis": "THES", "report": "RPRT", "newspaper": "NEWS", "web": "ELEC", "conference": "CPAPER", "law": "STAT", "standard": "STAND", "av": "ADVS", "interview": "PCOMM"}
BIBTEX_TYPES = {"journal": "article", "book": "book", "book_chapter": "incollection", "thesis": "phdthesis", "report": "techreport", "conference": "inproceedings"}
ESCAPES = [("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")]
CELL = 30_000


def looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key), F.lit(other))


def lines(*parts: Column) -> Column:
    """Parts that aren't null, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def tagged(tag: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(f"{tag}  - "), c))


def ris(items: DataFrame) -> DataFrame:
    """items with a column ris: one record of the RIS format."""
    kind, pages, year = field("type"), field("pages"), plain_year(F.col("year"))
    thesis = kind == "thesis"
    authors = F.array_join(F.transform(F.filter("authors", lambda a: a != ""), lambda a: F.concat(F.lit("AU  - "), a)), "\n")
    ranged = F.contains(pages, F.lit("-"))
    ends = F.split(pages, "-", 2)
    record = lines(
        F.concat(F.lit("TY  - "), looked_up(RIS_TYPES, kind, "GEN")),
        F.when(authors != "", authors),
        F.when(year.rlike(r"^\d{4}$"), F.concat(F.lit("PY  - "), year)),
        *(tagged(t, field(f)) for t, f in (("TI", "title"), ("T2", "container"), ("VL", "volume"), ("IS", "issue"))),
        tagged("SP", F.when(ranged, F.trim(F.get(ends, F.lit(0)))).otherwise(pages)),
        F.when(ranged, F.concat(F.lit("EP  - "), F.trim(F.get(ends, F.lit(1))))),
        F.when(thesis, tagged("PB", field("institution"))).otherwise(tagged("PB", field("publisher"))),
        F.when(thesis, tagged("M3", field("degree"))).otherwise(tagged("CY", field("place"))),
        tagged("DO", field("doi")),
        tagged("UR", field("url")),
        F.lit("ER  - "),
    )
    return items.withColumn("ris", record)


def escaped(c: Column) -> Column:
    return sub(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c), r"[\r\n]+", " ")


def bibtex(items: DataFrame, number_column: str = "position") -> DataFrame:
    """items with a column bibtex: one entry, keyed by its number. A degree that says master makes a master's thesis of any type."""
    kind, year = field("type"), plain_year(F.col("year"))
    thesis = kind == "thesis"
    master = (thesis & F.contains(field("degree"), F.lit("석사"))) | F.contains(field("degree"), F.lit("Master"))
    form = F.when(master, "mastersthesis").otherwise(looked_up(BIBTEX_TYPES, kind, "misc"))
    holder = F.when(form == "article", "journal").when(form.isin("incollection", "inproceedings"), "booktitle").otherwise("howpublished")

    def entry(name: str | Column, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit("  "), F.lit(name) if isinstance(name, str) else name, F.lit(" = {"), value, F.lit("}")))

    def link(c: Column) -> Column:
        return sub(c, r"(?U)[{}\r\n\s]+", "")

    fields = [
        entry("author", F.array_join(F.transform(F.filter("authors", lambda a: a != ""), escaped), " and ")),
        entry("title", escaped(field("title"))),
        entry("year", F.when(year.rlike(r"^\d{4}$"), year).otherwise("")),
        entry(holder, escaped(field("container"))),
        entry("volume", escaped(field("volume"))),
        entry("number", escaped(field("issue"))),
        entry("pages", escaped(F.replace(field("pages"), F.lit("-"), F.lit("--")))),
        F.when(thesis, entry("school", escaped(field("institution")))).otherwise(entry("publisher", escaped(field("publisher")))),
        F.when(thesis, F.lit(None)).otherwise(entry("address", escaped(field("place")))),
        entry("doi", link(field("doi"))),
        entry("url", link(field("url"))),
    ]
    body = F.array_join(F.filter(F.array(*fields), lambda p: p.isNotNull()), ",\n")
    return items.withColumn("bibtex", F.concat(F.lit("@"), form, F.lit("{ref"), F.col(number_column).cast("string"), F.lit(",\n"), body, F.lit("\n}")))


def listing(items: DataFrame, id_column: str = "doc_id", position_column: str = "position") -> DataFrame:
    """id and text: the formatted entries of a list in order, a line in brackets wherever the group changes."""
    headed = group_headers(items, "group", id_column, position_column)
    line = F.concat(F.when(F.col("header").isNull(), "").otherwise(F.concat(F.lit("["), "header", F.lit("]\n"))), field("formatted"))
    parts = headed.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct(position_column, line.alias("line")))).alias("parts"))
    return parts.select(id_column, F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))


def archive_rows(history: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """history (time, filename, user, org, style_name, total) with refs: the whole list in one cell of at most 30,000 characters."""
    return history.join(listing(items, id_column), id_column, "left").select(id_column, "time", "filename", "user", "org", "style_name", "total", F.substring(F.coalesce("text", F.lit("")), 1, CELL).alias("refs"))


def batch_report(summaries: DataFrame, errors: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row a file: its counts, or the error that kept it from being read."""
    return summaries.unionByName(errors, allowMissingColumns=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path, lineSep="\n\n")


def append_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows as JSON lines, in folders by a column if one is given."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def numbered(items: DataFrame, id_column: str = "doc_id", *order: Column) -> DataFrame:
    return items.withColumn("position", F.row_number().over(Window.partitionBy(id_column).orderBy(*order)))
