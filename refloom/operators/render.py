"""From an entry's fields to its string in the house style; validation, order and letters for works of one year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.names import author_line, sentence_case, title_case, western_name
from refloom.functions.text import compare_key, either, plain_year, rstrip, squeeze, strip, sub

# Fields that each type needs, labels and messages.
REQUIRED = {
    "journal": ["authors", "year", "title", "container"],
    "book": ["authors", "year", "title", "publisher"],
    "thesis": ["authors", "year", "title", "degree", "institution"],
    "report": ["year", "title"],
    "newspaper": ["title", "container"],
    "web": ["title", "url"],
    "conference": ["authors", "title", "container"],
}
LABELS = {"authors": "저자명", "year": "발행연도", "title": "제목", "container": "게재지·매체명", "publisher": "출판사", "degree": "학위명", "institution": "수여기관", "url": "URL", "place": "출판지"}
MISSING = " 누락 — 확인 필요"
NO_PAGES = "면수 누락 — 확인 필요(온라인 학술지는 아티클 넘버)"
GROUPS = {"ko": "국내문헌", "west": "서양문헌", "east": "동양문헌"}
LANG_RANK = {"ko": 0, "west": 1, "east": 2}


def field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def added(lead: str, c: Column, tail: str = "") -> Column:
    """lead, c and tail, or nothing if c is empty."""
    return F.when(c == "", "").otherwise(F.concat(F.lit(lead), c, F.lit(tail)))


def formatted(rows: DataFrame) -> DataFrame:
    """rows with a column formatted. Missing columns of an entry count as empty.

    Head (authors or title, then the date), then what the type has, then a link that would be lost otherwise.
    """
    from refloom.operators.parse import TEXT_FIELDS

    for name in TEXT_FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    west, kind = field("lang") == "west", field("type")
    title, container = rstrip(strip(field("title")), "."), rstrip(strip(field("container")), ".,")
    cased_title = F.when(~west, title).when(kind.isin("journal", "newspaper", "web", "conference"), sentence_case(title)).when(kind.isin("book", "report", "thesis"), title_case(title)).otherwise(title)
    cased_container = F.when(west & kind.isin("journal", "newspaper", "web", "conference"), title_case(container)).otherwise(container)
    year = F.when(field("orig_year") != "", F.concat(field("orig_year"), F.lit("/"), field("year"))).otherwise(either(field("year"), F.when(west, "n.d.").otherwise("발행년불명")))
    when = F.when((field("date") != "") & kind.isin("newspaper", "web", "conference", "interview", "av"), field("date")).otherwise(year)
    rows = rows.withColumns({"_title": cased_title, "_container": cased_container, "_year": year, "_when": when, "_who": author_line(F.col("authors"), field("author_note"), field("lang"))})

    t, c, who, url = F.col("_title"), F.col("_container"), F.col("_who"), field("url")
    named = who != ""
    head = F.concat(F.when(named, who).otherwise(F.concat(t, F.lit("."))), F.lit(" ("), F.col("_when"), F.lit(")."))

    def own(*more: Column) -> Column:
        """The title with what belongs to it, if authors stand in the head."""
        return F.when(named, F.concat(t, *more, F.lit("."))).otherwise("")

    volume = F.when(field("volume") == "", "").otherwise(F.concat(F.lit(", "), field("volume"), added("(", field("issue"), ")")))
    pages = added(", ", field("pages"))
    imprint = F.when(field("publisher") == "", "").when(field("place") == "", F.concat(field("publisher"), F.lit("."))).otherwise(F.concat(field("place"), F.lit(": "), field("publisher"), F.lit(".")))
    medium = F.concat(c, pages)
    school = rstrip(F.concat(either(field("degree"), F.when(west, "Thesis").otherwise("학위논문")), F.lit(", "), field("institution")), ", ")
    by_name = F.contains(F.array_join("authors", ", "), field("publisher"))
    parts = {
        "journal": [own(), F.concat(c, volume, F.when(field("pages") != "", pages).otherwise(added(", ", field("article_no"))), F.lit(".")), either(added("https://doi.org/", field("doi")), url)],
        "book": [F.when(named, own(added(" (", field("edition"), ")"))).otherwise(added("(", field("edition"), ").")), imprint],
        "thesis": [own(), F.concat(school, F.when(west, added(", ", field("country"))).otherwise(""), F.lit("."))],
        "report": [own(added(" (", field("report_no"), ")")), F.when(named & by_name, "").otherwise(added("", field("publisher"), "."))],
        "newspaper": [own(), added("", medium, "."), url],
        "web": [own(), added("", c, "."), F.when(url == "", "").otherwise(F.concat(F.when(west, "Available: ").otherwise("출처: "), url))],
        "conference": [own(), added("", medium, ".")],
        "av": [own(added(" ", field("medium"))), imprint],
        "interview": [own(added(" ", field("medium"))), imprint],
    }
    unknown = [F.when(named & (t != ""), own()).otherwise(""), added("", c, "."), F.when(field("publisher") == "", "").otherwise(imprint), url]

    # the parts of a line in turn, each made once by the entry's type
    every = ["_part0", *(f"_part{n}" for n in range(1, len(unknown) + 1))]

    def nth(n: int) -> Column:
        own_part = reduce(lambda chain, item: chain.when(kind == item[0], item[1][n] if n < len(item[1]) else ""), parts.items(), F.when(F.lit(False), ""))
        return own_part.otherwise(unknown[n])

    rows = rows.withColumns(dict(zip(every, [head, *(nth(n) for n in range(len(unknown)))], strict=True)))
    lost = (url != "") & (field("doi") == "") & ~reduce(lambda a, b: a | b, (F.contains(p, url) for p in every))
    whole = F.concat_ws(" ", *(F.when(F.trim(p) != "", F.col(p)) for p in every), F.when(lost & (F.trim(url) != ""), url))
    law = strip(F.replace(F.concat(t, F.lit(". "), field("report_no"), F.lit(".")), F.lit(" ."), F.lit(".")))
    code = added(" (", field("report_no"), ")")
    stated = F.when(named, F.concat(who, F.lit(". ("), year, F.lit("). "), field("title"), code)).otherwise(F.concat(t, F.lit(". ("), year, F.lit("). "), code))
    standard = strip(squeeze(F.concat(rstrip(stated, "."), F.lit("."), added(" ", url))))
    tidy = strip(sub(squeeze(whole), r"(?U)\.\s*\.", "."))
    result = F.when(kind == "law", law).when(kind == "standard", standard).otherwise(tidy)
    return rows.withColumn("formatted", result).drop("_title", "_container", "_year", "_when", "_who", *every)


def issues() -> Column:
    """Notes of an entry and what it lacks: required fields by type (the title, for types without a list), pages of articles, places of books."""
    found = F.col("notes")
    empty = F.array().cast("array<string>")

    def lacks(f: str) -> Column:
        return ~F.exists("authors", lambda a: a != "") if f == "authors" else field(f) == ""

    for f in dict.fromkeys([*(x for fields in REQUIRED.values() for x in fields), "title"]):
        kinds = [k for k, fields in REQUIRED.items() if f in fields]
        needed = field("type").isin(kinds) | (~field("type").isin(list(REQUIRED)) if f == "title" else F.lit(False))
        message = LABELS.get(f, f) + MISSING
        found = F.concat(found, F.when(needed & lacks(f) & ~F.array_contains("notes", message), F.array(F.lit(message))).otherwise(empty))
    paged = (field("type") == "journal") & (field("pages") == "") & (field("article_no") == "") & ~F.exists("notes", lambda n: F.contains(n, F.lit("면수")))
    placed = (field("type") == "book") & (field("place") == "")
    return F.concat(found, F.when(paged, F.array(F.lit(NO_PAGES))).otherwise(empty), F.when(placed, F.array(F.lit(LABELS["place"] + MISSING))).otherwise(empty))


def changed() -> Column:
    """Whether the rendered string differs from the raw one in more than blanks and punctuation."""
    return compare_key(F.col("raw")) != compare_key(F.col("formatted"))


def sort_columns() -> list[Column]:
    """Domestic, western, eastern; name of the first author (of western ones the surname, in lower case) or the title; year; title."""
    first = F.get("authors", F.lit(0))
    name = F.when(first.isNull(), F.lower(field("title"))).when(field("lang") == "west", F.lower(F.split_part(western_name(first), F.lit(","), F.lit(1)))).otherwise(first)
    rank = reduce(lambda c, item: c.when(field("lang") == item[0], item[1]), LANG_RANK.items(), F.when(F.lit(False), 0)).otherwise(0)
    year = F.coalesce(F.regexp_extract(field("year"), r"^(\d{4})", 1).try_cast("int"), F.lit(9999))
    return [rank.alias("_lang"), name.alias("_name"), year.alias("_number"), F.lower(field("title")).alias("_low")]


def sorted_with_letters(rows: DataFrame, id_column: str = "doc_id", seq_column: str = "seq") -> DataFrame:
    """rows with position (from 1) in their list and letters on the years of several works by the same authors in one year.

    Only plain four-digit years of entries with authors get letters: a, b, c by title, ties by the order before. All orders end with
    the input's own.
    """
    keys = sort_columns()
    keyed = rows.select("*", *keys)
    order = [F.col(c) for c in ("_lang", "_name", "_number", "_low", seq_column)]
    own = F.transform("authors", strip)
    lettered = (F.size("authors") > 0) & field("year").rlike(r"^\d{4}$")
    same = Window.partitionBy(id_column, "_group")
    keyed = keyed.withColumn("_group", F.when(lettered, F.struct(own.alias("a"), plain_year(F.col("year")).alias("y"))))
    several = F.count("*").over(same) > 1
    number = F.row_number().over(same.orderBy("_low", *order))
    keyed = keyed.withColumn("year", F.when(F.col("_group").isNotNull() & several, F.concat(F.col("year"), F.chr(number + 96))).otherwise(F.col("year")))
    listed = Window.partitionBy(id_column).orderBy(*order)
    return keyed.withColumn("position", F.row_number().over(listed)).drop("_lang", "_name", "_number", "_low", "_group")


def grouped_order(rows: DataFrame, group_column: str, text_column: str, id_column: str = "doc_id", seq_column: str = "seq") -> DataFrame:
    """rows with position: groups in the order in which they first appear, inside a group by the string in lower case."""
    first = F.min(seq_column).over(Window.partitionBy(id_column, group_column))
    ranked = rows.withColumn("_first", first)
    order = Window.partitionBy(id_column).orderBy("_first", F.lower(F.col(text_column)), seq_column)
    return ranked.withColumn("position", F.row_number().over(order)).drop("_first")


def group_headers(rows: DataFrame, group_column: str, id_column: str = "doc_id", position_column: str = "position") -> DataFrame:
    """rows with header: the group where it differs from the last group before that isn't empty, else null."""
    before = Window.partitionBy(id_column).orderBy(position_column).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(field(group_column) != "", F.col(group_column))
    last = F.last(own, ignorenulls=True).over(before)
    return rows.withColumn("header", F.when(own.isNotNull() & (last.isNull() | (last != own)), own))


def group_label() -> Column:
    return reduce(lambda c, item: c.when(field("lang") == item[0], item[1]), GROUPS.items(), F.when(F.lit(False), "")).otherwise(GROUPS["ko"])
