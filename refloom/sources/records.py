"""Authority records from XML and JSON answers, as rows of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions.names import clean_names
from refloom.functions.text import bare_doi, either, main_title, strip, sub, without_tags

META = ["title", "container", "year", "volume", "issue", "pages", "doi", "publisher", "isbn", "title_en", "record_id", "source"]
# Kinds of an article's references by code, and titles that are laws.
REFERENCE_KINDS = {"01": "journal", "02": "conference", "03": "book", "04": "report", "05": "thesis", "06": "web"}
LAW_TITLE = r"(?U)법률\s*제\s*\d+호|대통령령\s*제\s*\d+호|시행령|시행규칙|조례"
UPDATES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("date_parts", T.ArrayType(T.IntegerType()))]))


#: Stands between the texts of several paths: no XML may hold it.
BETWEEN = "\x1e"


def texts_of(xml: Column, paths: list[str]) -> Column:
    """Texts of the first element of each path, empty where there is none: all paths in one expression, so the XML is parsed once."""
    return F.split(F.xpath_string(xml, F.lit("concat(" + f", '{BETWEEN}', ".join(f"string({p})" for p in paths) + ")")), BETWEEN)


def digits(c: Column, n: int = 4) -> Column:
    return F.substring(sub(c, "[^0-9]", ""), 1, n)


def nodes(answers: DataFrame, tag: str, xml_column: str = "xml") -> DataFrame:
    """answers with pos and node: each element of this name as XML of its own."""
    return answers.select("*", F.posexplode(F.regexp_extract_all(F.coalesce(F.col(xml_column), F.lit("")), F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("pos", "node"))


def failed_answer(xml: Column) -> Column:
    """True if an answer reports an error; that nothing was found is none."""
    message = strip(F.regexp_extract(F.coalesce(xml, F.lit("")), r"(?is)<(?:resultMsg|returnReasonCode|errMsg|message)>(.*?)</", 1))
    return (message != "") & ~message.rlike("(?i)no data|데이터가 없|결과가 없|NORMAL|정상")


# Where an article's fields stand.
ARTICLE_PATHS = (
    "//article-title //articleTitle //title //journal-name //journalName //pub-year //pubYear //issue-date //volume //issue //fpage //lpage //doi //article-title[@lang='english'] //articleInfo/@article-id"
).split()


def articles(answers: DataFrame, xml_column: str = "xml") -> DataFrame:
    """answers with the META fields, authors and authors_en of each record element."""
    n = F.col("node")
    keys = [c for c in answers.columns if c != xml_column]
    read = nodes(answers, "record", xml_column).select(*keys, "pos", "node", texts_of(n, ARTICLE_PATHS).alias("_texts"))

    def of(*paths: str) -> Column:
        return either(*(strip(F.get("_texts", F.lit(ARTICLE_PATHS.index(p)))) for p in paths))

    pages = [of("//fpage"), of("//lpage")]
    # an attribute that is nowhere in the text needs no second look
    english = F.transform(F.when(F.contains(n, F.lit("english")), F.expr("xpath(node, '//author/@english')")).otherwise(F.array().cast("array<string>")), strip)
    return read.select(
        *keys,
        "pos",
        of("//article-title", "//articleTitle", "//title").alias("title"),
        of("//journal-name", "//journalName").alias("container"),
        digits(of("//pub-year", "//pubYear", "//issue-date")).alias("year"),
        of("//volume").alias("volume"),
        of("//issue").alias("issue"),
        F.array_join(F.filter(F.array(*pages), lambda p: p != ""), "-").alias("pages"),
        bare_doi(of("//doi")).alias("doi"),
        F.lit("").alias("publisher"),
        F.lit("").alias("isbn"),
        of("//article-title[@lang='english']").alias("title_en"),
        F.get("_texts", F.lit(ARTICLE_PATHS.index("//articleInfo/@article-id"))).alias("record_id"),
        F.lit("kci").alias("source"),
        F.filter(F.transform(F.expr("xpath(node, '//author/text()')"), strip), lambda a: a != "").alias("authors"),
        F.filter(english, lambda a: a != "").alias("authors_en"),
    )


# Names of a reference's elements, spelt as the service spells them.
REFERENCE_FIELDS = ["title", "author", "pubi-year", "registration-day", "journal-name", "conference-name", "site-name", "volume", "isseue", "page", "doi", "url", "pubilisher", "degree", "university"]
REFERENCE = ", ".join(f"`{f}` string" for f in ("_type-code", *REFERENCE_FIELDS))


def references(answers: DataFrame, xml_column: str = "xml") -> DataFrame:
    """answers with the entries of an article's own reference list: kind by code, laws by their titles; only the first author is known. Each element is
    parsed once; one that is no XML has no title and is left out."""
    keys = [c for c in answers.columns if c != xml_column]
    read = nodes(answers, "reference", xml_column).select(*keys, "pos", F.from_xml("node", REFERENCE).alias("_r"))

    def of(*fields: str) -> Column:
        return either(*(without_tags(F.col("_r")[f]) for f in fields))

    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in REFERENCE_KINDS.items() for x in p]), F.coalesce(F.col("_r")["_type-code"], F.lit(""))), F.lit("unknown"))
    title, author = F.col("title"), F.col("_author")
    made = read.select(*keys, "pos", "_r", of("title").alias("title"), of("author").alias("_author")).where("title <> ''")
    return made.select(
        *keys,
        "pos",
        "title",
        F.when((kind == "unknown") & title.rlike(LAW_TITLE), "law").otherwise(kind).alias("type"),
        F.when(F.concat(title, author).rlike("[가-힣]"), "ko").otherwise("west").alias("lang"),
        F.when(author == "", F.array().cast("array<string>")).otherwise(F.array(author)).alias("authors"),
        digits(of("pubi-year", "registration-day")).alias("year"),
        of("journal-name", "conference-name", "site-name").alias("container"),
        of("volume").alias("volume"),
        of("isseue").alias("issue"),
        of("page").alias("pages"),
        bare_doi(of("doi")).alias("doi"),
        of("url").alias("url"),
        of("pubilisher").alias("publisher"),
        of("degree").alias("degree"),
        of("university").alias("institution"),
    )


def reference_texts(answers: DataFrame, xml_column: str = "xml", least: int = 15) -> DataFrame:
    """Distinct texts of elements whose name speaks of references, in order of first appearance, `least` characters or more."""
    keys = [c for c in answers.columns if c != xml_column]
    found = F.regexp_extract_all(F.coalesce(F.col(xml_column), F.lit("")), F.lit(r"(?is)<[a-z-]*reference[a-z-]*(?:\s[^>]*)?>([^<]+)<"), F.lit(1))
    texts = F.array_distinct(F.filter(F.transform(found, lambda t: strip(sub(t, r"(?U)\s+", " "))), lambda t: F.length(t) >= least))
    return answers.select(*keys, F.posexplode(texts).alias("pos", "text"))


def library_records(answers: DataFrame, xml_column: str = "xml") -> DataFrame:
    """answers with the META fields of records that are lists of (name, value) items; of repeated names the last counts. The title's name varies by kind.
    Each record is parsed once; one that is no XML has empty fields."""
    keys = [c for c in answers.columns if c != xml_column]
    read = nodes(answers, "recode", xml_column).select(*keys, "pos", F.from_xml("node", "item array<struct<name:string,value:string>>")["item"].alias("_items"))
    pairs = F.transform(F.coalesce("_items", F.array()), lambda i: F.struct(without_tags(i["name"]).alias("n"), without_tags(i["value"]).alias("v")))
    read = read.select(*keys, "pos", pairs.alias("_pairs"))

    def last(w: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter("_pairs", lambda p: p["n"] == F.lit(w)), F.lit(-1))["v"], F.lit(""))

    def of(*wanted: str) -> Column:
        return either(*map(last, wanted))

    title = F.split_part(F.split_part(of("기사명", "논문명", "자료명", "서명"), F.lit(" = "), F.lit(1)), F.lit(" /"), F.lit(1))
    return read.select(
        *keys,
        "pos",
        strip(sub(title, r"[/\s]+$", "")).alias("title"),
        digits(of("발행년도", "학위년도", "발행년")).alias("year"),
        of("발행자").alias("publisher"),
        F.array(of("저자명")).alias("authors"),
        F.lit("nanet").alias("source"),
    )


BOOKS = "struct<docs:array<struct<TITLE:string,AUTHOR:string,PUBLISHER:string,PUBLISH_PREDATE:string,EA_ISBN:string>>,RESULT:string,ERR_MESSAGE:string>"


def books(answers: DataFrame, json_column: str = "json") -> DataFrame:
    """answers with the fields of each book in a JSON answer, and unavailable for answers that report an error in place of books."""
    parsed = answers.withColumn("_j", F.from_json(json_column, BOOKS))
    rows = parsed.select(*(c for c in answers.columns if c != json_column), F.posexplode_outer("_j.docs").alias("pos", "b"), ((F.col("_j.docs").isNull()) & (F.coalesce("_j.ERR_MESSAGE", F.lit("")) != "")).alias("unavailable"))
    return rows.select(
        *(c for c in answers.columns if c != json_column),
        "pos",
        "unavailable",
        main_title(F.col("b.TITLE")).alias("title"),
        F.coalesce("b.PUBLISHER", F.lit("")).alias("publisher"),
        digits(F.coalesce("b.PUBLISH_PREDATE", F.lit(""))).alias("year"),
        F.coalesce("b.EA_ISBN", F.lit("")).alias("isbn"),
        clean_names(F.array(F.coalesce("b.AUTHOR", F.lit("")))).alias("authors"),
        F.lit("nlk").alias("source"),
    )


def shortened_titles(title: Column) -> Column:
    """Up to three queries for a book, the widest first: the title, its main title, its first three and two words; short ones are no queries."""
    from refloom.functions.text import collapse

    def key_length(c: Column) -> Column:
        return F.length(sub(F.lower(c), r"""(?U)[\s:：\-·,.?!「」『』"'()\[\]]+""", ""))

    wide = F.array_distinct(F.filter(F.array(collapse(title), main_title(title)), lambda c: key_length(c) >= 3))
    words = F.split(F.coalesce(F.try_element_at(wide, F.lit(-1)), F.lit("")), " ")
    short = F.array(*(F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")) for n in (3, 2)))
    return F.slice(F.array_distinct(F.concat(wide, F.filter(short, lambda c: c.isNotNull() & (key_length(c) >= 6)))), 1, 3)


def rescued_json(c: Column, ddl: str) -> Column:
    """A JSON answer, or the outermost braces in one that has other text around it; null if neither parses."""
    return F.coalesce(F.when(c.rlike(r"^\s*\{"), F.from_json(c, ddl)), F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), ddl))


# ---------------------------------------------------------------- answers of article services in JSON
# Authors that are kept of a record, and how a registry writes DOIs as links.
MOST_AUTHORS, DOI_LINK = 30, "https://doi.org/"
ARTICLE_META = ["title", "subtitle", "container", "year", "volume", "issue", "pages", "doi", "publisher", "isbn", "authors", "source"]


def parsed_answers(answers: DataFrame, json_column: str = "json") -> DataFrame:
    """answers with v, their JSON as a variant (null if damaged or absent), and unavailable for those."""
    parsed = answers.withColumn("v", F.try_parse_json(F.col(json_column)))
    return parsed.withColumn("unavailable", F.col("v").isNull()).drop(json_column)


def items(parsed: DataFrame, path: str) -> DataFrame:
    """parsed_answers() with a row for each element of the array at a path, numbered by pos; v is the element. Answers without one have no row."""
    each = F.try_variant_get("v", path, "array<variant>")
    return parsed.select(*(c for c in parsed.columns if c not in ("v", "unavailable")), F.posexplode(each).alias("pos", "v"))


def at(path: str, kind: str = "string") -> Column:
    """What v has at a path, null if nothing or something else."""
    return F.try_variant_get("v", path, kind)


def text_at(path: str) -> Column:
    return F.coalesce(at(path), F.lit(""))


def joined_at(path: str) -> Column:
    """Strings of a list as one."""
    return F.coalesce(F.array_join(at(path, "array<string>"), " "), F.lit(""))


def _article(rows: DataFrame, **fields: Column) -> DataFrame:
    """rows with the ARTICLE_META fields instead of v; those that a service doesn't have are empty."""
    made = {f: F.coalesce(fields[f], F.lit("")) if f in fields else F.lit("") for f in ARTICLE_META if f != "authors"}
    made["authors"] = F.coalesce(F.slice(fields["authors"], 1, MOST_AUTHORS), F.array().cast("array<string>")) if "authors" in fields else F.array().cast("array<string>")
    return rows.withColumns({f: made[f] for f in ARTICLE_META}).drop("v")


def crossref_works(rows: DataFrame) -> DataFrame:
    """Works of Crossref (column v): words of title, subtitle and container joined, the first date part, persons as "family, given", groups by name."""
    person = F.transform(at("$.author", "array<struct<family:string,given:string,name:string>>"), lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit("")))).otherwise(a["name"]))
    first = F.slice(person, 1, MOST_AUTHORS)  # of the first ones, those that have a name
    return _article(
        rows,
        title=joined_at("$.title"),
        subtitle=joined_at("$.subtitle"),
        container=joined_at("$['container-title']"),
        year=at("$.issued['date-parts'][0][0]"),
        volume=at("$.volume"),
        issue=at("$.issue"),
        pages=F.replace(text_at("$.page"), F.lit("--"), F.lit("-")),
        doi=at("$.DOI"),
        publisher=at("$.publisher"),
        isbn=at("$.ISBN[0]"),
        authors=F.filter(first, lambda a: F.coalesce(a, F.lit("")) != ""),
        source=F.lit("Crossref"),
    )


def openalex_works(rows: DataFrame) -> DataFrame:
    """Works of OpenAlex (column v): pages from first and last, DOI without its resolver, display names."""
    last = text_at("$.biblio.last_page")
    pages = F.when(text_at("$.biblio.first_page") != "", F.concat(text_at("$.biblio.first_page"), F.when(last != "", F.concat(F.lit("-"), last)).otherwise("")))
    names = F.transform(F.slice(at("$.authorships", "array<struct<author:struct<display_name:string>>>"), 1, MOST_AUTHORS), lambda a: a["author"]["display_name"])
    return _article(
        rows,
        title=at("$.title"),
        container=at("$.primary_location.source.display_name"),
        year=at("$.publication_year"),
        volume=at("$.biblio.volume"),
        issue=at("$.biblio.issue"),
        pages=pages,
        doi=F.replace(text_at("$.doi"), F.lit(DOI_LINK), F.lit("")),
        authors=F.filter(names, lambda a: F.coalesce(a, F.lit("")) != ""),
        source=F.lit("OpenAlex"),
    )


def datacite_works(rows: DataFrame) -> DataFrame:
    """Attributes of a DataCite record (column v): the first title, creators by name."""
    return _article(
        rows,
        title=at("$.titles[0].title"),
        container=at("$.container.title"),
        year=at("$.publicationYear"),
        doi=at("$.doi"),
        publisher=at("$.publisher"),
        authors=F.filter(F.transform(at("$.creators", "array<struct<name:string>>"), lambda a: a["name"]), lambda a: F.coalesce(a, F.lit("")) != ""),
        source=F.lit("DataCite"),
    )


def s2_works(rows: DataFrame) -> DataFrame:
    """Papers of Semantic Scholar (column v)."""
    return _article(rows, title=at("$.title"), container=at("$.venue"), year=at("$.year"), doi=at("$.externalIds.DOI"), source=F.lit("Semantic Scholar"))


#: Where each service's answers hold records: the list of a search, or one record by DOI.
SERVICES = {"crossref": ("$.message.items", "$.message", crossref_works), "openalex": ("$.results", "$", openalex_works), "datacite": ("$.data", "$.data.attributes", datacite_works), "s2": ("$.data", "$", s2_works)}


def found_works(answers: DataFrame, service: str, json_column: str = "json") -> DataFrame:
    """answers of a search with pos and the ARTICLE_META fields of each record that it lists."""
    path, _, mapped = SERVICES[service]
    return mapped(items(parsed_answers(answers, json_column), path))


def known_work(answers: DataFrame, service: str, json_column: str = "json") -> DataFrame:
    """answers that hold one record, with its ARTICLE_META fields and unavailable; a damaged answer has empty fields, so that a lookup goes on."""
    _, path, mapped = SERVICES[service]
    parsed = parsed_answers(answers, json_column)
    return mapped(parsed.withColumn("v", F.try_variant_get("v", path, "variant") if path != "$" else F.col("v")))
