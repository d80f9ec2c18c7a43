"""Registered queries over answers of article services, lists whose lines were moved, citations that no list has, and stores that several writers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import similarity, text
from refloom.operators import align, citations, link, reports, segment, stages, stores
from refloom.operators.shared import Written
from refloom.plans import lookups
from refloom.plans.bibliography import BIBLIOGRAPHY_SQL as BIB
from refloom.plans.bibliography import bibliography, table
from refloom.plans.queries import USAGE, _usage, query, structured
from refloom.sources import exports, html, records

# ---------------------------------------------------------------- answers of article services

WORD = "translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij')"
FOUND = ["title", "subtitle", "container", "year", "volume", "issue", "pages", "doi", "publisher", "isbn", "source"]
#: Every eleventh answer breaks off; it has a row of empty fields and is marked.
BROKEN = 11


def key() -> Column:
    return F.col("o_orderkey")


def _answered(spark: SparkSession, sf_dir: str, answer: Column) -> DataFrame:
    """seq and json: an answer for each order, some broken off in the middle."""
    whole = F.to_json(answer)
    return table(spark, sf_dir, "orders").select(key().alias("seq"), F.when(key() % BROKEN == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("json"))


def _fields(found: DataFrame) -> DataFrame:
    return found.select("seq", "unavailable", *FOUND, F.array_join("authors", ";").alias("author"))


def _expected(source: str, **fields: str) -> str:
    """SQL of what an answer holds; a broken one holds nothing."""
    made = [f"CASE WHEN o_orderkey % {BROKEN} = 0 THEN '' ELSE {fields.get(f, chr(39) * 2)} END AS {f}" for f in [*FOUND[:-1], "author"]]
    return f"SELECT o_orderkey AS seq, o_orderkey % {BROKEN} = 0 AS unavailable, '{source}' AS source, {', '.join(made)} FROM orders"


YEAR = "CAST(year(o_orderdate) AS VARCHAR)"


@query(
    _expected(
        "Crossref", title=f"'On ' || {WORD} || ' lists'", subtitle="CASE WHEN o_orderkey % 3 = 0 THEN 'a survey' ELSE '' END", container="'List Journal'", year=f"CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {YEAR} END", volume="CAST(o_orderkey % 60 AS VARCHAR)",
        issue="CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '2' END", pages="CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_orderkey + 9 AS VARCHAR)", doi=f"'10.7/' || {WORD}", publisher="'Press'", isbn="CASE WHEN o_orderkey % 6 = 0 THEN '9780000000001' ELSE '' END", author="'Waa, B.;List Group;Wbb'",
    )
)
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by DOI: persons and groups, one author without any name, missing dates, issues and ISBNs, a numeric volume."""
    word = F.expr(WORD)
    person = lambda family, given, name: F.struct(F.lit(family).alias("family"), F.lit(given).alias("given"), F.lit(name).alias("name"))
    work = F.struct(
        F.array(F.lit("On"), word, F.lit("lists")).alias("title"), F.when(key() % 3 == 0, F.array(F.lit("a survey"))).alias("subtitle"), F.array(F.lit("List Journal")).alias("container-title"),
        F.when(key() % 4 != 0, F.struct(F.array(F.array(F.year("o_orderdate"), F.lit(1))).alias("date-parts"))).alias("issued"), (key() % 60).alias("volume"), F.when(key() % 5 != 0, "2").alias("issue"),
        F.concat(key().cast("string"), F.lit("--"), (key() + 9).cast("string")).alias("page"), F.concat(F.lit("10.7/"), word).alias("DOI"), F.lit("Press").alias("publisher"), F.when(key() % 6 == 0, F.array(F.lit("9780000000001"))).alias("ISBN"),
        F.array(person("Waa", "B.", None), person(None, None, "List Group"), person(None, "C.", None), person("Wbb", None, None)).alias("author"),
    )
    return _fields(records.known_work(_answered(spark, sf_dir, F.struct(F.lit("ok").alias("status"), work.alias("message"))), "crossref"))


@query(
    _expected(
        "OpenAlex", title=f"'On ' || {WORD}", container="CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'List Journal' END", year=YEAR, volume="'7'", issue="CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '2' END",
        pages="CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '12' ELSE '12-19' END", doi=f"CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '10.7/' || {WORD} END", author="'B. Waa'",
    )
)
def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with places that are null at every depth, first pages without last ones, authors without names."""
    k4 = key() % 4
    author = lambda name: F.struct(F.struct(F.lit(name).alias("display_name")).alias("author"))
    work = F.struct(
        F.concat(F.lit("On "), F.expr(WORD)).alias("title"), F.when(key() % 3 != 0, F.struct(F.struct(F.lit("List Journal").alias("display_name")).alias("source"))).alias("primary_location"), F.year("o_orderdate").alias("publication_year"),
        F.struct(F.lit("7").alias("volume"), F.when(key() % 5 != 0, "2").alias("issue"), F.when(k4 != 0, "12").alias("first_page"), F.when(k4 != 1, "19").alias("last_page")).alias("biblio"),
        F.when(key() % 6 != 0, F.concat(F.lit("https://doi.org/10.7/"), F.expr(WORD))).alias("doi"), F.array(author("B. Waa"), author(None)).alias("authorships"),
    )
    return _fields(records.known_work(_answered(spark, sf_dir, work), "openalex"))


@query(_expected("DataCite", title=f"'Data on ' || {WORD}", year=YEAR, doi=f"'10.8/' || {WORD}", publisher="'Archive'", author="CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Waa, B.;Wbb, C.' END"))
def datacite_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes two levels down, several titles, lists that are missing."""
    titles = F.array(F.struct(F.concat(F.lit("Data on "), F.expr(WORD)).alias("title")), F.struct(F.lit("another").alias("title")))
    creators = F.when(key() % 3 != 0, F.array(F.struct(F.lit("Waa, B.").alias("name")), F.struct(F.lit("Wbb, C.").alias("name"))))
    own = F.struct(titles.alias("titles"), F.year("o_orderdate").alias("publicationYear"), F.concat(F.lit("10.8/"), F.expr(WORD)).alias("doi"), F.lit("Archive").alias("publisher"), creators.alias("creators"))
    return _fields(records.known_work(_answered(spark, sf_dir, F.struct(F.struct(own.alias("attributes")).alias("data"))), "datacite"))


@query(f"SELECT o_orderkey AS seq, n AS pos, 'On ' || {WORD} || ' ' || CAST(n AS VARCHAR) AS title, 'Venue' AS container, CASE WHEN n = 1 THEN '' ELSE {YEAR} END AS year, CASE WHEN n = 0 THEN '10.9/' || {WORD} ELSE '' END AS doi FROM orders, (VALUES (0), (1), (2)) v(n) WHERE o_orderkey % {BROKEN} <> 0 AND n < o_orderkey % 4")
def s2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of a search, none to three of them; what is broken off lists none."""
    paper = lambda n: F.struct(F.concat(F.lit("On "), F.expr(WORD), F.lit(f" {n}")).alias("title"), F.lit("Venue").alias("venue"), F.year("o_orderdate").alias("year") if n != 1 else F.lit("").alias("year"), F.struct((F.concat(F.lit("10.9/"), F.expr(WORD)) if n == 0 else F.lit(None).cast("string")).alias("DOI")).alias("externalIds"))
    papers = F.slice(F.array(*(F.to_json(paper(n)) for n in range(3))), 1, (key() % 4).cast("int"))
    whole = F.concat(F.lit('{"total": 3, "data": ['), F.array_join(papers, ", "), F.lit("]}"))
    answers = table(spark, sf_dir, "orders").select(key().alias("seq"), F.when(key() % BROKEN == 0, F.substring(whole, 1, 25)).otherwise(whole).alias("json"))
    return records.found_works(answers, "s2").select("seq", "pos", "title", "container", "year", "doi")


# ---------------------------------------------------------------- lists beside each other, citations


@query(
    BIB + "SELECT doc_id, CASE WHEN seq % 9 = 0 THEN 'agent_only' ELSE 'pair' END AS kind, seq, CASE WHEN seq % 9 <> 0 THEN -seq END AS pos, seq % 9 <> 0 AND seq % 4 <> 0 AS same FROM bib "
    "UNION ALL SELECT doc_id, 'published_only', NULL, seq, false FROM bib WHERE seq % 10 = 3"
)
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries beside lines in another order. Entries that were lost, lines that were added and all the rest are written in alphabets of their own, so what fits
    nothing is known; a fourth of the lines have a DOI more."""
    b = bibliography(spark, sf_dir).withColumn("hex", F.sha2(F.col("seq").cast("string"), 512))
    other = lambda letters: F.translate("hex", "0123456789abcdef", letters)
    items = b.select("doc_id", "seq", F.col("hex").alias("raw"), F.when(F.col("seq") % 9 == 0, other("ghijklmnopqrstuv")).otherwise(F.col("hex")).alias("formatted"), F.lit("").alias("title"), F.concat(F.lit("10.5/"), F.substring("hex", 1, 30)).alias("doi"))
    kept = items.where("seq % 9 <> 0").select("doc_id", (-F.col("seq")).alias("pos"), F.concat("formatted", F.when(F.col("seq") % 4 == 0, F.concat(F.lit(" "), "doi")).otherwise("")).alias("text"))
    added = b.where("seq % 10 = 3").select("doc_id", F.col("seq").alias("pos"), other("가나다라마바사아자차카타파하거너").alias("text"))
    return align.align(items, kept.unionByName(added)).select("doc_id", "kind", "seq", "pos", "same")


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bodies that cite every third entry 30 years too late and works by authors whom the list lacks; some name a cited author in lower case. And the entries."""
    b = bibliography(spark, sf_dir)
    name = F.split_part("first", F.lit(","), F.lit(1))
    late = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("As told ("), name, F.lit(", "), (F.col("year").cast("int") + 30).cast("string"), F.lit(").")))
    lost = F.when(F.col("seq") % 4 == 1, F.concat(F.lit("See (Qu"), F.translate((F.col("seq") % 7).cast("string"), "0123456", "abcdefg"), F.lit("ist, "), F.col("year"), F.lit(").")))
    told = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("so says "), F.lower(name), F.lit(" too.")))
    lines = F.array_sort(F.collect_list(F.struct("seq", F.array_join(F.array(late, lost, told), "\n").alias("x"))))
    bodies = b.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["x"]), "\n").alias("text"))
    return segment.reference_lists(bodies.withColumn("text", F.concat("text", F.lit("\nReferences\n[1] Waa, B. (1990). On lists of every kind. List Journal, 1(2), 3-4.")))), structured(spark, sf_dir)


CITED = ", late AS (SELECT DISTINCT doc_id, split_part(first, ',', 1) AS name, CAST(CAST(year AS INTEGER) + 30 AS VARCHAR) AS year, true AS name_only_match FROM bib WHERE seq % 3 = 0), lost AS (SELECT DISTINCT doc_id, 'Qu' || translate(CAST(seq % 7 AS VARCHAR), '0123456', 'abcdefg') || 'ist' AS name, year, false AS name_only_match FROM bib WHERE seq % 4 = 1) "


@query(BIB + CITED + "SELECT doc_id, name, year, '(' || name || ', ' || year || ')' AS snippet, name_only_match FROM (SELECT * FROM late UNION ALL SELECT * FROM lost)")
def unlisted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that a list lacks, many in each text: those whose author has a work of another year, and those by others."""
    return citations.cross_check(*_cited(spark, sf_dir))[1]


@query(
    BIB + ", names AS (SELECT DISTINCT doc_id, lower(split_part(first, ',', 1)) AS name FROM bib WHERE seq % 3 <> 2), keys AS (SELECT doc_id, seq, lower(split_part(first, ',', 1)) AS name FROM bib UNION ALL SELECT doc_id, seq, lower(split_part(second, ',', 1)) FROM bib WHERE second <> '') "
    "SELECT doc_id, seq FROM bib WHERE NOT EXISTS (SELECT 1 FROM keys JOIN names ON keys.doc_id = names.doc_id AND names.name LIKE '%' || keys.name || '%' WHERE keys.doc_id = bib.doc_id AND keys.seq = bib.seq)"
)
def unnamed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of which no author stands in the text in any letter case."""
    return citations.cross_check(*_cited(spark, sf_dir))[2].select("doc_id", "seq")


FORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)(?:https?://|doi:\s*)[^\s]+', chr(1), 'g'), '\b(?:18|19|20)[0-9]{2}[a-z]?\b', chr(2), 'g'), '[0-9]+', chr(3), 'g'), '\p{L}+(?:[ ''’-]+\p{L}+)*', chr(4), 'g')"


@query(
    BIB + f", f AS (SELECT container AS journal, replace(replace(replace(replace({FORM}, chr(1), '<link>'), chr(2), '<year>'), chr(3), '<n>'), chr(4), '<words>') AS form FROM bib), c AS (SELECT journal, form, count(*) AS n FROM f GROUP BY 1, 2) "
    "SELECT journal, form, n, round(n / share_of, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY journal) AS share_of FROM c) WHERE n >= 5"
)
def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each journal's references are written, by the order of their parts and marks."""
    return stages.mined_forms(bibliography(spark, sf_dir).select(F.col("container").alias("journal"), "raw"), 5)


def _page_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names with a letter lost or changed, from the titles of all pages; and the listing: titles of every second page."""
    title = Written(spark).cut(html.page_record(table(spark, sf_dir, "pages")).select("page_id", "title"))  # pages are read once
    at = (F.col("page_id") % 11 + 2).cast("int")
    lost = F.concat(F.substring("title", 1, 12), F.expr("substring(title, 14)"))
    changed = F.overlay("title", F.lit("x"), at, 1)
    name = F.when(F.col("page_id") % 3 == 0, lost).when(F.col("page_id") % 3 == 1, changed).otherwise(F.col("title"))
    return title.select(F.lit("journal").alias("type"), name.alias("container")), title.where("page_id % 2 = 0").select("title")


@query()
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a listing has by the likeness that counts in production; names and listing grow with the pages."""
    return link.listed_journals(*_page_names(spark, sf_dir))


# ---------------------------------------------------------------- stores


@query("SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN 'book_chapter' WHEN 1 THEN 'book;book_chapter' ELSE '' END AS types, substr('Rule ' || c_name, 1, 600) AS rule FROM customer WHERE length(trim('Rule ' || c_name)) >= 5")
def chapter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for chapters keep their type; types that nobody knows go."""
    k = F.col("c_custkey") % 3
    types = F.when(k == 0, F.array(F.lit("book_chapter"), F.lit("chapter"))).when(k == 1, F.array(F.lit("book"), F.lit("book_chapter"))).otherwise(F.array(F.lit("scroll")))
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("Rule "), "c_name").alias("rule"), types.alias("types"), F.lit("").alias("topic"))
    return stores.validated(rules).select("seq", F.array_join("types", ";").alias("types"), "rule")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of changes to the records of 200 keys; a version is an event's number."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 200).alias("k"), F.col("event_id").cast("long").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.col("event_type").alias("value"))


LOG = "WITH log AS (SELECT user_id % 200 AS k, event_id AS version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op, event_type AS value FROM events)"


@query(LOG + " SELECT k, arg_max(version, version) AS version, arg_max(value, version) AS value FROM log WHERE version <= 500 GROUP BY k HAVING arg_max(op, version) <> 'delete'")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as it was at a version."""
    return stores.latest(_log(spark, sf_dir), "k", "version", as_of=500)


@query(LOG + " SELECT k, max(version) AS version, arg_max(op, version) AS op, arg_max(value, version) AS value FROM log WHERE version <= 500 GROUP BY k UNION ALL SELECT k, version, op, value FROM log WHERE version > 500")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without what later changes have replaced."""
    return stores.compacted(_log(spark, sf_dir), "k", "version", 500).select("k", "version", "op", "value")


@query(LOG + ", now AS (SELECT k, max(version) AS v FROM log GROUP BY k) SELECT k, 'second' AS writer FROM now WHERE k % 3 <> 0 UNION ALL SELECT k, 'first' FROM now WHERE k % 5 = 0")
def rejected_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers change each record: the later one loses where both saw the present version; one who saw an older version loses in any case."""
    log = _log(spark, sf_dir)
    now = log.groupBy("k").agg(F.max("version").alias("expected"))
    first = now.select("k", F.when(F.col("k") % 5 == 0, F.col("expected") - 1).otherwise(F.col("expected")).alias("expected"), F.lit("first").alias("writer"))
    second = now.where("k % 3 <> 0 OR k % 5 = 0").select("k", F.when(F.col("k") % 3 == 0, F.col("expected")).when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.col("expected")).alias("expected"), F.lit("second").alias("writer"))
    changes = first.unionByName(second).withColumns({"op": F.lit("update"), "value": F.lit("new")})
    return stores.accepted(log, changes, "k", "version")[1].select("k", "writer")


@query(
    "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 1 THEN 'a budget or a rate is a number' WHEN 2 THEN 'two codes are equal' WHEN 3 THEN 'codes are an object of names and codes' END AS error, "
    "CASE WHEN c_custkey % 5 = 0 THEN 1500.5 WHEN c_custkey % 5 = 4 THEN NULL ELSE 9.0 END AS budget, CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 = 4 THEN '' ELSE 'old' END AS access_code, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'BUILDING=x' || c_custkey WHEN c_custkey % 5 = 4 THEN 'A=1' ELSE 'A=1' END AS codes, CASE WHEN c_custkey % 5 = 0 THEN 'set' WHEN c_custkey % 5 = 4 THEN 'cleared' ELSE 'kept' END AS key, CASE c_custkey % 5 WHEN 0 THEN 'large' WHEN 4 THEN 'small' ELSE 'old' END AS model FROM customer"
)
def settings_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of many stores after a change each: valid ones, a budget that is no number, codes that clash or are no object, values that are unset."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    text = F.col("c_custkey").cast("string")
    current = c.select(F.col("c_custkey").alias("id"), F.lit("old").alias("model"), F.lit("old").alias("access_code"), F.lit(9.0).alias("monthly_budget_usd"), F.lit(None).cast("double").alias("usd_krw"), F.create_map(F.lit("A"), F.lit("1")).alias("access_codes"), *(F.create_map().cast("map<string,string>").alias(x) for x in ("editor_codes", "chair_codes")))
    changes = c.select(
        F.col("c_custkey").alias("id"), F.when(k == 0, "sk-1").otherwise("").alias("api_key"), F.when(k == 4, "1").otherwise("0").alias("clear"), F.when(k == 0, "large").otherwise("unknown").alias("model"), F.when(k == 0, F.col("c_name")).when(k == 4, " ").alias("access_code"),
        F.when(k == 0, "1,500.5").when(k == 1, "much").when(k == 4, "").alias("monthly_budget_usd"), F.lit(None).cast("string").alias("usd_krw"), F.when(k == 0, F.concat(F.lit('{"BUILDING": " x'), text, F.lit(' ", "": "1", "B": ""}'))).when(k == 3, "[1]").alias("access_codes"),
        F.when(k == 2, '{"Z": "1"}').alias("editor_codes"), F.lit(None).cast("string").alias("chair_codes"),
    )
    found = stores.saved_settings(current, changes, ["small", "large"])
    codes = F.array_join(F.transform(F.map_entries("access_codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("id", "error", F.col("monthly_budget_usd").alias("budget"), "access_code", codes.alias("codes"), "key", "model")


@query(
    USAGE + "SELECT 'month' AS level, substr(time, 1, 7) AS period, NULL AS org, count(*) AS uses, sum(files) AS files, sum(refs) AS refs, count(DISTINCT u) AS users FROM usage GROUP BY 2 UNION ALL SELECT 'day', substr(time, 1, 10), NULL, count(*), sum(files), sum(refs), count(DISTINCT u) FROM usage GROUP BY 2 "
    "UNION ALL SELECT 'org', NULL, CASE WHEN org = '' THEN '(미입력)' ELSE org END, count(*), sum(files), sum(refs), count(DISTINCT u) FROM usage GROUP BY 3 UNION ALL SELECT 'all', NULL, NULL, count(*), sum(files), sum(refs), count(DISTINCT u) FROM usage"
)
def usage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by month, by day, by organisation and in all, from one aggregate."""
    return reports.usage_levels(_usage(spark, sf_dir)).drop("users_estimate", "sketch")


ORGS = (("BUILDING", "Journal of Building"), ("MACHINERY", "Machinery Review"))


@query("SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Journal of Building' WHEN 'MACHINERY' THEN 'Machinery Review' END AS journal FROM customer")
def society_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Societies beside the journal that each of them has, if it is one of those that are supported."""
    known = spark.createDataFrame(ORGS, "org string, journal string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("org"))
    return reports.with_journal(rows, known).select("id", "journal")


@query(
    BIB + "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN count(*) END AS total, CASE WHEN doc_id % 7 <> 0 THEN count_if(seq % 3 = 0) END AS changed, CASE WHEN doc_id % 7 <> 0 THEN count_if(seq % 5 = 0) END AS verified, "
    "CASE WHEN doc_id % 7 <> 0 THEN count_if(seq % 4 = 0) END AS crosscheck_issues, CASE WHEN doc_id % 7 = 0 THEN 'no reference list found' END AS error FROM bib GROUP BY doc_id"
)
def batch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a file: its counts, or why it could not be read."""
    b = bibliography(spark, sf_dir).select("doc_id", "seq")
    k = F.col("seq")
    items = b.where("doc_id % 7 <> 0").select("doc_id", (k % 3 == 0).alias("changed"), (k % 2 == 0).alias("has_issues"), F.when(k % 5 == 0, "verified").otherwise("suspect").alias("status"), F.lit(False).alias("severe"), F.lit(0).alias("n_suggestions"), F.lit(0).alias("n_tips"))
    counts = reports.summary(items, b.where("doc_id % 7 <> 0 AND seq % 4 = 0"))
    errors = b.where("doc_id % 7 = 0").select("doc_id", F.lit("no reference list found").alias("error")).distinct()
    return exports.batch_report(counts, errors).select("doc_id", "total", "changed", "verified", "crosscheck_issues", "error")


# ---------------------------------------------------------------- lookups and text functions


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'not_found' WHEN o_orderkey % 5 IN (1, 2) THEN 'mismatch' ELSE 'verified' END AS status FROM orders")
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries beside the record that a given DOI names: one that nobody has, another work's, one of another year, the right one."""
    title = F.trim(F.regexp_replace(F.sha2(key().cast("string"), 256), "(.{8})", "$1 "))
    k, year = key() % 5, F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(key().alias("seq"), title.alias("title"), year.cast("string").alias("year"), k.alias("k"))
    doi = F.concat(F.lit("10.1234/"), F.col("seq").cast("string"))
    authority = rows.where("k <> 0").select(F.col("seq").alias("pos"), F.when(F.col("k") == 1, F.reverse("title")).otherwise(F.col("title")).alias("title"), F.lit("").alias("subtitle"), F.when(F.col("k") == 2, F.col("year").cast("int") + 3).otherwise(F.col("year").cast("int")).cast("string").alias("year"), *(F.lit("").alias(c) for c in ("volume", "issue", "pages", "isbn", "publisher")), doi.alias("doi"))
    found = lookups.with_identifier(rows.drop("k"), rows.select("seq", doi.alias("identifier")), authority, ["seq"])
    return found.select("seq", "status")


@query("SELECT p_partkey, 'equal:lists of |replace:' || p_name || '>' || p_brand AS steps FROM (SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', '가나다라마바사아자차카타파하거너더러머버서어저처커터') AS p_name, p_brand FROM part)")
def edit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from one string to another: what is equal, what is replaced."""
    name = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "가나다라마바사아자차카타파하거너더러머버서어저처커터")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("lists of "), name).alias("a"), F.concat(F.lit("lists of "), "p_brand").alias("b"))
    step = F.transform(similarity.edits("a", "b"), lambda e: F.concat(e["tag"], F.lit(":"), F.when(e["tag"] == "equal", e["a"]).otherwise(F.concat(e["a"], F.lit(">"), e["b"]))))
    return rows.select("p_partkey", F.array_join(step, "|").alias("steps"))


@query("SELECT event_id, event_id % 6 <> 0 AS blocked FROM events")
def blocked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that must not be fetched: private and loopback addresses, local names, other schemes."""
    k, own = F.col("event_id") % 6, F.col("event_id").cast("string")
    link = F.element_at(F.array(*(F.concat(F.lit(x), own) for x in ("https://lists.example/", "http://10.0.0.1/", "http://localhost:80/", "ftp://lists.example/", "http://[::1]/", "http://192.168.7.9/"))), (k + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.blocked_address(link).alias("blocked"))


@query("SELECT c_custkey AS k, sha256('salt' || c_name) AS code FROM customer")
def hashed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), stores.code_hash(F.col("c_name"), "salt").alias("code"))


@query("SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'feedback' END AS label, CASE WHEN c_custkey % 3 = 0 THEN 'specific' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'specific' ELSE 'common' END AS place FROM customer WHERE c_nationkey % 2 = 0 AND (c_custkey % 3 <> 0 OR c_mktsegment = 'BUILDING')")
def shown_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled rules as one society sees them: its own, those of cases that name it, those for all."""
    k = F.col("c_custkey")
    journal = F.when(k % 3 == 0, F.col("c_mktsegment")).when((k % 3 == 1) & (k % 2 == 0), "BUILDING Review").otherwise("")
    rules = table(spark, sf_dir, "customer").select(k.alias("rule_id"), F.when(k % 3 == 0, "org").otherwise("feedback").alias("source"), journal.alias("journal"), (F.col("c_nationkey") % 2 == 0).alias("enabled"))
    placed = stores.routed_rules(rules, "BUILDING").select("rule_id", "place")
    return stores.enabled_rules(rules, "BUILDING").join(placed, "rule_id").select("rule_id", "label", "place")


@query("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def key_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that either table has, each once."""
    return stores.key_union(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")))


@query("SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by time, then by number."""
    own = stores.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return own.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first"))
