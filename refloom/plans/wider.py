"""More registered queries: every kind of entry, misspelt titles through all routes, answers of services, changes of stores, marks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import names, text
from refloom.operators import link, parse, render, stages, stores
from refloom.plans.bibliography import table
from refloom.plans.queries import query
from refloom.plans.typed import TYPED_SQL, typed
from refloom.sources import records
from refloom.streaming import limits

# ---------------------------------------------------------------- entries of every kind

FIELDS = "type lang title container year date volume issue pages edition place publisher degree institution report_no url".split()


@query(TYPED_SQL + f"SELECT seq, rtrim(author, '.') AS author, notes, {', '.join(FIELDS)} FROM typed")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed fields of 15 kinds of entries, with Korean types, corporate authors and places that stand after their publishers."""
    found = parse.parse(typed(spark, sf_dir).select("seq", "raw"))
    return found.select("seq", F.rtrim(F.array_join("authors", ";"), F.lit(".")).alias("author"), F.array_join("notes", "; ").alias("notes"), *FIELDS)


@query(TYPED_SQL + "SELECT seq, styled AS formatted FROM typed")
def typed_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.formatted(parse.parse(typed(spark, sf_dir).select("seq", "raw"))).select("seq", "formatted")


@query(TYPED_SQL + "SELECT type, lang, count(*) AS n FROM typed GROUP BY 1, 2")
def typed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse(typed(spark, sf_dir).select("seq", "raw")).groupBy("type", "lang").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- misspelt titles

#: The route of an entry by its number modulo 10: type, language, the tables that have its record, and the result.
ROUTES = [
    ("journal", "west", ["crossref"], "verified", "crossref"),
    ("journal", "west", ["crossref", "openalex"], "verified", "crossref"),
    ("journal", "west", ["crossref"], "verified", "crossref any year"),
    ("journal", "west", ["crossref"], "suspect", None),
    ("journal", "west", ["openalex", "s2"], "verified", "openalex"),
    ("journal", "ko", ["kci", "crossref"], "verified", "kci"),
    ("thesis", "ko", ["nanet"], "verified", "nanet"),
    ("book", "ko", ["nanet"], "verified", "nanet"),
    ("report", "ko", ["crossref"], "not_found", None),
    ("web", "west", [], "link", None),
]


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with titles of eight words that no other has; in two of three, two letters of two words differ from the record's (right)."""
    k = F.col("o_orderkey")
    right = F.trim(F.regexp_replace(F.sha2(k.cast("string"), 256), "(.{8})", "$1 "))
    wrong = F.concat(F.substring(right, 1, 11), F.lit("z"), F.substring(right, 13, 30), F.lit("z"), F.substring(right, 44, 40))
    t = (k % 10).cast("int")
    by_route = lambda n: F.element_at(F.array(*(F.lit(r[n]) for r in ROUTES)), t + 1)
    url = F.when(t == 9, F.concat(F.lit("https://lists.example/"), (k % 20).cast("string"))).otherwise("")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), t.alias("t"), by_route(0).alias("type"), by_route(1).alias("lang"), F.when(k % 3 == 0, right).otherwise(wrong).alias("title"), right.alias("right"), F.year("o_orderdate").cast("string").alias("year"),
        (k % 60 + 1).cast("string").alias("volume"), (k % 4 + 1).cast("string").alias("issue"), F.concat((k % 400 + 1).cast("string"), F.lit("-"), (k % 400 + 9).cast("string")).alias("pages"), F.lit("").alias("doi"), url.alias("url"),
    )


@query(
    "SELECT o_orderkey AS seq, CASE o_orderkey % 10 WHEN 3 THEN 'suspect' WHEN 8 THEN 'not_found' WHEN 9 THEN CASE WHEN o_orderkey % 20 = 9 THEN 'link_ok' ELSE 'link_dead' END ELSE 'verified' END AS status, "
    "CASE o_orderkey % 10 WHEN 0 THEN 'crossref' WHEN 1 THEN 'crossref' WHEN 2 THEN 'crossref any year' WHEN 4 THEN 'openalex' WHEN 5 THEN 'kci' WHEN 6 THEN 'nanet' WHEN 7 THEN 'nanet' END AS source, "
    "CASE WHEN o_orderkey % 10 IN (3, 8, 9) THEN NULL ELSE '10.2/' || CAST(o_orderkey AS VARCHAR) END AS record FROM orders"
)
def verified_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt titles through every route: articles at hand and of other years, domestic articles, theses, books and reports, links."""
    entries = _routed(spark, sf_dir)
    # of kinds 2 and 3 the record is five years off; of kind 3 its volume, issue and page are other ones, too
    year = F.when(F.col("t").isin(2, 3), F.col("year").cast("int") + 5).when(F.col("t") == 1, F.col("year").cast("int") + 1).otherwise(F.col("year").cast("int")).cast("string")
    other = F.col("t") == 3
    record = entries.select("t", F.col("seq").alias("pos"), F.col("right").alias("title"), F.lit("").alias("subtitle"), year.alias("year"), *(F.when(other, "7777").otherwise(F.col(c)).alias(c) for c in ("volume", "issue", "pages")), F.concat(F.lit("10.2/"), F.col("seq").cast("string")).alias("doi"), F.lit("").alias("publisher"))
    authorities = {name: record.where(F.col("t").isin([n for n, r in enumerate(ROUTES) if name in r[2]])).drop("t") for name in ("crossref", "openalex", "s2", "kci", "nanet", "nlk")}
    links = spark.createDataFrame([("https://lists.example/9", True), ("https://lists.example/19", False)], "url string, ok boolean")
    found = link.verify(entries.drop("right", "t"), authorities, ["seq"], links)
    return found.select("seq", "status", "source", F.col("c_doi").alias("record"))


# ---------------------------------------------------------------- marks of records


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'retraction' WHEN 1 THEN 'correction' WHEN 2 THEN 'expression_of_concern' END AS type, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS severe, "
    "CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y') || '-2-3' WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN '' END AS date FROM events"
)
def retraction_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update of a record that counts: a severe one before those listed first."""
    k, y = F.col("event_id") % 5, F.year("ts")
    update = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), F.array(*parts).cast("array<int>").alias("date_parts"))
    some = F.when(k == 0, F.array(update("Correction", y), update("Retraction", y, F.lit(2), F.lit(3)))).when(k == 1, F.array(update("odd", y), update("correction", y))).when(k == 2, F.array(update("Expression-of-Concern"))).when(k == 3, F.array(update("odd", y)))
    found = table(spark, sf_dir, "events").select("event_id", link.retraction(some).alias("r"))
    return found.select("event_id", "r.type", "r.severe", "r.date")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'SSRN' WHEN 2 THEN 'OSF' WHEN 3 THEN 'bioRxiv/medRxiv' WHEN 4 THEN 'preprint' END AS server FROM events")
def preprint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    own = F.col("event_id").cast("string")
    doi = F.when(k == 0, F.concat(F.lit("10.48550/ARXIV."), own)).when(k == 2, F.concat(F.lit("10.31219/"), own)).when(k == 5, F.concat(F.lit("10.1000/"), own)).otherwise("")
    url = F.when(k == 1, F.concat(F.lit("https://papers.SSRN.com/"), own)).when(k == 3, F.concat(F.lit("https://www.medrxiv.org/"), own)).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", link.preprint_server(doi, url, F.when(k == 4, "preprint")).alias("server"))


# ---------------------------------------------------------------- answers of services


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


_LETTERS = "translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij')"


@query(
    f"""SELECT o_orderkey AS seq, n AS pos, CASE WHEN n = 1 THEN '목록 ' || {_LETTERS} || ' 시행령' ELSE 'On ' || {_LETTERS} || ' lists' END AS title,
CASE WHEN n = 1 THEN 'law' ELSE CASE o_orderkey % 7 WHEN 1 THEN 'journal' WHEN 2 THEN 'conference' WHEN 3 THEN 'book' WHEN 4 THEN 'report' WHEN 5 THEN 'thesis' WHEN 6 THEN 'web' ELSE 'unknown' END END AS type,
CASE WHEN n = 1 THEN 'ko' ELSE 'west' END AS lang, CASE WHEN n = 1 THEN '' ELSE 'Waa, B.' END AS author, CASE WHEN n = 1 THEN '2001' ELSE strftime(o_orderdate, '%Y') END AS year, CASE WHEN n = 1 THEN '' ELSE 'List Journal' END AS container, CASE WHEN n = 1 THEN '' ELSE '10.3/' || {_LETTERS} END AS doi
FROM orders, (VALUES (0), (1)) v(n)"""
)
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's own references from XML: kinds by code, laws by their titles; one without a title is none."""
    word = F.expr(_LETTERS)
    first = F.concat(F.lit('<reference type-code="0'), (F.col("o_orderkey") % 7).cast("string"), F.lit('">'), _tag("title", F.concat(F.lit("On "), word, F.lit(" lists"))), _tag("author", F.lit("Waa, B.")), _tag("pubi-year", F.year("o_orderdate").cast("string")), _tag("journal-name", F.lit("List Journal")), _tag("doi", F.concat(F.lit("https://doi.org/10.3/"), word)), F.lit("</reference>"))
    second = F.concat(F.lit('<reference type-code="99">'), _tag("title", F.concat(F.lit("목록 "), word, F.lit(" 시행령"))), _tag("registration-day", F.lit("2001-05-06")), F.lit("</reference>"))
    xml = F.concat(F.lit("<answer>"), first, second, F.lit('<reference type-code="01"><title> </title></reference></answer>'))
    found = records.references(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), xml.alias("xml")))
    return found.select("seq", "pos", "title", "type", "lang", F.array_join("authors", ";").alias("author"), "year", "container", "doi")


@query(f"SELECT o_orderkey AS seq, n AS pos, CASE n WHEN 0 THEN 'Waa, B. On ' || {_LETTERS} || ' lists' ELSE 'Another reference of some length' END AS text FROM orders, (VALUES (0), (1)) v(n)")
def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of reference-like elements: each once, long ones only."""
    line = F.concat(F.lit("Waa, B.  On "), F.expr(_LETTERS), F.lit(" lists"))
    xml = F.concat(F.lit("<a>"), _tag("reference-text", line), _tag("referenceInfo", F.lit("too short")), _tag("reference-text", F.lit("Another reference\nof some length")), _tag("reference-text", line), _tag("other", F.lit("an element that is no reference")), F.lit("</a>"))
    return records.reference_texts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), xml.alias("xml")))


@query(f"SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'Article ' WHEN 1 THEN 'Thesis ' ELSE 'Book ' END || {_LETTERS} AS title, strftime(o_orderdate, '%Y') AS year, 'Second Press' AS publisher, 'Waa, B.' AS author FROM orders")
def assembly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are lists of names and values; the title's name depends on the kind, the last of repeated names counts."""
    k, word = F.col("o_orderkey") % 3, F.expr(_LETTERS)
    item = lambda name, value: _tag("item", F.concat(_tag("name", name), _tag("value", value)))
    name = F.when(k == 0, "기사명").when(k == 1, "논문명").otherwise("자료명")
    title = F.concat(F.when(k == 0, "Article ").when(k == 1, "Thesis ").otherwise("Book "), word, F.lit(" = parallel title / by somebody"))
    year = F.when(k == 0, "발행년도").when(k == 1, "학위년도").otherwise("발행년")
    xml = F.concat(F.lit("<r><recode>"), item(name, title), item(year, F.date_format("o_orderdate", "yyyy.MM")), item(F.lit("발행자"), F.lit("First Press")), item(F.lit("저자명"), F.lit("Waa, B.")), item(F.lit("발행자"), F.lit("Second Press")), F.lit("</recode></r>"))
    found = records.library_records(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), xml.alias("xml")))
    return found.select("seq", "title", "year", "publisher", F.col("authors")[0].alias("author"))


@query("SELECT p_partkey, o_n AS pos, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS publisher, CASE WHEN p_partkey % 5 <> 0 THEN '1999' ELSE '' END AS year, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS isbn, p_partkey % 5 = 0 AS unavailable FROM (SELECT *, CASE WHEN p_partkey % 5 <> 0 THEN 0 END AS o_n FROM part)")
def library_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books from JSON answers; an error inside an answer makes a row without a book."""
    book = F.struct(F.concat("p_name", F.lit(" (big print) : a view = other")).alias("TITLE"), F.lit("Waa").alias("AUTHOR"), F.col("p_brand").alias("PUBLISHER"), F.lit("1999-02").alias("PUBLISH_PREDATE"), F.col("p_partkey").cast("string").alias("EA_ISBN"))
    json = F.when(F.col("p_partkey") % 5 == 0, F.lit('{"RESULT": "ERROR", "ERR_MESSAGE": "key"}')).otherwise(F.to_json(F.struct(F.array(book).alias("docs"))))
    found = records.books(table(spark, sf_dir, "part").select("p_partkey", json.alias("json")))
    return found.select("p_partkey", "pos", F.when(F.col("unavailable"), None).otherwise(F.col("title")).alias("title"), "publisher", "year", "isbn", "unavailable")


@query("SELECT p_partkey, 'guide to the ' || p_name || ' | guide to the | guide to' AS queries FROM part")
def shortened_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's queries: the title, its first three words, its first two."""
    made = records.shortened_titles(F.concat(F.lit("guide to the "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(made, " | ").alias("queries"))


# ---------------------------------------------------------------- changes of stores


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a store of rules in their first version."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), (F.col("c_nationkey") % 2 == 0).alias("enabled"), F.col("c_mktsegment").alias("org"), F.lit(1).alias("version"), F.lit("insert").alias("op"))


@query("SELECT c_custkey AS rule_id, (c_nationkey % 2 = 0) <> (c_custkey % 4 = 0) AS enabled FROM customer")
def toggled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after every fourth rule was switched."""
    log = _rules(spark, sf_dir)
    state = stores.latest(log, "rule_id", "version").withColumn("op", F.lit("insert"))
    changes = stores.toggled(state, log.where("rule_id % 4 = 0"), "rule_id", F.lit(2))
    return stores.latest(log.unionByName(changes), "rule_id", "version").select("rule_id", "enabled")


@query("SELECT c_custkey AS rule_id FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING')")
def deleted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after many rules were to be deleted by a viewer who may only touch one organisation's."""
    log = _rules(spark, sf_dir)
    own = stores.scoped(log.where("rule_id % 3 = 0"), "BUILDING")
    changes = stores.changed_rows(log, own, "rule_id", F.lit(2), "delete")
    return stores.latest(log.unionByName(changes), "rule_id", "version").select("rule_id")


@query(
    "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'approved' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 1 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS status, "
    "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 < 2 THEN 'chair' END AS resolved_by FROM orders"
)
def resolved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests after decisions: only pending ones change, the first decision of several counts, unknown actions change nothing."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"))
    action = F.when(F.col("request_id") % 3 == 0, "approve").when(F.col("request_id") % 3 == 1, "reject").otherwise("forget")
    first = requests.select("request_id", F.lit(1).alias("seq"), action.alias("action"), F.lit("chair").alias("resolver"), F.lit("").alias("note"))
    later = first.withColumns({"seq": F.lit(2), "action": F.lit("approve"), "resolver": F.lit("other")}).where("request_id % 3 < 2")
    return stores.resolved(requests, first.unionByName(later)).select("request_id", "status", "resolved_by")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one table that another lacks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return stores.key_difference(o, o.where("o_orderpriority = '1-URGENT'"), ["k"])


@query("SELECT o_orderkey AS seq, o_orderkey % 4 = 0 AS official, CASE WHEN o_orderkey % 4 = 0 THEN 'Official ' ELSE 'Stored ' END || CAST(o_orderkey AS VARCHAR) AS title_en FROM orders WHERE o_orderkey % 4 < 2")
def english_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English titles of domestic entries: official ones, for others a service's; an entry that the service leaves out has none."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("seq"), F.lit("ko").alias("lang"), F.col("o_orderkey").cast("string").alias("title"))
    official = e.where("doc_id % 4 = 0").select("doc_id", "seq", F.concat(F.lit("Official "), "title").alias("title_en"))

    def service(batch):
        own = batch[batch["doc_id"] % 4 == 1]
        return own.assign(title_en="Stored " + own["title"])[["doc_id", "seq", "title_en"]]

    found = stages.english_titles(e, official, service)
    return found.select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 4 == 0).alias("official"), "title_en")


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '이름 없는 기준' ELSE p_name END AS name, CASE WHEN p_partkey % 4 > 0 THEN 110 + length(p_name) ELSE length(p_name) END AS n, p_partkey % 4 > 0 AS kept, "
    "CASE WHEN p_partkey % 4 = 0 THEN 'a style needs 100 characters or more' END AS error FROM part"
)
def own_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as styles: short ones have an error, nameless ones a name."""
    k = F.col("p_partkey")
    texts = table(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("  "), "p_name", F.when(k % 4 > 0, F.repeat(F.lit("x"), F.lit(110))).otherwise(""), F.lit("\n")).alias("text"), F.lit("typed").alias("source"))
    return stores.styles(texts).select("p_partkey", "name", F.length("text").alias("n"), F.col("style_id").isNotNull().alias("kept"), "error")


@query(
    "SELECT c_custkey, c_custkey % 2 = 0 AS verify, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS autofix, CASE WHEN c_custkey % 5 = 0 THEN 'munpyeonhyeop' ELSE c_mktsegment END AS style_id, "
    "CASE c_custkey % 4 WHEN 0 THEN '기타(미기입)' WHEN 1 THEN c_mktsegment WHEN 2 THEN repeat('y', 60) ELSE '' END AS org, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'a user''s name is needed' WHEN c_custkey % 4 = 3 THEN 'an organisation is needed' END AS error FROM customer"
)
def checked_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flag = lambda n: F.when(k % n == 0, "1").otherwise("0")
    requests = table(spark, sf_dir, "customer").select(
        k, flag(2).alias("verify"), flag(3).alias("autofix"), *(F.lit("1").alias(c) for c in ("crosscheck", "english", "apply_extra")), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("style_id"),
        F.when(k % 7 == 0, " ").otherwise("somebody").alias("user_name"), F.when(k % 4 == 0, "기타").when(k % 4 == 1, F.col("c_mktsegment")).when(k % 4 == 2, "기타").otherwise("").alias("org"), F.when(k % 4 == 2, F.repeat(F.lit("y"), F.lit(70))).otherwise("").alias("org_etc"),
    )
    return stores.job_options(requests).select("c_custkey", "verify", "autofix", "style_id", "org", "error")


def _remembered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    cache = e.where("user_id % 4 = 0").select("user_id", F.lit("old").alias("answer")).distinct()
    ask = lambda keys: keys.select("user_id", F.when(F.col("user_id") % 4 == 1, "new").alias("answer"), (F.col("user_id") % 4 == 3).alias("failed"))
    return stores.remembered(e, "user_id", cache, ask)


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'old' WHEN user_id % 4 = 1 THEN 'new' END AS answer, user_id % 4 = 3 AS failed FROM events")
def remembered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from a cache and, once for each other key, from a service."""
    return _remembered(spark, sf_dir)[0].select("event_id", "answer", "failed")


@query("SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'old' WHEN user_id % 4 = 1 THEN 'new' END AS answer FROM events WHERE user_id % 4 <> 3")
def remembered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache afterwards: that nothing is known is remembered, failures are not."""
    return _remembered(spark, sf_dir)[1]


# ---------------------------------------------------------------- expiry and strings


@query("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus IN ('O', 'P') OR epoch(CAST(o_orderdate AS TIMESTAMP)) >= 852076800 - 7200")
def live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs still kept at the start of 1997: those that run or wait, and finished ones of the last two hours or later."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "waiting").otherwise("done").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp_ntz").cast("timestamp")).alias("created"))
    return limits.live(o, 852076800.0).select("job")


@query("SELECT event_id FROM events WHERE epoch(ts) > 1704672000 - 43200")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"))
    return limits.valid_sessions(e, 1704672000.0).select("event_id")


@query(
    "SELECT p_partkey, '10.5/' || CAST(p_partkey AS VARCHAR) AS doi, '10.5555/' || CAST(p_partkey AS VARCHAR) AS any_doi, 'https://lists.example/' || CAST(p_partkey AS VARCHAR) AS url, '978' || CAST(p_partkey AS VARCHAR) AS isbn, p_name AS main, p_name || ' and ' || p_brand AS plain, "
    "lower(regexp_replace(p_name || p_brand, '[^0-9A-Za-z]', '', 'g')) AS hangul, 'Rest of it.' AS rest FROM part"
)
def string_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, keys and cleaned forms of strings."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.bare_doi(F.concat(F.lit(" https://dx.doi.org/10.5/"), k)).alias("doi"),
        text.any_doi(F.concat(F.lit("see 10.5555/"), k, F.lit("), there"))).alias("any_doi"),
        text.url_of(F.concat(F.lit("At https://lists.example/"), k, F.lit(". Then"))).alias("url"),
        text.isbn_digits(F.concat(F.lit("ISBN: 978-"), k)).alias("isbn"),
        text.main_title(F.concat("p_name", F.lit(" [big print]: a view = other"))).alias("main"),
        text.without_tags(F.concat(F.lit("<b>"), "p_name", F.lit("</b> and  <i>"), "p_brand", F.lit("</i>"))).alias("plain"),
        text.hangul_key(F.concat("p_name", F.lit(" - "), "p_brand")).alias("hangul"),
        text.without_authors(F.concat(F.lit("Waa, "), "p_brand", F.lit(" (1999a). Rest of it."))).alias("rest"),
    )


@query("SELECT p_partkey, 'Notes on the ' || lower(p_name) || ' of lists: A view' AS cased FROM part")
def sentence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with capitals become sentences with one at the start and one after the colon."""
    made = F.concat(F.lit("Notes On The "), F.initcap("p_name"), F.lit(" Of Lists: A View"))
    return table(spark, sf_dir, "part").select("p_partkey", names.sentence_case(made).alias("cased"))
