"""The registered queries: each runs an operator over whole tables; most have the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import names, text
from refloom.operators import align, citations, link, parse, render, reports, segment, stores
from refloom.plans import lookups, manuscripts
from refloom.plans.bibliography import BIBLIOGRAPHY_SQL as BIB
from refloom.plans.bibliography import bibliography, table
from refloom.plans.bibliography import manuscripts as written
from refloom.sources import exports, html, records
from refloom.streaming import limits, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THIS_YEAR = 2000


def query(sql: str | None = None):
    def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries of the derived bibliography."""
    return parse.parse(bibliography(spark, sf_dir).select("doc_id", "seq", "raw"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived bibliography's own columns in the shape of parsed entries."""
    b = bibliography(spark, sf_dir)
    authors = F.filter(F.array("first", "second"), lambda a: a != "")
    return b.withColumns({"authors": authors, "lang": F.lit("west"), "type": F.lit("journal"), "notes": F.array().cast("array<string>"), "orig_year": F.lit(""), "publisher": F.lit("")})


# ---------------------------------------------------------------- pages and text


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'),
    '<br\s*/?>|</p>|</div>|</li>|</h[1-6]>|</tr>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 200) AS title, 'web' AS type, 'west' AS lang, '' AS year, '' AS doi FROM pages""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_record(table(spark, sf_dir, "pages")).select("page_id", "title", "type", "lang", "year", "doi")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN 'url' ELSE 'title' END AS kind, url AS value, NOT regexp_matches(url, '(?i)^https?://') AS blocked FROM pages""")
def page_input_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.input_kind(F.col("url")).alias("k"), text.blocked_address(F.col("url")).alias("blocked")).select("page_id", "k.kind", "k.value", "blocked")


@query("SELECT regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, count(*) AS n, count_if(regexp_matches(html, '(?i)<title')) AS titled FROM pages GROUP BY 1")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("html").rlike("(?i)<title")).alias("titled"))


@query("SELECT lang, CASE WHEN regexp_matches(substr(text, 1, 60), '[가-힣]') THEN 'ko' WHEN regexp_matches(substr(text, 1, 60), '[一-鿿぀-ゟ゠-ヿ]') THEN 'east' WHEN regexp_matches(substr(text, 1, 60), '[A-Za-z]') THEN 'west' ELSE 'ko' END AS script, count(*) AS n FROM documents GROUP BY 1, 2")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", text.script_class(F.coalesce("text", F.lit(""))).alias("script")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^0-9a-z]+', ' ', 'g')) AS title_key, regexp_replace(p_name || '. ' || p_type, '[\s.,:;()]+', '', 'g') AS compare_key, regexp_replace(lower(p_brand), '[^0-9a-z]', '', 'g') AS solid_key FROM part""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat("p_brand", F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.title_key(brand).alias("title_key"), text.compare_key(F.concat("p_name", F.lit(". "), "p_type")).alias("compare_key"), text.solid_key(F.col("p_brand")).alias("solid_key"))


@query(r"""WITH w AS (SELECT p_partkey, string_split('notes on the ' || p_name || ' of ' || lower(p_type) || ': a view', ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND NOT suffix(w[i - 1], ':') AND w[i] IN ('a', 'an', 'the', 'of', 'on') THEN w[i] ELSE upper(w[i][1:1]) || w[i][2:] END), ' ') AS titled FROM w""")
def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("notes on the "), "p_name", F.lit(" of "), F.lower("p_type"), F.lit(": a view"))
    return table(spark, sf_dir, "part").select("p_partkey", names.title_case(made).alias("titled"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents),
f AS (SELECT line, count(*) AS n, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1)
SELECT line, n, first[1] AS first_doc, first[2]::INTEGER AS first_pos FROM f""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.lines_of(table(spark, sf_dir, "documents"), "text")
    first = F.min(F.struct("doc_id", "pos"))
    return found.groupBy("line").agg(F.count("*").alias("n"), first.alias("f")).where("n > 1").select("line", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))


# ---------------------------------------------------------------- lists and entries


@query(BIB + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS seq, raw FROM bib")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.entries(segment.reference_lists(written(bibliography(spark, sf_dir))))


@query(BIB + "SELECT doc_id, count(*) AS n_entries, count(*) AS n_dated, count(*) >= 3 AS is_list FROM bib GROUP BY doc_id")
def list_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(bibliography(spark, sf_dir), heading=False)
    return segment.list_only(segment.entries(docs.withColumnRenamed("text", "section")))


@query(BIB + "SELECT doc_id, seq, 'journal' AS type, 'west' AS lang, rtrim(first, '.') || CASE WHEN second = '' THEN '' ELSE ';' || rtrim(second, '.') END AS authors, year, title, container, volume, issue, pages, doi, '' AS notes FROM bib")
def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("doc_id", "seq", "type", "lang", F.array_join("authors", ";").alias("authors"), "year", "title", "container", "volume", "issue", "pages", "doi", F.array_join("notes", ";").alias("notes"))


@query(BIB + "SELECT doc_id, seq, raw AS formatted, false AS changed FROM bib")
def entry_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.formatted(entries(spark, sf_dir)).select("doc_id", "seq", "formatted", render.changed().alias("changed"))


@query(
    BIB
    + """, g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, first, second, year) AS n, row_number() OVER (PARTITION BY doc_id, first, second, year ORDER BY lower(title), seq) AS r FROM bib)
SELECT doc_id, seq, year || CASE WHEN n > 1 THEN chr(CAST(96 + r AS INTEGER)) ELSE '' END AS year, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lower(split_part(first, ',', 1)), year, lower(title), seq) AS INTEGER) AS position FROM g"""
)
def sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.sorted_with_letters(structured(spark, sf_dir)).select("doc_id", "seq", "year", "position")


@query(
    BIB
    + """SELECT doc_id, seq, array_to_string(list_filter([CASE WHEN seq % 11 = 0 THEN '저자명 누락 — 확인 필요' END, CASE WHEN seq % 7 = 0 THEN '게재지·매체명 누락 — 확인 필요' END,
CASE WHEN seq % 5 = 0 THEN '면수 누락 — 확인 필요(온라인 학술지는 아티클 넘버)' END], lambda x: x IS NOT NULL), '; ') AS issues FROM bib"""
)
def entry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structured(spark, sf_dir)
    gone = {"container": F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("container")), "pages": F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("pages")), "authors": F.when(F.col("seq") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("authors"))}
    rows = rows.withColumns(gone | {"article_no": F.lit(""), "place": F.lit(""), "degree": F.lit(""), "institution": F.lit(""), "url": F.lit("")})
    return rows.select("doc_id", "seq", F.array_join(render.issues(), "; ").alias("issues"))


@query(
    BIB
    + """, o AS (SELECT doc_id, seq, year, title, min(seq) OVER (PARTITION BY doc_id, container, year) AS first FROM bib),
p AS (SELECT doc_id, seq, year, row_number() OVER (PARTITION BY doc_id ORDER BY first, lower(title), seq) AS position FROM o),
q AS (SELECT *, lag(year) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM p)
SELECT doc_id, seq, CAST(position AS INTEGER) AS position, CASE WHEN before IS NULL OR before <> year THEN year END AS header FROM q"""
)
def grouped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = render.grouped_order(structured(spark, sf_dir), "year", "title")
    return render.group_headers(ordered, "year").select("doc_id", "seq", "position", "header")


# ---------------------------------------------------------------- citations


@query(BIB + "SELECT doc_id, 'Zork' AS name, '1990' AS year, '(Zork, 1990)' AS snippet, false AS name_only_match FROM bib GROUP BY doc_id")
def cited_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bibliography(spark, sf_dir)
    return citations.cross_check(segment.reference_lists(written(b)), structured(spark, sf_dir))[1]


@query(BIB + "SELECT doc_id, seq, substr(raw, 1, 120) AS raw, first || CASE WHEN second = '' THEN '' ELSE ', ' || second END AS authors, year FROM bib WHERE doc_id NOT IN (SELECT doc_id FROM bib WHERE seq % 2 = 0)")
def listed_not_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bibliography(spark, sf_dir)
    return citations.cross_check(segment.reference_lists(written(b)), structured(spark, sf_dir))[2]


@query(BIB + ", c AS (SELECT DISTINCT doc_id, split_part(first, ',', 1) AS name, year, true AS matched FROM bib WHERE seq % 2 = 0 UNION ALL SELECT DISTINCT doc_id, 'Zork', '1990', false FROM bib) SELECT doc_id, name, year, '(' || name || ', ' || year || ')' AS snippet, matched FROM c")
def cited_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bibliography(spark, sf_dir)
    return citations.cross_check(segment.reference_lists(written(b)), structured(spark, sf_dir))[0]


# ---------------------------------------------------------------- links


def _shared_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1/"), (F.col("seq") % 7).cast("string")))


@query(BIB + "SELECT a.doc_id, a.seq AS seq_a, b.seq AS seq_b FROM bib a JOIN bib b ON a.doc_id = b.doc_id AND a.seq < b.seq AND a.seq % 7 = b.seq % 7")
def duplicate_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.duplicates(_shared_dois(spark, sf_dir).withColumn("title", F.lit(""))).where("reason = 'doi'").select("doc_id", "seq_a", "seq_b")


@query()
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.duplicates(_shared_dois(spark, sf_dir))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bibliography with titles of eight words each that no other title has."""
    return structured(spark, sf_dir).withColumn("title", F.trim(F.regexp_replace(F.sha2(F.col("seq").cast("string"), 256), "(.{8})", "$1 ")))


def _authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a third of the works, with a year that is one off for some."""
    w = _works(spark, sf_dir).where("seq % 3 = 0")
    shifted = F.when(F.col("seq") % 2 == 0, F.col("year").cast("int") + 1).otherwise(F.col("year").cast("int")).cast("string")
    return w.select(F.col("seq").alias("pos"), "title", F.lit("").alias("subtitle"), shifted.alias("year"), "volume", "issue", "pages", "doi", F.lit("").alias("publisher"))


@query(BIB + "SELECT doc_id, seq, seq AS found, 1.15 AS score FROM bib WHERE seq % 3 = 0")
def best_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work's best record; two thirds have none."""
    found = link.best_articles(_works(spark, sf_dir), _authority(spark, sf_dir), ["doc_id", "seq"])
    return found.select("doc_id", "seq", F.col("c_pos").alias("found"), F.round("score", 2).alias("score"))


@query(BIB + "SELECT doc_id, seq, seq AS found, seq % 2 <> 0 AS same_year FROM bib WHERE seq % 3 = 0")
def best_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link.best_books(_works(spark, sf_dir), _authority(spark, sf_dir), ["doc_id", "seq"])
    return found.select("doc_id", "seq", F.col("c_pos").alias("found"), "same_year")


@query(BIB + "SELECT doc_id, seq, CASE seq % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'verified' WHEN 3 THEN 'unchecked' ELSE 'not_found' END AS status, CASE seq % 5 WHEN 0 THEN 'crossref' WHEN 1 THEN 'crossref' WHEN 2 THEN 'openalex' END AS source FROM bib")
def doi_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = structured(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1/"), F.col("seq").cast("string")))
    known = e.select("doi", "title", F.lit(False).alias("unavailable"), (F.col("seq") % 5).alias("m"))
    crossref = known.where("m in (0, 1)").withColumn("title", F.when(F.col("m") == 1, F.lit("zzzz 999")).otherwise(F.col("title"))).drop("m")
    datacite = known.where("m = 3").withColumn("unavailable", F.lit(True)).drop("m")
    openalex = known.where("m in (0, 2)").drop("m")
    tiers = [("crossref", 0.75, crossref), ("datacite", 0.60, datacite), ("openalex", 0.75, openalex)]
    return link.doi_cascade(e, tiers, ["doc_id", "seq"]).select("doc_id", "seq", "status", "source")


@query(BIB + "SELECT doc_id, seq, CASE WHEN doi <> '' THEN CASE WHEN seq % 3 = 0 THEN 'verified' ELSE 'not_found' END WHEN seq % 3 = 0 THEN 'verified' ELSE 'suspect' END AS status, CASE WHEN seq % 3 = 0 THEN 'crossref' END AS source FROM bib")
def verified_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries through the routes by DOI, language and type."""
    return link.verify(_works(spark, sf_dir).withColumn("url", F.lit("")), {"crossref": _authority(spark, sf_dir)}, ["doc_id", "seq"]).select("doc_id", "seq", "status", "source")


@query(
    BIB
    + """SELECT doc_id, seq, array_to_string(list_filter([CASE WHEN seq % 4 = 0 THEN 'year:' || year || '>' || CAST(CAST(year AS INTEGER) + 1 AS VARCHAR) END, CASE WHEN seq % 6 = 0 THEN 'volume:' || volume || '>999' END,
CASE WHEN seq % 5 = 0 AND pages <> '1-2' THEN 'pages:' || pages || '>1-2' END], lambda x: x IS NOT NULL), ';') AS corrections FROM bib"""
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seq")
    own = structured(spark, sf_dir).withColumns({
        "m_year": F.when(k % 4 == 0, (F.col("year").cast("int") + 1).cast("string")).otherwise(F.col("year")),
        "m_volume": F.when(k % 6 == 0, "999").otherwise(F.col("volume")),
        "m_issue": F.lit(""),
        "m_pages": F.when(k % 5 == 0, "1–2").otherwise(F.replace("pages", F.lit("-"), F.lit("–"))),
        "m_publisher": F.lit("Any Press"),
    })
    found = link.corrections(own)
    return found.select("doc_id", "seq", F.array_join(F.transform("corrections", lambda c: F.concat(c["field"], F.lit(":"), c["current"], F.lit(">"), c["suggested"])), ";").alias("corrections"))


@query(BIB + "SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN pages ELSE 'x' END AS pages, CASE WHEN doi = '' THEN '10.9/' || volume ELSE doi END AS doi FROM bib")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = structured(spark, sf_dir)
    meta = e.select("doc_id", "seq", F.lit("x").alias("pages"), F.concat(F.lit("10.9/"), "volume").alias("doi"))
    return link.filled(e.withColumn("pages", F.when(F.col("seq") % 2 == 0, F.col("pages")).otherwise("")), meta, ["doc_id", "seq"], ("pages", "doi")).select("doc_id", "seq", "pages", "doi")


RULES = [("r1", "t1", "rule one", ["click", "view"], True), ("r2", "t2", "rule two", ["error"], True), ("r3", "t3", "rule three", ["click"], False)]


@query("SELECT event_id, r.rule_id FROM events JOIN (VALUES ('r1', 'click'), ('r1', 'view'), ('r2', 'error')) r(rule_id, type) ON event_type = r.type")
def rules_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, topic string, rule string, types array<string>, enabled boolean")
    return link.tips(table(spark, sf_dir, "events").withColumn("type", F.col("event_type")), rules).select("event_id", "rule_id")


def _open_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the even nations' journals, in capitals."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("JOURNAL OF NA"), F.upper(F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")), F.lit(" STUDIES")).alias("title"))


@query(BIB + "SELECT DISTINCT container FROM bib WHERE c_nationkey % 2 = 0")
def listed_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals whose names the list has letter for letter; similar_journals is the whole operator."""
    return link.listed_journals(structured(spark, sf_dir), _open_list(spark, sf_dir), 1.0)


@query()
def similar_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals that the list has by the likeness that counts in production."""
    return link.listed_journals(structured(spark, sf_dir), _open_list(spark, sf_dir))


@query()
def aligned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with unlike strings, the published ones in another order, some lost and some changed at their end."""
    b = bibliography(spark, sf_dir).withColumn("formatted", F.sha2(F.col("seq").cast("string"), 512))
    items = b.select("doc_id", "seq", "raw", "formatted", F.lit("").alias("title"), F.concat(F.lit("10.5/"), F.sha2(F.col("seq").cast("string"), 256)).alias("doi"))
    published = items.where("seq % 9 <> 0").select(F.col("doc_id").alias("doc_id"), (-F.col("seq")).alias("pos"), F.concat("formatted", F.when(F.col("seq") % 4 == 0, F.concat(F.lit(" "), "doi")).otherwise("")).alias("text"))
    return align.align(items, published).select("doc_id", "kind", "seq", "same")


@query(BIB + "SELECT doc_id, seq, title, container, year, volume, issue, pages, doi, first AS author FROM bib")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as XML answers and read back."""
    b = bibliography(spark, sf_dir)
    ends = F.split("pages", "-")
    xml = F.concat(
        F.lit("<record><article-title>"), "title", F.lit("</article-title><journal-name>"), "container", F.lit("</journal-name><pub-year>"), "year", F.lit("</pub-year><volume>"), "volume", F.lit("</volume><issue>"), "issue",
        F.lit("</issue><fpage>"), ends[0], F.lit("</fpage><lpage>"), ends[1], F.lit("</lpage><doi>"), F.when(F.col("doi") == "", "").otherwise(F.concat(F.lit("https://doi.org/"), "doi")), F.lit("</doi><author>"), "first", F.lit("</author></record>"),
    )
    found = records.articles(b.select("doc_id", "seq", xml.alias("xml")))
    return found.select("doc_id", "seq", "title", "container", "year", "volume", "issue", "pages", "doi", F.col("authors")[0].alias("author"))


@query(BIB + "SELECT seq AS query_id, CASE WHEN doi <> '' THEN 'doi' ELSE 'title' END AS kind, CASE WHEN seq % 3 = 0 THEN 'verified' ELSE 'not_found' END AS status, CASE WHEN seq % 3 = 0 THEN seq END AS pos FROM bib")
def quick_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each work, its DOI or its title, looked up in the records of a third of them."""
    asked = _works(spark, sf_dir).select(F.col("seq").alias("query_id"), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi", F.lit("."))).otherwise(F.col("title")).alias("q"))
    return lookups.lookup(asked, _authority(spark, sf_dir).withColumn("isbn", F.lit(""))).select("query_id", "kind", "status", "pos")


# ---------------------------------------------------------------- reports


@query(
    BIB
    + """SELECT doc_id, count(*) AS total, min(CAST(year AS INTEGER)) AS year_min, max(CAST(year AS INTEGER)) AS year_max, count(*) AS dated, count_if(CAST(year AS INTEGER) >= 1991) AS recent_count, 1 AS n_types, 0 AS self_cites,
round(count_if(CAST(year AS INTEGER) >= 1991) / count(*), 3) AS recent_ratio FROM bib GROUP BY doc_id"""
)
def list_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health(structured(spark, sf_dir), THIS_YEAR)


@query(BIB + "SELECT doc_id, CAST(year AS INTEGER) AS year_number, count(*) AS n FROM bib GROUP BY 1, 2")
def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.year_distribution(structured(spark, sf_dir))


@query(
    BIB
    + """, c AS (SELECT year AS doc_id, container AS name, count(*) AS n, min(seq) AS f FROM bib GROUP BY 1, 2), r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY doc_id), 3) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c)
SELECT doc_id, name, n, share, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def top_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_containers(structured(spark, sf_dir).withColumn("doc_id", F.col("year")))


@query(
    """SELECT d.source AS doc_id, count(*) AS total, count_if(l.quality = 0) AS changed, count_if(l.toxic = 1) AS needs_check, count_if(l.quality = 1) AS verified, 0 AS retracted, count_if(l.quality IS NULL) AS suspect,
sum(d.n_chars % 3) AS suggestions, sum(d.n_chars % 2) AS tips, coalesce(max(p.n), 0) AS crosscheck_issues
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) p ON p.source = d.source GROUP BY 1"""
)
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    items = docs.select(
        F.col("source").alias("doc_id"), (F.col("quality") == 0).alias("changed"), (F.col("toxic") == 1).alias("has_issues"), F.when(F.col("quality") == 1, "verified").when(F.col("quality").isNull(), "suspect").alias("status"), F.lit(False).alias("severe"),
        (F.col("n_chars") % 3).alias("n_suggestions"), (F.col("n_chars") % 2).alias("n_tips"),
    )
    return reports.summary(items, table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("doc_id")))


@query("SELECT source AS doc_id, count_if(quality = 1) AS verified, count_if(quality = 0) AS warn, count_if(quality IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def certificate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.certificate(docs.select(F.col("source").alias("doc_id"), F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "not_found").alias("status")))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("org"), F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user"),
        (F.col("event_id") % 4 + 1).alias("files"), (F.col("event_id") % 50).alias("refs"), "event_id",
    )


USAGE = """WITH usage AS (SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS org, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS u, event_id % 4 + 1 AS files, event_id % 50 AS refs, event_id FROM events)
"""


@query(USAGE + "SELECT CASE WHEN org = '' THEN '(미입력)' ELSE org END AS org, count(*) AS uses, sum(files) AS files, sum(refs) AS refs, count(DISTINCT u) AS users FROM usage GROUP BY 1")
def usage_by_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_by_org(_usage(spark, sf_dir))


@query(USAGE + "SELECT 'month' AS level, substr(time, 1, 7) AS period, count(*) AS uses, sum(files) AS files, sum(refs) AS refs, count(DISTINCT u) AS users FROM usage GROUP BY 2 UNION ALL SELECT 'day', substr(time, 1, 10), count(*), sum(files), sum(refs), count(DISTINCT u) FROM usage GROUP BY 2")
def usage_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_by_period(_usage(spark, sf_dir))


@query(USAGE + "SELECT count(*) AS uses, sum(files) AS files, sum(refs) AS refs, count(DISTINCT u) AS users FROM usage")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_totals(_usage(spark, sf_dir))


@query(USAGE + "SELECT event_id, org, files FROM usage ORDER BY event_id DESC LIMIT 50")
def newest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(_usage(spark, sf_dir).select("event_id", "org", "files"), 50, F.desc("event_id"))


PRICES = [("A", None, "1995-12-31", 2.0, 10.0), ("A", "1996-01-01", None, 3.0, 15.0), ("N", None, None, 5.0, 25.0), ("R", None, None, 1.0, 5.0)]
COSTS = """WITH log AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, l_returnflag AS model, count(*) AS calls, CAST(sum(l_quantity * 1000) AS BIGINT) AS input, CAST(sum(l_quantity * 100) AS BIGINT) AS output, CAST(sum(l_quantity * 10) AS BIGINT) AS cache_read, CAST(sum(l_quantity) AS BIGINT) AS cache_write FROM lineitem GROUP BY 1, 2),
priced AS (SELECT *, CASE model WHEN 'A' THEN CASE WHEN date <= '1995-12-31' THEN 2.0 ELSE 3.0 END WHEN 'N' THEN 5.0 ELSE 1.0 END AS r FROM log), cost AS (SELECT *, ((input + cache_read * 0.1 + cache_write * 1.25) * r + output * r * 5) / 1000000 AS usd FROM priced)
"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("model")).agg(
        F.count("*").alias("calls"), *(F.sum(F.col("l_quantity") * n).cast("long").alias(c) for c, n in (("input", 1000), ("output", 100), ("cache_read", 10), ("cache_write", 1)))
    )
    prices = spark.createDataFrame(PRICES, "model string, since string, until string, input_rate double, output_rate double")
    return reports.priced(log, prices)


@query(COSTS + "SELECT date, model, calls, input, output, round(CAST(usd AS DOUBLE), 4) AS usd FROM cost")
def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost_totals(_costs(spark, sf_dir)).select("date", "model", "calls", "input", "output", F.round("usd", 4).alias("usd"))


@query(COSTS + "SELECT model, CAST(sum(calls) AS BIGINT) AS calls, round(sum(CAST(usd AS DOUBLE)), 2) AS usd FROM cost GROUP BY 1")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost_by(_costs(spark, sf_dir), "model").withColumn("usd", F.round("usd", 2))


@query(COSTS + "SELECT date, CAST(sum(calls) AS BIGINT) AS calls, round(sum(CAST(usd AS DOUBLE)), 4) AS usd FROM cost GROUP BY 1 ORDER BY date DESC LIMIT 30")
def cost_of_recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(reports.cost_by(_costs(spark, sf_dir), "date"), 30, F.desc("date"))


@query(COSTS + "SELECT CAST(coalesce(sum(calls) FILTER (substr(date, 1, 7) = '1997-06'), 0) AS BIGINT) AS month_calls, CASE WHEN sum(CAST(usd AS DOUBLE)) FILTER (substr(date, 1, 7) = '1997-06') >= 10 THEN 'over' WHEN sum(CAST(usd AS DOUBLE)) FILTER (substr(date, 1, 7) = '1997-06') >= 8 THEN 'warn' ELSE 'ok' END AS level FROM cost")
def cost_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost_summary(_costs(spark, sf_dir), "1997-06-15", 10.0).select("month_calls", "level")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.when(F.col("conv_id") % 10 == 0, "").otherwise(F.col("conv_id").cast("string")).alias("hid"), F.col("role").alias("pub"), F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("org"), F.when(F.col("turn") % 3 == 0, "agent_only").otherwise("pair").alias("kind"), (F.col("turn") % 2 == 0).alias("same"))


CORPUS = """WITH c AS (SELECT CASE WHEN conv_id % 10 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS hid, role AS pub, CASE WHEN role = 'system' THEN '' ELSE role END AS org, CASE WHEN turn % 3 = 0 THEN 'agent_only' ELSE 'pair' END AS kind, turn % 2 = 0 AS same FROM conversations)
"""


@query(CORPUS + "SELECT count(*) AS rows, count(DISTINCT CASE WHEN hid <> '' THEN hid || '|' || pub END) AS papers, count_if(kind = 'pair' AND same) AS same, round(count_if(kind = 'pair' AND same) / count(*), 4) AS match_rate FROM c")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_stats(_corpus(spark, sf_dir))


@query(CORPUS + "SELECT CASE WHEN org = '' THEN '미지정' ELSE org END AS org, count(*) AS n FROM c GROUP BY 1")
def corpus_by_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_by_org(_corpus(spark, sf_dir))


@query(
    """WITH r AS (SELECT o_orderpriority AS ai, o_orderstatus AS verify, (o_orderkey % 300 + 1) / ceil((o_orderkey % 9 + 1) / 4) AS v, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT ai, verify, list_sort(list(v))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS per_wave, count(*) AS samples FROM r WHERE n <= 30 GROUP BY 1, 2"""
)
def wave_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ai"), F.col("o_orderstatus").alias("verify"), (F.col("o_orderkey") % 300 + 1).alias("secs"), (F.col("o_orderkey") % 9 + 1).alias("files"), "o_orderdate", "o_orderkey")
    return reports.seconds_per_wave(o, ["ai", "verify"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(BIB + "SELECT container AS journal, count(DISTINCT doc_id) AS papers, count(*) AS refs, round(count(*) / count(DISTINCT doc_id), 1) AS refs_per_paper, round(count_if(doi <> '') / count(*), 3) AS doi_share, 1.0 AS western_share, 0 AS theses FROM bib GROUP BY 1")
def journal_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.practice(structured(spark, sf_dir).withColumn("journal", F.col("container")))


# ---------------------------------------------------------------- stores


@query("SELECT o_orderkey AS record_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300")
def retained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.retained(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("written")))[0].select("record_id")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def newest_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.retained_by(table(spark, sf_dir, "orders"), "o_custkey", 3, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("update"))
    return stores.latest(log, "user_id", "event_id").select("user_id", "value")


@query("SELECT 'order' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.tagged_union(order=table(spark, sf_dir, "orders").select("o_orderkey"), customer=table(spark, sf_dir, "customer").select("c_custkey")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS k FROM customer JOIN orders ON c_custkey = o_custkey")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.key_overlap(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def keys_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.key_difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT min(c_custkey) AS seq FROM customer GROUP BY c_mktsegment HAVING c_mktsegment NOT IN ('BUILDING')")
def added_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.lit("case").alias("source"), F.lit("").alias("journal"), F.lit("").alias("topic"), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("rule"), F.array(F.lit("book")).alias("types"))
    stored = spark.createDataFrame([("case", "", "BUIL DING")], "source string, journal string, rule string")
    return stores.new_rules(stored, rows)[0].select("seq")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with text around it is read from its outermost braces."""
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", records.rescued_json(said, "k int")["k"].alias("k"))


# ---------------------------------------------------------------- exports

RIS_SQL = """SELECT doc_id, seq, 'TY  - JOUR' || chr(10) || 'AU  - ' || first || CASE WHEN second = '' THEN '' ELSE chr(10) || 'AU  - ' || second END || chr(10) || 'PY  - ' || year || chr(10) || 'TI  - ' || title || chr(10) || 'T2  - ' || container || chr(10) || 'VL  - ' || volume || chr(10) || 'IS  - ' || issue
|| chr(10) || 'SP  - ' || split_part(pages, '-', 1) || chr(10) || 'EP  - ' || split_part(pages, '-', 2) || CASE WHEN doi = '' THEN '' ELSE chr(10) || 'DO  - ' || doi END || chr(10) || 'ER  - ' AS ris FROM bib"""


@query(BIB + RIS_SQL)
def ris_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = structured(spark, sf_dir).withColumns({c: F.lit("") for c in ("institution", "degree", "place", "url")})
    return exports.ris(e).select("doc_id", "seq", "ris")


BIBTEX_SQL = """SELECT doc_id, seq, '@article{ref' || CAST(seq AS VARCHAR) || ',' || chr(10) || '  author = {' || first || CASE WHEN second = '' THEN '' ELSE ' and ' || second END || '},' || chr(10) || '  title = {' || title || '},' || chr(10) || '  year = {' || year || '},' || chr(10)
|| '  journal = {' || container || ' \\& Co},' || chr(10) || '  volume = {' || volume || '},' || chr(10) || '  number = {' || issue || '},' || chr(10) || '  pages = {' || replace(pages, '-', '--') || '}' || CASE WHEN doi = '' THEN '' ELSE ',' || chr(10) || '  doi = {' || doi || '}' END || chr(10) || '}' AS bibtex FROM bib"""


@query(BIB + BIBTEX_SQL.replace("\\\\", "\\"))
def bibtex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = structured(spark, sf_dir).withColumns({c: F.lit("") for c in ("institution", "degree", "place", "url")} | {"container": F.concat("container", F.lit(" & Co"))})
    return exports.bibtex(e, "seq").select("doc_id", "seq", "bibtex")


@query(BIB + "SELECT doc_id, '[서양문헌]' || chr(10) || string_agg(raw, chr(10) ORDER BY seq) AS text FROM bib GROUP BY doc_id")
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structured(spark, sf_dir).withColumns({"formatted": F.col("raw"), "group": render.group_label(), "position": F.col("seq")})
    return exports.listing(rows)


# ---------------------------------------------------------------- state and windows


@query()
def throttled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return limits.throttled(e.select((F.col("user_id") % 20).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 4e7).alias("at")))


@query()
def locked_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return limits.locked(e.select((F.col("user_id") % 20).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "purchase").alias("success")), "admin")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.daily_totals(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns({"total": F.round("total", 2), "day": F.col("day").cast("string")})


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "2 hours").select("user_id", "n")


@query("WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), x AS (SELECT event_type, h AS f FROM w UNION ALL SELECT event_type, h - INTERVAL 1 HOUR FROM w) SELECT CAST(epoch(f) AS BIGINT) AS from_s, event_type, count(*) AS n FROM x GROUP BY 1, 2")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_counts(table(spark, sf_dir, "events"), ["event_type"], "2 hours", "1 hour").select(F.unix_seconds("from").alias("from_s"), "event_type", "n")


# ---------------------------------------------------------------- the whole way


@query(
    BIB
    + """, g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, first, second, year) AS n, row_number() OVER (PARTITION BY doc_id, first, second, year ORDER BY lower(title), seq) AS r FROM bib)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lower(split_part(first, ',', 1)), year, lower(title), seq) AS INTEGER) AS position, regexp_replace(raw, '\\(([0-9]{4})\\)', '(\\1' || CASE WHEN n > 1 THEN chr(CAST(96 + r AS INTEGER)) ELSE '' END || ')') AS formatted FROM g""".replace("\\\\", "\\")
)
def finished_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuscripts to rendered, ordered, lettered entries."""
    done = manuscripts.process(written(bibliography(spark, sf_dir)), THIS_YEAR)
    return done.items.select("doc_id", "position", "formatted")


@query(BIB + "SELECT doc_id, count(*) AS total, count(*) FILTER (false) AS needs_check, 1 + CASE WHEN count_if(seq % 2 = 0) = 0 THEN count(*) ELSE 0 END AS crosscheck_issues FROM bib GROUP BY doc_id")
def finished_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = manuscripts.process(written(bibliography(spark, sf_dir)), THIS_YEAR)
    return done.summary.select("doc_id", "total", "needs_check", "crosscheck_issues")
