"""Entries against each other and against authority records: duplicates, best candidates, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.similarity import record_key, title_similarity
from refloom.functions.text import compare_key, first_page, hangul_key, plain_year, publisher_key, sub, title_key, year_number
from refloom.operators import near
from refloom.operators.render import field
from refloom.operators.shared import Written

# Thresholds that results depend on.
DUPLICATE, ARTICLE, ARTICLE_ANY_YEAR, OTHER_ARTICLE, DOMESTIC = 0.92, 0.82, 0.93, 0.85, 0.80
DOI_TIERS = (("crossref", 0.75), ("datacite", 0.60), ("openalex", 0.75))
OPEN_LIST, DOMESTIC_LIST = 0.90, 0.85
ANCHOR_BONUS = 0.05
SEVERE = ("retraction", "retracted", "withdrawal", "removal")
KNOWN_UPDATES = (*SEVERE, "correction", "corrigendum", "erratum", "expression_of_concern", "new_edition", "new_version")
PREPRINT_PREFIXES = {"10.48550": "arXiv", "10.2139": "SSRN", "10.1101": "bioRxiv/medRxiv", "10.31219": "OSF", "10.20944": "Preprints.org", "10.21203": "Research Square", "10.31235": "SocArXiv"}


def duplicates(entries: DataFrame, id_column: str = "doc_id", seq_column: str = "seq", threshold: float = DUPLICATE) -> DataFrame:
    """id, seq_a, seq_b, reason (doi or title), similarity: pairs in one list with the same DOI or titles that are alike.

    Equal DOIs are an equi-join. Titles are searched among those of their list (near.later_pairs()), which loses none that is alike enough. A DOI counts before a title.
    Entries are made once: they are written to the shared folder, where the result reads them.
    """
    own = Written(entries.sparkSession).cut(entries.select(id_column, seq_column, field("doi").alias("doi"), hangul_key(F.col("title")).alias("key")))
    a, b = (own.where("doi <> ''").select(id_column, F.col(seq_column).alias(f"seq_{side}"), "doi") for side in "ab")
    pair = [id_column, "seq_a", "seq_b"]
    by_doi = F.lit(2.0)  # beyond any similarity
    same_doi = a.join(b, [id_column, "doi"]).where("seq_a < seq_b").select(*pair, by_doi.alias("_best"))
    found = near.later_pairs(own.select(F.col(id_column).alias("block"), F.col(seq_column).alias("number"), F.col("key").alias("text")), threshold)
    alike = found.select(F.col("block").alias(id_column), F.col("l").alias("seq_a"), F.col("r").alias("seq_b"), F.col("similarity").alias("_best"))
    best = same_doi.unionByName(alike).groupBy(*pair).agg(F.max("_best").alias("_best"))
    return best.select(*pair, F.when(F.col("_best") == by_doi, "doi").otherwise("title").alias("reason"), F.least("_best", F.lit(1.0)).alias("similarity"))


def article_titles(title: Column) -> list[tuple[str, Column]]:
    """Under which names a title is searched, and as what (null: not): words, or all characters but blanks where no known script is left in one of the two."""
    key, bare = title_key(title), sub(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", "")
    return [("words", F.when(key != "", key)), ("all", bare), ("lost", F.when(key == "", bare))]


def article_records(title: Column) -> list[tuple[str, Column]]:
    """What article_titles() meets: titles without a known script meet all, the others those without."""
    key, bare = title_key(title), sub(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", "")
    return [("words", F.when(key != "", key)), ("all", F.when(key == "", bare)), ("lost", F.when(key != "", bare))]


def named_texts(rows: DataFrame, keep: list[str], source: Column, named: list[tuple[str, Column]]) -> DataFrame:
    """keep, block (source and name), text: a row for each name under which a row is searched or found."""
    each = F.array(*(F.struct(F.concat_ws("|", source, F.lit(n)).alias("block"), c.alias("text")) for n, c in named))
    return rows.select(*keep, F.explode(each).alias("_x")).select(*keep, "_x.block", "_x.text").where("text <> ''")


def candidates(asked: DataFrame, known: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """keys, source, c_pos, similarity of all pairs of entries and records whose titles are alike to the threshold, each pair once.

    asked: keys, block, text; known: source, c_pos, block, text, as named_texts() makes them. All sources are searched in one index (near.alike()); a text that many
    entries or records have is compared once. The similarity is that of the most alike of a record's titles.
    """
    pairs = near.alike(asked, known, threshold)
    met = asked.withColumnRenamed("text", "a").join(pairs, ["block", "a"]).join(known.withColumnRenamed("text", "b"), ["block", "b"])
    return met.groupBy(*keys, "source", "c_pos").agg(F.max("similarity").alias("similarity"))


def equal_texts(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """candidates() at a similarity of 1: an equi-join."""
    return asked.join(known, ["block", "text"]).select(*keys, "source", "c_pos").distinct().withColumn("similarity", F.lit(1.0))


def full_title(title: Column, subtitle: Column) -> Column:
    """Title and subtitle together; null without a subtitle."""
    return F.when(F.coalesce(subtitle, F.lit("")) != "", F.concat(F.coalesce(title, F.lit("")), F.lit(": "), subtitle))


#: Blocks of texts whose year is not known, and of all years.
NO_YEAR, EVERY_YEAR = "none", "every"


def by_year(texts: DataFrame) -> DataFrame:
    """texts once for each of their _years (an array of strings), which become a part of the block."""
    return texts.withColumn("_year", F.explode("_years")).withColumn("block", F.concat_ws("|", "block", "_year")).drop("_year", "_years")


def asked_years(year: Column) -> Column:
    """In which blocks an entry finds all records that are near in time (scored_articles()): the years beside its own and those without, or every one."""
    want = year_number(year)
    near_ones = F.array(*(((want + k).cast("string")) for k in (-1, 0, 1)), F.lit(NO_YEAR))
    return F.when(want.isNull(), F.array(F.lit(EVERY_YEAR))).otherwise(near_ones)


def known_years(year: Column) -> Column:
    """The blocks of a record by its year."""
    return F.array(F.coalesce(year.try_cast("int").cast("string"), F.lit(NO_YEAR)), F.lit(EVERY_YEAR))


def known_articles(authority: DataFrame, source: Column, *more: str) -> DataFrame:
    """Texts of a table of articles (pos, title, perhaps subtitle): by title, and by title and subtitle together. more: other columns that they keep."""
    rows = authority if "subtitle" in authority.columns else authority.withColumn("subtitle", F.lit(""))
    named = article_records(F.col("title")) + [(n, F.when(F.coalesce("subtitle", F.lit("")) != "", c)) for n, c in article_records(full_title(F.col("title"), F.col("subtitle")))]
    return named_texts(rows.select("title", "subtitle", source.alias("source"), F.col("pos").alias("c_pos"), *more), ["source", "c_pos", *more], F.col("source"), named)


def known_books(authority: DataFrame, source: Column, *more: str) -> DataFrame:
    """Texts of a table of catalogue records (pos, title)."""
    return named_texts(authority.select("title", source.alias("source"), F.col("pos").alias("c_pos"), *more), ["source", "c_pos", *more], F.col("source"), [("record", record_key(F.col("title")))])


def asked_texts(entries: DataFrame, keys: list[str], source: Column, book: bool) -> DataFrame:
    """Texts of entries that are searched among articles (titles of eight characters or more) or among catalogue records."""
    if book:
        return named_texts(entries, keys, source, [("record", record_key(F.col("title")))])
    return named_texts(entries.where(F.length("title") >= 8), keys, source, article_titles(F.col("title")))


def scored_articles(pairs: DataFrame) -> DataFrame:
    """pairs (entry and c_ fields) with anchors and hits (how many of volume, issue and first page could and do agree), near_year (a year off at most, if both
    are known) and score (the similarity and a bonus for each hit)."""
    anchors, hits = F.lit(0), F.lit(0)
    for own, other in ((field("volume"), field("c_volume")), (field("issue"), field("c_issue")), (first_page(F.col("pages")), first_page(F.col("c_pages")))):
        anchors = anchors + F.when(own != "", 1).otherwise(0)
        hits = hits + F.when((own != "") & (own == other), 1).otherwise(0)
    want, have = year_number(F.col("year")), F.col("c_year").try_cast("int")
    pairs = pairs.withColumns({"anchors": anchors, "hits": hits, "near_year": want.isNull() | have.isNull() | (F.abs(want - have) <= 1)})
    return pairs.withColumn("score", F.col("similarity") + ANCHOR_BONUS * F.col("hits"))


def acceptable(any_year: Column) -> Column:
    """Of scored articles those that may be the work: near in time; or, if any year will do, not one that could agree in two places and agrees in none."""
    return F.when(any_year, (F.col("anchors") < 2) | (F.col("hits") > 0)).otherwise(F.col("near_year"))


def same_year() -> Column:
    return (plain_year(F.col("year")) != "") & (plain_year(F.col("year")) == F.substring(field("c_year"), 1, 4))


NOTHING_BETTER = "similarity = 1 AND hits = anchors"


#: Up to so many characters a text that differs from another has a similarity of 0.999 or less, rounded to three places.
SURELY_UNLIKE = 900


def _nothing(entries: DataFrame, authority: DataFrame, keys: list[str], **more: str) -> DataFrame:
    """The rows of _beside() with similarity and more columns, for no entry: the authority is not read then."""
    none = entries.limit(0).select("*", *(F.lit(None).cast(authority.schema[c].dataType).alias(f"c_{c}") for c in authority.columns), F.lit(None).cast("double").alias("similarity"))
    return none.withColumns({c: F.lit(None).cast(kind) for c, kind in more.items()})


def _beside(entries: DataFrame, authority: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with the fields of entries, and those of authority as c_ fields."""
    named = authority.select(*(F.col(c).alias(f"c_{c}") for c in authority.columns))
    return pairs.drop("source").join(named, "c_pos").join(entries, keys)


def best_articles(entries: DataFrame, authority: DataFrame, keys: list[str], threshold: float = ARTICLE, ignore_year: bool = False) -> DataFrame:
    """For each entry the best article: keys, similarity, hits, score and the candidate's columns.

    A candidate is as similar as the threshold asks and at most a year off, if both years are known. Its score is the similarity and a bonus for
    each of volume, issue and first page that agrees; the first of equals wins. With ignore_year, a candidate that could agree in two of
    them and agrees in none is another work. authority: pos (rank), title, subtitle, year, volume, issue, pages.
    """
    one, written = F.lit("one"), Written(entries.sparkSession)
    entries = written.cut(entries)  # both sides and their texts are made once
    asked = written.cut(asked_texts(entries.withColumn("_years", asked_years(F.col("year"))), [*keys, "_years"], one, False))
    if asked.isEmpty():
        return _nothing(entries, authority, keys, anchors="int", hits="int", near_year="boolean", score="double")

    authority = written.cut(authority)
    known = written.cut(known_articles(authority.withColumn("_years", known_years(F.col("year"))), one, "_years"))

    def best(pairs: DataFrame) -> DataFrame:
        good = scored_articles(_beside(entries, authority, pairs, keys)).where(acceptable(F.lit(ignore_year)))
        return top(good, keys, [F.desc("score"), F.col("c_pos")])

    # a record with the same title that agrees in all that is known has the highest score there is: the others alone are searched by likeness
    settled = written.cut(best(equal_texts(asked, known, keys)).where(NOTHING_BETTER))
    rest = asked.join(settled.select(*keys), keys, "left_anti")
    if not ignore_year:  # only records that are near in time count: the others are not met
        rest, known = by_year(rest), by_year(known)
    return settled.unionByName(best(candidates(rest, known, threshold, keys)))


def best_books(entries: DataFrame, authority: DataFrame, keys: list[str], threshold: float = DOMESTIC) -> DataFrame:
    """For each entry the best record by rounded similarity, then by an equal year; the first of equals wins."""
    one, written = F.lit("one"), Written(entries.sparkSession)
    entries = written.cut(entries)  # both sides and their texts are made once
    asked = written.cut(asked_texts(entries, keys, one, True))
    if asked.isEmpty():
        return _nothing(entries, authority, keys, rounded="double", same_year="boolean")
    authority = written.cut(authority)
    known = written.cut(known_books(authority, one))

    def best(pairs: DataFrame) -> DataFrame:
        pairs = _beside(entries, authority, pairs, keys).withColumns({"rounded": F.round("similarity", 3), "same_year": same_year()})
        return top(pairs, keys, [F.desc("rounded"), F.desc("same_year"), F.col("c_pos")])

    # a short title that is not equal rounds to less than 1, so where a record has an equal one no other record can win
    settled = written.cut(best(equal_texts(asked.where(F.length("text") <= SURELY_UNLIKE), known, keys)))
    return settled.unionByName(best(candidates(asked.join(settled.select(*keys), keys, "left_anti"), known, threshold, keys)))


def top(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each entry; partial ranking keeps one row an entry before the shuffle."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def doi_cascade(entries: DataFrame, tiers: list[tuple[str, float, DataFrame]], keys: list[str]) -> DataFrame:
    """keys, status, source, similarity, meta_title of entries with a DOI: the first tier that knows it decides.

    tiers: name, threshold, table (doi, title, unavailable). Titles that are too unlike make a mismatch; a DOI that no tier knows is not found,
    or unchecked if one of the tiers could not be asked (a row with the DOI and unavailable).
    """
    rows = entries.where(field("doi") != "").select(*keys, "title", "doi")
    for n, (_, _, known) in enumerate(tiers):
        own = known.groupBy("doi").agg(F.min(F.when(~F.coalesce("unavailable", F.lit(False)), F.coalesce("title", F.lit("")))).alias(f"_t{n}"), F.bool_or(F.coalesce("unavailable", F.lit(False))).alias(f"_u{n}"))
        rows = rows.join(own, "doi", "left")
    found = F.coalesce(*(F.when(F.col(f"_t{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.lit(name).alias("source"), F.lit(limit).alias("limit"), F.col(f"_t{n}").alias("title"))) for n, (name, limit, _) in enumerate(tiers)))
    failed = F.coalesce(*(F.when(F.coalesce(F.col(f"_u{n}"), F.lit(False)), F.lit(True)) for n in range(len(tiers))), F.lit(False))
    rows = rows.withColumns({"_f": found, "_failed": failed}).withColumn("similarity", title_similarity(F.col("title"), F.coalesce("_f.title", F.lit(""))))
    unlike = (field("title") != "") & ((F.col("_f.title") != "") | (F.col("_f.n") == 0)) & (F.col("similarity") < F.col("_f.limit"))
    status = F.when(F.col("_f").isNotNull(), F.when(unlike, "mismatch").otherwise("verified")).when(F.col("_failed"), "unchecked").otherwise("not_found")
    return rows.select(*keys, status.alias("status"), F.col("_f.source").alias("source"), F.when(F.col("_f").isNotNull(), F.col("similarity")).alias("similarity"), F.col("_f.title").alias("meta_title"))


#: Routes of entries without a DOI: for each kind of entry the sources that are asked in turn, each with the least similarity and whether any year will do.
ROUTES = {
    "domestic article": (("kci", "kci", DOMESTIC, False), ("crossref", "crossref", ARTICLE, False)),
    "thesis": (("nanet", "nanet", DOMESTIC, False),),
    "book": (("nlk", "nlk", DOMESTIC, False), ("nanet", "nanet", DOMESTIC, False)),
    "article": (("crossref", "crossref", ARTICLE, False), ("crossref any year", "crossref", ARTICLE_ANY_YEAR, True), ("openalex", "openalex", OTHER_ARTICLE, False), ("s2", "s2", OTHER_ARTICLE, False)),
}
CATALOGUES = ("kci", "nanet", "nlk")
#: Searches by likeness in turn: sources, the least similarity that one of their tiers accepts, whether only years that are near count, and the routes that ask (none: all).
PASSES = (
    (("kci", "nanet", "nlk"), DOMESTIC, False, ()),
    (("crossref",), ARTICLE, True, ()),
    (("crossref",), ARTICLE_ANY_YEAR, False, ("article",)),
    (("openalex", "s2"), OTHER_ARTICLE, True, ()),
)
RECORD = ("pos", "doi", "title", "subtitle", "year", "volume", "issue", "pages", "publisher")


def route_of() -> Column:
    """Which of ROUTES an entry takes; null for none."""
    ko = (field("lang") == "ko") & field("type").isin("journal", "thesis", "book", "report")
    kind = F.when(field("type") == "journal", "domestic article").when(field("type") == "thesis", "thesis").otherwise("book")
    return F.when(ko, kind).when(field("type") == "journal", "article")


def cascade(entries: DataFrame, sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Matches of the first tier of an entry's route that has one: keys, tier, similarity and the record's c_ fields.

    entries: keys, route and fields. One table holds the records of all sources, each tagged with its own. An entry with an equal title that no other record can beat is
    settled first. The others are searched by likeness in PASSES, which keep the order of the tiers on every route, so an entry that a pass finds need not be
    searched in later ones. Each pass asks for the likeness that its tiers need and meets, where the year counts, records that are near in time only.
    """
    tagged = None
    for name, rows in sources.items():
        own = rows.select(F.lit(name).alias("source"), *(F.col(c).cast("long" if c == "pos" else "string").alias(f"c_{c}") if c in rows.columns else F.lit("").alias(f"c_{c}") for c in RECORD))
        tagged = own if tagged is None else tagged.unionByName(own)
    tiers = F.create_map(*[x for route, steps in ROUTES.items() for x in (F.lit(route), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(t).alias("tier"), F.lit(c).alias("source"), F.lit(float(m)).alias("limit"), F.lit(y).alias("any_year")) for n, (t, c, m, y) in enumerate(steps))))])
    steps = F.try_element_at(tiers, F.col("route"))
    is_book = F.col("source").isin(*CATALOGUES)
    written = Written(entries.sparkSession)
    tagged = written.cut(tagged)  # both sides and their texts are made once
    asked = entries.where(F.col("route").isNotNull()).select(*keys, "title", "route", asked_years(F.col("year")).alias("_years"), F.explode(F.array_distinct(F.transform(steps, lambda x: x["source"]))).alias("source"))
    keep = [*keys, "source", "route", "_years"]
    texts = written.cut(asked_texts(asked.where(is_book), keep, F.col("source"), True).unionByName(asked_texts(asked.where(~is_book), keep, F.col("source"), False)))
    records = tagged.select("source", F.col("c_pos").alias("pos"), F.col("c_title").alias("title"), F.col("c_subtitle").alias("subtitle"), known_years(F.col("c_year")).alias("_years"))
    known = written.cut(known_books(records.where(is_book), F.col("source"), "_years").unionByName(known_articles(records.where(~is_book), F.col("source"), "_years")))
    own = entries.select(*keys, *("year volume issue pages route".split()))

    def best(pairs: DataFrame) -> DataFrame:
        """The record of the first tier that accepts one; first: whether that is the route's first tier and no record can be better."""
        scored = scored_articles(pairs.join(tagged, ["source", "c_pos"]).join(own, keys)).withColumns({"rounded": F.round("similarity", 3), "same_year": same_year(), "_step": F.explode(F.filter(steps, lambda x: x["source"] == F.col("source")))})
        good = scored.where((F.col("similarity") >= F.col("_step.limit")) & (is_book | acceptable(F.col("_step.any_year"))))
        order = [F.col("_step.n"), F.desc(F.when(is_book, F.col("rounded")).otherwise(F.col("score"))), F.desc(is_book & F.col("same_year")), F.col("c_pos")]
        perfect = (F.col("_step.n") == 0) & F.when(is_book, F.col("same_year")).otherwise(F.expr(NOTHING_BETTER))
        return top(good, keys, order).select(*keys, F.col("_step.tier").alias("tier"), "similarity", *(f"c_{c}" for c in RECORD), perfect.alias("first"))

    found = [written.cut(best(equal_texts(texts.drop("source"), known, keys)).where("first"))]
    rest = texts
    for names, threshold, near_years, routes in PASSES:
        if not set(names) & set(sources):
            continue
        rest = rest.join(found[-1].select(*keys), keys, "left_anti")
        mine, theirs = rest.where(F.col("source").isin(*names)), known.where(F.col("source").isin(*names))
        if routes:
            mine = mine.where(F.col("route").isin(*routes))
        mine, theirs = (by_year(rows) if near_years else rows.drop("_years") for rows in (mine, theirs))
        found.append(written.cut(best(candidates(mine.drop("source", "route"), theirs, threshold, keys))))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.drop("first")


def verify(entries: DataFrame, authorities: dict[str, DataFrame], keys: list[str], links: DataFrame | None = None, failed: tuple[str, ...] = ()) -> DataFrame:
    """keys, status, source, similarity, c_doi, c_title, c_year, c_volume, c_issue, c_pages, c_publisher of every entry.

    With a DOI: doi_cascade() over crossref, datacite and openalex. Domestic articles: kci, then crossref; theses: nanet; books and reports: nlk,
    then nanet. Other articles: crossref, crossref in any year, openalex, s2. A link alone is ok or dead by `links` (url, ok). What no source has is
    suspect if western articles, not found if domestic, unchecked if a source in `failed` could not be asked, else skipped.
    """
    empty = next(iter(authorities.values())).limit(0)
    entries = Written(entries.sparkSession).cut(entries)  # every route reads them
    table = {name: authorities.get(name, empty) for name in ("crossref", "datacite", "openalex", "s2", "kci", "nanet", "nlk")}
    with_doi = entries.where(field("doi") != "")
    tiers = [(name, limit, table[name].select("doi", "title", F.lit(False).alias("unavailable")).where("doi <> ''")) for name, limit in DOI_TIERS]
    by_doi = doi_cascade(with_doi, tiers, keys)
    rest = entries.where(field("doi") == "").withColumn("route", route_of())
    found = cascade(rest, {name: authorities[name] for name in table if name in authorities}, keys).select(*keys, "tier", "similarity", "c_doi", "c_title", "c_year", "c_volume", "c_issue", "c_pages", "c_publisher")
    ko = F.coalesce(F.col("route") != "article", F.lit(False))
    joined = rest.select(*keys, field("type").alias("_type"), field("lang").alias("_lang"), field("url").alias("_url"), ko.alias("_ko")).join(found, keys, "left")
    if links is not None:
        joined = joined.join(links.select(F.col("url").alias("_url"), F.col("ok").alias("_ok")).dropDuplicates(["_url"]), "_url", "left")
    else:
        joined = joined.withColumn("_ok", F.lit(None).cast("boolean"))
    article_like = F.col("_type") == "journal"
    status = (
        F.when(F.col("tier").isNotNull(), "verified")
        .when((F.col("_ko") | article_like) & F.lit(bool(failed)), "unchecked")
        .when(F.col("_ko"), "not_found")
        .when(article_like, F.when(F.col("_lang") == "west", "suspect").otherwise("skipped"))
        .when(F.col("_url") != "", F.when(F.coalesce("_ok", F.lit(False)), "link_ok").otherwise("link_dead"))
        .otherwise("skipped")
    )
    titled = joined.select(*keys, status.alias("status"), F.col("tier").alias("source"), *found.columns[len(keys) + 1 :])
    doi = by_doi.select(*keys, "status", "source", "similarity", F.col("meta_title").alias("c_title"))
    return titled.unionByName(doi, allowMissingColumns=True)


def listed_journals(entries: DataFrame, listing: DataFrame, threshold: float = OPEN_LIST) -> DataFrame:
    """Distinct container names that a listing (column title) has: by equal keys, the rest by similarity, found in an exact index. Names and listing are made once and
    written to the shared folder."""
    written = Written(entries.sparkSession)
    listing = written.cut(listing.select("title").distinct())
    names = written.cut(entries.where((field("type") == "journal") & (F.length("container") >= 3)).select("container").distinct()).withColumn("_key", title_key(F.col("container")))
    keys = listing.select(title_key(F.col("title")).alias("_key")).distinct()
    equal = names.join(keys, "_key", "left_semi").select("container")
    left = names.join(equal, "container", "left_anti").select(F.col("container").alias("title"))
    own, one = left.select("title", F.col("title").alias("_name")), F.lit("one")
    texts = named_texts(own, ["_name"], one, article_titles(F.col("title")))
    listed = named_texts(listing, [], one, article_records(F.col("title")))
    found = near.alike(texts, listed, threshold)
    near_names = texts.withColumnRenamed("text", "a").join(found, ["block", "a"], "left_semi").select(F.col("_name").alias("container")).distinct()
    return equal.unionByName(near_names)


def retraction(updates: Column) -> Column:
    """Struct type, severe, date of a record's updates (array of type, date parts): the first severe one, else the first known one, else null."""
    named = F.transform(updates, lambda u: F.struct(F.replace(F.lower(F.coalesce(u["type"], F.lit(""))), F.lit("-"), F.lit("_")).alias("type"), F.array_join(F.transform(u["date_parts"], lambda d: d.cast("string")), "-").alias("date")))
    severe, known = F.filter(named, lambda u: u["type"].isin(*SEVERE)), F.filter(named, lambda u: u["type"].isin(*KNOWN_UPDATES))
    pick = F.coalesce(F.get(severe, F.lit(0)), F.get(known, F.lit(0)))
    return F.when(pick.isNotNull(), F.struct(pick["type"].alias("type"), pick["type"].isin(*SEVERE).alias("severe"), pick["date"].alias("date")))


def preprint_server(doi: Column, url: Column, subtype: Column | None = None) -> Column:
    """Name of the preprint server by DOI prefix, link or the record's own kind; null if it isn't one."""
    prefix = F.split_part(F.lower(F.coalesce(doi, F.lit(""))), F.lit("/"), F.lit(1))
    low = F.lower(F.coalesce(url, F.lit("")))
    by_prefix = F.try_element_at(F.create_map(*[F.lit(x) for p in PREPRINT_PREFIXES.items() for x in p]), prefix)
    by_url = F.when(low.contains("arxiv.org"), "arXiv").when(low.contains("ssrn.com"), "SSRN").when(low.contains("biorxiv.org") | low.contains("medrxiv.org"), "bioRxiv/medRxiv")
    own = F.when(subtype == "preprint", "preprint") if subtype is not None else F.lit(None)
    return F.coalesce(by_prefix, by_url, own)


def corrections(pairs: DataFrame) -> DataFrame:
    """pairs (entry fields and m_ fields of its authority record) with corrections: array of field, current, suggested.

    Year (four digits, letters aside), volume, issue, pages and, for books and reports, the publisher; equal values in another spelling are none.
    """
    made = []
    for f in ("year", "volume", "issue", "pages", "publisher"):
        own, new = F.trim(field(f)), sub(F.trim(field(f"m_{f}")), "–", "-")
        own = plain_year(own) if f == "year" else own
        differs = (new != "") & (new != own)
        if f == "year":
            differs = differs & new.rlike(r"^\d{4}$")
        if f == "pages":
            differs = differs & ~((own != "") & (compare_key(own) == compare_key(new)))
        if f == "publisher":
            differs = differs & field("type").isin("book", "report") & ~((own != "") & (publisher_key(own) == publisher_key(new)))
        made.append(F.when(differs, F.struct(F.lit(f).alias("field"), F.when(own == "", "(없음)").otherwise(own).alias("current"), new.alias("suggested"))))
    return pairs.withColumn("corrections", F.filter(F.array(*made), lambda s: s.isNotNull()))


def corrected(pairs: DataFrame) -> DataFrame:
    """pairs with the suggested values in place of the entry's own."""
    for f in ("year", "volume", "issue", "pages", "publisher"):
        new = F.get(F.expr(f"filter(corrections, s -> s.field = '{f}')"), F.lit(0))["suggested"]
        pairs = pairs.withColumn(f, F.coalesce(new, F.col(f)))
    return pairs


def filled(entries: DataFrame, meta: DataFrame, keys: list[str], fields: tuple[str, ...]) -> DataFrame:
    """entries with empty fields taken from meta; values that are there stay."""
    joined = entries.join(meta.select(*keys, *(F.col(f).alias(f"_m_{f}") for f in fields)), keys, "left")
    return joined.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_m_{f}"), F.lit("")) for f in fields}).drop(*(f"_m_{f}" for f in fields))


def tips(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items beside the enabled rules whose types hold the item's: an equi-join on the exploded types."""
    return items.join(rules.where("enabled").select("rule_id", "topic", "rule", F.explode("types").alias("type")).distinct(), "type")


def same_doi_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose DOI b has, in any letter case."""
    return a.join(b.select(F.lower("doi").alias("_d")).distinct(), F.lower(a["doi"]) == F.col("_d"), "left_semi")
