"""Fuzzy title searches against all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from refloom.functions.similarity import record_key
from refloom.functions.text import hangul_key, title_key
from refloom.operators import link
from refloom.plans import lookups


def misspelt(rng, title, n):
    letters = list(title)
    for _ in range(n):
        k = rng.randrange(len(letters))
        new = rng.choice("가나다라마바사아자차") if "가" <= letters[k] <= "힣" else rng.choice("abcdefghijklmnopqrstuvwxyz")
        letters[k : k + 1] = rng.choice([[new], [new, letters[k]], []])
    return "".join(letters)


def titles(rng):
    stock = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    common = ["introduction", "of", "the", "analysis", "study"]
    west = [(" ".join(rng.choices(stock, k=rng.randint(2, 7)) + rng.choices(common, k=rng.randint(0, 3))), rng.choice(["", " ".join(rng.choices(stock, k=4))])) for _ in range(120)]
    korean = [("".join(rng.choice("한국문학연구사회정책교육경제역사철학방법이론") for _ in range(rng.randint(8, 14))), "") for _ in range(60)]
    others = [("دراسة في قوائم المراجع", ""), ("دراسة في قائمة المراجع", ""), ("!!! ??? ...", "")]
    return west + korean + others


def test_all_articles_that_are_alike(spark):
    """Typos in any word, words that moved, one-word titles, titles with subtitles, scripts that have no key: every pair and its similarity."""
    rng = random.Random(6)
    records = [(k, t, s) for k, (t, s) in enumerate(titles(rng))]
    asked = []
    for _, t, s in records:
        full = f"{t}: {s}" if s and rng.random() < 0.5 else t
        words = full.split()
        asked.append((len(asked), " ".join(words[1:] + words[:1]) if rng.random() < 0.2 else misspelt(rng, full, rng.randint(0, 3 if len(full) > 15 else 1))))
    authority, entries = spark.createDataFrame(records, "pos long, title string, subtitle string"), spark.createDataFrame(asked, "seq long, title string")
    every = {t for _, t in asked} | {t for _, t, _ in records} | {f"{t}: {s}" for _, t, s in records}
    key = {r.t: r.k for r in spark.createDataFrame([(x,) for x in every], "t string").select("t", title_key(F.col("t")).alias("k")).collect()}

    def likeness(a, b):
        x, y = (key[a], key[b]) if key[a] and key[b] else ("".join(a.lower().split()), "".join(b.lower().split()))
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    one = F.lit("one")
    for threshold in (link.ARTICLE, link.OTHER_ARTICLE, link.ARTICLE_ANY_YEAR):
        expected = {}
        for i, q in asked:
            for pos, t, s in records:
                best = max(likeness(q, x) for x in {t, f"{t}: {s}" if s else t})
                if len(q) >= 8 and best >= threshold:
                    expected[i, pos] = round(best, 9)
        found = link.candidates(link.asked_texts(entries, ["seq"], one, False), link.known_articles(authority, one), threshold, ["seq"]).collect()
        assert {(r.seq, r.c_pos): round(r.similarity, 9) for r in found} == expected and len(expected) > 100


def test_all_records_that_are_alike(spark):
    rng = random.Random(9)
    records = [(k, t) for k, (t, _) in enumerate(titles(rng))]
    asked = [(k, misspelt(rng, t, rng.randint(0, 3))) for k, t in records]
    keys = spark.createDataFrame([(x,) for x in {t for _, t in [*asked, *records]}], "t string").select("t", record_key(F.col("t")).alias("k")).collect()
    key = {r.t: r.k for r in keys}
    ratio = lambda a, b: difflib.SequenceMatcher(None, key[a], key[b]).ratio() if key[a] and key[b] else 0.0
    expected = {(i, pos): round(ratio(q, t), 9) for i, q in asked for pos, t in records if ratio(q, t) >= link.DOMESTIC}
    one = F.lit("one")
    found = link.candidates(link.asked_texts(spark.createDataFrame(asked, "seq long, title string"), ["seq"], one, True), link.known_books(spark.createDataFrame(records, "pos long, title string"), one), link.DOMESTIC, ["seq"]).collect()
    assert {(r.seq, r.c_pos): round(r.similarity, 9) for r in found} == expected


def test_duplicates_equal_all_pairs(spark):
    """Lists of their own, equal titles and DOIs, titles that differ in a few letters, empty titles."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 60))) for _ in range(25)]
    rows = [(k % 4, k, "10.1/x" if k % 11 == 0 else "", misspelt(rng, rng.choice(base), rng.randint(0, 3)) if k % 17 else "") for k in range(160)]
    found = link.duplicates(spark.createDataFrame(rows, "doc_id long, seq long, doi string, title string")).collect()
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for _, _, _, t in rows], "t string").select("t", hangul_key(F.col("t")).alias("k")).distinct().collect()}
    expected = {}
    for d, i, doi, t in rows:
        for e, j, other, u in rows:
            if d == e and i < j:
                x, y = keys[t], keys[u]
                s = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
                if doi and doi == other:
                    expected[d, i, j] = ("doi", 1.0)
                elif s >= link.DUPLICATE:
                    expected[d, i, j] = ("title", round(s, 9))
    assert {(r.doc_id, r.seq_a, r.seq_b): (r.reason, round(r.similarity, 9)) for r in found} == expected and len(found) == len(expected)


def test_journals_equal_all_pairs(spark):
    rng = random.Random(5)
    listing = [f"Journal of {w} studies" for w in ("reference", "archive", "library", "metadata")] + ["문헌정보학회지", "مجلة المراجع"]
    names = [misspelt(rng, t, rng.randint(0, 4)) for t in listing for _ in range(12)] + ["ab", "Nature"]
    entries = spark.createDataFrame([("journal", n) for n in names], "type string, container string")
    table = spark.createDataFrame([(t,) for t in listing], "title string")
    key = {r.t: r.k for r in spark.createDataFrame([(x,) for x in {*names, *listing}], "t string").select("t", title_key(F.col("t")).alias("k")).collect()}
    for threshold in (link.OPEN_LIST, link.DOMESTIC_LIST):
        expected = set()
        for n in names:
            for t in listing:
                x, y = (key[n], key[t]) if key[n] and key[t] else ("".join(n.lower().split()), "".join(t.lower().split()))
                if len(n) >= 3 and (key[n] == key[t] or difflib.SequenceMatcher(None, x, y).ratio() >= threshold):
                    expected.add(n)
        assert {r.container for r in link.listed_journals(entries, table, threshold).collect()} == expected


def test_duplicates_make_their_entries_once(spark):
    """Parsing costs more than the search: each entry is made in one task only."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k // 5, k, "10.1/a" if k % 3 else "", f"On the nature of lists {k % 4}") for k in range(100)], "doc_id long, seq long, doi string, title string")
    found = link.duplicates(rows.mapInArrow(counted, rows.schema))
    assert found.count() > 100 and found.where("reason = 'title'").count() > 20 and made.value == 100


def test_lookups_and_routes_make_their_rows_once(spark):
    """Lines and entries are made in one task each, however many routes and searches read them; a record of a far year is found where any year will do."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    titles = ["On the nature of reference lists", "A history of library catalogues", "Metadata in the age of archives"]
    rows = spark.createDataFrame([(k, titles[k % 3][:-1] + "zs"[k % 2], "1999" if k % 3 else "", "journal", "west") for k in range(30)], "seq long, title string, year string, type string, lang string")
    entries = rows.selectExpr("*", "'' AS volume", "'' AS issue", "'' AS pages", "'' AS doi", "'' AS url")
    records = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(titles, ("1950", "1998", "1950"), strict=True))], "pos long, title string, year string")
    authority = records.selectExpr("pos", "title", "'' AS subtitle", "year", "'' AS volume", "'' AS issue", "'' AS pages", "'' AS doi", "'' AS publisher", "'' AS isbn")
    found = link.verify(entries.mapInArrow(counted, entries.schema), {"crossref": authority}, ["seq"]).collect()
    tier = {0: "crossref", 1: "crossref", 2: "crossref any year"}
    assert {r.seq: r.source for r in found} == {k: tier[k % 3] for k in range(30)} and made.value == 30
    made.value = 0
    lines = rows.selectExpr("seq AS query_id", "title AS q")
    found = lookups.lookup(lines.mapInArrow(counted, lines.schema), authority).collect()
    assert {r.query_id: r.pos for r in found} == {k: k % 3 for k in range(30)} and made.value == 30


def test_entries_of_identifiers_are_shuffled_once(spark):
    from refloom.plans import lookups

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = spark.createDataFrame([(1, "On the nature of lists", "2001"), (1, "On the nature of lists", "2001"), (2, "Another work", "2001"), (3, "On the nature of lists", "2005"), (4, "No record", ""), (5, None, None), (None, "On the nature of lists", "2001"), (6, "Without an identifier", "2001")], "seq long, title string, year string")
        identifiers = spark.createDataFrame([(1, "10.1234/a"), (2, "10.1234/A"), (3, "https://doi.org/10.1234/a"), (4, "10.1234/none"), (5, "10.1234/a"), (None, "10.1234/a")], "seq long, identifier string")
        authority = spark.createDataFrame([(1, "On the nature of lists", "", "2001", "10.1234/a"), (2, "On the nature of lists", "", "2001", "10.1234/a")], "pos long, title string, subtitle string, year string, doi string").selectExpr("*", *(f"'' AS {c}" for c in ("volume", "issue", "pages", "isbn", "publisher")))
        found = lookups.with_identifier(entries, identifiers, authority, ["seq"])
        assert sorted((r.seq, r.status, r.pos) for r in found.collect() if r.seq not in (4,)) == [*[(1, "verified", 1)] * 4, (2, "mismatch", 1), (3, "mismatch", 1), (5, "mismatch", 1)]
        assert [(r.status, r.pos) for r in found.where("seq = 4").collect()] == [("not_found", None)]
        queries = entries.join(identifiers, "seq").selectExpr("struct(seq) AS query_id", "identifier AS q")
        alone = lookups.lookup(queries, authority).where("pos IS NOT NULL").select("query_id.*", "pos")
        dealt = [rows._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(query_id") for rows in (found, alone)]
        assert dealt[0] <= dealt[1]  # entries are not dealt by the query's struct, too
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
