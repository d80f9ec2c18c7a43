"""Segmentation, parser, renderer, order, citations on whole small manuscripts."""

import pytest
from pyspark.sql import functions as F

from refloom.operators import citations, parse, render, segment
from refloom.plans import manuscripts

MANUSCRIPT = """A study of lists
1. Introduction
As shown before (Adams, 1999; Baker & Cole, 2001), and by 홍길동(2015), lists matter. Table (Figure 1999) does not count.
Daniels (2010) disagrees; (Evans et al., 2012, 15-17) too.
References
[1] Adams, A. (1999). On lists. Journal of Lists, 12(3), 45-
67.
[2] Baker, B., & Cole, C. (2001). Lists and more. London: List Press.
[3] 홍길동 (2015). 목록의 연구. 한국목록학회지, 제4권 제2호, 11-20.
[4] Daniels, D. (2010). "Daniel's view." List Review, 8(1), 1-9. https://doi.org/10.1000/dv.8.
[5] Unused, U. (2003). Never cited. Journal of Nothing, 1(1), 1-2.
Appendix
Not a part of the list at all.
"""


@pytest.fixture(scope="module")
def lists(spark):
    docs = spark.createDataFrame([(1, MANUSCRIPT), (2, "no list here"), (3, None), (4, "")], "doc_id long, text string")
    return segment.reference_lists(docs)


def fields(spark, raw):
    return parse.parse(spark.createDataFrame([(raw,)], "raw string")).first()


def test_sections(lists):
    found = {r.doc_id: r for r in lists.collect()}
    assert found[1].section.startswith("[1] Adams") and found[1].section.endswith("1-2.") and "Daniels (2010)" in found[1].body
    assert [found[k].error for k in (1, 2, 3, 4)] == [None, *["no reference list found"] * 3]


def test_last_heading_counts(spark):
    text = "Contents\nReferences\n1. Introduction\n" + "x " * 200 + "\n<참고문헌>\n홍길동 (2020). 어떤 제목. 어떤 학회지, 1(1), 1-2."
    found = segment.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found.section.startswith("홍길동") and "Contents" in found.body


def test_entries(lists):
    found = [r.raw for r in segment.entries(lists).orderBy("doc_id", "seq").collect()]
    assert len(found) == 5 and found[0] == "Adams, A. (1999). On lists. Journal of Lists, 12(3), 45- 67." and found[2].startswith("홍길동")


def test_lists_without_headings(spark):
    lines = "\n".join(f"Name{chr(97 + k)}, A. (20{10 + k}). Some title. Some Journal, {k}(1), 1-2." for k in range(5))
    docs = spark.createDataFrame([(1, lines), (2, "Prose without years.\nMore prose, and more.\nAnd an end to it all.")], "doc_id long, text string")
    assert {r.doc_id: r.error is None for r in segment.reference_lists(docs).collect()} == {1: True, 2: False}


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Ram, S. (1987). A model of innovation resistance. Advances in Consumer Research, 14, 208-212.", {"type": "journal", "authors": ["Ram, S"], "year": "1987", "volume": "14", "issue": "", "pages": "208-212", "container": "Advances in Consumer Research"}),
        ("Caplan, Priscilla. Metadata basics, part 2. Chicago: American Library Association, 2003.", {"type": "book", "authors": ["Caplan, Priscilla"], "place": "Chicago", "publisher": "American Library Association", "year": "2003"}),
        ("이수상 (2008). 디지털도서관운영론 2. 한국도서관협회: 서울.", {"type": "book", "place": "서울", "publisher": "한국도서관협회"}),
        ("변회균 (2014). 사서의 활용. 박사 학위 논문, 경기대학교.", {"type": "thesis", "degree": "박사학위논문", "institution": "경기대학교"}),
        ("Kim, A. (2011). Uses of data. Doctoral dissertation, Rutgers University, USA.", {"type": "thesis", "degree": "Doctoral dissertation", "institution": "Rutgers University", "country": "USA"}),
        ("홍길동 (2019. 3. 7). 기사 제목. 한국일보, 12.", {"type": "newspaper", "date": "2019. 3. 7.", "year": "2019", "container": "한국일보", "pages": "12"}),
        ("Smith, J. (2012, March 5). A page. Some Site. https://a.b/c", {"type": "web", "date": "2012, March 5", "url": "https://a.b/c", "title": "A page"}),
        ("Lee, B. (2001/2005). Translated work. Journal of X, 1(1), 1-2.", {"year": "", "orig_year": ""}),
        ("도서관법. 법률 제19592호.", {"type": "law", "title": "도서관법", "report_no": "법률 제19592호"}),
        ("", {"type": "unknown", "year": "", "authors": []}),
    ],
)
def test_parsed_fields(spark, raw, expected):
    found = fields(spark, raw).asDict()
    assert {k: found[k] for k in expected} == expected


def test_notes(spark):
    assert parse.NOTE_YEAR in fields(spark, "Someone. A title without a year.").notes
    assert parse.NOTE_NO_PAGES in fields(spark, "Wilson, T. D. (2000). Recent trends. Information Research, 5(3).").notes


@pytest.mark.parametrize(
    ("entry", "expected"),
    [
        ({"type": "book", "lang": "west", "authors": ["Jane Doe"], "year": "2001", "title": "on the nature of lists", "place": "London", "publisher": "List Press", "edition": "2nd ed."}, "Doe, J. (2001). On the Nature of Lists (2nd ed.). London: List Press."),
        ({"type": "journal", "lang": "west", "authors": ["Doe, J", "Roe, R", "Poe, E A"], "year": "2001", "title": "The Nature Of Many Lists", "container": "journal of lists", "volume": "3", "issue": "4", "pages": "5-6", "doi": "10.1/x"}, "Doe, J., Roe, R., & Poe, E. A. (2001). The nature of many lists. Journal of Lists, 3(4), 5-6. https://doi.org/10.1/x"),
        ({"type": "report", "lang": "ko", "authors": ["국립도서관"], "year": "2019", "title": "운영 지침", "publisher": "국립도서관"}, "국립도서관 (2019). 운영 지침."),
        ({"type": "web", "lang": "ko", "authors": ["홍길동"], "year": "2020", "date": "2020. 1. 2.", "title": "글", "url": "http://a.b"}, "홍길동 (2020. 1. 2.). 글. 출처: http://a.b"),
        ({"type": "thesis", "lang": "west", "authors": ["Doe, J"], "year": "2001", "title": "lists", "institution": "Any University", "url": "http://t.u"}, "Doe, J. (2001). Lists. Thesis, Any University. http://t.u"),
        ({"type": "unknown", "lang": "west", "authors": [], "year": "", "title": "Just this"}, "Just this. (n.d.)."),
        ({"type": "law", "lang": "ko", "authors": [], "title": "도서관법", "report_no": "법률 제1호"}, "도서관법. 법률 제1호."),
        ({"type": "standard", "lang": "west", "authors": [], "year": "2010", "title": "Lists", "report_no": "ISO 1"}, "Lists. (2010). (ISO 1)."),
    ],
)
def test_rendered(spark, entry, expected):
    schema = ", ".join(f"{k} {'array<string>' if k == 'authors' else 'string'}" for k in entry)
    assert render.formatted(spark.createDataFrame([tuple(entry.values())], schema)).first().formatted == expected


def test_order_and_letters(spark):
    rows = [(1, 1, ["Doe, J"], "2001", "b", "west"), (1, 2, ["Doe, J"], "2001", "A", "west"), (1, 3, ["Doe, J"], "2001a", "c", "west"), (1, 4, ["가나"], "2010", "x", "ko"), (1, 5, [], "", "zz", "west"), (1, 6, ["漢字"], "1990", "y", "east"), (2, 1, ["Doe, J"], "2001", "b", "west")]
    found = render.sorted_with_letters(spark.createDataFrame(rows, "doc_id int, seq int, authors array<string>, year string, title string, lang string")).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.seq, r.year) for r in found] == [(1, 4, "2010"), (1, 2, "2001a"), (1, 1, "2001b"), (1, 3, "2001a"), (1, 5, ""), (1, 6, "1990"), (2, 1, "2001")]


def test_headers(spark):
    rows = [(1, k, g) for k, g in enumerate(["a", "a", "", "a", "b", None, "a"], 1)]
    found = render.group_headers(spark.createDataFrame(rows, "doc_id int, position int, g string"), "g").orderBy("position").collect()
    assert [r.header for r in found] == ["a", None, None, None, "b", None, "a"]


def test_issues(spark):
    rows = parse.parse(spark.createDataFrame([("Doe, J. (2001). Only a title. London: Press.",), ("Wilson, T. D. (2000). Recent trends. Information Research, 5(3).",)], "raw string"))
    found = {r.type: r.i for r in rows.select("type", render.issues().alias("i")).collect()}
    assert found == {"book": [], "journal": [parse.NOTE_NO_PAGES]}


def test_citations(lists, spark):
    found = {(r.name, r.year) for r in citations.citations(lists.where("doc_id = 1")).collect()}
    assert found == {("Adams", "1999"), ("Baker", "2001"), ("Evans", "2012"), ("홍길동", "2015"), ("Daniels", "2010")}


def test_cross_check(lists):
    parsed = parse.parse(segment.entries(lists))
    cited, missing, unused = citations.cross_check(lists, parsed)
    assert [(r.name, r.year, r.name_only_match) for r in missing.collect()] == [("Evans", "2012", False)]
    assert [r.seq for r in unused.collect()] == [5]
    assert cited.where("matched").count() == 4


def test_whole_way(spark):
    docs = spark.createDataFrame([(1, MANUSCRIPT), (2, "nothing")], "doc_id long, text string")
    rules = spark.createDataFrame([("r1", "t", "rule", ["book"], True)], "rule_id string, topic string, rule string, types array<string>, enabled boolean")
    done = manuscripts.process(docs, 2012, rules=rules)
    summary = done.summary.first()
    assert (summary.total, summary.tips, summary.crosscheck_issues) == (5, 1, 2)
    assert [r.error for r in done.errors.collect()] == ["no reference list found"]
    health = done.health.first()
    assert (health.year_min, health.year_max, health.recent_count) == (1999, 2015, 3)
    again = done.items.where("seq = 1").withColumn("formatted", F.lit("new"))
    assert {r.formatted for r in manuscripts.reverified(done.items, again).where("seq = 1").collect()} == {"new"}
    done.release()


def test_citations_read_each_text_once(spark):
    docs = spark.createDataFrame([(1, "Kim (2001) and (Lee, 2002; Park, 2003). 김철수(2004)")], "doc_id long, body string")
    found = citations.citations(docs)
    assert found._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1
    assert {(r.name, r.year) for r in found.collect()} == {("Kim", "2001"), ("Lee", "2002"), ("Park", "2003"), ("김철수", "2004")}


def test_lists_are_cut_in_their_own_rows(spark):
    """No shuffle, each text read once, also where no heading is found; lists that share an id are not mixed; every kind of line end, lines that go on, odd characters."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    bare = "\n".join(f"[{k}] Waner, A. (199{k}). On lists of kind {k}. List Journal, {k}(2), 3-4." for k in range(1, 5))
    text = "Body\nReferences\r\n[1] Waner, A. (1990). On lists\x01of kinds.\x0b  and their   ends, \n\x0c12-14.\x85[2] Doner, B. (1991). Other lists of kinds. \n[3] Short.\nhttps://example.org/x"
    docs = spark.createDataFrame([(1, text), (1, bare), (None, bare), (2, None), (3, "no list")], "doc_id long, text string")
    found = segment.entries(segment.reference_lists(docs.mapInArrow(counted, docs.schema)))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r.doc_id, r.seq, r.raw) for r in found.collect()]
    assert read.value == 5
    own = [(k, f"Waner, A. (199{k}). On lists of kind {k}. List Journal, {k}(2), 3-4.") for k in range(1, 5)]
    cut = [(1, "Waner, A. (1990). On lists\x01of kinds. and their ends, 12-14."), (2, "Doner, B. (1991). Other lists of kinds."), (3, "Short. https://example.org/x")]
    assert sorted(rows, key=str) == sorted([*((1, *x) for x in cut), *((1, *x) for x in own), *((None, *x) for x in own)], key=str)


def test_cited_works_are_searched_once(spark):
    """What is cited is searched in the texts once, for all three tables."""
    from refloom.operators import citations, segment

    docs = spark.createDataFrame([(k, "As told (Waa, 1990) and (Zork, 1991).\nReferences\n[1] Waa, B. (1990). On lists of every kind. List Journal, 1(2), 3-4.") for k in range(4)], "doc_id long, text string")
    entries = spark.createDataFrame([(k, 1, "Waa, B. (1990). On lists.", ["Waa, B."], "1990", "", "On lists", "west") for k in range(4)], "doc_id long, seq long, raw string, authors array<string>, year string, orig_year string, title string, lang string")
    cited, not_listed, not_cited = citations.cross_check(segment.reference_lists(docs), entries)
    assert cited.count() == 8 and cited.where("matched").count() == 4 and not_cited.count() == 0
    assert [(r.doc_id, r.name) for r in not_listed.orderBy("doc_id").collect()] == [(k, "Zork") for k in range(4)]
    assert all("regexp_extract_all" not in t._jdf.queryExecution().executedPlan().toString() for t in (cited, not_listed))


def test_groups_of_a_tail_are_those_of_its_pattern(spark):
    tails = {
        "book": ["A title (2nd ed.). London: Press.", "제목 (개정판). 서울: 글터.", "No place here.", "A: b", "😀 A title. Paris: Press", "One\x1eTwo. Paris: Press", "", "Line\nof two. Paris: Press"],
        "thesis": ["On lists. Doctoral dissertation, X University, Korea.", "목록. 석사 학위 논문, 가나대학교.", "On lists", "Master's thesis", "a\x1eb. Master's thesis, X"],
        "report": ["A report (No. 3). Press.", "A report", "a\x1eb (1). c", ". ."],
        "conference": ["A talk. Proceedings of lists, 1-2.", "A talk", "a\x1eb? c"],
        "unknown": ["A title (2nd ed.). London: Press."],
    }
    rows = [(t, r) for t, own in tails.items() for r in own * 2] + [(None, "A. B: c"), ("book", None)]
    found = parse.tail_groups(spark.createDataFrame(rows, "type string, _rest string"))
    own = {t: F.when(F.col("_rest").rlike(p), F.array(*(F.regexp_extract("_rest", p, k) for k in range(1, n + 1)))) for t, (p, n) in parse.TAILS.items()}
    expected = F.coalesce(*(F.when(F.col("type") == t, c) for t, c in own.items()))
    some = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.get("_groups", k))
    for row in found.select("type", "_rest", F.filter(some, lambda g: g.isNotNull()).alias("got"), expected.alias("want")).collect():
        assert (row.got or None) == (row.want and row.want[:4]) or (row.want is not None and row.got[: len(row.want)] == row.want), row


def test_a_tail_is_searched_once(spark):
    """The pattern of books stands in one rewriting, and in the groups of texts that hold a separator, not in each field."""
    rows = parse.tail_groups(spark.createDataFrame([("book", "A title. London: Press.", False, "")], "type string, _rest string, _fixed boolean, title string"))
    plan = rows.select(*(c.alias(name) for name, c in parse.book_fields().items()))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(parse.BOOK_TAIL) <= 2 + parse.TAILS["book"][1]


def test_odd_entries_parse_as_ever(spark):
    rows = [(1, None), (2, ""), (3, " . "), (4, "Doe, J. (2014). On 2014 lists, 2014. London: Press, 2014."), (4, "Doe, J. (2014). On 2014 lists, 2014. London: Press, 2014."), (5, "Doe, J. (2014). Lists. http://a.example/b doi: 10.1234/ab Available: x")]
    found = {r.k: r for r in parse.parse(spark.createDataFrame(rows, "k int, raw string")).collect()}
    assert found[1].title == found[2].title == "" and found[1].type == "unknown" and found[1].authors == []
    assert (found[4].year, found[4].publisher) == ("2014", "Press") and "2014" not in found[4].title + found[4].place
    assert (found[5].doi, found[5].url) == ("10.1234/ab", "http://a.example/b")


def test_parts_of_a_line_are_columns(spark):
    """No function of an array goes over the parts of a line, which would be evaluated without generated code; blank links and null names stay out."""
    schema = "k int, type string, lang string, title string, container string, year string, url string, publisher string, authors array<string>"
    rows = [(1, "journal", "west", "On lists", "List Journal", "2001", " ", "", ["Doe, J.", None, " "]), (2, "x", "ko", "목록", "", "", "http://a.example", "글터", None), (3, None, None, None, None, None, None, None, [])]
    made = render.formatted(spark.createDataFrame(rows, schema))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "_part1" in plan
    found = {r.k: r.formatted for r in made.collect()}
    assert found[1] == "Doe, J. (2001). On lists. List Journal."
    assert found[3] == ". (발행년불명)."
