"""Normalisers, names and letter case on literals, scripts other than Latin among them."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from refloom.functions import names, text
from refloom.operators import parse


def values(spark, rows, *columns):
    schema = ", ".join(f"c{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(rows[0]))
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (text.script_class, {"홍길동 (2020)": "ko", "図書館の研究": "east", "漢字": "east", "Smith": "west", "123": "ko", "": "ko"}),
        (text.strip, {"　 a b ": "a b", "": ""}),
        (text.title_key, {"Digital—Library: 연구, 2nd!": "digital library 연구 2nd", "Ⅳ": "", "Основы": "основы"}),
        (text.compare_key, {"A. B, “C” (D)·E-F": "ABCDE-F"}),
        (text.publisher_key, {"(주)조은글터": "조은글터", "도서출판 한울": "한울", "Wiley-Blackwell": "wileyblackwell", "Elsevier Ltd.": "elsevier", "Incunabula": "incunabula"}),
        (text.solid_key, {"Ab-1 가漢か": "ab1가漢"}),
        (text.bare_doi, {"https://dx.doi.org/10.1/X": "10.1/X", "10.1/X": "10.1/X"}),
        (text.doi_of, {"see doi: 10.1234/ab.c.": "10.1234/ab.c", "10.1234/abc": ""}),
        (text.any_doi, {"x 10.1234/ab-c), y": "10.1234/ab-c", "110.1234/abc": ""}),
        (text.url_of, {"at https://a.b/c?d=e). Then": "https://a.b/c?d=e"}),
        (text.main_title, {"정보서비스론 (개정판): 이론과 실제": "정보서비스론", "국문 = English": "국문"}),
        (text.without_authors, {"A, B. (2020). Title. X": "Title. X", "no head": "no head", "가 (n.d.). 나": "나"}),
        (text.without_tags, {'a<font color="red">b</font>  c': "ab c"}),
        (text.safe_name, {"../x/a:b?.txt": "a_b_.txt"}),
        (text.plain_year, {"2020a": "2020", "n.d.": "n.d."}),
        (text.first_page, {" 12-34": "12", "e12": ""}),
        (names.title_case, {"digital library of the IFLA: a view from x": "Digital Library of the IFLA: A View from X", "가나 다": "가나 다", "the end": "The End"}),
        (names.sentence_case, {"The Impact Of Open Data: A Study": "The impact of open data: A study", "The impact of IFLA": "The impact of IFLA", "two Words": "Two Words"}),
        (names.western_name, {"Priscilla Caplan": "Caplan, P.", "Caplan, Priscilla": "Caplan, P.", "Wilson, T.D": "Wilson, T. D.", "IFLA": "IFLA", "Public Library Association": "Public Library Association", "": ""}),
    ],
)
def test_functions_of_one_string(spark, function, cases):
    found = dict(values(spark, [(k,) for k in cases], F.col("c0"), function(F.col("c0"))))
    assert found == cases


def test_input_kinds(spark):
    cases = {"https://doi.org/10.1000/xyz.": ("doi", "10.1000/xyz"), "ISBN: 978-89-1234-567-8": ("isbn", "9788912345678"), "089-123-456-x": ("isbn", "089123456x".upper()), "http://a.b": ("url", "http://a.b"), "A title": ("title", "A title")}
    found = {r[0]: (r[1].kind, r[1].value.upper() if r[1].kind == "isbn" else r[1].value) for r in values(spark, [(k,) for k in cases], F.col("c0"), text.input_kind(F.col("c0")))}
    assert found == cases


def test_blocked_addresses(spark):
    blocked = ["ftp://a.b", "http://localhost/x", "http://127.0.0.1", "http://10.1.2.3/", "http://172.20.0.1", "http://192.168.1.1:80/", "http://169.254.169.254/", "http://[::1]/", "http://[fd00::1]/", "x", None]
    free = ["https://example.org/a", "http://8.8.8.8", "http://172.32.0.1", "http://[2001:4860::8888]/"]
    found = dict(values(spark, [(u,) for u in blocked + free], F.col("c0"), text.blocked_address(F.col("c0"))))
    assert {u for u, b in found.items() if b} == set(blocked)


@pytest.mark.parametrize(
    ("line", "lang", "expected"),
    [
        ("Huber, E., Rueschemeyer, D., & Stephens, J. D.", "west", ["Huber, E", "Rueschemeyer, D", "Stephens, J. D"]),
        ("Caplan, Priscilla", "west", ["Caplan, Priscilla"]),
        ("Smith, J. and Jones, K.", "west", ["Smith, J", "Jones, K"]),
        ("Smith and Jones", "west", ["Smith, Jones"]),  # read as surname and given name
        ("Smith, J., et al.", "west", ["Smith, J"]),
        ("구정화·우윤희·신난희", "ko", ["구정화", "우윤희", "신난희"]),
        ("김영석, 외", "ko", ["김영석"]),
        ("", "west", []),
    ],
)
def test_split_authors(spark, line, lang, expected):
    assert values(spark, [(line, lang)], names.split_authors(F.col("c0"), F.col("c1")))[0][0] == expected


def test_author_lines(spark):
    rows = [(["Smith, John"], "", "west"), (["Smith, J", "Doe, A B"], "eds.", "west"), (["A B", "C D", "E F"], "ed", "west"), (["홍길동", " 김철수"], "옮김", "ko"), ([""], "", "ko")]
    found = [r[0] for r in values(spark, rows, names.author_line(F.col("c0"), F.col("c1"), F.col("c2")))]
    assert found == ["Smith, J.", "Smith, J. & Doe, A. B. eds.", "B, A., D, C., & F, E. ed.", "홍길동, 김철수 옮김", ""]


def test_clean_names(spark):
    rows = [(["이경란(충남대학교 문헌정보학과)", "Wilson, T.D.; Department of X", "y" * 61, " "],)]
    assert values(spark, rows, names.clean_names(F.col("c0")))[0][0] == ["이경란", "Wilson, T.D"]


def test_blanks_are_those_of_unicode(spark):
    points = [k for k in range(0x3100) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(k, chr(k)) for k in points], "k int, c string")
    assert {r.k for r in rows.where(F.col("c").rlike(r"(?U)^\s\z")).collect()} == {r.k for r in rows.where(text.strip(F.col("c")) == "").collect()} == set(map(ord, text.BLANKS))


def test_serial_parts_equal_the_whole_pattern(spark):
    tails = ["Journal of X, 12(3), 45-60.", "A 3 4 5", "Ab, 12, 34", "X, 1 (2) 3", ",, 5, 6", "Jıournal İssue K 5, e1234", "9. ab 7, paper 3", "a" * 70 + " 3, 4", "Name, 7(1).", "No numbers", "x\x1ey, 5, 6-7", "1 2, 3, 4 5"]
    rows = spark.createDataFrame([("journal", t) for head in ("", "Title of a work. ", "제목은 ", "Q " * 40) for t in (head + x for x in tails)], "type string, _serial string")
    found = parse.serial_parts(rows).withColumn("whole", parse.whole_tail(F.col("_serial"))).collect()
    assert [r._parts for r in found] == [r.whole for r in found]


def test_words_lose_no_type(spark):
    """What a type's pattern finds has one of the type's words, in any letter case and with the letters that count as s, k and i."""
    found = ["석사 학위 논문", "DOCTORAL DİſſERTATION", "Maſter'ſ theſıs", "unpublished master", "법률 제12호", "공포번호", "시행령", "시행규칙", "in Chapter A-1.", "NAK 1", "ISO/2", "KS X 1", "IEC 3", "Standardization", "표준", "[영화]", "[tv 프로그램]",
             "[dvd]", "[fılm]", "[İntervıew]", "와의 면담", "학술대회", "학술발표대회", "발표 논문집", "PROCEEDİNGS of", "Paper preſented", "워크샵", "워크숍", "심포지엄", "연구보고서", "정책연구", "조사분석", "간행물 번호", "RePort No", "백서", "우수사례집", "매뉴얼", "지침"]
    rules = [*parse.TYPES, ("report", parse.REPORT, parse.REPORT_WORDS)]
    matched = reduce(lambda a, b: a | b, (F.col("t").rlike(p) for _, p, _ in rules))
    guarded = reduce(lambda a, b: a | b, (F.col("t").rlike(p) & reduce(lambda a, b: a | b, (F.contains(text.folded(F.col("t")), F.lit(w)) for w in words)) for _, p, words in rules))
    rows = spark.createDataFrame([(t,) for t in found], "t string").select("t", matched.alias("m"), guarded.alias("g")).collect()
    assert [r.t for r in rows if not (r.m and r.g)] == []
