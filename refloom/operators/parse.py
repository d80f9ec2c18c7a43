"""From an entry's string to its fields: staged columns, one case expression for each field."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import names
from refloom.functions.text import BLANKS, DOI_LINK, URL, YEAR, doi_of, either, folded, group, lstrip, rstrip, script_class, squeeze, strip, sub, url_of

TEXT_FIELDS = "raw type lang author_note year date orig_year title container editors volume issue pages article_no edition place publisher degree institution country report_no doi url medium".split()
FIELDS = [*TEXT_FIELDS, "authors", "notes"]

# Patterns and lists that the fields depend on, in the order in which they are tried.
KO_DATE = rf"(?U)\(({YEAR})\s*[.,]\s*(\d{{1,2}})\s*[.,]\s*(\d{{1,2}})\s*\.?\s*\)"
EN_DATE = rf"(?U)\(({YEAR}),\s*([A-Z][a-z]+)(?:\s+(\d{{1,2}}))?\)"
YEAR_IN_PARENS = rf"\(({YEAR}[a-z]?|{YEAR}/{YEAR}|{YEAR}[.,][^)]*|발행년불명|n\.d\.)\)"
QUOTED = r"""(?U)^([^"“『「]{2,70}?)[.,]?\s*["“『「]([^"”』」]+)["”』」][.,]?\s*(.*)$"""
SENTENCE_END = r"""(?U)\.\s+(?=[A-Z가-힣“"'『「])"""
ROLE = r"(?U)(편저|공편|엮음|옮김|번역|감독|연출|편|eds?\.|Eds?\.|ed\.|Translated by)\s*$"
#: Type, pattern, and words in lower case of which a string that matches has one: most strings have none, and need no pattern.
TYPES: list[tuple[str, str, tuple[str, ...]]] = [
    ("thesis", r"(?iU)(석사|박사)\s*학위\s*논문|Doctoral dissertation|Master'?s thesis|Unpublished (doctoral|master)", ("학위", "doctoral", "master")),
    ("law", r"(?U)법률\s*제?\s*\d+호|공포번호|시행령|시행규칙|(^|\s)Chapter\s+[A-Z0-9][A-Z0-9\-.]*\.?$", ("법률", "공포번호", "시행", "chapter")),
    ("standard", r"(?U)NAK\s?\d|ISO[/ ]?\d|KS\s?[A-Z]{1,2}\s?\d|IEC\s?\d|Standardization|표준", ("nak", "iso", "ks", "iec", "standardization", "표준")),
    ("av", r"(?iU)\[(영화|TV\s*프로그램|CD|DVD|음반|Television|Motion picture|Film)\]", ("[",)),
    ("interview", r"(?iU)\[(인터뷰|Interview)\]|와의\s*면담", ("[", "면담")),
    ("conference", r"(?iU)학술대회|학술발표대회|발표\s*논문집|Proceedings of|Paper presented|워크샵|워크숍|심포지엄", ("학술", "논문집", "proceedings", "presented", "워크", "심포지엄")),
]
NEWS_NAME, NEWS_DATE = r"(?U)(일보|신문|Times|Post|Herald|Tribune)[\s,.]", rf"(?U)\({YEAR}[.,]\s*\d"
NEWS_WORDS = ("일보", "신문", "Times", "Post", "Herald", "Tribune")
REPORT = r"(?iU)연구보고서?|정책연구|조사분석|간행물\s*번호|Report No|백서|우수사례집|매뉴얼|지침서?"
REPORT_WORDS = ("연구보고", "정책연구", "조사분석", "간행물", "report", "백서", "우수사례집", "매뉴얼", "지침")
#: Patterns of articles, each with strings of which a text that matches has one.
JOURNAL: list[tuple[str, tuple[str, ...]]] = [
    (r"(?U)[,\s]\d{1,4}\s*\(\d{1,3}\)\s*[,:：]", ("(",)),
    (r"(?U)[,\s]\d{1,4}\s*[,:：]\s*\d{1,5}\s*[-–]\s*\d{1,5}", ("-", "–")),
    (r"(?U)(학회지|학보|저널|논집|논총|연구\s*[,.]|Journal|Review|Quarterly|Research|Bulletin|Proceedings)[\s,.]", ("학회지", "학보", "저널", "논집", "논총", "연구", "Journal", "Review", "Quarterly", "Research", "Bulletin", "Proceedings")),
    (r"(?U)제?\s*\d{1,3}\s*권\s*제?\s*\d{1,3}\s*호", ("권",)),
]
COLONS = (":", "：")
BOOK = r"(?U)[가-힣A-Za-z.\s]{1,20}\s*[:：]\s*\S"
BODY_END = "(도서관|위원회|연구원|연구소|재단|협회|학회|공사|공단|부|처|청|원)$"
PUBLISHER_END = r"(?U)(출판|출판사|협회|문화사|서관|미디어|아카데미|프레스)\s*\.?\s*$"
PUBLISHER_LIKE = "(협회|출판|문화사|서관|미디어|아카데미|정보|Press|Publish|Association|Books|House|사)$"
CITIES = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "파주", "고양", "수원", "성남", "청주", "chicago", "london", "new york", "boston", "oxford", "cambridge", "berlin", "tokyo", "paris", "amsterdam", "philadelphia", "los angeles", "san francisco", "reading", "westport"]
VOLUME_REWRITES = (
    (r"(?U)[Vv]ol\.?\s*(\d+)", " $1"),
    (r"(?U)[Nn]o\.?\s*(\d+)", "($1)"),
    (r"(?U)[Pp]p?\.\s*(\d+)", "$1"),
)
KOREAN_VOLUMES = (
    (r"(?U)제?\s*(\d+)\s*권\s*,?\s*제?\s*(\d+)\s*호", " $1($2)"),
    (r"(?U)제?\s*(\d+)\s*권", " $1"),
    (r"(?U)제?\s*(\d+)\s*집", " $1"),
)
PAGE_REWRITES = (
    (r"(?U)(\d+)\s*[-–~]\s*(\d+)\s*(쪽|면|p\b)?", "$1-$2"),
    (r"(?U)(\d)\s*,?\s*\(\s*(\d{1,3})\s*\)", "$1($2)"),
    (r"(?U)\s{2,}", " "),
)
SERIAL = r"[가-힣A-Za-z一-鿿&:：\-·\s]{2,60}?"
NUMBERS = r"[,\s]+(\d{1,4})\s*(?:\((\d{1,3})\))?\s*[,:：\s]\s*(paper\s*\d+|e\d{3,7}|\d{1,5}\s*[-–]\s*\d{1,5}|\d{1,5})\s*\.?\s*$"
SERIAL_TAIL = rf"(?iU)^(.*?)({SERIAL}){NUMBERS}"
SERIAL_NO_PAGES = rf"(?U)^(.*?)({SERIAL})[,\s]+(\d{{1,4}})\s*\((\d{{1,3}})\)\s*[,.]?\s*$"
SEPARATOR = "\x1e"
#: A name's characters as SERIAL has them, letters of either case and what counts as such named one by one. A name starts where no such character precedes it.
NAME_CHARACTERS = rf"[A-Za-zſKıİ가-힣一-鿿&:：\-·{BLANKS}]"
SERIAL_HEAD = rf"^([^\n\r\x85\u2028\u2029{SEPARATOR}]*?)(?<!{NAME_CHARACTERS})({NAME_CHARACTERS}{{2,60}}+){SEPARATOR}"
BOOK_TAIL = r"(?U)^(.+?)[.?]?\s*(?:\(([^)]*(?:판|ed\.)[^)]*)\))?\s*[.]?\s*([가-힣A-Za-z.\s]{1,25}?)\s*[:：]\s*([^.]+)\.?$"
THESIS = r"(?iU)(석사\s*학위\s*논문|박사\s*학위\s*논문|Doctoral dissertation|Master'?s thesis)\s*,?\s*([^,.]+)?(?:,\s*([^.]+))?"
REPORT_TAIL = r"(?U)^(.+?)\s*(?:\(([^)]+)\))?\s*\.\s*([^.]+)?\.?$"
CONFERENCE_TAIL = r"(?U)^(.+?)[.?]\s*(.+)$"
#: Types whose fields are groups of a pattern, and how many groups it has.
TAILS = {"book": (BOOK_TAIL, 4), "thesis": (THESIS, 3), "report": (REPORT_TAIL, 3), "conference": (CONFERENCE_TAIL, 2)}
#: An entry with an identifier, or a word before one, has one of these strings.
IDENTIFIER_MARKS = ("10.", "://", "출처", "Available", "Retrieved")
NOTE_YEAR, NOTE_SPLIT, NOTE_AUTHORS, NOTE_TITLE = "발행연도 확인 필요", "저자·연도 구분 확인 필요", "저자명 확인 필요", "제목 확인 필요"
NOTE_NO_PAGES, NOTE_VOLUME, NOTE_IMPRINT = "면수 확인 필요(온라인 학술지는 아티클 넘버)", "권·호·면수 확인 필요", "출판지·출판사 확인 필요"
NOTE_SCHOOL, NOTE_DEGREE = "학위수여기관 확인 필요", "학위명·수여기관 확인 필요"


def col(name: str) -> Column:
    return F.col(name)


def note(condition: Column, text: str) -> Column:
    return F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))


def before(c: Column, pattern: str) -> Column:
    """What stands before the first match; the whole if there is none."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def sentence_head(c: Column) -> tuple[Column, Column]:
    """A first sentence of 2 to 70 characters and the rest; without one, nothing and the whole."""
    at = F.regexp_instr(c, F.lit(SENTENCE_END)) - 1
    cut = at.between(2, 70)
    gap = F.length(group(c, SENTENCE_END))
    return strip(F.when(cut, F.substring(c, F.lit(1), at)).otherwise("")), F.when(cut, strip(F.substring(c, at + gap + 1, F.length(c)))).otherwise(c)


def has(c: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text: cheaper than a pattern that needs one of them."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def identifiers(rows: DataFrame) -> DataFrame:
    """Adds lang, doi, url and _text: the entry with one period at its end, one kind of middle dot, and no identifiers."""
    text = F.concat(rstrip(squeeze(strip(col("raw"))), "."), F.lit("."))
    rows = rows.withColumn("_text", F.translate(text, "․‧", "··"))
    rows = rows.withColumns({"lang": script_class(col("_text")), "_marked": has(col("_text"), IDENTIFIER_MARKS)})

    def if_marked(c: Column, otherwise: Column) -> Column:
        return F.when(col("_marked"), c).otherwise(otherwise)

    rows = rows.withColumn("doi", if_marked(doi_of(col("_text")), F.lit("")))
    rows = rows.withColumn("_text", if_marked(sub(col("_text"), DOI_LINK, " "), col("_text")))
    rows = rows.withColumn("url", if_marked(url_of(col("_text")), F.lit("")))
    rows = rows.withColumn("_text", if_marked(sub(col("_text"), URL, " "), col("_text")))
    # what has no mark is the text as it was made above, which has neither blanks at its ends nor two in a row
    return rows.withColumn("_text", if_marked(strip(squeeze(sub(col("_text"), r"(?U)(출처|Available|Retrieved from|Retrieved)\s*[:：]?\s*", " "))), col("_text"))).drop("_marked")


def dates(rows: DataFrame) -> DataFrame:
    """Adds year, date and orig_year. A full date wins, then a year in parentheses, then one at the end or before a colon."""
    t = col("_text")
    plain = rf"\(({YEAR}[a-z]?)\)"
    pair = rf"\(({YEAR})/({YEAR})\)"
    # a pair alone gives no year
    kind = F.when(t.rlike(KO_DATE), "ko").when(t.rlike(EN_DATE), "en").when(~t.rlike(plain), "none").when(t.rlike(pair), "pair").otherwise("plain")
    rows = rows.withColumn("_dated", kind)
    is_ = {k: col("_dated") == k for k in ("ko", "en", "pair", "plain")}
    number = [group(t, KO_DATE, k).try_cast("int").cast("string") for k in (2, 3)]
    day = group(t, EN_DATE, 3)
    tail, mid = rf"(?U)[,\s(]({YEAR})[a-z]?\s*[.):]*\s*$", rf"(?U)[\s,(]({YEAR})[):：]"
    date = F.when(is_["ko"], F.concat(group(t, KO_DATE, 1), F.lit(". "), number[0], F.lit(". "), number[1], F.lit("."))).when(is_["en"], F.concat(group(t, EN_DATE, 1), F.lit(", "), group(t, EN_DATE, 2), F.when(day != "", F.concat(F.lit(" "), day)).otherwise("")))
    year = (
        F.when(is_["ko"], group(t, KO_DATE, 1))
        .when(is_["en"], group(t, EN_DATE, 1))
        .when(is_["pair"], group(t, pair, 2))
        .when(is_["plain"], group(t, plain, 1))
        .otherwise(either(group(t, tail, 1), group(t, mid, 1), F.when(t.contains("(발행년불명)"), "발행년불명"), F.when(t.rlike(r"(?i)\(n\.d\.\)"), "n.d.")))
    )
    return rows.withColumns({"year": year, "date": F.coalesce(date, F.lit("")), "orig_year": F.when(is_["pair"], group(t, pair, 1)).otherwise("")}).drop("_dated")


def entry_type(text: Column, low: Column, date: Column, url: Column) -> Column:
    """The first rule that applies; their order is the meaning. low: the text as folded() gives it."""
    found = F.when(F.lit(False), "")
    for name, pattern, words in TYPES:
        found = found.when(has(low, words) & text.rlike(pattern), name)
    found = found.when(has(text, NEWS_WORDS) & text.rlike(NEWS_DATE) & text.rlike(NEWS_NAME), "newspaper").when((date != "") & (url != ""), "web").when(has(low, REPORT_WORDS) & text.rlike(REPORT), "report")
    for pattern, words in JOURNAL:
        found = found.when(has(text, words) & text.rlike(pattern), "journal")
    return found.when(has(text, COLONS) & text.rlike(BOOK), "book").when(url != "", "web").otherwise("unknown")


def authors_and_title(rows: DataFrame) -> DataFrame:
    """Adds authors, author_note, title, _rest, _fixed (the title stands in quotes) and _split_notes.

    Layouts in turn: a year in parentheses among the first 70 characters after the authors; a quoted title; a first sentence without a
    year; else all is title.
    """
    t = col("_text")
    paren = group(t, YEAR_IN_PARENS)
    at = F.regexp_instr(t, F.lit(YEAR_IN_PARENS)) - 1
    dated = (col("_paren") != "") & (col("_at") <= 70)
    rows = rows.withColumns({"_at": at, "_paren": paren})
    rows = rows.withColumn("_layout", F.when(dated, "year").when(t.rlike(QUOTED), "quote"))
    # sentences are looked for where nothing better is found
    head, tail = (F.when(col("_layout").isNull(), c).otherwise("") for c in sentence_head(t))
    rows = rows.withColumns({"_head": head, "_tail": tail})
    rows = rows.withColumn("_layout", F.coalesce("_layout", F.when((col("_head") != "") & ~col("_head").rlike(YEAR), "sentence").otherwise("title")))
    is_ = {k: col("_layout") == k for k in ("year", "quote", "sentence", "title")}
    named = (
        F.when(is_["year"], rstrip(strip(F.substring(t, F.lit(1), col("_at"))), ".,"))
        .when(is_["quote"], rstrip(strip(group(t, QUOTED, 1)), ".,"))
        .when(is_["sentence"], rstrip(col("_head"), ".,"))
        .otherwise("")
    )
    after = strip(lstrip(strip(F.substring(t, col("_at") + F.length("_paren") + 1, F.length(t))), ".,"))
    rows = rows.withColumns({
        "_named": named,
        "_rest": F.when(is_["year"], after).when(is_["quote"], strip(group(t, QUOTED, 3))).when(is_["sentence"], col("_tail")).otherwise(""),
        "title": F.when(is_["quote"], rstrip(strip(group(t, QUOTED, 2)), ".,")).when(is_["title"], rstrip(strip(t), ".")).otherwise(""),
        "_fixed": is_["quote"],
    })
    rows = rows.withColumn("author_note", group(col("_named"), ROLE, 1))
    bare = F.when(col("author_note") != "", rstrip(strip(before(col("_named"), ROLE)), ".,")).otherwise(col("_named"))
    rows = rows.withColumn("authors", F.when(col("_named") == "", F.array().cast("array<string>")).otherwise(names.split_authors(bare, col("lang"))))
    unnamed = (F.size("authors") == 0) & (col("_named") != "")
    return rows.withColumn("_split_notes", F.concat(note(is_["title"], NOTE_SPLIT), note(unnamed, NOTE_AUTHORS)))


def refined_type(rows: DataFrame) -> DataFrame:
    """Second chance for unknown types: a corporate author alone makes a report, a colon or an imprint at the end a book."""
    rest = strip(sub(col("_rest"), r"(?U)[,\s]+\(?(?:18|19|20)\d{2}[a-z]?\)?[.):]*\s*$", "."))
    body = (col("lang") == "ko") & (F.size("authors") == 1) & F.coalesce(F.get("authors", F.lit(0)).rlike(BODY_END), F.lit(False))
    imprint = (col("lang") == "west") & rest.rlike(r"(?U)\.\s+[A-Z][^.]*?,\s*[A-Z][a-z]+\s*\.?\s*$")
    book = rest.rlike("[:：]") | imprint | ((col("lang") == "ko") & rest.rlike(PUBLISHER_END))
    return rows.withColumn("type", F.when(col("type") != "unknown", col("type")).when(body, "report").when(book, "book").otherwise("unknown"))


def is_city(c: Column) -> Column:
    bare = rstrip(strip(c), ".")
    return F.lower(bare).isin(CITIES) | bare.rlike("^[가-힣]{2,4}$")


def is_publisher(c: Column) -> Column:
    return rstrip(strip(c), ".").rlike(PUBLISHER_LIKE)


def two_parts(c: Column) -> tuple[Column, Column]:
    """Before and after the first sentence end; the second is null if there is none."""
    parts = F.split(c, r"(?U)[.?]\s+", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def serial_parts(rows: DataFrame) -> DataFrame:
    """Adds _parts: head, container, volume, issue and pages of an article's tail (_serial), or the first four of one without pages, or the string alone. Null
    for other types.

    SERIAL_TAIL tries many splits. Where its numbers stand is found first, as they only stand at the end; then what precedes them is split. That is the same unless
    the first such place has no whole name of 60 characters or less before it; then the whole pattern is tried. Matches are rewritten with separators between their groups.
    """
    c = col("_serial")
    rows = rows.withColumn("_marked", F.when(col("type") == "journal", F.regexp_replace(c, f"(?iU){NUMBERS}", SEPARATOR + SEPARATOR.join(("$1", "$2", "$3")))))
    rows = rows.withColumn("_cut", F.split(F.regexp_replace(col("_marked"), SERIAL_HEAD, SEPARATOR.join(("$1", "$2", ""))), SEPARATOR))
    short = F.split(F.regexp_replace(c, SERIAL_NO_PAGES, SEPARATOR.join(f"${k}" for k in range(1, 5))), SEPARATOR)
    parts = F.when(F.contains(c, F.lit(SEPARATOR)), whole_tail(c)).when(F.size("_cut") == 5, col("_cut")).when(col("_marked") == c, short).otherwise(whole_tail(c))
    return rows.withColumn("_parts", F.when(col("type") == "journal", parts))


def whole_tail(c: Column) -> Column:
    """The parts by the whole pattern."""
    full = F.split(F.regexp_replace(c, SERIAL_TAIL, SEPARATOR.join(f"${k}" for k in range(1, 6))), SEPARATOR)
    short = F.split(F.regexp_replace(c, SERIAL_NO_PAGES, SEPARATOR.join(f"${k}" for k in range(1, 5))), SEPARATOR)
    return F.get(F.transform(F.array(full), lambda p: F.when(F.size(p) == 5, p).otherwise(short)), F.lit(0))


def journal_fields() -> dict[str, Column]:
    r, parts = col("_serial"), col("_parts")
    full, short = F.size(parts) == 5, F.size(parts) == 4

    def part(k: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(k - 1)), F.lit(""))

    found = full | short
    page = part(5)
    article = page.rlike("(?i)^(paper|e[0-9])")
    first, second = two_parts(r)
    head = rstrip(strip(part(1)), ".,")
    loose = F.when(col("_fixed"), rstrip(strip(r), ".")).otherwise(rstrip(strip(F.coalesce(second, F.lit(""))), "."))
    return {
        "title": F.when(found, either(head, col("title"))).otherwise(rstrip(strip(first), ".,")),
        "container": F.when(found, lstrip(rstrip(strip(part(2)), ".,"), ".,")).otherwise(loose),
        "volume": F.when(found, part(3)).otherwise(""),
        "issue": F.when(found, part(4)).otherwise(""),
        "article_no": F.when(full & article, page).otherwise(""),
        "pages": F.when(full & ~article, sub(page, r"(?U)\s*[-–]\s*", "-")).otherwise(""),
        "_notes": F.concat(note(~full & short, NOTE_NO_PAGES), note(~found, NOTE_VOLUME)),
    }


def tail_groups(rows: DataFrame) -> DataFrame:
    """Adds _groups: for the types of TAILS the groups of their pattern in _rest, from 1 on, null if it doesn't match. For the others null.

    A pattern is searched once, not once for each group: its matches are rewritten with separators between the groups.
    """
    r = col("_rest")
    marked, apart = F.when(F.lit(False), r), F.when(F.lit(False), F.array(r))
    for name, (pattern, n) in TAILS.items():
        every = range(1, n + 1)
        marked = marked.when(col("type") == name, F.regexp_replace(r, pattern, "".join(f"{SEPARATOR}${k}" for k in every) + SEPARATOR))
        apart = apart.when((col("type") == name) & r.rlike(pattern), F.array(F.lit(""), *(group(r, pattern, k) for k in every)))
    rows = rows.withColumn("_marked", marked)
    return rows.withColumn("_groups", F.when(F.contains(r, F.lit(SEPARATOR)), apart).when(col("_marked") != r, F.split("_marked", SEPARATOR)))


def tail_group(number: int) -> Column:
    return F.get("_groups", F.lit(number))


def book_fields() -> dict[str, Column]:
    r = col("_rest")
    full = col("_groups").isNotNull()
    place, publisher = strip(tail_group(3)), strip(tail_group(4))
    swapped = (place != "") & (publisher != "") & ~is_city(place) & is_city(publisher) & is_publisher(place)
    head, tail = sentence_head(r)
    title = rstrip(strip(either(head, F.split_part(r, F.lit("."), F.lit(1)))), ".,")
    imprint = rstrip(strip(F.when(col("_fixed"), r).otherwise(tail)), ".,")
    pair = r"(?U)^([^,:：]+),\s*([^,:：]+)$"
    paired = imprint.rlike(pair) & (F.size(names.words_of(group(imprint, pair, 2))) <= 2)
    own = F.when(col("_fixed"), col("title")).otherwise(title)
    return {
        "title": F.when(full, rstrip(strip(tail_group(1)), ".,")).otherwise(title),
        "edition": F.when(full, strip(tail_group(2))).otherwise(""),
        "place": F.when(full, F.when(swapped, publisher).otherwise(place)).when(paired, strip(group(imprint, pair, 2))).otherwise(""),
        "publisher": F.when(full, F.when(swapped, place).otherwise(publisher)).when(paired, strip(group(imprint, pair, 1))).when(imprint != own, imprint).otherwise(""),
        "_notes": note(~full & ~paired, NOTE_IMPRINT),
    }


def thesis_fields() -> dict[str, Column]:
    r = col("_rest")
    found = col("_groups").isNotNull()
    head, degree = rstrip(strip(before(r, THESIS)), ".,"), tail_group(1)
    school = strip(tail_group(2))
    return {
        "title": F.when(found, either(head, col("title"))).otherwise(strip(F.split_part(r, F.lit("."), F.lit(1)))),
        "degree": F.when(found, F.when(degree.rlike("[가-힣]"), sub(degree, r"(?U)\s", "")).otherwise(degree)).otherwise(""),
        "institution": F.when(found, school).otherwise(""),
        "country": F.when(found, strip(tail_group(3))).otherwise(""),
        "_notes": F.concat(note(found & (school == ""), NOTE_SCHOOL), note(~found, NOTE_DEGREE)),
    }


def report_fields() -> dict[str, Column]:
    r = col("_rest")
    found = col("_groups").isNotNull()
    return {
        "title": F.when(found, rstrip(strip(tail_group(1)), ".")).otherwise(rstrip(strip(r), ".")),
        "report_no": F.when(found, strip(tail_group(2))).otherwise(""),
        "publisher": F.when(found, strip(tail_group(3))).otherwise(""),
    }


def news_fields() -> dict[str, Column]:
    parts = F.split(col("_rest"), r"(?U)[.?]\s+")
    medium = rstrip(strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), ".,")
    paged = r"(?U)^(.+?),\s*([\dA-Z\-–, ]+)$"
    return {
        "title": strip(F.get(parts, F.lit(0))),
        "container": F.when(medium.rlike(paged), strip(group(medium, paged, 1))).otherwise(medium),
        "pages": strip(group(medium, paged, 2)),
    }


def conference_fields() -> dict[str, Column]:
    r = col("_rest")
    found = col("_groups").isNotNull()
    held = rstrip(strip(tail_group(2)), ".")
    page = r"(?U)[,\s](\d{1,5}\s*[-–]\s*\d{1,5})\s*\.?\s*$"
    paged = held.rlike(page)
    return {
        "title": F.when(found, strip(tail_group(1))).otherwise(rstrip(strip(r), ".")),
        "container": F.when(found & paged, rstrip(strip(before(held, page)), ".,")).when(found, held).otherwise(""),
        "pages": F.when(found & paged, sub(group(held, page, 1), r"(?U)\s*[-–]\s*", "-")).otherwise(""),
    }


def law_fields() -> dict[str, Column]:
    return {"title": strip(F.split_part(col("raw"), F.lit("."), F.lit(1))), "report_no": group(col("raw"), r"(?U)법률\s*제?\s*\d+호|Chapter\s+[A-Z0-9\-.]+")}


def standard_fields() -> dict[str, Column]:
    return {"title": rstrip(strip(two_parts(col("_rest"))[0]), "."), "report_no": group(col("raw"), r"\(([^)]*(?:NAK|ISO|KS|IEC)[^)]*)\)", 1)}


def other_fields() -> dict[str, Column]:
    first, second = two_parts(col("_rest"))
    return {
        "title": either(rstrip(strip(first), "."), col("title")),
        "container": F.when(col("_fixed"), rstrip(strip(col("_rest")), ".")).otherwise(rstrip(strip(F.coalesce(second, F.lit(""))), ".")),
    }


BY_TYPE: dict[str, Callable[[], dict[str, Column]]] = {
    "journal": journal_fields,
    "book": book_fields,
    "thesis": thesis_fields,
    "report": report_fields,
    "newspaper": news_fields,
    "web": news_fields,
    "conference": conference_fields,
    "law": law_fields,
    "standard": standard_fields,
}


def type_fields(rows: DataFrame) -> DataFrame:
    """Fills the fields of each type from what follows the authors. A quoted title stays (but for laws)."""
    year = sub(col("year"), "[a-z]$", "")
    again = F.concat(F.lit(r"(?U)[,\s(]+"), year, F.lit(r"[a-z]?[).:：]?\s*"))
    # the pattern is another one for each year: it is built only where the year stands again
    once = F.when(F.contains("_rest", year), F.regexp_replace(col("_rest"), again, F.lit(" "))).otherwise(col("_rest"))
    rows = rows.withColumn("_rest", F.when(year.rlike(r"^\d{4}$"), squeeze(strip(once))).otherwise(strip(col("_rest"))))

    def rewritten(c: Column, rewrites: tuple[tuple[str, str], ...]) -> Column:
        return reduce(lambda s, pair: sub(s, *pair), rewrites, c)

    rows = rows.withColumn("_serial", F.when(col("type") == "journal", rewritten(col("_rest"), VOLUME_REWRITES)).otherwise(""))
    korean = F.contains("_serial", F.lit("권")) | F.contains("_serial", F.lit("집"))
    rows = rows.withColumn("_serial", F.when(korean, rewritten(col("_serial"), KOREAN_VOLUMES)).otherwise(col("_serial")))
    rows = tail_groups(serial_parts(rows.withColumn("_serial", rewritten(col("_serial"), PAGE_REWRITES))))
    made = {name: make() for name, make in BY_TYPE.items()}
    other = other_fields()
    none = F.array().cast("array<string>")
    fields: dict[str, Column] = {}
    for f in ("title", "container", "volume", "issue", "pages", "article_no", "edition", "place", "publisher", "degree", "institution", "country", "report_no", "_notes"):
        default = none if f == "_notes" else F.lit("")
        value = F.when(F.lit(False), default)
        for name, own in made.items():
            if f in own:
                fixed = col("_fixed") & F.lit(f == "title" and name != "law")
                value = value.when(col("type") == name, F.when(fixed, col("title")).otherwise(own[f]) if f == "title" else own[f])
        known = col("type").isin(list(made))
        fields[f] = value.when(~known, F.when(col("_fixed"), col("title")).otherwise(other["title"]) if f == "title" else other.get(f, default)).otherwise(default)
    return rows.withColumns(fields)


def parse(rows: DataFrame) -> DataFrame:
    """rows (with a column raw) and the fields of each entry: strings, empty where missing, authors and notes as arrays.

    Every stage adds named columns; no Python runs on the rows. Null entries parse as empty ones.
    """
    others = [c for c in rows.columns if c not in FIELDS]
    rows = dates(identifiers(rows.select(*others, F.coalesce("raw", F.lit("")).alias("raw"))))
    rows = rows.withColumn("_low", folded(col("_text")))
    rows = rows.withColumn("type", entry_type(col("_text"), col("_low"), col("date"), col("url")))
    rows = type_fields(refined_type(authors_and_title(rows)))
    rows = rows.withColumn("notes", F.concat(note(col("year") == "", NOTE_YEAR), col("_split_notes"), col("_notes"), note(col("title") == "", NOTE_TITLE)))
    return rows.withColumns({"editors": F.lit(""), "medium": F.lit("")}).select(*others, *FIELDS)
