"""A second derived bibliography: an entry for each order, in every kind that the parser tells apart, domestic and western.

Its expressions are the same in Spark's SQL and DuckDB's, so the columns that an entry was written from are known to both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.plans.bibliography import dealt, table

_WORD = "translate(CAST(k AS STRING), '0123456789', 'abcdefghij')"
_HANGUL = "translate(CAST(k AS STRING), '0123456789', '가나다라마바사자차카')"
_YEAR = "CAST(1990 + k % 30 AS STRING)"
_NUMBER = "CAST(k % 90 + 1 AS STRING)"
_PAGES = "CAST(k % 400 + 1 AS STRING) || '-' || CAST(k % 400 + 9 AS STRING)"
_WEST = f"'Wa' || {_WORD} || 'ner, A.'"
_KO = "'김' || translate(CAST(k % 100 + 100 AS STRING), '0123456789', '가나다라마바사자차카')"

# Titles of books end in a number or an edition: the pattern of the place takes up to 25 letters and blanks before the colon, so a title of letters alone loses its end
# to the place. What each kind has, the entry as it was found and in the house style; {field} stands for a field, {cased} for the title with capitals.
FIELDS = "type lang author title container year date volume issue pages edition place publisher degree institution report_no url notes".split()
_ENTRIES: list[tuple[dict[str, str], str, str]] = [
    ({"type": "'journal'", "lang": "'ko'", "author": _KO, "title": f"{_HANGUL} || ' 목록의 성장'", "container": "'한국문헌학회지'", "volume": _NUMBER, "issue": "CAST(k % 4 + 1 AS STRING)", "pages": _PAGES}, "{author} ({year}). {title}. {container}, 제{volume}권 제{issue}호, {pages}쪽.", "{author} ({year}). {title}. {container}, {volume}({issue}), {pages}."),
    ({"type": "'journal'", "lang": "'west'", "author": _WEST, "title": f"'Growth of ' || {_WORD} || ' lists'", "container": "'Journal of List Studies'", "volume": _NUMBER, "issue": "CAST(k % 4 + 1 AS STRING)", "pages": _PAGES}, "{author} ({year}). {title}. {container}, Vol. {volume}, No. {issue}, pp. {pages}.", "{author} ({year}). {title}. {container}, {volume}({issue}), {pages}."),
    ({"type": "'book'", "lang": "'west'", "author": _WEST, "title": f"'Guide to ' || {_WORD} || ' lists'", "edition": "'2nd ed.'", "place": "'Chicago'", "publisher": "'Naa Books'"}, "{author} ({year}). {title} ({edition}). {place}: {publisher}.", "{author} ({year}). {cased} ({edition}). {place}: {publisher}."),
    ({"type": "'book'", "lang": "'ko'", "author": _KO, "title": f"{_HANGUL} || ' 목록의 이론 2'", "place": "'서울'", "publisher": "'글터출판사'"}, "{author} ({year}). {title}. {place}: {publisher}.", "{author} ({year}). {title}. {place}: {publisher}."),
    ({"type": "'book'", "lang": "'ko'", "author": _KO, "title": f"{_HANGUL} || ' 목록의 역사 1'", "place": "'서울'", "publisher": "'글터출판사'"}, "{author} ({year}). {title}. {publisher}: {place}.", "{author} ({year}). {title}. {place}: {publisher}."),
    ({"type": "'thesis'", "lang": "'ko'", "author": _KO, "title": f"{_HANGUL} || ' 목록의 구조'", "degree": "'석사학위논문'", "institution": "'가나대학교'"}, "{author} ({year}). {title}. 석사 학위 논문, {institution}.", "{author} ({year}). {title}. {degree}, {institution}."),
    ({"type": "'thesis'", "lang": "'west'", "author": _WEST, "title": f"'Order of ' || {_WORD} || ' lists'", "degree": "'Doctoral dissertation'", "institution": "'Naa University'"}, "{author} ({year}). {title}. {degree}, {institution}.", "{author} ({year}). {cased}. {degree}, {institution}."),
    ({"type": "'report'", "lang": "'ko'", "author": "'글터연구원'", "title": f"{_HANGUL} || ' 목록의 조사'", "publisher": "'글터연구원'", "report_no": f"'정책연구 ' || {_NUMBER}"}, "{author} ({year}). {title} ({report_no}). {publisher}.", "{author} ({year}). {title} ({report_no})."),
    ({"type": "'report'", "lang": "'ko'", "author": "'글터위원회'", "title": f"{_HANGUL} || ' 목록의 현황'"}, "{author} ({year}). {title}.", "{author} ({year}). {title}."),
    ({"type": "'newspaper'", "lang": "'ko'", "author": _KO, "title": f"{_HANGUL} || ' 목록의 소식'", "container": "'글터일보'", "pages": "'12'", "date": f"{_YEAR} || '. 3. 7.'"}, "{author} ({date}). {title}. {container}, {pages}.", "{author} ({date}). {title}. {container}, {pages}."),
    ({"type": "'web'", "lang": "'west'", "author": _WEST, "title": f"'Notes on ' || {_WORD} || ' lists'", "container": "'List Site'", "url": f"'https://lists.example/' || {_WORD}", "date": f"{_YEAR} || ', March 7'"}, "{author} ({date}). {title}. {container}. Retrieved from {url}", "{author} ({date}). {title}. {container}. Available: {url}"),
    ({"type": "'conference'", "lang": "'west'", "author": _WEST, "title": f"'Talk on ' || {_WORD} || ' lists'", "container": "'Proceedings of the List Meeting'", "pages": _PAGES}, "{author} ({year}). {title}. {container}, {pages}.", "{author} ({year}). {title}. {container}, {pages}."),
    ({"type": "'law'", "lang": "'ko'", "author": f"{_HANGUL} || ' 목록법'", "title": f"{_HANGUL} || ' 목록법'", "report_no": f"'법률 제' || {_NUMBER} || '호'", "year": "''", "notes": "'발행연도 확인 필요'"}, "{title}. {report_no}.", "{title}. {report_no}."),
    ({"type": "'standard'", "lang": "'west'", "author": "'List Institute'", "title": f"'Rules for ' || {_WORD} || ' lists'", "report_no": f"'ISO ' || {_NUMBER}"}, "{author} ({year}). {title}. ({report_no}).", "{author}. ({year}). {title} ({report_no})."),
    ({"type": "'unknown'", "lang": "'west'", "author": _WEST, "title": f"'Remarks on ' || {_WORD} || ' lists'", "container": "'Private paper'"}, "{author} ({year}). {title}. {container}.", "{author} ({year}). {title}. {container}."),
]


def _expressions() -> dict[str, str]:
    """Each field, raw and styled, as one CASE over the kinds."""
    own: list[dict[str, str]] = []
    for fields, *lines in _ENTRIES:
        values = {f: "''" for f in FIELDS} | {"year": _YEAR} | fields
        cased = values["title"].replace(_WORD, f"upper(substr({_WORD}, 1, 1)) || substr({_WORD}, 2)").replace("lists", "Lists")
        known = values | {"cased": cased}
        made = (" || ".join(known[p[1:-1]] if p.startswith("{") else f"'{p}'" for p in _split(line)) for line in lines)
        own.append(values | dict(zip(("raw", "styled"), made, strict=True)))
    return {f: "CASE t " + " ".join(f"WHEN {n} THEN {v[f]}" for n, v in enumerate(own)) + " END" for f in [*FIELDS, "raw", "styled"]}


def _split(entry: str) -> list[str]:
    """'{a} (b)' as ['{a}', ' (b)']."""
    out: list[str] = []
    for part in entry.split("{"):
        if "}" in part:
            name, text = part.split("}", 1)
            out += ["{" + name + "}"] + ([text] if text else [])
        elif part:
            out.append(part)
    return out


KINDS = len(_ENTRIES)
_COLUMNS = _expressions()
_SELECTED = ", ".join(f"{sql} AS {name}" for name, sql in _COLUMNS.items())
#: typed (doc_id, seq, t, the fields, raw, styled) as common table expressions in DuckDB's SQL, to build on.
TYPED_SQL = f"WITH keys AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey AS k, o_orderkey % {KINDS} AS t FROM orders), typed AS (SELECT doc_id, seq, t, {_SELECTED} FROM keys)\n"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (unique), t (number of the kind), the fields, raw and styled (the entry in the house style)."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % KINDS).alias("t"))
    keys = dealt(keys, keys.count())
    return keys.select("doc_id", "seq", "t", *(F.expr(sql).alias(name) for name, sql in _COLUMNS.items()))
