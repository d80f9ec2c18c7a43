"""Links, alignment, reports, stores, sources, exports, state and streams on small tables."""

import difflib
import io
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from refloom.functions import similarity
from refloom.operators import align, link, reports, stages, stores
from refloom.sources import documents, exports, html, records
from refloom.streaming import limits, windows


def test_ratio_is_not_symmetric_and_skips_popular_characters(spark):
    rows = [("tide", "diet"), ("diet", "tide"), ("", "x"), ("x" + "a" * 300, "a" * 300 + "y")]
    found = [(r.r, r.f) for r in spark.createDataFrame(rows, "a string, b string").select(similarity.ratio("a", "b").alias("r"), similarity.full_ratio("a", "b").alias("f")).collect()]
    assert found[:3] == [(0.25, 0.25), (0.5, 0.5), (0.0, 0.0)] and found[3][0] == 0.0 and found[3][1] > 0.99


def test_edits(spark):
    found = spark.createDataFrame([("abc", "abd")], "a string, b string").select(similarity.edits("a", "b").alias("e")).first().e
    assert [(e.tag, e.a, e.b) for e in found] == [("equal", "ab", "ab"), ("replace", "c", "d")]


def test_duplicates(spark):
    rows = [(1, 1, "10.1/a", "On the nature of lists"), (1, 2, "10.1/A", "On the nature of list"), (1, 3, "10.1/a", "Quite another"), (1, 4, "", "on the NATURE of lists!"), (1, 5, "", ""), (2, 1, "10.1/a", "")]
    found = {(r.seq_a, r.seq_b): r.reason for r in link.duplicates(spark.createDataFrame(rows, "doc_id int, seq int, doi string, title string")).collect()}
    assert found == {(1, 2): "title", (1, 3): "doi", (1, 4): "title", (2, 4): "title"}


AUTHORITY = "pos long, title string, subtitle string, year string, volume string, issue string, pages string, doi string, publisher string"


@pytest.fixture(scope="module")
def authority(spark):
    rows = [
        (1, "A study of reference lists", "", "2014", "3", "1", "10-20", "10.1/a", ""),
        (2, "A study of reference lists", "", "2017", "6", "2", "33-40", "10.1/b", ""),
        (3, "Metadata handbook", "theory and practice", "2008", "", "", "", "", "List Press"),
        (4, "Metadata handbook", "", "2026", "", "", "", "", "List Press"),
    ]
    return spark.createDataFrame(rows, AUTHORITY)


ENTRY = "doc_id int, seq int, type string, lang string, title string, year string, volume string, issue string, pages string, doi string, url string"


def test_best_candidates(spark, authority):
    rows = [(1, 1, "journal", "west", "A study of reference lists", "2017", "6", "2", "33-40", "", ""), (1, 2, "journal", "west", "A study of reference lists", "2011", "", "", "", "", ""), (1, 3, "journal", "west", "Metadata handbook: theory and practice", "", "", "", "", "", ""), (1, 4, "journal", "west", "Wholly unknown matter", "2010", "", "", "", "", "")]
    entries = spark.createDataFrame(rows, ENTRY)
    found = {r.seq: (r.c_pos, r.hits) for r in link.best_articles(entries, authority, ["doc_id", "seq"]).collect()}
    assert found == {1: (2, 3), 3: (3, 0)}
    found = {r.seq: r.c_pos for r in link.best_articles(entries, authority, ["doc_id", "seq"], 0.93, True).collect()}
    assert found[2] == 1 and 4 not in found
    books = spark.createDataFrame([(1, 1, "book", "ko", "Metadata handbook", "2026", "", "", "", "", "")], ENTRY)
    assert link.best_books(books, authority, ["doc_id", "seq"]).first().c_pos == 4


def test_verification_routes(spark, authority):
    rows = [
        (1, 1, "journal", "west", "A study of reference lists", "2014", "", "", "", "10.1/a", ""),
        (1, 2, "journal", "west", "Something else entirely", "2014", "", "", "", "10.1/a", ""),
        (1, 3, "journal", "west", "A study of reference lists", "2014", "", "", "", "10.1/zz", ""),
        (1, 4, "journal", "west", "A study of reference lists", "2014", "", "", "", "", ""),
        (1, 5, "journal", "west", "A work that was made up", "2014", "", "", "", "", ""),
        (1, 6, "book", "ko", "Metadata handbook", "2026", "", "", "", "", ""),
        (1, 7, "book", "ko", "어디에도 없는 책", "2026", "", "", "", "", ""),
        (1, 8, "web", "west", "Page", "", "", "", "", "", "http://ok"),
        (1, 9, "web", "west", "Page", "", "", "", "", "", "http://dead"),
        (1, 10, "book", "west", "Offline book", "", "", "", "", "", ""),
    ]
    links = spark.createDataFrame([("http://ok", True), ("http://dead", False)], "url string, ok boolean")
    entries = spark.createDataFrame(rows, ENTRY)
    found = {r.seq: r.status for r in link.verify(entries, {"crossref": authority, "nlk": authority}, ["doc_id", "seq"], links).collect()}
    assert found == {1: "verified", 2: "mismatch", 3: "not_found", 4: "verified", 5: "suspect", 6: "verified", 7: "not_found", 8: "link_ok", 9: "link_dead", 10: "skipped"}
    failed = {r.seq: r.status for r in link.verify(entries, {"crossref": authority}, ["doc_id", "seq"], links, ("openalex",)).collect()}
    assert failed[5] == "unchecked" and failed[4] == "verified"


def test_retractions_and_preprints(spark):
    rows = [("[{'type':'Correction','date_parts':[2020,1]},{'type':'retraction','date_parts':[2021,2,3]}]",), ("[{'type':'new-edition','date_parts':[2020]}]",), ("[{'type':'odd'}]",), ("[]",)]
    found = [r.r for r in spark.createDataFrame(rows, "j string").select(link.retraction(F.from_json(F.replace("j", F.lit("'"), F.lit('"')), records.UPDATES)).alias("r")).collect()]
    assert [(x.type, x.severe, x.date) if x else None for x in found] == [("retraction", True, "2021-2-3"), ("new_edition", False, "2020"), None, None]
    rows = [("10.48550/arXiv.1", "", ""), ("", "https://ssrn.com/1", ""), ("", "", "preprint"), ("10.1/a", "http://a", "")]
    found = [r[0] for r in spark.createDataFrame(rows, "d string, u string, s string").select(link.preprint_server(F.col("d"), F.col("u"), F.col("s"))).collect()]
    assert found == ["arXiv", "SSRN", "preprint", None]


def test_corrections(spark):
    schema = "type string, year string, volume string, issue string, pages string, publisher string, m_year string, m_volume string, m_issue string, m_pages string, m_publisher string"
    rows = [("journal", "2020a", "1", "", "71-86", "X", "2020", "2", "3", "71–86", "Y"), ("book", "2020", "", "", "", "조은글터", "n.d.", "", "", "", "(주)조은글터"), ("book", "2020", "", "", "", "A", "2021", "", "", "", "B")]
    found = link.corrections(spark.createDataFrame(rows, schema))
    assert [[(c.field, c.current, c.suggested) for c in r.corrections] for r in found.collect()] == [[("volume", "1", "2"), ("issue", "(없음)", "3")], [], [("year", "2020", "2021"), ("publisher", "A", "B")]]
    assert [(r.year, r.volume, r.issue) for r in link.corrected(found).collect()][0] == ("2020a", "2", "3")


def test_greedy_alignment(spark):
    """Against the definition: each item in turn takes the best free line."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items, published = [], []
    for doc in (1, 2, 3):
        texts = [" ".join(word() for _ in range(8)) for _ in range(7)]
        items += [(doc, k, t, t, t[:20] if k % 2 else "", "10.1/x" if k == 3 else "") for k, t in enumerate(texts)]
        lines = [t if k % 3 else t[: len(t) // 2] + " 10.1/X " + word() for k, t in enumerate(texts[:-1])]
        rng.shuffle(lines)
        published += [(doc, k, t) for k, t in enumerate([*lines, "totally other line", None])]
    expected = set()
    solid = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    for doc in (1, 2, 3):
        free = {p: t or "" for d, p, t in published if d == doc}
        for d, seq, _, formatted, title, doi in items:
            if d != doc:
                continue
            best, at = 0.0, None
            for p, t in free.items():
                score = difflib.SequenceMatcher(None, solid(formatted), solid(t), autojunk=False).ratio()
                score = max(score, 0.99 if doi and doi in t.lower() else 0, 0.9 if len(solid(title)) >= 8 and solid(title) in solid(t) else 0)
                if score > best:
                    best, at = score, p
            if at is not None and best >= 0.45:
                expected.add((doc, seq, at, round(best, 3)))
                del free[at]
    frame = spark.createDataFrame(items, "doc_id long, seq long, raw string, formatted string, title string, doi string")
    lines = spark.createDataFrame(published, "doc_id long, pos long, text string")
    found = align.align(frame, lines).collect()
    assert {(r.doc_id, r.seq, r.pos, r.sim) for r in found if r.kind == "pair"} == expected
    assert all((r.diff is None) == r.same for r in found if r.kind == "pair")
    assert sum(r.kind != "published_only" for r in found) == len(items) and sum(r.kind != "agent_only" for r in found) == len(published)
    assert align.rule_drafts(align.align(frame, lines)).count() == sum(r.kind == "pair" and not r.same for r in found)


def test_throttle_and_lockout(spark):
    rng = random.Random(1)
    events = [(rng.choice("ab"), k, k * 2.5 + rng.random(), rng.random() < 0.1) for k in range(400)]
    frame = spark.createDataFrame(events, "key string, event_id long, at double, success boolean")
    hits, expected = {"a": [], "b": []}, {}
    for key, k, at, _ in events:
        recent = [t for t in hits[key] if at - t < 60]
        expected[k] = len(recent) < 12
        hits[key] = [*recent, at] if expected[k] else recent
    assert {r.event_id: r.allowed for r in limits.throttled(frame).collect()} == expected
    fails, expected = {"a": [], "b": []}, {}
    for key, k, at, ok in events:
        recent = [t for t in fails[key] if at - t < 600]
        expected[k] = len(recent) < 5
        if expected[k]:
            recent = [] if ok else [*recent, at]
        fails[key] = recent
    assert {r.event_id: r.allowed for r in limits.locked(frame, "admin").collect()} == expected


def test_streams_decide_as_tables_do(spark, tmp_path):
    rows = [("a" if k % 3 else "b", k, float(k * 3), False) for k in range(90)]
    schema = "key string, event_id long, at double, success boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run = limits.throttled(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"{tmp_path}/state").start()
    end = time.time() + 90
    while spark.table("throttled").count() < len(rows) and time.time() < end and run.isActive:  # timeouts keep such a query busy, so it never idles
        time.sleep(0.5)
    run.stop()
    assert {(r.event_id, r.allowed) for r in spark.table("throttled").collect()} == {(r.event_id, r.allowed) for r in limits.throttled(spark.createDataFrame(rows, schema)).collect()}


def test_daily_totals_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 05:00:00", "x", 1.0), ("2024-01-01 23:00:00", "x", 2.0), ("2024-01-03 00:00:00", "x", 4.0)], "ts string, k string, v double").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "k", "v").write.parquet(f"{tmp_path}/e")
    table = spark.read.parquet(f"{tmp_path}/e")
    assert sorted((str(r.day), r.n, r.total) for r in windows.daily_totals(table, ["k"], "v").collect()) == [("2024-01-01", 2, 3.0), ("2024-01-03", 1, 4.0)]
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/e")
    run = windows.daily_totals(stream, ["k"], "v").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("daily").count() == 2


def test_job_and_session_expiry(spark):
    jobs = spark.createDataFrame([(1, "done", 0.0), (2, "running", 0.0), (3, "error", 9000.0)], "id int, status string, created double")
    assert sorted(r.id for r in limits.live(jobs, 10_000.0).collect()) == [2, 3]
    assert sorted(r.id for r in limits.valid_sessions(jobs, 45_000.0).collect()) == [3]


def test_estimates(spark):
    usage = spark.createDataFrame([("x", k, 10 * k, 4) for k in range(1, 5)], "ai string, n int, secs int, files int")
    assert reports.seconds_per_wave(usage, ["ai"], [F.desc("n")]).first().per_wave == 30.0
    rows = spark.createDataFrame([(30.0, 9, True, True), (None, 1, False, False), (None, 5, True, False)], "w double, n int, ai boolean, v boolean")
    assert [r[0] for r in rows.select(reports.estimate(F.col("w"), F.col("n"), F.col("ai"), F.col("v"))).collect()] == [90, 15, 160]


def test_dashboard(spark):
    one = reports.dashboard(spark.createDataFrame([("pending",), ("approved",)], "status string"), spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "usd double"), spark.createDataFrame([("2024-01-05",), ("2024-02-05",)], "time string"), "2024-01").first()
    assert (one.pending, one.month_uses, one.mean_cost) == (1, 1, 3.0)


def test_stores(spark):
    log = spark.createDataFrame([("a", 1, "insert", True), ("a", 2, "update", False), ("b", 1, "insert", True), ("b", 3, "delete", True)], "id string, version int, op string, enabled boolean")
    state = stores.latest(log, "id", "version")
    assert [(r.id, r.enabled) for r in state.collect()] == [("a", False)]
    toggled = stores.toggled(state, spark.createDataFrame([("a",)], "id string"), "id", F.lit(9)).first()
    assert (toggled.enabled, toggled.op, toggled.version) == (True, "update", 9)
    requests = spark.createDataFrame([("r1", "pending", None), ("r2", "approved", None)], "request_id string, status string, note string")
    decisions = spark.createDataFrame([(1, "r1", "approve", "me", "ok"), (2, "r1", "reject", "you", "no"), (3, "r2", "reject", "me", "no")], "seq int, request_id string, action string, resolver string, note string")
    assert {(r.request_id, r.status, r.resolved_by) for r in stores.resolved(requests, decisions).collect()} == {("r1", "approved", "me"), ("r2", "approved", None)}
    kept, gone = stores.retained(spark.createDataFrame([(k, k % 3) for k in range(10)], "record_id int, written int"), 4)
    assert sorted(r.record_id for r in kept.collect()) == [2, 5, 7, 8] and gone.count() == 6
    assert stores.all_unique(spark.createDataFrame([("a",), ("",), ("",), ("b",)], "c string"), "c").first().ok
    rules = spark.createDataFrame([("case", "", True), ("org", "X", True), ("org", "Y", True), ("prof", "", False)], "source string, journal string, enabled boolean")
    assert stores.enabled_rules(rules, "X").count() == 2 and stores.enabled_rules(rules).count() == 1
    assert {r.place for r in stores.routed_rules(rules, "X").collect()} == {"specific", "common"}
    assert stores.scoped(spark.createDataFrame([("X",), ("Y",)], "org string"), "X").count() == 1


def test_rule_inserts(spark):
    stored = spark.createDataFrame([("case", "", "Use  commas")], "source string, journal string, rule string")
    incoming = spark.createDataFrame([(1, "case", "", "Use commas", ["book"]), (2, "org", "X", "Use commas", ["book", "odd"]), (3, "org", "X", "Usecommas", []), (4, "case", "", "abc", [])], "seq int, source string, journal string, rule string, types array<string>")
    added, skipped = stores.new_rules(stored, incoming.withColumn("topic", F.lit("")))
    assert [(r.seq, r.topic, r.types) for r in added.collect()] == [(2, "일반", ["book"])] and sorted(r.seq for r in skipped.collect()) == [1, 3, 4]


def test_json_stores(spark, tmp_path):
    assert stores.json_store(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert stores.json_store(spark, f"{tmp_path}/a.json", "a int").count() == 2
    assert stores.record_folder(spark, f"{tmp_path}/a.json", "a int").columns == ["a", "written"]


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/"), content)
    return bytearray(out.getvalue())


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive(**{"word__document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"})
    part = lambda t: f'<s xmlns:hp="h"><hp:p><hp:run><hp:t>{t}<hp:x/>!</hp:t></hp:run></hp:p></s>'
    hwpx = archive(**{"Contents__section10.xml": part("ten"), "Contents__section2.xml": part("two")})
    rows = {"a.docx": docx, "b.hwpx": hwpx, "c.hwp": hwpx, "d.txt": bytearray("한글".encode("cp949")), "e.txt": bytearray(b"\xef\xbb\xbfx"), "f.pdf": bytearray(b"%PDF"), "g.docx": bytearray(b"no zip"), "h.hwp": bytearray(bytes.fromhex("D0CF11E0A1B11AE1")), "i.odt": bytearray(b"x"), "~$j.txt": bytearray(b"x")}
    files = spark.createDataFrame([(k, len(v), v) for k, v in rows.items()] + [("big.txt", 11 << 20, bytearray(b"x"))], "path string, length long, content binary")
    found = {r.path: (r.text, r.error is not None) for r in documents.texts(files).collect()}
    assert found["a.docx"] == ("One two\nThree", False) and found["b.hwpx"] == found["c.hwp"] == ("ten!\ntwo!", False)
    assert found["d.txt"] == ("한글", False) and found["e.txt"] == ("x", False)
    assert all(found[k] == (None, True) for k in ("f.pdf", "g.docx", "h.hwp", "i.odt", "big.txt"))
    for name, content in rows.items():
        (tmp_path / name).write_bytes(content)
    assert documents.folder(spark, str(tmp_path)).count() == 8
    flags = spark.createDataFrame([(bytearray(36) + bytearray([6, 0, 0, 0]),)], "h binary").select(documents.header_flags(F.col("h")).alias("f")).first().f
    assert flags.encrypted and flags.distribution


def test_pages(spark):
    page = '<html><head><title>Plain\n title</title><meta name="citation_title" content="Real title"><meta content="10.1000/x" name="citation_doi"><meta name="citation_author" content="A, B"><meta name="citation_author" content="C, D"><meta name="citation_firstpage" content="1"><meta name="citation_lastpage" content="9"><meta name="citation_date" content="2019/05"></head><body><script>var x="<p>";</script><p>Hi&nbsp;you</p><br/>there</body></html>'
    found = html.page_record(spark.createDataFrame([(page,), ("<title>한글 쪽</title>",), (None,)], "html string")).collect()
    assert (found[0].title, found[0].doi, found[0].authors, found[0].pages, found[0].year, found[0].type) == ("Real title", "10.1000/x", ["A, B", "C, D"], "1-9", "2019", "journal")
    assert (found[1].title, found[1].lang, found[1].type) == ("한글 쪽", "ko", "web") and found[2].title == ""
    assert spark.createDataFrame([(page,)], "h string").select(html.page_text(F.col("h"))).first()[0].splitlines()[-1].strip() == "there"


def test_xml_and_json_records(spark):
    refs = '<r><referenceInfo><reference type-code="01"><title>글</title><author>홍길동</author><pubi-year>2019년</pubi-year><journal-name>학회지</journal-name><page>1-2</page></reference><reference type-code="07"><title>도서관법. 법률 제1호</title></reference><reference type-code="03"><title> </title></reference></referenceInfo></r>'
    found = records.references(spark.createDataFrame([(1, refs), (2, None)], "id int, xml string")).orderBy("pos").collect()
    assert [(r.type, r.lang, r.year, r.authors) for r in found] == [("journal", "ko", "2019", ["홍길동"]), ("law", "ko", "", [])]
    library = "<x><recode><item><name>논문명</name><value>제목 = Title /저자</value></item><item><name>학위년도</name><value>2014</value></item><item><name>발행자</name><value>대학&lt;b&gt;교&lt;/b&gt;</value></item></recode></x>"
    one = records.library_records(spark.createDataFrame([(library,)], "xml string")).first()
    assert (one.title, one.year, one.publisher) == ("제목", "2014", "대학교")
    books = spark.createDataFrame([('{"docs":[{"TITLE":"책 (개정판): 부제","PUBLISHER":"P","PUBLISH_PREDATE":"20200101","EA_ISBN":"1","AUTHOR":"A(B)"}]}',), ('{"RESULT":"ERROR","ERR_MESSAGE":"key"}',)], "json string")
    found = records.books(books).collect()
    assert (found[0].title, found[0].year, found[0].authors, found[0].unavailable) == ("책", "2020", ["A"], False) and found[1].unavailable
    assert spark.createDataFrame([("정보서비스론: 이론과 실제",)], "t string").select(records.shortened_titles(F.col("t"))).first()[0][:2] == ["정보서비스론: 이론과 실제", "정보서비스론"]
    messages = spark.createDataFrame([("<r><resultMsg>인증키 오류</resultMsg></r>",), ("<r><resultMsg>no data</resultMsg></r>",), (None,)], "x string")
    assert [r[0] for r in messages.select(records.failed_answer(F.col("x"))).collect()] == [True, False, False]
    texts = spark.createDataFrame([(1, "<a><reference>A long reference text</reference><reference>short</reference><reference>A long reference text</reference></a>")], "id int, xml string")
    assert [r.text for r in records.reference_texts(texts).collect()] == ["A long reference text"]


def test_exports(spark, tmp_path):
    schema = "doc_id int, position int, type string, authors array<string>, year string, title string, container string, volume string, issue string, pages string, publisher string, place string, institution string, degree string, doi string, url string, formatted string, group string"
    rows = [(1, 1, "thesis", ["Doe, J"], "2001a", "A_b & {c}", "", "", "", "", "", "", "U", "Master's thesis", "", "http://a{b}", "one", "g"), (1, 2, "report", ["R"], "n.d.", "T", "C", "", "", "5", "P", "L", "", "Master", "", "", "two", "g")]
    items = spark.createDataFrame(rows, schema)
    ris = [r.ris for r in exports.ris(items).orderBy("position").collect()]
    assert ris[0].splitlines() == ["TY  - THES", "AU  - Doe, J", "PY  - 2001", "TI  - A_b & {c}", "PB  - U", "M3  - Master's thesis", "UR  - http://a{b}", "ER  - "]
    assert "SP  - 5" in ris[1] and "CY  - L" in ris[1] and "PY" not in ris[1]
    bib = [r.bibtex for r in exports.bibtex(items).orderBy("position").collect()]
    assert bib[0].startswith("@mastersthesis{ref1,\n  author = {Doe, J},\n  title = {A\\_b \\& \\{c\\}},") and "url = {http://ab}" in bib[0] and bib[1].startswith("@mastersthesis{ref2")
    assert exports.listing(items).first().text == "[g]\none\ntwo"
    history = spark.createDataFrame([(1, "t", "f", "u", "o", "s", 2)], "doc_id int, time string, filename string, user string, org string, style_name string, total int")
    assert exports.archive_rows(history, items).first().refs == "[g]\none\ntwo"
    exports.write_lines(exports.ris(items), "ris", f"{tmp_path}/ris")
    exports.write_csv(items.select("doc_id", "title"), f"{tmp_path}/csv")
    exports.append_rows(items.select("doc_id", "title"), f"{tmp_path}/log")
    exports.append_rows(items.select("doc_id", "title"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4 and spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_stages_fall_back_to_rules(spark):
    sections = spark.createDataFrame([(1, "Adams, A. (1999). On lists. Journal of Lists, 12(3), 45-67.\nBaker, B. (2001). More. London: Press."), (2, "Cole, C. (2003). Fewer lists. Paris: Press.")], "doc_id long, section string")

    def split(frame):
        if frame["doc_id"].iloc[0] == 2:
            raise RuntimeError("refused")
        return frame.assign(entries=[["A first entry of some length", "x", "A second entry of some length"]])[["doc_id", "entries"]]

    assert [r.raw[:8] for r in stages.entries(sections, split).orderBy("doc_id", "seq").collect()] == ["A first ", "A second", "Cole, C."]
    raws = stages.entries(sections)

    def fields(frame):
        kept = frame[frame["raw"].str.startswith("Adams")]
        return kept.assign(type="book_chapter", title="New title", container=None, year=None, authors=None)[["doc_id", "seq", "type", "title", "container", "year", "authors"]]

    found = {r.raw[:5]: r for r in stages.structured(raws, fields).collect()}
    assert (found["Adams"].type, found["Adams"].title, found["Adams"].year) == ("book", "New title", "1999") and "no answer for this entry" in found["Baker"].notes
    assert stages.structured(raws).count() == 3
    items = raws.select("doc_id", "seq", F.col("raw").alias("formatted"))
    assert stages.changed_lines(items).count() == 3
    entries = raws.withColumns({"lang": F.lit("ko"), "title": F.lit("t"), "style_id": F.lit("s")})
    assert stages.english_titles(entries, entries.limit(1).withColumn("title_en", F.lit("T"))).count() == 1
    assert stages.custom_style(entries, entries).where("error IS NOT NULL").count() == 3
    assert {r.pattern for r in stages.mined_rules(raws.withColumn("journal", F.lit("J"))).collect()} == {"year in parentheses with period"}


def test_articles_parse_each_record_once_for_all_texts(spark):
    xml = (
        "<r><record><articleInfo article-id='A1'><article-title lang='original'> 가나 &amp; <b>다</b> </article-title><article-title lang='english'>Other</article-title><journalName>J</journalName>"
        "<pub-year>2001.05</pub-year><volume/><lpage>9</lpage><doi>https://doi.org/10.1/x</doi><author english='Kim'>김 <name>x</name></author><author> </author></articleInfo></record>"
        "<record><title>T2</title><issue-date>19990101</issue-date></record></r>"
    )
    found = records.articles(spark.createDataFrame([(1, xml), (2, None)], "k int, xml string"))
    rows = {r.pos: r for r in found.collect()}
    assert [rows[0][c] for c in ("title", "container", "year", "volume", "pages", "doi", "title_en", "record_id", "authors", "authors_en")] == ["가나 & 다", "J", "2001", "", "9", "10.1/x", "Other", "A1", ["김"], ["Kim"]]
    assert [rows[1][c] for c in ("title", "year", "record_id", "authors", "authors_en")] == ["T2", "1999", "", [], []]
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("xpath_string") + plan.count("xpathstringevaluator") == 1


def test_parts_grow_with_the_entries(spark, tmp_path, monkeypatch):
    from refloom.plans import bibliography, typed

    tables = "/root/testdata/sf0.001"
    if not os.path.exists(tables):
        pytest.skip("the driver's tables are not here")

    monkeypatch.setattr(bibliography, "TASK_ROWS", 100)
    for rows in (bibliography.bibliography(spark, tables), typed.typed(spark, tables)):
        assert rows.rdd.getNumPartitions() == 15
