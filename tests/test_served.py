"""Names in texts, parts of long sections, guarded stores, levels of use, answers that are damaged."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from refloom.operators import align, citations, reports, segment, stages, stores
from refloom.sources import records


@pytest.mark.parametrize("most", [50_000, 2])
def test_names_in_texts(spark, monkeypatch, most):
    """Names inside words, names that hold each other, upper and lower case, Hangul, null and empty texts; lists longer than an automaton."""
    monkeypatch.setattr(citations, "NAMES", most)
    bodies = [(1, "As Wagner said, 김철수(2001) and O'Neil agree. WA"), (2, None), (3, ""), (4, "nothing here"), (5, "İstanbul ÉCOLE")]
    names = [(1, n) for n in ("Wagner", "wagner", "Wag", "agn", "김철수", "철수", "o'neil", "Zork", "", "wa")] + [(2, "a"), (3, "a"), (4, "here"), (4, "HERE"), (5, "école"), (6, "lost")]
    found = citations.names_in(spark.createDataFrame(bodies, "doc_id int, body string"), spark.createDataFrame([*names, names[0]], "doc_id int, name string"))
    texts = {d: b or "" for d, b in bodies}
    expected = {(d, n) for d, n in names if n and d in texts and (n in texts[d] or n in texts[d].lower())}
    rows = found.collect()
    assert {(r.doc_id, r.name) for r in rows} == expected and len(rows) == len(expected)


def test_one_copy_of_a_text_in_the_plan(spark):
    """Names are gathered before they meet a text, so the plan joins one row with each."""
    bodies, names = spark.createDataFrame([(1, "x")], "doc_id int, body string"), spark.createDataFrame([(1, "x")], "doc_id int, name string")
    plan = citations.names_in(bodies, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_set") and plan.count("Join") == 1


def test_long_sections_go_in_parts(spark, monkeypatch):
    """Parts end where an entry ends; a part without an answer keeps the rules' entries; nothing is lost."""
    monkeypatch.setattr(stages, "LONGEST_SECTION", 400)
    lines = [f"[{k}] Waa, B. (19{k % 90 + 10}). On lists of kind {k}. List Journal, {k}(1), 1-9." for k in range(1, 31)]
    sections = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:2])), (3, "\n".join(lines[:3]))], "doc_id long, section string")
    seen = []

    def service(frame):
        assert frame["section"].str.len().max() <= 400
        if "kind 12." in frame["section"].iloc[0] or frame["doc_id"].iloc[0] == 3:
            raise ValueError("busy")
        return pd.DataFrame({"doc_id": frame["doc_id"], "entries": [["told: " + x for x in frame["section"].iloc[0].split("\n")]]})

    ruled = {(r.doc_id, r.seq): r.raw for r in segment.entries(sections).collect()}
    found = sorted((r.doc_id, r.seq, r.raw) for r in stages.entries(sections, service).collect())
    assert [(d, s) for d, s, _ in found] == sorted(ruled) and seen == []
    assert all(raw.removeprefix("told: ").endswith(ruled[d, s][-40:]) for d, s, raw in found)
    told = [raw.startswith("told: ") for d, _, raw in found if d == 1]
    assert any(told) and not all(told) and not any(raw.startswith("told") for d, _, raw in found if d == 3)


LOG = "k string, version long, op string, value string"


def test_two_writers_one_is_rejected(spark):
    log = spark.createDataFrame([("a", 1, "insert", "x"), ("a", 2, "update", "y"), ("b", 1, "insert", "z")], LOG)
    changes = spark.createDataFrame([("a", 2, "w1", "update", "p"), ("a", 2, "w2", "update", "q"), ("b", 0, "w1", "update", "r"), ("c", None, "w1", "insert", "s"), ("c", None, "w2", "insert", "t"), ("b", None, "w3", "update", "u")], "k string, expected long, writer string, op string, value string")
    appended, rejected = stores.accepted(log, changes, "k", "version")
    assert sorted((r.k, r.version, r.value) for r in appended.collect()) == [("a", 3, "p"), ("c", 1, "s")]
    assert sorted((r.k, r.writer) for r in rejected.collect()) == [("a", "w2"), ("b", "w1"), ("b", "w3"), ("c", "w2")]
    after = log.unionByName(appended)
    assert {(r.k, r.value) for r in stores.latest(after, "k", "version").collect()} == {("a", "p"), ("b", "z"), ("c", "s")}
    assert {(r.k, r.value) for r in stores.latest(after, "k", "version", as_of=1).collect()} == {("a", "x"), ("b", "z"), ("c", "s")}


def test_compaction_keeps_every_later_state(spark):
    rows = [(f"k{i % 5}", v, "delete" if (i + v) % 4 == 0 else "update", f"{i}.{v}") for i in range(5) for v in range(1, 9)]
    log = spark.createDataFrame(rows, LOG)
    short = stores.compacted(log, "k", "version", 5)
    assert short.count() < log.count()
    for version in (5, 6, 8, None):
        assert sorted(stores.latest(short, "k", "version", version).collect()) == sorted(stores.latest(log, "k", "version", version).collect())


def test_equal_versions_don_t_depend_on_the_order_of_rows(spark):
    rows = [("a", 1, "update", "x"), ("a", 1, "update", "y"), ("b", 1, "update", "x"), ("b", 1, "delete", "")]
    for order in (rows, rows[::-1]):
        assert [tuple(r) for r in stores.latest(spark.createDataFrame(order, LOG), "k", "version").collect()] == [("a", 1, "y")]


def test_bulk_deletion_in_scope(spark, monkeypatch):
    monkeypatch.setattr(stores, "MOST_DELETED", 3)
    state = spark.createDataFrame([(f"k{i}", 1, "v", "own" if i % 2 else "other") for i in range(10)], "k string, version int, value string, org string")
    ids = spark.createDataFrame([(f"k{i}", i) for i in (1, 3, 3, 2, 5, 7)], "k string, seq int")
    gone = stores.bulk_deleted(state, ids, "k", F.lit(2), "own").collect()
    assert {(r.k, r.op, r.version) for r in gone} == {("k1", "delete", 2), ("k3", "delete", 2)}  # k2 is another's, k5 is the fourth


def test_prices_of_equal_rows(spark):
    """Rows that are equal are each priced; a day takes the latest rate that holds; unknown models and null days have no price."""
    log = spark.createDataFrame([("2020-01-01", "m", 10, 0, 0, 0)] * 2 + [("2020-02-01", "m", 10, 0, 0, 0), ("2020-01-01", "n", 1, 1, 1, 1), (None, "m", 1, 0, 0, 0)], "date string, model string, input long, output long, cache_read long, cache_write long")
    prices = spark.createDataFrame([("m", None, None, 1.0, 1.0), ("m", "2020-01-15", None, 2.0, 1.0)], "model string, since string, until string, input_rate double, output_rate double")
    assert sorted((str(r.date), r.model, r.usd) for r in reports.priced(log, prices).collect() if r.usd is not None) == [("2020-01-01", "m", 1e-5), ("2020-01-01", "m", 1e-5), ("2020-02-01", "m", 2e-5), ("None", "m", 1e-6)]


def test_levels_can_be_merged(spark):
    rows = [(f"2020-{m:02d}-0{d} 10:00", "" if m == 1 else "org", str(u), 1, 2) for m in (1, 2) for d in (1, 2) for u in range(50 * m)] + [("2020", "org", "", 1, 1)]
    usage = spark.createDataFrame(rows, "time string, org string, user string, files long, refs long")
    whole = {(r.level, r.period, r.org): r for r in reports.usage_levels(usage).collect()}
    parts = reports.merged_levels(*(reports.usage_levels(usage.where(w)) for w in ("files = 1 AND user < '3'", "NOT user < '3'")))
    for r in parts.collect():
        w = whole[r.level, r.period, r.org]
        assert (r.uses, r.files, r.refs) == (w.uses, w.files, w.refs) and abs(r.users_estimate - w.users) <= 0.05 * w.users
    assert whole["all", None, None].users == 100 and ("month", "2020", None) not in whole


def test_damaged_answers(spark):
    """Broken JSON, other shapes, null answers: empty fields and a mark, no failed job."""
    answers = ['{"message": {"title": ["a', None, "", "[]", '{"message": 5}', '{"message": {"title": "no list", "issued": {"date-parts": [[null]]}, "author": [1, {"family": "W"}], "page": 7}}']
    frame = spark.createDataFrame(list(enumerate(answers)), "n int, json string")
    found = {r.n: r for r in records.known_work(frame, "crossref").collect()}
    assert len(found) == 6 and [found[n].unavailable for n in range(6)] == [True, True, True, False, False, False]
    print({n: (r.title, r.year, r.authors) for n, r in found.items()})
    assert all(r.year == "" for r in found.values()) and all(r.title == "" and r.authors == [] for n, r in found.items() if n < 5) and found[5].pages == "7"
    for service in records.SERVICES:
        assert records.found_works(frame, service).count() == 0
    many = '{"message": {"author": [' + ", ".join('{"family": "F%d"}' % k for k in range(40)) + "]}}"
    assert len(records.known_work(spark.createDataFrame([(1, many)], "n int, json string"), "crossref").first().authors) == 30


def test_forms_of_references(spark):
    raws = ["Waa, B. (1990a). On lists - again. List Journal, 12(3), 4-5. https://doi.org/10.1/x", "김철수 (2001). 목록의 형식. 목록학회지, 3.", "Number 12345 of 1899 and 2100."]
    found = [r.f for r in spark.createDataFrame([(x,) for x in raws], "raw string").select(stages.form(F.col("raw")).alias("f")).collect()]
    assert found == ["<words>, <words>. (<year>). <words>. <words>, <n>(<n>), <n>-<n>. <link>", "<words> (<year>). <words>. <words>, <n>.", "<words> <n> <words> <year> <words> <n>."]
    forms = stages.mined_forms(spark.createDataFrame([("j", raws[1])] * 3 + [("j", raws[2]), ("k", raws[2])], "journal string, raw string"))
    assert [(r.journal, r.n, r.share) for r in forms.collect()] == [("j", 3, 0.75)]


def test_repeated_changes(spark):
    """Steps that lines of several lists take: what kind they are, how often, in how many lists."""
    items, lines = [], []
    for doc in range(3):
        for k in range(4):
            title = "".join(chr(97 + (doc * 7 + k * 5 + j) % 26) for j in range(30))
            items.append((doc, k, "", f"Waa. {title}, 19{k}0: x", "", ""))
            lines.append((doc, k, f"Waa. {title}; 19{k}0: x" if k else f"Waa. {title}, 19{k}0: X"))
    aligned = align.align(spark.createDataFrame(items, "doc_id long, seq long, raw string, formatted string, title string, doi string"), spark.createDataFrame(lines, "doc_id long, pos long, text string"))
    found = {(r.kind, r.a, r.b): (r.n, r.lists) for r in align.repeated_changes(aligned).collect()}
    assert found == {("punctuation", ",", ";"): (9, 3), ("case", "x", "X"): (3, 3)}
    kinds = spark.createDataFrame([("a b", "ab"), ("12", "13"), ("volume", "vol."), ("", "-")], "a string, b string").select(align.change_kind(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.k for r in kinds] == ["spacing", "number", "wording", "punctuation"]


def test_settings_with_errors_change_nothing(spark):
    maps = "access_codes map<string,string>, editor_codes map<string,string>, chair_codes map<string,string>"
    current = spark.createDataFrame([(k, "m", "common", 5.0, 1300.0, {"A": "1"}, {"A": "2"}, {}) for k in range(6)], f"id int, model string, access_code string, monthly_budget_usd double, usd_krw double, {maps}")
    rows = [
        (0, "", "0", "n", None, None, None, None, None, None),  # nothing sent but the model
        (1, "key", "0", "?", "", "", "1,200", '{" B ": " 9 ", "C": ""}', None, None),
        (2, "key", "1", "m", None, "-3", None, None, "{}", None),
        (3, "key", "1", "m", "2", None, None, None, None, None),  # the common code is an editor's
        (4, "key", "0", "m", None, "NaN", None, None, None, None),
        (5, "key", "0", "m", None, None, None, '{"a": ', None, None),
    ]
    changes = spark.createDataFrame(rows, "id int, api_key string, clear string, model string, access_code string, monthly_budget_usd string, usd_krw string, access_codes string, editor_codes string, chair_codes string")
    found = {r.id: r for r in stores.saved_settings(current, changes, ["m", "n"]).collect()}
    assert (found[0].model, found[0].access_code, found[0].key, found[0].error) == ("n", "common", "kept", None)
    assert (found[1].model, found[1].access_code, found[1].monthly_budget_usd, found[1].usd_krw, found[1].access_codes, found[1].key) == ("m", "", None, 1200.0, {"B": "9"}, "set")
    assert (found[2].monthly_budget_usd, found[2].editor_codes, found[2].key) == (0.0, {}, "cleared")
    for k, error in ((3, "two codes are equal"), (4, "a budget or a rate is a number"), (5, "codes are an object of names and codes")):
        assert found[k].error == error and found[k].key == "kept" and found[k].access_code == "common" and found[k].monthly_budget_usd == 5.0


def test_rules_are_applied_by_place(spark):
    """Sparse answers, places that are not there, several for one place, empty ones, a batch that fails; what is not named stays letter for letter."""
    items = spark.createDataFrame([(1, k, f"entry {k}") for k in range(30)], "doc_id long, seq long, formatted string").coalesce(1)
    standards = spark.createDataFrame([(2, "second", None), (1, "first", "as here")], "seq int, rule string, example string")
    directives = spark.createDataFrame([(1, "always")], "seq int, rule string")

    def service(frame, own, other):
        assert own == "- first (예: as here)\n- second" and other == "- always" and frame["index"].tolist() == list(range(len(frame)))
        if "entry 24" in frame["reference"].tolist():
            raise ValueError("busy")
        return pd.DataFrame({"index": [1, 1, 3, 5, 99, -1], "formatted": ["lost", "new", "", None, "x", "y"], "note": ["a", "b", "c", None, "", ""], "conflict": [None, "", "with the standard", "", "", ""]})

    found = {r.seq: (r.formatted, r.note, r.conflict) for r in stages.applied_rules(items, standards, directives, service).collect()}
    for k in range(30):
        place = k % 12
        expected = (f"entry {k}", "", "") if k >= 24 or place not in (1, 3) else ("new", "b", "") if place == 1 else (f"entry {k}", "c", "with the standard")
        assert found[k] == expected
    none = standards.limit(0)
    assert {(r.note, r.conflict) for r in stages.applied_rules(items, none, none, service).collect()} == {("", "")} and stages.applied_rules(items, standards, directives).count() == 30
