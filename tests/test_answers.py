"""Damaged and odd answers, own styles, remembered answers."""

from pyspark.sql import functions as F

from refloom.operators import stores
from refloom.sources import records


def test_damaged_references_are_left_out(spark):
    rows = [
        (1, '<a><reference type-code="01"><title>One <i>of</i> two</title><page>1-2</page></reference></a>'),
        (2, "<a><reference><title>Open <b>tag</title></reference></a>"),
        (3, "<a><reference><title>No code &amp; no year</title></reference><reference></reference></a>"),
        (4, None),
        (5, ""),
    ]
    found = records.references(spark.createDataFrame(rows, "id int, xml string")).collect()
    assert {(r.id, r.title, r.type, r.pages) for r in found} == {(1, "One of two", "journal", "1-2"), (3, "No code & no year", "unknown", "")}


def test_library_records_without_items(spark):
    rows = [(1, "<r><recode></recode><recode><item><name>서명</name></item></recode></r>"), (2, "<r><recode><item><name>서명</name><value>A</recode></r>"), (3, None)]
    found = records.library_records(spark.createDataFrame(rows, "id int, xml string")).collect()
    assert sorted((r.id, r.pos, r.title, r.publisher) for r in found) == [(1, 0, "", ""), (1, 1, "", ""), (2, 0, "", "")]


def test_styles_of_files_and_texts(spark):
    rows = [("A", "x" * 50_000, "typed", None), ("A", "x" * 50_000, "typed", None), ("B", "x" * 99, "typed", None), (None, None, "file", "can't be read"), ("", "y" * 100, "typed", "")]
    found = stores.styles(spark.createDataFrame(rows, "name string, text string, source string, error string")).collect()
    assert [len(r.text) for r in found] == [40_000, 40_000, 99, 0, 100]
    assert found[0].style_id == found[1].style_id != found[4].style_id and found[4].name == "이름 없는 기준"
    assert [r.error for r in found] == [None, None, "a style needs 100 characters or more", "can't be read", None]


def test_each_missing_key_is_asked_for_once(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",), (None,)], "key string")
    cache = spark.createDataFrame([("b", None), ("z", "kept")], "key string, answer string")
    asked = []

    def ask(keys):
        asked.extend(sorted(r.key for r in keys.collect()))
        return keys.select("key", F.when(F.col("key") == "a", "found").alias("answer"), F.when(F.col("key") == "c", True).alias("failed"))

    answered, after = stores.remembered(rows, "key", cache, ask)
    assert asked == ["a", "c"]
    assert sorted((r.key or "", r.answer, r.failed) for r in answered.collect()) == [("", None, None), ("a", "found", False), ("a", "found", False), ("b", None, False), ("c", None, True), ("c", None, True)]
    assert {(r.key, r.answer) for r in after.collect()} == {("a", "found"), ("b", None), ("z", "kept")}
