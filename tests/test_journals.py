"""Journals of a list by likeness, against a brute-force comparison of all names."""

import difflib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from refloom.functions.text import hangul_key, title_key
from refloom.plans import bibliography, queries, served
from refloom.plans.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")


def test_similar_journals_agree_with_brute_force(spark, tmp_path):
    tables = {
        "nation": ([(k,) for k in range(12)], "n_nationkey long"),
        "customer": ([(k, k) for k in range(12)], "c_custkey long, c_nationkey long"),
        "orders": ([(k, k % 12) for k in range(36)], "o_orderkey long, o_custkey long"),
        "part": ([(k, f"part {k}") for k in range(5)], "p_partkey long, p_name string"),
    }
    for name, (rows, schema) in tables.items():
        frame = spark.createDataFrame(rows, schema)
        frame = frame.selectExpr("*", "DATE'1995-01-01' AS o_orderdate") if name == "orders" else frame
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    names = bibliography.bibliography(spark, str(tmp_path)).select("container", title_key("container").alias("key")).distinct().collect()
    listed = [r.key for r in names if r.container[13:-8] in {"".join("abcdefghij"[int(d)] for d in str(k)) for k in range(0, 12, 2)}]
    expected = {r.container for r in names if any(difflib.SequenceMatcher(None, r.key, k).ratio() >= 0.90 for k in listed)}
    found = [r.container for r in QUERIES["similar_journals"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
    assert set(r.container for r in QUERIES["listed_journals"](spark, str(tmp_path)).collect()) < expected


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
def test_similar_titles_agree_with_brute_force(spark):
    names, listing = served._page_names(spark, str(TABLES))
    names = [r.container for r in names.where("length(container) >= 3").distinct().collect()]
    keys = {r.t: r.k for part in (names, [r.title for r in listing.collect()]) for r in spark.createDataFrame([(x,) for x in part], "t string").select("t", title_key(F.col("t")).alias("k")).collect()}
    listed = [r.title for r in listing.distinct().collect()]
    solid = lambda t: "".join(t.lower().split())
    alike = lambda a, b: keys[a] == keys[b] or difflib.SequenceMatcher(None, *((keys[a], keys[b]) if keys[a] and keys[b] else (solid(a), solid(b)))).ratio() >= 0.90
    expected = {n for n in names if any(alike(n, t) for t in listed)}
    found = [r.container for r in QUERIES["similar_titles"](spark, str(TABLES)).collect()]
    assert sorted(found) == sorted(expected) and len(expected) > 20


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
def test_duplicate_entries_agree_with_all_pairs(spark):
    """The registered query over its whole smallest table."""
    rows = [(r.doc_id, r.seq, r.doi, r.key) for r in queries._shared_dois(spark, str(TABLES)).select("doc_id", "seq", "doi", hangul_key(F.col("title")).alias("key")).collect()]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    expected = {}
    for doc, own in by.items():
        own.sort(key=lambda r: r[1])
        for k, (_, i, doi, x) in enumerate(own):
            for _, j, other, y in own[k + 1 :]:
                if doi and doi == other:
                    expected[doc, i, j] = "doi"
                elif x and y and difflib.SequenceMatcher(None, x, y).ratio() >= 0.92:
                    expected[doc, i, j] = "title"
    found = [(r.doc_id, r.seq_a, r.seq_b, r.reason) for r in QUERIES["duplicate_entries"](spark, str(TABLES)).collect()]
    assert {r[:3]: r[3] for r in found} == expected and len(found) == len(expected)


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
def test_similar_titles_read_each_page_once(spark, monkeypatch):
    read, table = spark.sparkContext.accumulator(0), served.table

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(served, "table", lambda *a: (rows := table(*a)).mapInArrow(counted, rows.schema))
    assert QUERIES["similar_titles"](spark, str(TABLES)).count() > 20
    assert read.value == table(spark, str(TABLES), "pages").count()
