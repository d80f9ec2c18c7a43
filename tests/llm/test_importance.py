import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from refloom.llm import importance
from refloom.llm.common import spread_join
from refloom.llm.queries import IMPORTANCE_SQL


def plain(rows, target, percent=10, least_words=20, longest=1, buckets=10_000):
    """The drawing by plain loops: rows (id, text) -> sorted (id, n_words, n_features, weight, score, rank)."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(map(bucket, features(text)[1]))
    for text in target:
        wanted.update(map(bucket, features(text)[1]))
    s, t = source.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    good = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(good[: len(good) * percent // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return ["The passage of a test", None, "", "ABC déf 1a2", "The test 漢字"]


@pytest.mark.parametrize("settings", [{}, {"percent": 60, "least_words": 1, "longest": 3, "buckets": 50}])
def test_drawing_equals_plain_loops(spark, docs, texts, target, settings):
    """Null and empty texts, null ids, repeated rows, extra columns with clashing names."""
    aimed = spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "item_id int, text string, bucket int")
    assert rows_of(importance.resample(docs, aimed, **settings)) == plain(texts, target, **settings)


def test_empty_tables(spark, docs, no_docs, texts):
    assert rows_of(importance.resample(no_docs, docs)) == []
    assert rows_of(importance.resample(docs, no_docs, percent=50)) == plain(texts, [], percent=50)


def test_hot_words_one_huge_text_and_ties(spark):
    """One word makes up most rows, one text is longer than a slice, one is a single huge word; equal scores go to the smaller id."""
    rows = [(k, "the " * 30 + f"w{k}") for k in range(40)] + [(100, "Long wörd " * 500_000), (101, "x" * 3_000_000), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("the w1 w2",)], "text string")
    assert rows_of(importance.resample(docs, target, percent=50)) == plain(rows, ["the w1 w2"], percent=50)


def test_words_follow_their_definition(spark):
    text = "Ab-cD_ÉÀ\x7f\x00naïve①9z`{|}~ x İ"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows_of(importance.resample(docs, docs)) == plain([(1, text)], [text])


def test_spread_join_equals_a_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "key long, n long")
    facts = rows.groupBy("key").count().where("key <> 5").withColumn("fact", F.col("key") * 2)
    for hot in (1, 4, 1000):
        for how in ("inner", "left"):
            got = spread_join(rows, facts, ["key"], "count", 300, how, hot)
            assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(facts.drop("count"), ["key"], how).collect()))


def test_oracle_over_awkward_rows(spark, texts):
    """The SQL that the driver compares with, on a small table with one row an id."""
    rows = {i: t for i, t in texts if i is not None}
    documents = pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())})
    benchmark = pd.DataFrame({"text": ["The test of passages", "déjà vu 漢字"]})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    got = importance.resample(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), spark.createDataFrame(benchmark))
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({IMPORTANCE_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
