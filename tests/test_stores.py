"""Records in files of their own, rolling totals, progress."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from refloom.plans import manuscripts
from refloom.sources import record_files
from refloom.streaming import progress, upserts


@pytest.fixture
def source(spark):
    spark.dataSource.register(record_files.RecordFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def records(spark, path):
    return spark.read.format("records").option("path", str(path)).load()


def test_records_round_trip(source, tmp_path):
    rows = [(f"h_{k}", json.dumps({"id": k, "name": "김 é", "n": [1, {"a": None}]}, ensure_ascii=False)) for k in range(30)]
    source.createDataFrame(rows, "id string, record string").repartition(4).write.format("records").mode("append").option("path", str(tmp_path / "r")).save()
    assert sorted((r.id, r.record) for r in records(source, tmp_path / "r").collect()) == sorted(rows)
    source.createDataFrame([("h_1", '{"id": "new"}')], "id string, record string").write.format("records").mode("append").option("path", str(tmp_path / "r")).save()
    assert records(source, tmp_path / "r").where("id = 'h_1'").first().record == '{"id": "new"}' and len(os.listdir(tmp_path / "r")) == 30
    (tmp_path / "r" / "damaged.json").write_text('{"a": ')
    (tmp_path / "r" / "other.txt").write_text("x")
    assert records(source, tmp_path / "r").count() == 30 and records(source, tmp_path / "none").count() == 0


def test_a_failed_task_leaves_no_file(source, tmp_path):
    rows = [(f"h_{k}", "{}") for k in range(20)] + [("h_bad", "no json")]
    with pytest.raises(Exception, match="(?s)JSON|Expecting"):
        source.createDataFrame(rows, "id string, record string").repartition(3).write.format("records").mode("append").option("path", str(tmp_path / "r")).save()
    assert [n for n in os.listdir(tmp_path / "r") if not n.startswith(".")] == []


def test_time_bounds_are_tested_on_the_listing(source, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    for k in range(6):
        (folder / f"h_{k}.json").write_text("{}")
        os.utime(folder / f"h_{k}.json", (1_700_000_000 + k * 1000,) * 2)
    bound = F.timestamp_seconds(F.lit(1_700_003_000))
    found = records(source, folder).where(F.col("written") >= bound)
    assert sorted(r.id for r in found.collect()) == ["h_3", "h_4", "h_5"]
    reader = record_files.RecordReader(str(folder))
    left = list(reader.pushFilters([record_files.GreaterThanOrEqual(("written",), record_files.utc("2023-11-14T23:03:20")), record_files.EqualTo(("id",), "h_4")]))
    assert left == [record_files.EqualTo(("id",), "h_4")] and [len(p.names) for p in reader.partitions()] == [3]


def test_patches(spark):
    rows = [("a", '{"x":1,"y":{"z":[1,2]}}'), ("b", '{"x":1}'), ("c", "damaged"), ("d", None)]
    patches = [("a", '{"x":"new","w":null}'), ("c", '{"x":2}'), ("b", "[]"), ("e", "{}")]
    found = record_files.patched(spark.createDataFrame(rows, "id string, record string"), spark.createDataFrame(patches, "id string, patch string")).collect()
    by = {r.id: r.record for r in found}
    assert json.loads(by["a"]) == {"x": "new", "w": None, "y": {"z": [1, 2]}} and by["b"] == '{"x":1}' and by["c"] == "damaged" and by["d"] is None


def test_rolling_totals(spark, tmp_path):
    """Batches are added once each, also when they are sent again; the newest rows stay; the result is that of one aggregate."""
    totals = upserts.RollingTotals(str(tmp_path / "t"), ("day", "model"), ("calls", "usd"), kept=5)
    schema = "day string, model string, calls long, usd double"
    batches = [[(f"2024-01-0{d}", m, n + 1, 0.5) for d in range(1 + n, 4 + n) for m in "ab"] for n in range(3)]
    assert totals.state(spark) is None
    for n, rows in enumerate(batches):
        for _ in range(2):
            totals.merge(spark.createDataFrame(rows, schema), n)
    every = spark.createDataFrame([r for b in batches for r in b], schema).groupBy("day", "model").agg(F.sum("calls"), F.sum("usd")).orderBy(F.desc("day"), F.desc("model")).limit(5)
    assert sorted(map(tuple, totals.state(spark).select("day", "model", "calls", "usd").collect())) == sorted(map(tuple, every.collect()))
    totals.merge(spark.createDataFrame(batches[0], schema), 1)
    assert totals.state(spark).agg(F.sum("calls")).first()[0] == every.agg(F.sum("sum(calls)")).first()[0]


def test_a_stream_keeps_totals_and_counts(spark, tmp_path):
    """A stopped query goes on where it was; its listener counts each batch once."""
    totals = upserts.RollingTotals(str(tmp_path / "t"), ("day",), ("calls",))
    listener = progress.StreamProgress("costs", {"read": 9})
    spark.streams.addListener(listener)
    try:
        for part in range(3):
            spark.createDataFrame([(f"d{k}", k + part) for k in range(3)], "day string, calls long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("day string, calls long").parquet(f"{tmp_path}/in").observe("read", F.count(F.lit(1)).alias("done"))
            run = totals.follow(stream, f"{tmp_path}/c")
            run.processAllAvailable()
            run.stop()
        end = time.time() + 20
        while listener.rows()[0][2] < 9 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(map(tuple, totals.state(spark).collect())) == [("d0", 3), ("d1", 6), ("d2", 9)]
    assert listener.rows() == [("costs", "read", 9, 9)]
    listener.counted("q", 1, {"read": {"done": 4}, "other": {"done": 1}})
    listener.counted("q", 1, {"read": {"done": 4}})
    assert listener.rows()[0][2] == 13


def test_counters_of_a_job_s_stages(spark, tmp_path):
    text = "Body (Waa, 1990).\nReferences\n[1] Waa, B. (1990). On lists. List Journal, 1(2), 3-4.\n[2] Wbb, C. (1991). On other lists. List Journal, 2(2), 3-4."
    docs = spark.createDataFrame([(k, text) for k in range(4)] + [(9, "no list")], "doc_id long, text string")
    spark.sparkContext.setJobGroup("job 1", "progress")
    counters = progress.Progress(spark, "job 1")
    result = manuscripts.process(counters.watched(docs, "read", 5), 2026)
    items, errors = counters.watched(result.items, "items", 8), counters.watched(result.errors, "errors", 1)
    n_items, n_errors = len(items.collect()), len(errors.collect())
    result.release()
    written = {r.stage: (r.done, r.total) for r in counters.write(f"{tmp_path}/p").collect()}
    assert written["items"] == (n_items, 8) and written["errors"] == (n_errors, 1) and written["read"][0] >= 5
    assert n_items == 8 and n_errors == 1 and spark.read.parquet(f"{tmp_path}/p").count() == 3
    done, total = counters.of_tasks()
    assert 0 <= done <= total
