"""Registered limit and alignment queries against plain loops over the smallest of the driver's tables."""

from collections import defaultdict
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from refloom.operators import align
from refloom.plans.queries import QUERIES
from refloom.streaming import limits

TABLES = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")


def events():
    return sorted(pq.read_table(TABLES / "events.parquet").to_pylist(), key=lambda e: (e["ts"], e["event_id"]))


def seconds(e):
    return (e["ts"] - datetime(1970, 1, 1)).total_seconds()


@here
def test_throttled_requests(spark):
    accepted, expected = defaultdict(list), {}
    for e in events():
        key, at = e["user_id"] % 20, seconds(e) / 40
        recent = [t for t in accepted[key] if at - t < 60]
        expected[e["event_id"]] = len(recent) < 12
        accepted[key] = [*recent, at] if len(recent) < 12 else recent
    assert {r.event_id: r.allowed for r in QUERIES["throttled_requests"](spark, str(TABLES)).collect()} == expected


@here
def test_locked_attempts(spark):
    failed, expected = defaultdict(list), {}
    for e in events():
        key, at = e["user_id"] % 20, seconds(e)
        recent = [t for t in failed[key] if at - t < 600]
        expected[e["event_id"]] = len(recent) < 5
        if len(recent) < 5:
            failed[key] = [] if e["event_type"] == "purchase" else [*recent, at]
    assert {r.event_id: r.allowed for r in QUERIES["locked_attempts"](spark, str(TABLES)).collect()} == expected


def test_gaps_of_just_the_limit_and_null_keys(spark):
    """A run that ends exactly one window before the next event, equal times, null keys, no rows."""
    times = [0.0] * 14 + [60.0] * 13 + [119.9] * 2 + [120.0] * 3
    rows = [(key, k, t) for k, (key, t) in enumerate((key, t) for key in ("a", None) for t in times)]
    frame = spark.createDataFrame(rows, "key string, event_id long, at double")
    kept, expected = defaultdict(list), {}
    for key, k, at in rows:
        recent = [t for t in kept[key] if at - t < 60]
        expected[k] = len(recent) < 12
        kept[key] = [*recent, at] if expected[k] else recent
    assert {r.event_id: r.allowed for r in limits.throttled(frame).collect()} == expected
    assert limits.throttled(frame.limit(0)).count() == 0


@here
def test_aligned_entries(spark):
    """Every ninth entry has no line; of the rest each has its own, the same but for a DOI at the end of some."""
    found = QUERIES["aligned_entries"](spark, str(TABLES)).where("kind = 'pair'")
    assert found.where((F.col("seq") % 9 != 0) & (F.col("same") != (F.col("seq") % 4 != 0))).count() == 0
    assert found.where(F.col("seq") % 9 != 0).count() == sum(o % 9 != 0 for o in pq.read_table(TABLES / "orders.parquet")["o_orderkey"].to_pylist())


def test_equal_lines_are_taken_in_order(spark):
    """Of equal lines the first free one counts; the rest stays single."""
    items = spark.createDataFrame([(1, k, "r", "one and the same line", "", "") for k in range(3)], "doc_id long, seq long, raw string, formatted string, title string, doi string")
    lines = spark.createDataFrame([(1, k, "one and the same line") for k in (7, 5, 6, 9)], "doc_id long, pos long, text string")
    found = align.align(items, lines).collect()
    assert sorted((r.seq, r.pos) for r in found if r.kind == "pair") == [(0, 5), (1, 6), (2, 7)]
    assert [r.pos for r in found if r.kind == "published_only"] == [9]
