"""Limits on streams: events that come late and out of order, a breaker, state that expires."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from refloom.streaming import limits

SCHEMA = "key string, event_id long, at double, success boolean, refused boolean"
FAR = 10_000_000.0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def streamed(spark, tmp_path, batches, decide, name):
    """Decisions on batches that come one after the other; a last event far ahead lets all others be decided."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    run = decide(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for n, rows in enumerate([*batches, [("flush", -1, FAR, False, False)], [("flush", -2, FAR, False, False)]]):
            lines = [json.dumps(dict(zip(("key", "event_id", "at", "success", "refused"), r, strict=True))) for r in rows]
            (tmp_path / f"b{n}").write_text("\n".join(lines))
            (tmp_path / f"b{n}").rename(folder / f"b{n}.json")
            run.processAllAvailable()
        return {(r.key, r.event_id): r.allowed for r in spark.table(name).collect() if r.key != "flush"}
    finally:
        run.stop()


def shuffled(rng, rows, late):
    """Rows in an order in which none comes more than `late` seconds behind one before it."""
    return sorted(rows, key=lambda r: r[2] + rng.uniform(0, late))


@pytest.mark.parametrize("kind", ["throttled", "locked"])
def test_unordered_events_decide_as_the_table_does(rocks, tmp_path, kind):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), k, round(rng.uniform(1000, 1600), 2), rng.random() < 0.05, False) for k in range(240)]
    order = shuffled(rng, rows, 300)
    assert order != sorted(rows, key=lambda r: r[2])
    decide = (lambda e: limits.throttled(e, "10 minutes")) if kind == "throttled" else lambda e: limits.locked(e, "admin", "10 minutes")
    found = streamed(rocks, tmp_path, [order[:90], order[90:91], order[91:200], order[200:]], decide, kind)
    table = {(r.key, r.event_id): r.allowed for r in decide(rocks.createDataFrame(rows, SCHEMA)).collect()}
    assert found == table and set(table.values()) == {True, False}


def test_the_breaker_opens_and_stays_open(rocks, tmp_path):
    rows = [("good", 1, 10.0, False, False), ("bad", 2, 20.0, False, False), ("bad", 3, 30.0, False, True), ("bad", 4, 25.0, False, False), ("bad", 5, 40.0, False, False), ("bad", 6, 90_000.0, False, False), ("good", 7, 90_000.0, False, False)]
    found = streamed(rocks, tmp_path, [rows[2:4], rows[:2], rows[4:5], rows[5:]], limits.unbroken, "unbroken")
    table = {(r.key, r.event_id): r.allowed for r in limits.unbroken(rocks.createDataFrame(rows, SCHEMA)).collect()}
    assert found == table == {("good", 1): True, ("bad", 2): True, ("bad", 3): True, ("bad", 4): True, ("bad", 5): False, ("bad", 6): False, ("good", 7): True}


def test_late_events_are_dropped(rocks, tmp_path):
    """An event behind the watermark is not decided, one within it is."""
    rows = [[("a", k, 100.0 + k, False, False) for k in range(15)], [("b", 50, 5000.0, False, False)], [("a", 60, 101.5, False, False), ("a", 61, 5001.0, False, False)]]
    found = streamed(rocks, tmp_path, rows, lambda e: limits.throttled(e, "10 minutes"), "late")
    assert [found["a", k] for k in range(15)] == [True] * 12 + [False] * 3
    assert ("a", 60) not in found and found["a", 61] is True and found["b", 50] is True


class Kept:
    """State and timers as a processor sees them."""

    def __init__(self):
        self.map, self.value, self.timers = {}, None, set()

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return Value(self)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.map[k]

    def iterator(self):
        return iter(list(self.map.items()))


class Value:
    def __init__(self, kept):
        self.kept = kept

    def exists(self):
        return self.kept.value is not None

    def get(self):
        return self.kept.value

    def update(self, v):
        self.kept.value = v

    def clear(self):
        self.kept.value = None


@pytest.mark.parametrize("forget", [60.0, None])
def test_state_expires(forget):
    """What is remembered goes when nothing came for as long as it counts, and not before; without such a time it stays."""
    kept, made = Kept(), limits.Ordered(limits.admit, forget)
    made.init(kept)
    rows = pd.DataFrame([("a", 2, 20.0, False), ("a", 1, 10.0, False), ("a", 3, 50.0, False)], columns=["key", "event_id", "at", "success"])
    list(made.handleInputRows(("a",), iter([rows]), None))
    assert kept.timers == {10_000, 20_000, 50_000} and len(kept.map) == 3

    def fire(at):
        kept.timers.discard(at)
        return pd.concat(made.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda: at)))["event_id"].tolist()

    assert fire(20_000) == [1, 2] and len(kept.map) == 1 and kept.value == ([10.0, 20.0],)
    assert fire(50_000) == [3] and not kept.map
    if forget is None:
        assert kept.timers == {10_000} and kept.value == ([10.0, 20.0, 50.0],)
    else:
        assert 110_000 in kept.timers and fire(80_000) == [] and kept.value is not None  # the timer of the events before the last one
        assert fire(110_000) == [] and kept.value is None
