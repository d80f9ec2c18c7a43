"""Admission and lockout limits by key, on streams with state and on tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

# Accepted requests a minute, and failures in ten minutes by kind.
ACCEPTED, MINUTE = 12, 60.0
FAILURES, TEN_MINUTES = {"access": 15, "admin": 5}, 600.0
OUT = "key string, event_id long, at double, allowed boolean"
NAMES = ["key", "event_id", "at", "allowed"]
STATE = "times array<double>"

Step = Callable[[list[float], float, bool], tuple[bool, list[float]]]


def admit(times: list[float], at: float, _: bool) -> tuple[bool, list[float]]:
    """A request is accepted if fewer than 12 were in the last minute; refused ones aren't remembered."""
    recent = [t for t in times if at - t < MINUTE]
    return (False, recent) if len(recent) >= ACCEPTED else (True, [*recent, at])


def attempt(limit: int) -> Step:
    """An attempt is allowed if fewer failures than the limit were in the last ten minutes. A failure is remembered, a success clears; refused attempts change nothing."""

    def step(times: list[float], at: float, success: bool) -> tuple[bool, list[float]]:
        recent = [t for t in times if at - t < TEN_MINUTES]
        if len(recent) >= limit:
            return False, recent
        return True, [] if success else [*recent, at]

    return step


def _keyed(events: DataFrame) -> DataFrame:
    """events (key, event_id, at in seconds, and success where it matters) with the columns that the steps read."""
    success = F.col("success") if "success" in events.columns else F.lit(False)
    return events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"), success.alias("success"))


def _decided(step: Step, key: str, rows: pd.DataFrame, times: list[float]) -> tuple[pd.DataFrame, list[float]]:
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        allowed, times = step(times, r.at, bool(r.success))
        out.append((key, r.event_id, r.at, allowed))
    return pd.DataFrame(out, columns=["key", "event_id", "at", "allowed"]), times


def on_table(events: DataFrame, step: Step, forget_after: float) -> DataFrame:
    """key, event_id, at, allowed: decisions in the order of time.

    Each decides on those before, but after a gap of forget_after seconds nothing is remembered. So a key's events are cut at such gaps, found by a window, and
    each run is gone through by itself: batches come sorted, and what is kept between them is one run's short list of times, whatever the size of a key.
    """
    at, rows = F.col("at"), _keyed(events)
    before = F.lag("at").over(Window.partitionBy("key").orderBy("at", "event_id"))
    starts = F.coalesce(at - before >= forget_after, F.lit(True)).cast("int")
    cut = rows.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    # null keys are a key of their own
    dealt = cut.repartition("key", "_run").sortWithinPartitions("key", "_run", "at", "event_id").select("key", "event_id", "at", "success", "_run")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, times = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = (r.key, r[4])
                if own != run:
                    run, times = own, []
                allowed, times = step(times, r.at, bool(r.success))
                out.append(allowed)
            yield batch[["key", "event_id", "at"]].assign(allowed=out)

    return dealt.mapInPandas(work, OUT)


def on_arrival(events: DataFrame, step: Step, forget_after: float) -> DataFrame:
    """Decisions on a stream as events arrive, those of a batch in the order of time. A key's state is a short list of times; it is dropped when nothing came for forget_after seconds."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        out, times = _decided(step, key[0], rows, list(state.get[0]) if state.exists else [])
        state.update((times,))
        state.setTimeoutDuration(int(forget_after * 1000))
        yield out

    return _keyed(events).groupBy("key").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class Ordered(StatefulProcessor):
    """Decides a key's events in the order of their time, whatever the order in which they come.

    waiting (a map from time and number to success) holds events until the watermark has passed them; a timer at an event's time then lets all up to it go through the
    step. times is what the step remembers. It is dropped by a timer of its own when nothing came for forget_after seconds; None: never.
    """

    def __init__(self, step: Step, forget_after: float | None):
        self.step, self.forget_after = step, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at double, event_id long", "success boolean")
        self.times = handle.getValueState("times", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the base class's names
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.waiting.updateValue((float(r.at), int(r.event_id)), (bool(r.success),))
                self.handle.registerTimer(_milliseconds(r.at))
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k, v[0]) for k, v in self.waiting.iterator() if _milliseconds(k[0]) <= now)
        times = list(self.times.get()[0]) if self.times.exists() else []
        out = []
        for (at, event_id), success in due:
            allowed, times = self.step(times, at, success)
            out.append((key[0], event_id, at, allowed))
            self.waiting.removeKey((at, event_id))
        if due and times:
            self.times.update((times,))
            if self.forget_after is not None:
                self.handle.registerTimer(_milliseconds(max(times) + self.forget_after))
        elif due or (times and self.forget_after is not None and now >= _milliseconds(max(times) + self.forget_after)):
            self.times.clear()
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def _milliseconds(at: float) -> int:
    return math.ceil(at * 1000)


def on_stream(events: DataFrame, step: Step, forget_after: float | None, late: str) -> DataFrame:
    """on_table() on a stream: events may come in any order and `late` behind the latest; later ones are dropped. An event is decided when none before it can
    come any more, so decisions are those of the table. State is kept by RocksDB, which the session must name as its provider."""
    timed = _keyed(events).withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Ordered(step, forget_after), OUT, "Append", "eventTime")


def breaker(opened: list[float], at: float, refused: bool) -> tuple[bool, list[float]]:
    """A call goes out until one was refused; from then on none does."""
    return (False, opened) if opened else (True, [at] if refused else [])


def unbroken(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """key, event_id, at, allowed of calls (key, event_id, at, refused): those after a key's first refusal are not made. On a table that is a minimum by key; on a stream the
    refusal is kept for good."""
    if calls.isStreaming:
        return on_stream(calls.withColumn("success", F.col("refused")), breaker, None, late)
    rows = _keyed(calls.withColumn("success", F.col("refused")))
    first = rows.where("success").groupBy("key").agg(F.min(F.struct("at", "event_id")).alias("_first"))
    joined = rows.alias("r").join(first.alias("f"), F.col("r.key").eqNullSafe(F.col("f.key")), "left")
    return joined.select("r.key", "r.event_id", "r.at", F.coalesce(F.struct("r.at", "r.event_id") <= F.col("_first"), F.lit(True)).alias("allowed"))


def _limited(events: DataFrame, step: Step, window: float, kept: float, late: str | None) -> DataFrame:
    if not events.isStreaming:
        return on_table(events, step, window)
    return on_arrival(events, step, kept) if late is None else on_stream(events, step, window, late)


def throttled(events: DataFrame, late: str | None = None) -> DataFrame:
    """Decisions of admit(). On a stream they are made on arrival, as whoever asks waits for them; with `late` they wait for events that come so much later, and are those
    of the table."""
    return _limited(events, admit, MINUTE, 2 * MINUTE, late)


def locked(events: DataFrame, kind: str = "access", late: str | None = None) -> DataFrame:
    """Decisions of attempt(), as throttled() makes them."""
    return _limited(events, attempt(FAILURES[kind]), TEN_MINUTES, TEN_MINUTES, late)


def live(jobs: DataFrame, now: float, ttl: float = 7200.0) -> DataFrame:
    """Jobs that are still kept: running ones, and finished ones created in the last two hours."""
    return jobs.where((F.col("status") == "running") | ~F.col("status").isin("done", "error") | (F.col("created") >= now - ttl))


def valid_sessions(sessions: DataFrame, now: float, ttl: float = 43200.0) -> DataFrame:
    return sessions.where(F.lit(now) - F.col("created") < ttl)
