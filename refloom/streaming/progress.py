"""How far a job is: counters that travel with its own stages, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

COUNTERS = "job string, stage string, done long, total long"


class Progress:
    """Counters of one job's stages.

    watched() counts a stage's rows while they pass, without a pass of its own; a stage is done when an action has gone through it. of_tasks() tells how far the running actions
    of the job are, by tasks.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self.stages: dict[str, tuple[Observation, int]] = {}

    def watched(self, rows: DataFrame, stage: str, total: int) -> DataFrame:
        """rows, counted as a stage of which `total` rows are expected."""
        seen = Observation(f"{self.job} {stage}")
        self.stages[stage] = (seen, total)
        return rows.observe(seen, F.count(F.lit(1)).alias("done"))

    def finished(self, stage: str) -> dict[str, object]:
        """The counters of a stage through which an action has gone."""
        seen, total = self.stages[stage]
        return {"job": self.job, "stage": stage, "done": seen.get["done"], "total": total}

    def write(self, path: str) -> DataFrame:
        """Append the counters of all stages, which must be done, to a table."""
        rows = self.spark.createDataFrame([self.finished(s) for s in self.stages], COUNTERS)
        rows.write.mode("append").parquet(path)
        return rows

    def of_tasks(self) -> tuple[int, int]:
        """(done, total) tasks of the job's running stages. The job must run in a job group of its name."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = filter(None, (tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.job)))
        infos = [i for job in jobs for s in job.stageIds if (i := tracker.getStageInfo(s))]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)


class StreamProgress(StreamingQueryListener):
    """Adds up what the batches of streams report: a stage is a name that observe() was given, with a column done. Each batch of a query counts once, even if it is reported
    again after a restart."""

    def __init__(self, job: str, totals: dict[str, int]):
        self.job, self.totals = job, totals
        self.batches: dict[tuple[str, str, int], int] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802  the base class's names
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        self.counted(str(event.progress.id), event.progress.batchId, {k: v.asDict() for k, v in event.progress.observedMetrics.items()})

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass

    def counted(self, query: str, batch: int, metrics: dict[str, dict]) -> None:
        for stage, values in metrics.items():
            if stage in self.totals and values.get("done") is not None:
                self.batches[query, stage, batch] = values["done"]

    def rows(self) -> list[tuple[str, str, int, int]]:
        """(job, stage, done, total) of all stages."""
        return [(self.job, s, sum(n for (_, stage, _), n in self.batches.items() if stage == s), total) for s, total in self.totals.items()]
