"""Totals by key that a stream keeps up to date: each batch is merged once, the newest rows stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows that a cost log keeps.
KEPT = 800


@dataclass(frozen=True)
class RollingTotals:
    """Sums of columns by keys, in a folder that all machines share.

    Each batch makes a version of the whole table, named by the batch's number; the last complete one counts. So a batch that is sent again, after a failure or a restart, finds
    its version there and changes nothing, and readers never see half a change. Of the keys, in their order, the last `kept` stay: the first key must grow with time.
    """

    path: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    kept: int = KEPT

    def _versions(self, spark: SparkSession) -> list[int]:
        """Numbers of complete versions, ascending."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")) if files.exists(folder) else None
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or [])

    def state(self, spark: SparkSession) -> DataFrame | None:
        """The table as the last complete batch left it; None before the first."""
        versions = self._versions(spark)
        return spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Add a batch to the table, unless its number was added before."""
        spark = batch.sparkSession
        versions = self._versions(spark)
        if versions and number <= versions[-1]:
            return
        rows = batch.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))
        if versions:
            rows = self.state(spark).unionByName(rows).groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))
        newest = rows.orderBy(*(F.desc(k) for k in self.keys)).limit(self.kept)
        newest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={number}")  # `kept` rows
        for old in versions[:-1]:  # the last one may still be read
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A running query that merges each batch of a stream."""
        return stream.writeStream.outputMode("append").foreachBatch(self.merge).option("checkpointLocation", checkpoint).start()
