"""Tables in the folder that the cluster's machines share: what rounds of a loop write and read back, so that no plan grows and a lost executor costs a read."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="refloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one only where none is named and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    return folder


class Written:
    """Tables that one computation has written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: it has no lineage then."""
        self.paths.append(f"{shared_folder(self.spark)}/{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Delete all but the last `keep` tables."""
        last = len(self.paths) - keep
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths[:last]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = self.paths[last:]
