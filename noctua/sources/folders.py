"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and driver and tasks are one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = known.get() if known.isDefined() else None
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (known or "file://" + tempfile.mkdtemp(prefix="noctua-")).rstrip("/")


class Tables:
    """Intermediate tables of one operator in the shared folder: they cut lineage and survive lost executors.

    `drop` deletes those that nothing reads any more; what is left goes as the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/noctua/{name}-{uuid.uuid4().hex}"
        self.path(self.folder)[0].deleteOnExit(self.path(self.folder)[1])

    def path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        at, path = self.path(f"{self.folder}/{name}")
        at.delete(path, True)
