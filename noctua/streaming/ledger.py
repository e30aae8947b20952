"""A ledger of nights: batches land their rows, nights that they touch are made again whole, and a new version counts at once.

Three tables stand below a folder. `rows` has what each batch brought, by batch and slot (a hash of the night, so that a batch
reads only the slots of its nights again, and folders do not grow with the nights). `nights` has the results, a version a batch. `ledger` has a row for each
night of a version, and is written last: a night's current version is the newest in the ledger, so that readers see the old
result or the new one, never a part. A batch that is taken again writes its own folders again; results do not depend on how
rows are divided into batches, as a night is always made of all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, or an empty one where none is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_parts(schema: T.StructType, *parts: str) -> T.StructType:
    """The columns of a table as it is read: those of its folders last."""
    return T.StructType([*schema, *(T.StructField(p, T.LongType()) for p in parts)])


def take(batch: DataFrame, version: int, work: Callable[[DataFrame], DataFrame], path: str, slots: int = 64) -> None:
    """One batch: lands its rows, makes its nights again from all their rows, and enters them in the ledger."""
    spark = batch.sparkSession
    placed = batch.withColumn("slot", F.pmod(F.xxhash64("night"), F.lit(slots)))
    placed.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/rows/version={version}")
    landed = stored_table(spark, f"{path}/rows", with_parts(batch.schema, "version", "slot")).filter(F.col("version") <= version)
    touched = landed.filter(F.col("version") == version).select("night", "slot").distinct()
    read = [r.slot for r in touched.select("slot").distinct().collect()]  # `slots` numbers at most
    rows = landed.filter(F.col("slot").isin(read)).join(touched.select("night"), "night", "left_semi").select(batch.columns)
    work(rows).write.mode("overwrite").parquet(f"{path}/nights/version={version}")
    entry = touched.select("night", F.current_timestamp().alias("made_at"))
    entry.write.mode("overwrite").parquet(f"{path}/ledger/version={version}")


def upsert(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> None:
    """Takes the batches of a stream (with a column night); work makes results, with night, of whole nights."""
    query = stream.writeStream.foreachBatch(lambda df, version: take(df, version, work, path)).option("checkpointLocation", checkpoint)
    (query.trigger(availableNow=True) if once else query).start().awaitTermination()


def versions(spark: SparkSession, path: str, night: T.DataType = T.LongType()) -> DataFrame:
    """night, version, made_at of each night's current version."""
    entries = stored_table(spark, f"{path}/ledger", T.StructType([T.StructField("night", night), T.StructField("made_at", T.TimestampType()), T.StructField("version", T.LongType())]))
    return entries.groupBy("night").agg(F.max(F.struct("version", "made_at")).alias("last")).select("night", "last.*")


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The results as they count now, with the columns of schema."""
    made = stored_table(spark, f"{path}/nights", with_parts(schema, "version"))
    return made.join(versions(spark, path, schema["night"].dataType).select("night", "version"), ["night", "version"], "left_semi").select(schema.names)


def not_done(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Those of wanted (with night) that the ledger does not have: where a run that broke off goes on."""
    return wanted.join(versions(spark, path, wanted.schema["night"].dataType).select("night"), "night", "left_anti")


def swept(spark: SparkSession, path: str, schema: T.StructType) -> list[int]:
    """The versions of which no night counts any more; their folders below `nights` may go. A version a number: few and small."""
    held = {r.version for r in versions(spark, path, schema["night"].dataType).select("version").distinct().collect()}
    every = {r.version for r in stored_table(spark, f"{path}/nights", with_parts(schema, "version")).select("version").distinct().collect()}
    return sorted(every - held)
