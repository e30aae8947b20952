"""The incremental side: windows, sessions and gaps over event streams, and idempotent nightly upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.sources.folders import shared_folder
from noctua.sources.recording import write_nights

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(events: DataFrame, keys: list[str], time: str, value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean of each window; events later than `late` behind the newest are dropped, state with them."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events no further apart than gap."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns all it gave, as a Parquet table in the shared folder.

    Tasks write the rows; none passes through the driver. A batch that is taken again replaces its own folder. In
    complete mode the last batch is the result.
    """
    spark, path = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/noctua/drained-{uuid.uuid4().hex}"
    done = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch}")
        done.append(batch)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    kept = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{k}" for k in kept]) if kept else spark.createDataFrame([], stream.schema)


def landing(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_nights(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Runs work on each batch and replaces the nights it gives; a batch that fails is taken again, done ones are not."""
    query = stream.writeStream.foreachBatch(lambda df, _: write_nights(work(df), path)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def closed(events: DataFrame, time: str) -> DataFrame:
    """events and, at their end, one row with a time far ahead and nulls, so that the watermark passes all of a finished input."""
    spark, path = events.sparkSession, f"{shared_folder(events.sparkSession)}/noctua/end-{uuid.uuid4().hex}"
    end = [F.lit("2200-01-01").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*end).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def stream_gaps(events: DataFrame, key: str, time: str, seconds: float, late: str = "1 hour", slots: int = 1024) -> DataFrame:
    """key, start, gap_s: pauses longer than seconds between events of a key that the watermark has passed.

    Events wait in the key's state until the watermark passes them, so that a late one still fills the gap that it lies in;
    then they are settled in order of time, and only the newest settled time is kept. A timer in event time settles what waits;
    a key keeps one number then. State is held by slots (a hash of the key), of many keys each:
    it is called a few times a slot and batch. A batch reads and writes the numbers of all keys of the slots that it settles;
    `slots` stays the same over a checkpoint's life.
    """
    from noctua.streaming.gaps import gap_processor

    # columns of state need the store that has them; it holds for the session's streams that start from here on
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema[key].dataType.simpleString()
    # a null key goes as a flag and some value: state is not kept under a null
    some = F.coalesce(key, F.lit("0").cast(kind)).alias("some")
    keyed = events.withWatermark(time, late).select(F.col(key).isNull().alias("none"), some, time, F.unix_micros(time).alias("at"), F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot"))
    found = keyed.groupBy("slot").transformWithStateInPandas(gap_processor(seconds), f"none boolean, some {kind}, start long, gap_s double", "append", "eventTime")
    return found.select(F.when(~F.col("none"), F.col("some")).alias(key), "start", "gap_s")
