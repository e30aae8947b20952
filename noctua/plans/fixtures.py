"""The fixture tables in the roles of the domain: hypnograms, segments, night series, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.operators.epoching import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """night, epoch, stage, value, ts: a user's events in order as a hypnogram."""
    codes = F.create_map(*[F.lit(x) for kv in {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}.items() for x in kv])
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("night"), "ts", "event_id", "value", F.try_element_at(codes, F.col("event_type")).alias("stage"))
    return numbered(events, "night", "ts", "event_id", name="epoch")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """night, epoch, samples: an embedding as an epoch of 64 samples at 64 Hz."""
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("night"), F.col("vec_id").alias("epoch"), samples.alias("samples"))


def night_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, day, n, total, mean: a row a day of orders."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    days = days.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"))
    return numbered(days.withColumn("series", F.lit(0)), "series", "day").drop("series")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """night, epoch keys and four features, some missing."""
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("night"), F.col("l_linenumber").alias("epoch"), F.col("l_returnflag").alias("grp"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"),
    )
    return f
