"""Hypnograms: labels, counts, transitions, runs and nightly metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.schema import EPOCH_SECONDS, STAGES


def stage_name(stage: Column) -> Column:
    """The label of a code; an unknown code passes through as text."""
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, stage), stage.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def stage_counts(stages: DataFrame, night: str) -> DataFrame:
    """night, stage, n, pct and its text; stages that do not occur have no row."""
    n = stages.groupBy(night, "stage").agg(F.count("*").alias("n"))
    pct = percent(F.col("n"), F.sum("n").over(W.Window.partitionBy(night)))
    return n.withColumn("pct", pct).withColumn("pct_text", F.format_string("%.1f%%", F.bround(pct, 1)))


def nightly_metrics(stages: DataFrame, night: str) -> DataFrame:
    """Duration, efficiency and shares of a night, in one aggregation."""
    n = F.count("*")
    of = lambda *codes: F.count_if(F.col("stage").isin(*codes))
    shares = [percent(of(k), n).alias(f"{v.lower()}_pct") for k, v in STAGES.items()]
    return stages.groupBy(night).agg(
        n.alias("n_epochs"), (n * EPOCH_SECONDS / F.lit(3600.0)).alias("duration_h"), percent(n - of(0), n).alias("efficiency_pct"), *shares, percent(of(3, 4), n).alias("n3_rem_pct"),
    )


def stage_matrix(stages: DataFrame, night: str) -> DataFrame:
    """A row a night, the share of each stage in fixed order, 0 where absent."""
    shares = stage_counts(stages, night).groupBy(night).pivot("stage", list(STAGES)).agg(F.first("pct"))
    return shares.select(night, *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(v.lower()) for k, v in STAGES.items()])


def transitions(stages: DataFrame, night: str) -> DataFrame:
    """How often each stage follows each, over all nights."""
    after = F.lead("stage").over(W.Window.partitionBy(night).orderBy("epoch"))
    return stages.select("stage", after.alias("next_stage")).filter("next_stage is not null").groupBy("stage", "next_stage").agg(F.count("*").alias("n"))


def runs(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Islands of equal values: group, value, first, last and length of each."""
    w = W.Window.partitionBy(*group).orderBy(order)
    v = W.Window.partitionBy(*group, value).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(v)
    made = df.withColumn("_island", island).groupBy(*group, value, "_island")
    return made.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_island")


def run_metrics(found: DataFrame, night: str, value: str, seconds: float) -> DataFrame:
    """Coverage, mean duration and onsets a minute of each value in a night."""
    total = F.sum("total").over(W.Window.partitionBy(night))
    by = found.groupBy(night, value).agg(F.sum("length").alias("total"), F.count("*").alias("runs"), F.avg("length").alias("mean_length"))
    return by.select(
        night, value, (F.col("total") / total).alias("coverage"), (F.col("mean_length") * seconds).alias("mean_duration_s"), (F.col("runs") * 60 / (total * seconds)).alias("onsets_per_min"),
    )


def dashboard(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of the nightly metrics, a row a metric."""
    names = ["wake_pct", "n3_pct", "rem_pct", "duration_h", "efficiency_pct"]
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("m"))
    return long.groupBy("m.metric").agg(F.avg("m.v").alias("mean"), F.stddev_pop("m.v").alias("sd"), F.count("m.v").alias("nights"))
