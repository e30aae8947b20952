"""Detected events: class probabilities to intervals, thresholds, descriptions and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.operators.staging import runs
from noctua.schema import EVENT_WINDOW


def argmax(proba: Column) -> Column:
    """The place of the largest value from 0; the first of equal ones."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def event_intervals(windows: DataFrame, epoch: str, threshold: float, size: int = EVENT_WINDOW, per_epoch: int | None = None) -> DataFrame:
    """Intervals of consecutive windows of one class whose probability is above the threshold.

    windows: epoch, win, label, proba. Start and end are in samples, the end past the last window; an interval that
    touches an edge of the epoch is clamped to it. Nothing above the threshold gives an empty result.
    """
    above = windows.filter(F.col("proba") > threshold)
    w = W.Window.partitionBy(epoch, "label").orderBy("win")
    marked = above.withColumn("_island", F.col("win") - F.row_number().over(w))
    found = marked.groupBy(epoch, "label", "_island").agg(F.min("win").alias("_a"), F.max("win").alias("_b"), F.avg("proba").alias("predict_proba"))
    last = (F.col("_b") + 1) * size if per_epoch is None else F.least((F.col("_b") + 1) * size, F.lit(per_epoch * size))
    start = F.greatest(F.col("_a") * size, F.lit(0))
    return found.select(epoch, "label", start.cast("long").alias("start"), last.cast("long").alias("end"), (last - start).cast("long").alias("duration"), "predict_proba")


def above_thresholds(intervals: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Intervals at or above their label's threshold; thresholds (label, threshold) is a small dimension."""
    kept = intervals.join(thresholds, "label", "left").filter(F.col("predict_proba") >= F.coalesce("threshold", F.lit(default)))
    return kept.drop("threshold")


def described(intervals: DataFrame) -> DataFrame:
    """A row a label: count, mean probability in per cent, share of all events."""
    by = intervals.groupBy("label").agg(F.count("*").alias("n"), (F.avg("predict_proba") * 100).alias("mean_proba"))
    return by.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(W.Window.partitionBy()))


def annotations(intervals: DataFrame, epoch: str) -> DataFrame:
    """A JSON body an interval, with an id that is the same for the same interval."""
    name = F.substring(F.md5(F.concat_ws("|", F.col(epoch), "label", "start", "end")), 1, 10)
    body = F.struct("label", "start", "end", F.round("predict_proba", 3).alias("score"))
    return intervals.select(epoch, "label", "start", name.alias("id"), F.to_json(F.struct(name.alias("id"), F.lit("labels").alias("type"), body.alias("value"))).alias("body"))


__all__ = ["above_thresholds", "annotations", "argmax", "described", "event_intervals", "runs"]
