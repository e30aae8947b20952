"""Epochs: tumbling, sliding and range windows, gaps, and the alignment of streams with epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def numbered(df: DataFrame, night: str, *order: str, name: str = "idx") -> DataFrame:
    """Rows of each night numbered from 0 in order: one shuffle by night, shared by what follows."""
    return df.withColumn(name, F.row_number().over(W.Window.partitionBy(night).orderBy(*order)) - 1)


def tumbling(df: DataFrame, night: str, size: int, keep_partial: bool = False) -> DataFrame:
    """Adds epoch = idx div size; the incomplete last epoch of a night is dropped unless wanted."""
    out = df.withColumn("epoch", F.floor(F.col("idx") / size).cast("int"))
    if keep_partial:
        return out
    n = F.count("*").over(W.Window.partitionBy(night, "epoch"))
    return out.withColumn("_n", n).filter(F.col("_n") == size).drop("_n")


def sliding(samples: Column, size: int, step: int) -> Column:
    """Array of the windows of an array of samples."""
    last = F.size(samples) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(samples, i + 1, F.lit(size))))


def rolling(column: str, night: str, before: int, after: int, *order: str) -> Column:
    """Centred mean, null where the window is not whole."""
    w = W.Window.partitionBy(night).orderBy(*order).rowsBetween(-before, after)
    return F.when(F.count(column).over(w) == before + after + 1, F.avg(column).over(w))


def gaps(segments: DataFrame, night: str, start: str, seconds: str) -> DataFrame:
    """Adds gap_seconds to the end of the segment before in the same night (null for the first)."""
    w = W.Window.partitionBy(night).orderBy(start)
    ended = F.unix_micros(F.lag(start).over(w).cast("timestamp")) / F.lit(1e6) + F.lag(seconds).over(w)
    return segments.withColumn("gap_seconds", F.unix_micros(F.col(start).cast("timestamp")) / F.lit(1e6) - ended)


def filled(epochs: DataFrame, night: str, values: dict[str, object]) -> DataFrame:
    """Every epoch from a night's first to its last; missing ones get the values given and is_gap."""
    span = epochs.groupBy(night).agg(F.min("epoch").alias("_a"), F.max("epoch").alias("_b"))
    dense = span.select(night, F.explode(F.sequence("_a", "_b")).alias("epoch"))
    marked = epochs.withColumn("_real", F.lit(True))
    out = dense.join(marked, [night, "epoch"], "left").withColumn("is_gap", F.col("_real").isNull()).drop("_real")
    return out.withColumns({k: F.when(F.col("is_gap"), F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def windows_to_epochs(windows: DataFrame, night: str, epochs: int) -> DataFrame:
    """The epoch of each window: epoch e of a night has windows from rint(e * r) up to rint((e + 1) * r), r = windows / epochs.

    The bounds are few a night, so the range condition is met within an equi-join on night.
    """
    n = windows.groupBy(night).agg(F.count("*").alias("_n"))
    bound = lambda e: F.bround(e * (F.col("_n") / F.lit(float(epochs))), 0).cast("long")
    spans = n.select(night, "_n", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    spans = spans.select(night, "epoch", bound(F.col("epoch")).alias("_a"), bound(F.col("epoch") + 1).alias("_b"))
    return windows.join(spans, night).filter((F.col("win") >= F.col("_a")) & (F.col("win") < F.col("_b"))).drop("_a", "_b")


def aligned_stages(epochs: DataFrame, stages: DataFrame, key: str, unknown: int = -1) -> DataFrame:
    """Every epoch with its stage, unknown where the hypnogram is shorter; stages beyond the epochs are left out."""
    return epochs.join(stages, key, "left").withColumn("stage", F.coalesce("stage", F.lit(unknown)))


def without_leading_wake(stages: DataFrame, night: str) -> DataFrame:
    """Epochs from the first that is not wake; a night of wake alone stays whole."""
    first = F.min(F.when(F.col("stage") != 0, F.col("epoch"))).over(W.Window.partitionBy(night))
    return stages.withColumn("_first", F.coalesce(first, F.lit(0))).filter(F.col("epoch") >= F.col("_first")).drop("_first")


def renumbered(epochs: DataFrame, night: str, *order: str) -> DataFrame:
    return epochs.withColumn("epoch", (F.row_number().over(W.Window.partitionBy(night).orderBy(*order)) - 1).cast("int"))
