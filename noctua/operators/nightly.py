"""Dependence across nights: autocorrelation, cross-correlation, weekly rhythm, rolling correlation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.schema import MAX_LAG


def z_of(alpha: float = 0.05) -> float:
    """The two-sided quantile of the normal law."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def lagged_pairs(series: DataFrame, x: str, y: str, lags: list[int]) -> DataFrame:
    """lag, x at i, y at i + lag. A night series has a row a night; lags are few, so that the lag table goes to the rows."""
    left = series.select(F.col("idx"), F.col(x).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    right = series.select(F.col("idx").alias("_j"), F.col(y).alias("y"))
    return left.join(right, F.col("_j") == F.col("idx") + F.col("lag")).select("lag", "idx", "x", "y")


def acf(series: DataFrame, column: str, max_lag: int = MAX_LAG, least: int = 10) -> DataFrame:
    """lag, acf, bound, significant: biased autocorrelation; no rows for fewer than `least` nights or no variance."""
    stats = series.agg(F.avg(column).alias("_m"), F.var_pop(column).alias("_v"), F.count(column).alias("_n"))
    pairs = lagged_pairs(series, column, column, list(range(max_lag + 1))).join(F.broadcast(stats))  # one row of sums
    r = F.sum((F.col("x") - F.col("_m")) * (F.col("y") - F.col("_m"))) / F.max(F.col("_n") * F.col("_v"))
    out = pairs.filter((F.col("_n") >= least) & (F.col("_v") > 0)).groupBy("lag").agg(r.alias("acf"), (F.lit(z_of()) / F.sqrt(F.max("_n"))).alias("bound"))
    return out.withColumn("significant", (F.col("lag") > 0) & (F.abs("acf") > F.col("bound")))


def pacf(series: DataFrame, column: str, max_lag: int = MAX_LAG) -> DataFrame:
    """lag, pacf by Levinson-Durbin on the autocorrelations, at most max_lag + 1 numbers."""
    r = [x.acf for x in acf(series, column, max_lag).orderBy("lag").collect()]
    out, phi = [(0, 1.0)] if r else [], np.zeros(0)
    for k in range(1, len(r)):
        rho = np.array(r[1:k])
        a = (r[k] - phi @ rho[::-1]) / (1 - phi @ rho) if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append((k, float(a)))
    return series.sparkSession.createDataFrame(out, "lag int, pacf double")


def ccf(series: DataFrame, x: str, y: str, max_lag: int = 10) -> DataFrame:
    """lag, r: Pearson correlation of the overlapping parts; at positive lags x leads."""
    return lagged_pairs(series, x, y, list(range(-max_lag, max_lag + 1))).groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def weekly_rhythm(series: DataFrame, column: str, permutations: int = 1000, seed: int = 42, least: int = 14) -> DataFrame:
    """r7, n, p: the lag-7 autocorrelation against seeded permutations of the nights, two-sided. Null for fewer than `least` nights."""
    stats = series.agg(F.avg(column).alias("m"), F.count(column).alias("n"), (F.var_pop(column) * F.count(column)).alias("ss"))
    drawn = series.select(F.col("idx"), F.col(column).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    mixed = F.when(F.col("perm") == 0, F.col("idx")).otherwise(F.xxhash64("idx", "perm", F.lit(seed)))
    w = W.Window.partitionBy("perm").orderBy(mixed, "idx")
    lagged = drawn.select("perm", "x", F.lead("x", 7).over(w).alias("y")).filter("y is not null").join(F.broadcast(stats))
    each = lagged.groupBy("perm").agg((F.sum((F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))) / F.max("ss")).alias("r"), F.max("n").alias("n"))
    true = F.max(F.when(F.col("perm") == 0, F.col("r")))
    both = each.withColumn("r7", F.max(F.when(F.col("perm") == 0, F.col("r"))).over(W.Window.partitionBy(F.lit(0))))
    out = both.groupBy().agg(true.alias("r7"), F.max("n").alias("n"), ((F.count_if((F.col("perm") > 0) & (F.abs("r") >= F.abs("r7"))) + 1) / F.lit(permutations + 1.0)).alias("p"))
    return out.filter(F.col("n") >= least)


def rolling_acf(series: DataFrame, column: str, lag: int, window: int = 20) -> DataFrame:
    """idx of a window's middle, r of the pairs within the window; whole windows only."""
    order = W.Window.partitionBy(F.lit(0)).orderBy("idx")
    pairs = series.select("idx", F.col(column).alias("x"), F.lead(column, lag).over(order).alias("y"))
    frame = order.rowsBetween(0, window - lag - 1)
    r = F.when(F.count("y").over(frame) == window - lag, F.corr("x", "y").over(frame))
    return pairs.select((F.col("idx") + window // 2).alias("idx"), F.lit(lag).alias("lag"), r.alias("r")).filter("r is not null")


def report(series: DataFrame, columns: list[str], lags=(1, 3, 7, 14)) -> DataFrame:
    """metric, mean, sd, and the autocorrelations at a few lags with their significance."""
    out = None
    for c in columns:
        stats = series.agg(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
        at = acf(series, c, max(lags)).groupBy().agg(*[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"acf{k}") for k in lags], *[F.max(F.when(F.col("lag") == k, F.col("significant"))).alias(f"sig{k}") for k in lags])
        row = stats.join(at)
        out = row if out is None else out.unionByName(row)
    return out


def metric_matrix(series: DataFrame, columns: list[str], max_lag: int = 10) -> DataFrame:
    """metric_i, metric_j, lag, r: for each pair the lag of the largest |r|; a metric with itself lags by 1 at least."""
    out = None
    for a in columns:
        for b in columns:
            told = ccf(series, a, b, max_lag).filter("r is not null")
            if a == b:
                told = told.filter("lag > 0")
            best = told.agg(F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("m"))
            row = best.select(F.lit(a).alias("metric_i"), F.lit(b).alias("metric_j"), "m.lag", "m.r")
            out = row if out is None else out.unionByName(row)
    return out
