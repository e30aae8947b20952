"""Spectra as tables: band power, entropy, moments, edges and log-log fits over a row a bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.schema import BANDS


def band_power(power: DataFrame, keys: list[str], hz: float = 1.0, bands=BANDS) -> DataFrame:
    """keys, then the relative power of each band; band edges belong to the band."""
    f = F.col("k") * hz
    sums = power.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(f.between(*e), F.col("power"))), F.lit(0.0)).alias(b) for b, e in bands.items()])
    whole = sum((F.col(b) for b in bands), F.lit(0.0))
    return sums.select(*keys, *[F.try_divide(F.col(b), whole).alias(b) for b in bands])


def spectral_entropy(power: DataFrame, keys: list[str]) -> DataFrame:
    share = F.try_divide(F.col("power"), F.sum("power").over(W.Window.partitionBy(*keys)))
    shared = power.withColumn("p", share).filter("p > 0")
    return shared.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def spectral_moments(power: DataFrame, keys: list[str], hz: float = 1.0) -> DataFrame:
    """Centroid, spread, and the edges below which 50, 90 and 95 % of the power lie (shares of the sum, not of an integral)."""
    w = W.Window.partitionBy(*keys)
    p = F.try_divide(F.col("power"), F.sum("power").over(w))
    run = F.try_divide(F.sum("power").over(w.orderBy("k")), F.sum("power").over(w))
    told = power.select(*keys, (F.col("k") * F.lit(hz)).alias("f"), p.alias("p"), run.alias("run"))
    edge = lambda q: F.min(F.when(F.col("run") >= q, F.col("f"))).alias(f"sef{round(q * 100)}")
    out = told.groupBy(*keys).agg(F.sum(F.col("p") * F.col("f")).alias("centroid"), F.sum(F.col("p") * F.col("f") * F.col("f")).alias("_q"), edge(0.5), edge(0.9), edge(0.95))
    return out.withColumn("spread", F.sqrt(F.greatest(F.col("_q") - F.col("centroid") * F.col("centroid"), F.lit(0.0)))).drop("_q")


def log_log_fit(power: DataFrame, keys: list[str], hz: float = 1.0) -> DataFrame:
    """Slope, intercept and beta of log10 power on log10 frequency, over bins with power."""
    x, y = F.log10(F.col("k") * hz), F.log10("power")
    told = power.filter((F.col("power") > 0) & (F.col("k") > 0)).select(*keys, x.alias("x"), y.alias("y"))
    out = told.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("bins"))
    return out.filter("bins >= 3").withColumn("beta", -F.col("slope"))


def permutation_entropy(samples: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Entropy of the order patterns of three samples in a row; equal values rank by place."""
    w = W.Window.partitionBy(group).orderBy(order)
    t = samples.select(group, F.col(value).alias("a"), F.lead(value).over(w).alias("b"), F.lead(value, 2).over(w).alias("c")).filter("c is not null")
    pattern = (F.col("a") <= F.col("b")).cast("int") * 4 + (F.col("b") <= F.col("c")).cast("int") * 2 + (F.col("a") <= F.col("c")).cast("int")
    n = t.groupBy(group, pattern.alias("pattern")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.Window.partitionBy(group))
    return n.select(group, p.alias("p")).groupBy(group).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


