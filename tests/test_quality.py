"""Percentiles with infinities and wide ranges, k-means with all starts in one scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.operators import quality

INF = float("inf")


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, INF], [-INF, -INF, 5.0, 1.7e308, -1.7e308, 0.0], [INF, -INF], [5e-324, 0.0, 1e-323, -5e-324], [1.7e308, -1.7e308, 1.0, 2.0, 3.0, 4.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, INF, float("nan")]])
def test_percentiles_end(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = sorted(v for v in values if not math.isnan(v))
    shares = [0.0, 0.2, 0.25, 0.5, 0.75, 1.0]
    want = []
    for q in shares:
        p = q * (len(x) - 1)
        want.append(quality.between_ranks(x[math.floor(p)], x[math.ceil(p)], p - math.floor(p)))
    assert quality.exact_percentiles(df, ["x"], shares)["x"] == want


def test_percentiles_of_many_in_few_scans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=60000), np.repeat(0.5, 20000), rng.pareto(0.3, 5000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    q = [0.0, 0.003, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert np.allclose(quality.exact_percentiles(df, ["x"], q)["x"], np.percentile(x, [100 * v for v in q]), rtol=1e-12)


def test_clusters_of_many_starts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(9, 3)) * 6
    x = np.concatenate([m + rng.normal(size=(150, 3)) for m in middles])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(9999, None, 1.0, 1.0)], "id int, a double, b double, c double").repartition(3)
    scans, real = [], quality.centre_sums
    monkeypatch.setattr(quality, "centre_sums", lambda *a: scans.append(len(a[2])) or real(*a))
    rows, cost, silhouette = quality.clustered(df, ["a", "b", "c"], 9, seeds=8)
    many = len(scans)
    got = rows.toPandas()
    assert len(got) == len(x)
    centres = got.groupby("cluster")[["a", "b", "c"]].mean().to_numpy()
    assert cost == pytest.approx(sum(((g[["a", "b", "c"]].to_numpy() - g[["a", "b", "c"]].to_numpy().mean(0)) ** 2).sum() for _, g in got.groupby("cluster")), rel=1e-3)
    sample, single, rounds = np.array(sorted(map(tuple, x))), [], []
    for m in range(8):  # plain rounds from the same beginnings
        c = quality.first_centres(sample, 9, np.random.default_rng((42, m)))
        for n in range(500):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(9)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var(0).mean():
                break
        single.append(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
        rounds.append(n + 1)
    assert cost == pytest.approx(min(single)) and many == max(rounds) + 1 and sum(scans) == sum(rounds) + 8
    assert len(centres) == 9 and silhouette() > 0.5
    assert quality.clustered(df.filter("id < 0"), ["a"], 3)[0].count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "`a-b c` double")
    assert quality.exact_percentiles(df, ["a-b c"], [0.5]) == {"a-b c": [2.0]} and df.agg(F.max("`a-b c`")).first()[0] == 3.0


def test_equal_rows_count_as_often_as_they_are(spark, monkeypatch):
    base = spark.range(300).select((F.col("id") % 97 * 1.5).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    copies = base.crossJoin(spark.range(8).select(F.col("id").alias("copy")))
    scanned, sums = [], quality.centre_sums
    monkeypatch.setattr(quality, "centre_sums", lambda rows, *rest: (scanned.append(rows.count()), sums(rows, *rest))[1])
    rows, cost, _ = quality.clustered(copies, ["a", "b"], 3, seeds=2)
    assert set(scanned) == {base.distinct().count()}
    told = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.sum("a").alias("_s")).collect()
    assert sum(r.n for r in told) == 2400
    plain = rows.join(F.broadcast(spark.createDataFrame([(r.cluster, r.a, r.b) for r in told], "cluster int, ca double, cb double")), "cluster")
    assert abs(plain.agg(F.sum((F.col("a") - F.col("ca")) ** 2 + (F.col("b") - F.col("cb")) ** 2)).first()[0] / cost - 1) < 1e-3
