"""Percentiles against numpy, Granger's F against plain regressions, path lengths against a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.functions import kernels
from noctua.operators import channels, connectivity, features, quality
from noctua.sources import tables


@pytest.mark.parametrize("seed", range(3))
def test_exact_percentiles(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.pareto(0.5, 500) * 10.0 ** (6 * seed)])
    df = spark.createDataFrame([(float(v), None if i % 7 else float(i), 1.0, None) for i, v in enumerate(x)], "x double, y double, flat double, none double")
    got = quality.exact_percentiles(df, ["x", "y", "flat", "none"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    q = [0, 10, 25, 50, 75, 100]
    assert np.allclose(got["x"], np.percentile(x, q), rtol=1e-12)
    assert np.allclose(got["y"], np.percentile([i for i in range(len(x)) if i % 7 == 0], q))
    assert got["flat"] == [1.0] * 6 and got["none"] == [None] * 6


def plain_f(x, y, lag):
    n = len(y) - lag
    past = lambda v: np.stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)], 1)
    own = np.column_stack([np.ones(n), past(y)])
    both = np.column_stack([own, past(x)])
    rss = lambda a: ((y[lag:] - a @ np.linalg.lstsq(a, y[lag:], rcond=None)[0]) ** 2).sum()
    return (rss(own) - rss(both)) / lag / (rss(both) / (n - 2 * lag - 1))


def test_granger_f():
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, 400))
    y = np.concatenate([[0], 0.5 * x[:-1]]) + rng.normal(size=400)
    assert connectivity.granger_all([x, z], y) == pytest.approx([plain_f(x, y, 5), plain_f(z, y, 5)])


def test_path_lengths(spark):
    """A chain of four with strong edges, a pair apart: the chain is the largest component."""
    names = "abcdef"
    strong = {("a", "b"), ("b", "c"), ("c", "d"), ("e", "f")}
    rows = [(1, p, q, 0.9 if (p, q) in strong else 0.1) for i, p in enumerate(names) for q in names[i + 1 :]]
    r = channels.path_lengths(spark.createDataFrame(rows, "night int, ch_i string, ch_j string, value double"), ["night"], 0.7).first()
    assert (r.largest, r.path_length) == (4, pytest.approx((3 * 1 + 2 * 2 + 1 * 3) / 6))


def test_pipeline_csv_needs_two_files(spark, tmp_path):
    spark.createDataFrame([(1, 0, 2.0)], "night int, epoch int, x double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/one")
    with pytest.raises(ValueError, match="at least 2"):
        tables.load_pipeline_csv(spark, f"{tmp_path}/one")


def test_night_from_the_file_name(spark, tmp_path):
    (tmp_path / "features_night12.csv").write_text("epoch,x,Unnamed: 0\n0,1.5,9\n1,2.5,9\n")
    got = tables.read_feature_csv(spark, f"file://{tmp_path}/features_night12.csv")
    assert sorted(got.columns) == ["epoch", "night", "x"] and got.agg(F.min("night"), F.sum("x")).first()[:] == (12, 4.0)


def test_granger_bands(spark):
    rng = np.random.default_rng(3)
    x = {c: rng.normal(size=200) for c in "ab"}
    rows = spark.createDataFrame([(1, c, v.tolist()) for c, v in x.items()], "night int, channel string, samples array<double>")
    bands = {"theta": (4.0, 8.0), "alpha": (8.0, 12.0)}
    got = {(r.band, r.source, r.target): r.f for r in connectivity.granger(rows, ["night"], 2, bands, 64.0).collect()}
    assert len(got) == 4
    for b, e in bands.items():
        y = {c: kernels.band_pass(v, 64.0, *e) for c, v in x.items()}
        assert got[b, "a", "b"] == pytest.approx(plain_f(y["a"], y["b"], 2), rel=1e-4)


def test_regions_cut_and_left_out(spark):
    rows = spark.createDataFrame([(1, "p", [1.0, 2.0, 9.0]), (1, "q", [3.0, 6.0]), (1, "r", [5.0]), (1, "none", [7.0])], "night int, channel string, samples array<double>")
    regions = spark.createDataFrame([("p", "one"), ("q", "one"), ("r", "two")], "channel string, region string")
    assert {(r.channel, tuple(r.samples)) for r in connectivity.by_region(rows, regions, ["night"]).collect()} == {("one", (2.0, 4.0)), ("two", (5.0,))}


def test_at_rate(spark):
    wave = lambda fs: np.sin(2 * np.pi * 5 * np.arange(int(2 * fs)) / fs).tolist()
    rows = spark.createDataFrame([(1, wave(250)), (2, None), (3, []), (4, [1.0, float("nan"), 2.0])], "night int, samples array<double>")
    got = {r.night: r.samples for r in features.at_rate(rows, ["night"], 250.0, 100.0).collect()}
    assert got.pop(1) == pytest.approx(wave(100), abs=1e-9)
    assert got == {2: None, 3: None, 4: None}
