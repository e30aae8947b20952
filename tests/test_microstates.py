import numpy as np
import pytest

from noctua.operators import connectivity, microstates

NAMES = ["C0", "C1", "C2", "C3", "C4"]


def planted(seed, n=600, noise=0.05):
    """Five channels in runs of four planted maps."""
    rng = np.random.default_rng(seed)
    maps = np.linalg.qr(rng.normal(size=(5, 5)) - 0.0)[0][:4]
    maps = maps - maps.mean(1, keepdims=True)
    label = np.repeat(rng.integers(0, 4, n // 10 + 1), 10)[:n]
    return maps / np.linalg.norm(maps, axis=1, keepdims=True), label, (maps[label] * rng.normal(1, 2, (n, 1))).T + noise * rng.normal(size=(5, n))


def rows_of(night, x, size, left_out=()):
    return [(night, e, c, x[i, e * size : (e + 1) * size].tolist()) for e in range(x.shape[1] // size) if e not in left_out for i, c in enumerate(NAMES)]


SCHEMA = "night string, epoch int, channel string, samples array<double>"


def test_as_on_one_machine(spark):
    """Maps, labels and durations are those of the local version on all samples in a row, from the same start."""
    signals = {"a": planted(1)[2], "b": planted(2)[2]}
    df = spark.createDataFrame([r for k, x in signals.items() for r in rows_of(k, x, 60)], SCHEMA).repartition(5)
    begin = {k: np.random.default_rng(7).normal(size=(4, 5)) for k in signals}
    start = spark.createDataFrame([(k, s, m.tolist()) for k, ms in begin.items() for s, m in enumerate(ms)], "night string, state int, map array<double>")
    maps, runs = microstates.segmented(df, ["night"], "epoch", tolerance=1e-12, start=start)
    found = {(r.night, r.state): np.array(r.map) for r in maps.collect()}
    metrics = {(r.night, r.state): r for r in microstates.state_metrics(runs, ["night"], "epoch", 60.0).collect()}
    for k, x in signals.items():
        want, label = connectivity.microstates(x, 4, maps=begin[k].copy())
        assert all(abs(found[k, s] @ want[s]) == pytest.approx(1, abs=1e-6) for s in range(4))
        for s in range(4):
            starts = int(((label == s) & (np.r_[-1, label[:-1]] != s)).sum())
            assert (metrics[k, s].samples, metrics[k, s].runs) == ((label == s).sum(), starts)
            assert metrics[k, s].per_second == pytest.approx(starts / (len(label) / 60.0))


def test_planted_maps_and_any_deal(spark):
    """The planted maps come back; the result does not depend on partitions or on the way that maps reach the scans."""
    true, _, x = planted(3, 1200, 0.01)
    df = spark.createDataFrame(rows_of("a", x, 100), SCHEMA)
    one = {r.state: np.array(r.map) for r in microstates.segmented(df.repartition(1), ["night"], "epoch", tolerance=1e-12)[0].collect()}
    two = {r.state: np.array(r.map) for r in microstates.segmented(df.repartition(7), ["night"], "epoch", tolerance=1e-12)[0].collect()}
    assert all(abs(one[s] @ two[s]) > 1 - 1e-9 for s in range(4))
    likeness = np.abs(np.stack([one[s] for s in range(4)]) @ true.T)
    assert (likeness.max(1) > 0.95).sum() >= 3


def test_missing_epochs_and_odd_rows(spark, monkeypatch):
    _, _, x = planted(4, 300)
    odd = [("a", 3, "C0", [1.0] * 60), ("b", 0, "C0", [1.0, 2.0]), ("b", 0, "C1", [float("nan"), 1.0]), ("c", 0, "C0", None), ("d", 0, "C0", [1.0]), ("d", 0, "C1", [2.0])]
    df = spark.createDataFrame(rows_of("a", x, 60, left_out={1, 3}) + odd, SCHEMA)
    monkeypatch.setattr(microstates, "BROADCAST_RECORDINGS", 0)
    monkeypatch.setattr(microstates, "SUMS_HELD", 0)
    _, runs = microstates.segmented(df, ["night"], "epoch")
    rows = runs.collect()
    # epoch 3 of a has one channel of five; b has no finite epoch, c no samples; d has one sample and so one state
    assert {(r.night, r.epoch) for r in rows} == {("a", 0), ("a", 2), ("a", 4), ("d", 0)}
    metrics = microstates.state_metrics(runs, ["night"], "epoch", 60.0)
    each = [r for r in rows if r.night == "a"]
    assert metrics.filter("night = 'a'").agg({"runs": "sum"}).first()[0] == len(each)  # no two epochs follow one another
    assert {(r.samples, r.coverage) for r in metrics.filter("night = 'd'").collect()} == {(1, 1.0)}


def test_runs_over_epochs(spark):
    rows = [("a", 0, 0, 4, 10, 1), ("a", 0, 4, 6, 10, 2), ("a", 1, 0, 10, 10, 2), ("a", 2, 0, 3, 10, 2), ("a", 2, 3, 4, 10, 1), ("a", 2, 7, 3, 10, 2), ("a", 4, 0, 10, 10, 2)]
    df = spark.createDataFrame(rows, "night string, epoch int, place long, length long, n long, state int")
    got = {r.state: r for r in microstates.state_metrics(df, ["night"], "epoch", 1.0).collect()}
    assert (got[1].samples, got[1].runs) == (8, 2)
    assert (got[2].samples, got[2].runs, got[2].mean_duration_s) == (32, 3, pytest.approx(32 / 3))
    empty = df.filter("false")
    assert microstates.state_metrics(empty, ["night"], "epoch").count() == 0
