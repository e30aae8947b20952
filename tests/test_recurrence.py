import numpy as np
import pytest

from noctua.functions import kernels
from noctua.operators import recurrence

NAMES = {"rate": "rqa_RR", "determinism": "rqa_DET", "laminarity": "rqa_LAM", "longest": "rqa_L_max", "mean_length": "rqa_L_mean", "trapping": "rqa_TT", "entropy": "rqa_ENTR"}


def signals():
    rng = np.random.default_rng(5)
    return {1: rng.normal(size=400), 2: np.sin(np.arange(300) / 7), 3: np.cumsum(rng.normal(size=500)), 4: rng.integers(0, 3, 200) * 1.0, 5: np.r_[np.zeros(150), 1.0, np.zeros(49)]}


@pytest.mark.parametrize(("m", "tau", "decimate"), [(3, 1, 5), (2, 2, 1)])
def test_lines_like_the_whole_matrix(spark, m, tau, decimate):
    rows = [(k, v.tolist()) for k, v in signals().items()]
    odd = [(6, None), (7, [1.0] * 100), (8, [1.0, 2.0]), (9, [1.0, float("nan")] * 60), (10, []), (11, [1.0, None] * 60)]
    df = spark.createDataFrame(rows + odd, "epoch int, samples array<double>")
    got = {r.epoch: r.asDict() for r in recurrence.recurrence(df, ["epoch"], m, tau, decimate=decimate).collect()}
    assert sorted(got) == sorted(signals())
    for k, x in signals().items():
        want = kernels.recurrence(x, 250.0, m=m, tau=tau, decimate=decimate)
        for mine, theirs in NAMES.items():
            assert got[k][mine] == (pytest.approx(want[theirs], abs=1e-9) if theirs in want else None), (k, mine)


def test_diameter_like_all_pairs(spark):
    rng = np.random.default_rng(2)
    sets = {k: v for k, v in enumerate([rng.normal(size=120), rng.uniform(size=90), np.cos(np.arange(80)), np.r_[np.zeros(40), 3.0]])}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in sets.items()], "epoch int, samples array<double>")
    got = {r.epoch: r.diameter for r in recurrence.diameters(recurrence.templates(df, ["epoch"]), ["epoch"]).collect()}
    for k, x in sets.items():
        t = np.lib.stride_tricks.sliding_window_view(x, 3)
        assert got[k] == pytest.approx(np.sqrt(((t[:, None] - t[None]) ** 2).sum(2)).max(), abs=1e-12)


def pairs_by_pair(x, m, r, strict):
    t = np.lib.stride_tricks.sliding_window_view(x, m)
    apart = np.abs(t[:, None] - t[None]).max(2)
    return (apart < r if strict else apart <= r).sum(1)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("m", [2, 3])
def test_counts_without_pairs(monkeypatch, m, strict):
    """Counts by cells are those of all pairs, with ties, repeats, constant runs and radii on the lattice."""
    monkeypatch.setattr(kernels, "FEW_TEMPLATES", 0)
    for x in [*signals().values(), np.arange(7.0), np.zeros(40), np.array([1.0, 2.0, 1.0, 2.0])]:
        for r in (0.2 * x.std(), 1.0, 0.5):
            assert (kernels.template_matches(x, m, r, strict) == pairs_by_pair(x, m, r, strict)).all()


def test_a_whole_epoch():
    x = np.cumsum(np.random.default_rng(3).normal(size=7500))
    some = slice(0, 200)
    t = np.lib.stride_tricks.sliding_window_view(x, 3)
    want = (np.abs(t[some, None] - t[None]).max(2) < 0.2 * x.std()).sum(1)
    assert (kernels.template_matches(x, 3, 0.2 * x.std(), True)[some] == want).all()


def odd_rows():
    return [(6, None), (7, [1.0] * 100), (8, [1.0, 2.0]), (9, [1.0, float("nan")] * 60), (10, []), (11, [1.0, None] * 60), (None, [1.0, 2.0, 4.0] * 40), (12, [float(i % 4) for i in range(14)]), (13, [float(2**i) for i in range(11)])]


@pytest.mark.parametrize(("m", "tau", "decimate", "shortest", "share"), [(3, 1, 1, 2, 0.3), (2, 2, 3, 3, 0.1), (4, 3, 1, 2, 0.001)])
def test_tasks_and_grid_give_the_same(spark, m, tau, decimate, shortest, share):
    """Whatever number of templates is few: none, some, all."""
    df = spark.createDataFrame([(k, v.tolist()) for k, v in signals().items()] + odd_rows(), "epoch int, samples array<double>")
    got = [{r.epoch: r.asDict() for r in recurrence.recurrence(df, ["epoch"], m, tau, share, shortest, decimate, few).collect()} for few in (0, 300, 2048)]
    assert {1, 2, 3, 4, 5} <= set(got[0]) <= {1, 2, 3, 4, 5, 12}
    for k, x in signals().items():
        want = kernels.recurrence(x, 250.0, m=m, tau=tau, share=share, shortest=shortest, decimate=decimate)
        for mine, theirs in NAMES.items():
            assert got[0][k][mine] == (pytest.approx(want[theirs], abs=1e-9) if theirs in want else None), (k, mine)
    for other in got[1:]:
        assert set(other) == set(got[0])
        for k, row in got[0].items():
            assert other[k] == {c: v if v is None else pytest.approx(v, abs=1e-9) for c, v in row.items()}, k


def test_short_segments_are_not_exploded(spark, monkeypatch):
    """No template of a short segment becomes a row that moves; two keys, lengths mixed, floats."""
    made, plain = [], recurrence.templates
    monkeypatch.setattr(recurrence, "templates", lambda *a, **b: made.append(plain(*a, **b)) or made[-1])
    rng = np.random.default_rng(8)
    rows = [(f"n{i % 3}", i, rng.normal(size=64 - i % 5).tolist()) for i in range(40)]
    got = recurrence.recurrence(spark.createDataFrame(rows, "night string, epoch int, samples array<float>"), ["night", "epoch"], share=0.3, decimate=1).collect()
    assert sum(t.count() for t in made) == 0
    assert sorted((r.night, r.epoch, r.n) for r in got) == sorted((a, b, len(x) - 2) for a, b, x in rows)
    for r in got:
        want = kernels.recurrence(np.float32(rows[r.epoch][2]).astype(float), 250.0, share=0.3, decimate=1)
        for mine, theirs in NAMES.items():
            assert r[mine] == (pytest.approx(want[theirs], abs=1e-9) if theirs in want else None), (r.epoch, mine)


def test_diameter_of_segments_with_null_keys(spark):
    points = recurrence.templates(spark.createDataFrame([(1, [0.0, 3.0, 4.0, 0.0]), (None, [0.0, 9.0, 1.0, 2.0])], "epoch int, samples array<double>"), ["epoch"])
    assert [(r.epoch, r.n) for r in recurrence.diameters(points, ["epoch"]).collect()] == [(1, 2)]
