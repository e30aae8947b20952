import math

import numpy as np
import pytest

from noctua.functions import kernels as k
from noctua.operators.connectivity import epoch_edges, granger_f, microstates, omega
from noctua.schema import PAIR_BANDS

FS = 250.0
T = np.arange(7500) / FS
RNG = np.random.default_rng(7)
NOISE = RNG.normal(size=7500)
SINE = np.sin(2 * np.pi * 10 * T)


def test_welch_peak_and_parseval():
    f, p = k.welch(SINE, FS)
    assert abs(f[p.argmax()] - 10) < 0.3
    f, p = k.welch(NOISE, FS)
    assert abs(p.sum() * (f[1] - f[0]) - NOISE.var()) < 0.1
    assert abs(sum(v for n, v in k.welch_bands(NOISE, FS).items() if n != "psd_entropy") - 1) < 1e-9


def test_shape_of_sine():
    s = k.spectral_shape(SINE + 0.001 * NOISE, FS)
    assert abs(s["centroid"] - 10) < 0.5
    assert s["sef50"] <= s["sef90"] <= s["sef95"]


def test_entropies():
    assert k.sample_entropy(SINE[:1500], FS)["sample_entropy"] < k.sample_entropy(NOISE[:1500], FS)["sample_entropy"]
    assert k.sample_entropy(np.ones(100), FS) == {}
    assert 0 <= k.approximate_entropy(SINE[:800], FS)["approximate_entropy"] < k.approximate_entropy(NOISE[:800], FS)["approximate_entropy"]


def test_sample_entropy_brute_force():
    x = NOISE[:60]
    r = 0.2 * x.std()
    near = lambda m: sum(max(abs(x[i + t] - x[j + t]) for t in range(m)) < r for i in range(len(x) - 2) for j in range(len(x) - 2) if i != j)
    assert k.sample_entropy(x, FS)["sample_entropy"] == pytest.approx(-math.log(near(3) / near(2)))


def test_fractal():
    assert abs(k.higuchi(np.arange(2000.0), FS)["higuchi_fd"] - 1) < 0.01
    assert abs(k.higuchi(NOISE, FS)["higuchi_fd"] - 2) < 0.1
    assert abs(k.detrended_fluctuation(NOISE, FS)["dfa"] - 0.5) < 0.1
    assert abs(k.detrended_fluctuation(np.cumsum(NOISE), FS)["dfa"] - 1.5) < 0.15


def test_lempel_ziv():
    assert k.lempel_ziv(NOISE, FS)["lz_complexity"] > 0.8
    assert k.lempel_ziv(SINE, FS)["lz_complexity"] < 0.2


def test_wavelet_band():
    w = k.wavelet_power(SINE, FS)
    assert max(w, key=lambda n: w[n] or 0) == "wavelet_alpha"


def test_irasa_slope():
    f = np.fft.rfftfreq(30000, 1 / FS)
    f[0] = f[1]
    x = np.fft.irfft(np.fft.rfft(RNG.normal(size=30000)) / f**0.75)
    assert abs(k.irasa(x, FS)["aperiodic_slope"] + 1.5) < 0.35
    assert k.irasa(np.zeros(2000), FS) == {}


def test_recurrence():
    s, n = k.recurrence(SINE[:1500], FS), k.recurrence(NOISE[:1500], FS)
    assert s["rqa_DET"] > 0.9 > n["rqa_DET"]
    assert k.recurrence(np.ones(500), FS) == {}


def test_autocorrelation_of_cosine():
    a = k.autocorrelation(np.cos(2 * np.pi * 2 * T), FS)
    assert abs(a["acf_zc"] - 0.125) < 0.01
    assert abs(a["acf_first_min"] - 0.25) < 0.01


def test_band_pass_keeps_and_removes():
    x = SINE + np.sin(2 * np.pi * 90 * T)
    assert np.abs(k.band_pass(x, FS, 1, 40) - SINE)[500:-500].max() < 0.05


def test_connectivity():
    x = np.stack([SINE, SINE, np.sin(2 * np.pi * 10 * T - 1), NOISE])
    rows = {(m, b, i, j): v for m, b, i, j, v in epoch_edges(x + 1e-9 * RNG.normal(size=x.shape), list("abcd"), FS, PAIR_BANDS)}
    assert rows["plv", "alpha", "a", "b"] > 0.999
    assert rows["pli", "alpha", "a", "c"] > 0.99
    assert rows["correlation", "broad", "a", "b"] > 0.999
    assert all(0 <= v <= 1 + 1e-9 for (m, *_), v in rows.items() if m != "correlation")


def test_granger_direction():
    x, y = RNG.normal(size=2000), np.zeros(2000)
    for i in range(1, 2000):
        y[i] = 0.5 * y[i - 1] + 0.8 * x[i - 1] + 0.1 * NOISE[i]
    assert granger_f(x, y) > 20 * granger_f(y, x)
    assert granger_f(x[:10], y[:10]) is None


def test_spatial():
    same = np.stack([NOISE] * 3)
    assert abs(omega(same) - 1) < 0.01
    assert abs(omega(RNG.normal(size=(4, 20000))) - 4) < 0.05
    maps = np.eye(4) - 0.25
    x = np.concatenate([maps[[i]].T * RNG.normal(size=(1, 300)) for i in range(4)], 1)
    _, label = microstates(x, 4)
    assert all(len(set(label[i * 300 : (i + 1) * 300])) == 1 for i in range(4)) or len(set(label)) >= 3


def test_median_places_are_those_of_each_threshold():
    for y in (np.random.default_rng(3).normal(size=500), np.round(np.random.default_rng(4).normal(size=64), 1), np.repeat([0.0, 1.0], 50)):
        n, want = len(y), []
        for t in np.arange(0, y.max(), 0.01):
            at = np.flatnonzero(y >= t)
            if len(at) < 0.02 * n or len(at) < 2:
                break
            want.append(np.median(at + 1) / (n / 2) - 1)
        assert k.median_places(y) == want
