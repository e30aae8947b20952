"""Connectivity of channels: an edge table night, epoch, method, band, ch_i, ch_j, value. One task has one epoch's channels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions.kernels import analytic_phase, band_pass
from noctua.schema import PAIR_BANDS

EDGES = "method string, band string, ch_i string, ch_j string, value double"


def cross_spectra(x: np.ndarray, fs: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the channels x channels x bins of mean cross-spectra."""
    size = min(size, x.shape[1] // 2)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    cut = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: max(1, size // 2)]
    f = np.fft.rfft((cut - cut.mean(2, keepdims=True)) * w, axis=2)
    return np.fft.rfftfreq(size, 1 / fs), np.einsum("isf,jsf->ijf", f, f.conj()) / f.shape[1]


def epoch_edges(x: np.ndarray, names: list[str], fs: float, bands: dict) -> list[tuple]:
    f, s = cross_spectra(x, fs)
    auto = np.einsum("iif->if", s).real
    scale = np.sqrt(auto[:, None] * auto[None]) + 1e-300
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x)
    upper = list(zip(*np.triu_indices(len(names), 1), strict=True))
    rows = [("correlation", "broad", names[i], names[j], r[i, j]) for i, j in upper]
    for b, (lo, hi) in bands.items():
        ok = (f >= lo) & (f <= hi)
        if ok.any():
            coherence = (np.abs(s[..., ok]) ** 2 / scale[..., ok] ** 2).mean(2)
            imaginary = np.abs((s[..., ok] / scale[..., ok]).imag).mean(2)
            rows += [(m, b, names[i], names[j], v[i, j]) for m, v in (("coherence", coherence), ("imaginary_coherence", imaginary)) for i, j in upper]
        unit = np.exp(1j * np.stack([analytic_phase(c, fs, lo, hi) for c in x]))
        locked = np.abs(unit @ unit.conj().T) / x.shape[1]
        lagged = np.stack([np.abs(np.sign(np.round((e * unit.conj()).imag, 12)).mean(1)) for e in unit])
        rows += [(m, b, names[i], names[j], v[i, j]) for i, j in upper for m, v in (("plv", locked), ("pli", lagged))]
    return [(*r[:4], float(r[4]) if np.isfinite(r[4]) else None) for r in rows]


def connectivity(segments: DataFrame, keys: list[str], fs: float = 250.0, bands: dict = PAIR_BANDS) -> DataFrame:
    """Coherence, imaginary coherence, phase locking, phase lag and correlation of each pair of channels.

    segments: keys, channel, samples; channels of an epoch of equal length (others are cut to the shortest).
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*keys).schema)

    def run(key, pdf):
        pdf = pdf.sort_values("channel")
        n = min(len(s) for s in pdf["samples"])
        x = np.stack([np.asarray(s, float)[:n] for s in pdf["samples"]])
        rows = epoch_edges(x, list(pdf["channel"]), fs, bands) if len(x) > 1 and n >= 8 and np.isfinite(x).all() else []
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, "method", "band", "ch_i", "ch_j", "value"])

    return segments.select(*keys, "channel", "samples").groupBy(*keys).applyInPandas(run, f"{schema}, {EDGES}")


def by_region(segments: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, samples with a region in a channel's place: the mean of its channels, sample by sample.

    regions: channel, region, a row a channel. Channels of no region are left out; a region's channels are those of one
    epoch, cut to the shortest.
    """
    told = segments.select(*keys, "channel", "samples").join(F.broadcast(regions.select("channel", "region")), "channel")
    stacked = told.groupBy(*keys, "region").agg(F.collect_list("samples").alias("_s"), F.min(F.size("samples")).alias("_n"))
    at = lambda i: F.aggregate("_s", F.lit(0.0), lambda a, s: a + s[i]) / F.size("_s")
    places = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    return stacked.select(*keys, F.col("region").alias("channel"), F.transform(places, at).alias("samples"))


def granger_f(x: np.ndarray, y: np.ndarray, lag: int = 5) -> float | None:
    """F of x's past on y, given y's own past."""
    return granger_all([x], y, lag)[0]


def granger_all(sources: list[np.ndarray], y: np.ndarray, lag: int = 5) -> list[float | None]:
    """F of each source's past on y: y's own regression is solved once, and a source's past is tested on what it leaves."""
    n = len(y) - lag
    if n <= 2 * lag + 1:
        return [None] * len(sources)
    past = lambda v: np.stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)], 1)
    q, _ = np.linalg.qr(np.column_stack([np.ones(n), past(y)]))
    clear = lambda a: a - q @ (q.T @ a)
    rest, out = clear(y[lag:]), []
    for x in sources:
        theirs = clear(past(x))
        u = float(((rest - theirs @ np.linalg.lstsq(theirs, rest, rcond=1e-12)[0]) ** 2).sum())
        out.append((float(rest @ rest) - u) / lag / (u / (n - 2 * lag - 1)) if u > 0 else None)
    return out


def granger(segments: DataFrame, keys: list[str], lag: int = 5, bands: dict | None = None, fs: float = 250.0) -> DataFrame:
    """keys, band, source, target, f of each ordered pair of channels; without bands, one named broad of the signals as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*keys).schema)

    def run(key, pdf):
        whole = {c: np.asarray(s, float) for c, s in zip(pdf["channel"], pdf["samples"], strict=True)}
        rows = []
        for band, edges in (bands or {"broad": None}).items():
            signal = {c: band_pass(x, fs, *edges) for c, x in whole.items()} if edges else whole
            for b in signal:
                others = [a for a in signal if a != b and len(signal[a]) == len(signal[b])]
                rows += [(*key, band, a, b, f) for a, f in zip(others, granger_all([signal[a] for a in others], signal[b], lag), strict=True)]
        return pd.DataFrame(rows, columns=[*keys, "band", "source", "target", "f"])

    return segments.select(*keys, "channel", "samples").groupBy(*keys).applyInPandas(run, f"{schema}, band string, source string, target string, f double")


def omega(x: np.ndarray) -> float:
    """exp of the entropy of the normalised eigenvalues of the channels' covariance."""
    v = np.maximum(np.linalg.eigvalsh(np.cov(x) + 1e-10 * np.eye(len(x))), 1e-15)
    v = v / v.sum()
    return float(np.exp(-(v * np.log(v)).sum()))


def microstates(x: np.ndarray, k: int = 4, seed: int = 42, rounds: int = 100, maps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(maps, label of each sample) by modified k-means: polarity does not count. Maps begin as given or as samples at random."""
    x = x - x.mean(0)
    if maps is None:
        maps = x[:, np.random.default_rng(seed).choice(x.shape[1], k, replace=False)].T
    maps = maps / (np.linalg.norm(maps, axis=1, keepdims=True) + 1e-12)
    label = None
    for _ in range(rounds):
        new = ((maps @ x) ** 2).argmax(0)
        if label is not None and (new == label).all():
            break
        label = new
        for i in range(k):
            if (label == i).any():
                s = x[:, label == i]
                maps[i] = np.linalg.eigh(s @ s.T)[1][:, -1]
    return maps, label


def spatial(segments: DataFrame, keys: list[str], states: int = 4) -> DataFrame:
    """keys, omega, and the share of samples of each microstate, the largest first."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*keys).schema)

    def run(key, pdf):
        n = min(len(s) for s in pdf["samples"])
        x = np.stack([np.asarray(s, float)[:n] for s in pdf.sort_values("channel")["samples"]])
        if len(x) < 2 or n < states or not np.isfinite(x).all():
            return pd.DataFrame([(*key, None, None)], columns=[*keys, "omega", "coverage"])
        _, label = microstates(x, states)
        share = sorted((np.bincount(label, minlength=states) / n).tolist(), reverse=True)
        return pd.DataFrame([(*key, omega(x), share)], columns=[*keys, "omega", "coverage"])

    return segments.select(*keys, "channel", "samples").groupBy(*keys).applyInPandas(run, f"{schema}, omega double, coverage array<double>")
