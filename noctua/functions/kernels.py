"""Kernels on one epoch's samples, in numpy: those that built-in expressions cannot say. x: samples, fs: rate.

Each returns a dict of doubles; a value that is not defined (too few samples, no variance) is None. They run inside
one Arrow pass over the segments, whatever their number: see noctua.operators.features.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from noctua.schema import BANDS

FEW_TEMPLATES = 512

KERNELS: dict[str, tuple[Callable, list[str]]] = {}


def kernel(*names: str):
    def put(f):
        KERNELS[f.__name__] = (f, list(names))
        return f

    return put


@lru_cache(maxsize=512)
def hann(size: int, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window, the frequencies of its transform, and what turns a squared transform into a one-sided density."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    scale = np.full(size // 2 + 1, 1 / (fs * (w * w).sum()))
    scale[1 : -1 if size % 2 == 0 else None] *= 2
    return w, np.fft.rfftfreq(size, 1 / fs), scale


def welch(x: np.ndarray, fs: float, size: int = 1024, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density: Hann windows of at most `size`, half overlapped, each less its mean."""
    size = min(size, len(x))
    step = step or max(1, size // 2)
    w, f, scale = hann(size, fs)
    cut = x[None] if len(x) < size + step else np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    cut = cut[:, :size]
    g = np.fft.rfft((cut - cut.mean(1, keepdims=True)) * w, axis=1)
    return f.copy(), (g.real**2 + g.imag**2).mean(0) * scale


def band_sums(f, p, bands=BANDS) -> dict[str, float]:
    return {b: float(p[(f >= lo) & (f <= hi)].sum()) for b, (lo, hi) in bands.items()}


@kernel("psd_delta", "psd_theta", "psd_alpha", "psd_beta", "psd_gamma", "psd_entropy")
def welch_bands(x, fs):
    f, p = welch(x, fs)
    sums = band_sums(f, p)
    whole, q = sum(sums.values()), p[p > 0] / p.sum() if p.sum() > 0 else np.zeros(0)
    return {f"psd_{b}": v / whole if whole else None for b, v in sums.items()} | {"psd_entropy": float(-(q * np.log2(q)).sum()) if len(q) else None}


@kernel("centroid", "spread", "skewness", "kurtosis", "sef50", "sef90", "sef95", "theta_beta_ratio", "delta_alpha_ratio", "alpha_beta_ratio")
def spectral_shape(x, fs):
    f, p = welch(x, fs)
    ok = (f >= 0.5) & (f <= 40) & (p > 0)
    f, p = f[ok], p[ok]
    if len(f) < 3:
        return {}
    whole = np.trapezoid(p, f)
    c = np.trapezoid(f * p, f) / whole
    s = math.sqrt(max(np.trapezoid((f - c) ** 2 * p, f) / whole, 0))
    m = lambda k: float(np.trapezoid((f - c) ** k * p, f) / whole / s**k) if s else None
    run = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(f))]) / whole
    edge = lambda q: float(f[np.searchsorted(run, q).clip(0, len(f) - 1)])
    b = {k: max(v, 1e-12) for k, v in band_sums(f, p).items()}
    return {
        "centroid": float(c), "spread": s, "skewness": m(3), "kurtosis": m(4), "sef50": edge(0.5), "sef90": edge(0.9), "sef95": edge(0.95),
        "theta_beta_ratio": b["theta"] / b["beta"], "delta_alpha_ratio": b["delta"] / b["alpha"], "alpha_beta_ratio": b["alpha"] / b["beta"],
    }


def box_counts(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each box low <= rank < high (dimensions x boxes) the number of points (dimensions x n, ranks of 0 to n - 1) in it.

    Slabs of n ** 0.6 ranks: whole cells are read off a summed table, points of cut slabs are looked at one by one, so
    that the work grows with n ** 1.6 and not with the pairs that are near.
    """
    d, n = rank.shape
    slab = max(1, round(n**0.6))
    cells = -(-n // slab)
    first = np.minimum(-(-low // slab) * slab, high)  # whole slabs are those from first to last
    last = np.maximum(high // slab * slab, first)
    out = np.zeros(low.shape[1], np.int64)
    for k in range(d):
        at = np.argsort(rank[k])
        # dimensions before k hold whole slabs only: their cut slabs have been counted
        begin = np.concatenate([first[:k], low[k:]])
        end = np.concatenate([last[:k], high[k:]])
        others = [o for o in range(d) if o != k]
        for a, b in ((low[k], first[k]), (last[k], high[k])):
            for step in range(int((b - a).max(initial=0))):
                p = at[np.minimum(a + step, n - 1)]
                inside = a + step < b
                for o in others:
                    inside &= (rank[o, p] >= begin[o]) & (rank[o, p] < end[o])
                out += inside
    table = np.zeros([cells + 1] * d, np.int64)
    np.add.at(table, tuple(rank // slab + 1), 1)
    for k in range(d):
        table.cumsum(k, out=table)
    ends = (first // slab, last // slab)
    whole = (last > first).all(0)
    for corner in np.ndindex(*[2] * d):
        place = tuple(np.minimum(ends[c][k], cells) for k, c in enumerate(corner))
        out += np.where(whole, (-1) ** (d - sum(corner)) * table[place], 0)
    return out


def template_matches(x: np.ndarray, m: int, r: float, strict: bool) -> np.ndarray:
    """For each template of length m the number of templates within r (Chebyshev), itself included.

    Few templates are compared pair by pair, which is quicker for them; the counts are the same.
    """
    t = np.lib.stride_tricks.sliding_window_view(x, m).T
    n = t.shape[1]
    if n <= FEW_TEMPLATES:
        apart = np.abs(t[:, :, None] - t[:, None]).max(0)
        return (apart < r if strict else apart <= r).sum(1)
    order = np.argsort(t, axis=1, kind="stable")
    rank, low, high = np.empty((m, n), np.int64), np.empty((m, n), np.int64), np.empty((m, n), np.int64)
    near = (lambda d: d < r) if strict else (lambda d: d <= r)
    for k in range(m):
        rank[k, order[k]] = np.arange(n)
        low[k], high[k] = bounds(t[k], t[k][order[k]], near)
    return box_counts(rank, low, high)


def bounds(x: np.ndarray, values: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The half-open range of places in sorted values that are near each x, by the very test that a pair would take."""

    def places(below: Callable) -> np.ndarray:
        a, b = np.zeros(len(x), np.int64), np.full(len(x), len(values))
        while (a < b).any():
            mid = np.minimum((a + b) // 2, len(values) - 1)
            up = (a < b) & below(values[mid])
            a, b = np.where(up, mid + 1, a), np.where(up | (a >= b), b, mid)
        return a

    return places(lambda v: (v < x) & ~near(x - v)), places(lambda v: (v < x) | near(v - x))


@kernel("sample_entropy")
def sample_entropy(x, fs, m=2, factor=0.2):
    r = factor * x.std()
    if r == 0 or len(x) <= m + 1:
        return {}
    b = template_matches(x[:-1], m, r, True).sum() - (len(x) - m)
    a = template_matches(x, m + 1, r, True).sum() - (len(x) - m)
    return {"sample_entropy": float(-np.log(a / b)) if a > 0 and b > 0 else None}


@kernel("approximate_entropy")
def approximate_entropy(x, fs, m=2, factor=0.2):
    r = factor * x.std()
    if r == 0 or len(x) <= m + 1:
        return {}
    phi = lambda k: np.log(template_matches(x, k, r, False) / (len(x) - k + 1)).mean()
    return {"approximate_entropy": float(phi(m) - phi(m + 1))}


@kernel("lz_complexity")
def lempel_ziv(x, fs):
    """Phrases of the parsing of samples above the median, times log2 n / n."""
    s, n = (x > np.median(x)).astype(np.uint8).tobytes(), len(x)
    phrases, at = 0, 0
    while at < n:
        k = 1
        while at + k <= n and s.find(s[at : at + k], 0, at + k - 1) >= 0:
            k += 1
        phrases, at = phrases + 1, at + k
    return {"lz_complexity": phrases * math.log2(n) / n if n > 1 else None}


@kernel("higuchi_fd")
def higuchi(x, fs, kmax=10):
    n, lengths, ks = len(x), [], []
    for k in range(1, min(kmax, n // 2) + 1):
        steps = (n - 1 - np.arange(k)) // k  # of each start, at least 1 as k is n // 2 at most
        apart = np.abs(x[k:] - x[:-k])
        each = np.bincount(np.arange(len(apart)) % k, apart, k) * (n - 1) / (steps * k) / k
        if each.mean() > 0:
            lengths.append(math.log(each.mean()))
            ks.append(math.log(1 / k))
    return {"higuchi_fd": float(np.polyfit(ks, lengths, 1)[0]) if len(ks) > 1 else None}


@kernel("dfa")
def detrended_fluctuation(x, fs):
    y, n = np.cumsum(x - x.mean()), len(x)
    sizes = np.unique(np.floor(np.logspace(math.log10(4), math.log10(max(n / 4, 5)), 12)).astype(int))
    logs = []
    for s in sizes[sizes * 2 <= n]:
        cut = y[: n // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        rest = cut - cut.mean(1, keepdims=True) - np.outer(cut @ t / (t @ t), t)
        f = math.sqrt((rest**2).mean())
        if f > 0:
            logs.append((math.log(s), math.log(f)))
    return {"dfa": float(np.polyfit(*zip(*logs, strict=True), 1)[0]) if len(logs) > 1 else None}


@lru_cache(maxsize=256)
def morlet(f: float, fs: float, cycles: float) -> np.ndarray:
    """Of unit energy, five deviations to each side."""
    s = cycles / (2 * math.pi * f)
    t = np.arange(-(half := max(1, int(math.ceil(5 * s * fs)))), half + 1) / fs
    w = np.exp(2j * math.pi * f * t - t**2 / (2 * s * s))
    return w / np.sqrt((np.abs(w) ** 2).sum())


@kernel("wavelet_delta", "wavelet_theta", "wavelet_alpha", "wavelet_beta", "wavelet_gamma")
def wavelet_power(x, fs, cycles=5.0):
    """Mean Morlet power at 20 frequencies from 2 to 40 Hz, averaged over bands."""
    freqs = np.logspace(math.log10(2), math.log10(40), 20)
    freqs = freqs[freqs < fs / 2]
    size = 1 << (2 * len(x) - 1).bit_length()
    spectrum = np.fft.fft(x - x.mean(), size)
    power = []
    for f in freqs:
        w = morlet(float(f), fs, cycles)
        half = len(w) // 2
        if len(w) > len(x):
            y = np.convolve(x - x.mean(), w, "same")
        else:
            y = np.fft.ifft(spectrum * np.fft.fft(w, size))[half : half + len(x)]
        power.append(float((np.abs(y) ** 2).mean()))
    power = np.array(power)
    out = {}
    for b, (lo, hi) in BANDS.items():
        ok = (freqs >= lo) & (freqs <= hi)
        out[f"wavelet_{b}"] = float(power[ok].mean()) if ok.any() else None
    return out


def resampled(x: np.ndarray, factor: float) -> np.ndarray:
    """x at len * factor places, band-limited by its transform."""
    n = max(2, int(round(len(x) * factor)))
    f = np.fft.rfft(x)
    g = np.zeros(n // 2 + 1, complex)
    k = min(len(f), len(g))
    g[:k] = f[:k]
    return np.fft.irfft(g, n) * (n / len(x))


@kernel("aperiodic_slope", "aperiodic_intercept", "aperiodic_beta")
def irasa(x, fs, band=(0.3, 35.0), seconds=4.0):
    """Median over factors of the geometric mean of the spectra of x stretched and squeezed, then a log-log fit."""
    x = np.where(np.isfinite(x), x, np.nanmedian(x)) - np.nanmean(x)
    if x.var() < 1e-10:
        return {}
    size, found = min(len(x), int(fs * seconds)), []
    for h in np.arange(1.1, 1.9, 0.05):
        _, up = welch(resampled(x, h), fs, size)
        _, down = welch(resampled(x, 1 / h), fs, size)
        k = min(len(up), len(down))
        if k < 2:
            continue
        # squeezed signals may be shorter than a window: their spectrum is read at the same frequencies
        fu, fd = np.linspace(0, fs / 2, len(up)), np.linspace(0, fs / 2, len(down))
        f = np.fft.rfftfreq(size, 1 / fs)
        found.append(np.sqrt(np.interp(f, fu, up) * np.interp(f, fd, down)))
    if not found:
        return {}
    p, f = np.median(found, 0), np.fft.rfftfreq(size, 1 / fs)
    ok = (f >= band[0]) & (f <= band[1]) & (p > 0)
    if ok.sum() < 3:
        return {}
    slope, intercept = np.polyfit(np.log10(f[ok]), np.log10(p[ok]), 1)
    return {"aperiodic_slope": float(slope), "aperiodic_intercept": float(intercept), "aperiodic_beta": float(-slope)}


def run_lengths(mask: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True along the last axis, rows kept apart."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return np.nonzero(edge == -1)[1] - np.nonzero(edge == 1)[1]


@kernel("rqa_RR", "rqa_DET", "rqa_LAM", "rqa_L_max", "rqa_L_mean", "rqa_TT", "rqa_ENTR")
def recurrence(x, fs, m=3, tau=1, share=0.1, shortest=2, decimate=5):
    x = x[::decimate]
    n = len(x) - (m - 1) * tau
    if n < 10:
        return {}
    t = np.stack([x[k * tau : k * tau + n] for k in range(m)], 1)
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(2))
    if d.max() == 0:
        return {}
    r = d <= share * d.max()
    np.fill_diagonal(r, False)
    points = r.sum()
    rows = np.zeros((2 * n - 1, n), bool)  # diagonals as rows
    i, j = np.nonzero(r)
    rows[j - i + n - 1, np.minimum(i, j)] = True
    lines = run_lengths(rows)
    lines, stacks = lines[lines >= shortest], run_lengths(r.T)
    stacks = stacks[stacks >= shortest]
    out = {"rqa_RR": float(points / (n * (n - 1)))}
    if points:
        out |= {"rqa_DET": float(lines.sum() / points), "rqa_LAM": float(stacks.sum() / points)}
    if len(lines):
        p = np.bincount(lines)[1:] / len(lines)
        p = p[p > 0]
        out |= {"rqa_L_max": float(lines.max()), "rqa_L_mean": float(lines.mean()), "rqa_ENTR": float(-(p * np.log(p)).sum())}
    if len(stacks):
        out["rqa_TT"] = float(stacks.mean())
    return out


@kernel("acf_zc", "acf_first_min", "acf_decay", "acf_lag1", "acf_lag10")
def autocorrelation(x, fs, seconds=2.0):
    y, n = x - x.mean(), len(x)
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2)[: min(n, int(seconds * fs) + 1)]
    if r[0] <= 0:
        return {}
    r = r / r[0]
    out = {"acf_lag1": float(r[1]) if len(r) > 1 else None, "acf_lag10": float(r[10]) if len(r) > 10 else None}
    drop = np.flatnonzero((r[:-1] > 0) & (r[1:] <= 0))
    low = np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] < r[2:]))
    out["acf_zc"] = float((drop[0] + 1) / fs) if len(drop) else None
    out["acf_first_min"] = float((low[0] + 1) / fs) if len(low) else None
    lags = np.arange(1, min(51, len(r)))
    if (r[lags] > 0.01).sum() >= 5:
        out["acf_decay"] = float(-np.polyfit(lags / fs, np.log(np.maximum(r[lags], 1e-12)), 1)[0])
    return out


def median_places(y: np.ndarray, step: float = 0.01) -> list[float]:
    """Median place, from -1 to 1, of the samples that reach each threshold from 0 up, as long as two and 2 % of all do.

    Samples come in from the highest down, so that a threshold costs no look at the samples again.
    """
    n, order = len(y), np.argsort(-y, kind="stable")
    counts = n - np.searchsorted(np.sort(y), np.arange(0, y.max(), step), "left")
    counts = counts[(counts >= 0.02 * n) & (counts >= 2)]
    medians, inside = {}, []
    wanted = set(counts.tolist())
    for c, i in enumerate(order[: max(wanted, default=0)].tolist(), 1):
        insort(inside, i + 1)
        if c in wanted:
            medians[c] = (inside[(c - 1) // 2] + inside[c // 2]) / 2 / (n / 2) - 1
    return [medians[c] for c in counts.tolist()]


@kernel("hist_mode_5", "hist_mode_10", "first_e_crossing", "trev", "pnn40", "long_stretch_mean", "long_stretch_down", "outlier_timing_p", "outlier_timing_n", "welch_area_5", "welch_centroid", "forecast_mean3_sd")
def canonical(x, fs):
    """Members of the published set of canonical time-series features, on z-scored samples."""
    sd = x.std(ddof=1)
    if sd == 0 or len(x) < 12:
        return {}
    z, n = (x - x.mean()) / sd, len(x)
    out = {}
    for bins in (5, 10):
        count, edge = np.histogram(z, bins)
        top = np.flatnonzero(count == count.max())
        out[f"hist_mode_{bins}"] = float(((edge[:-1] + edge[1:]) / 2)[top].mean())
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(z - z.mean(), size)) ** 2)[:n]
    r = r / r[0]
    under = np.flatnonzero(r < 1 / math.e)
    if len(under):
        k = under[0]
        out["first_e_crossing"] = float(k - 1 + (r[k - 1] - 1 / math.e) / (r[k - 1] - r[k]))
    d = np.diff(z)
    out["trev"] = float((d**3).mean())
    out["pnn40"] = float((np.abs(d) * 1000 > 40).mean())
    longest = lambda m: int(run_lengths(m[None]).max(initial=0))
    out["long_stretch_mean"], out["long_stretch_down"] = float(longest(z > z.mean())), float(longest(d < 0))
    for name, y in (("p", z), ("n", -z)):
        places = median_places(y)
        out[f"outlier_timing_{name}"] = float(np.median(places)) if places else None
    p = np.abs(np.fft.rfft(z, size)) ** 2
    run = np.cumsum(p)
    out["welch_area_5"], out["welch_centroid"] = float(run[len(p) // 5] / run[-1]), float(2 * math.pi * np.searchsorted(run, run[-1] / 2) / size)
    out["forecast_mean3_sd"] = float((z[3:] - (z[:-3] + z[1:-2] + z[2:-1]) / 3).std(ddof=1))
    return out


def band_pass(x: np.ndarray, fs: float, low: float = 0.1, high: float = 40.0, half: int | None = None) -> np.ndarray:
    """Zero-phase windowed-sinc band-pass over a whole segment. half: the filter's half length, where x is a part of one."""
    half = int(min(len(x) // 2, math.ceil(1.65 * fs / max(low, 0.1)))) if half is None else half
    if half < 1:
        return x.astype(float)
    t = np.arange(-half, half + 1)
    sinc = lambda f: 2 * f / fs * np.sinc(2 * f / fs * t)
    h = (sinc(min(high, fs / 2)) - sinc(low)) * np.hamming(len(t))
    padded = np.pad(x.astype(float), half, "reflect")
    size = 1 << (len(padded) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)[2 * half : 2 * half + len(x)]


def analytic_phase(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Phase of the analytic signal of the samples within a band, by the transform."""
    f = np.fft.fftfreq(len(x), 1 / fs)
    spectrum = np.fft.fft(x - x.mean())
    return np.angle(np.fft.ifft(np.where((f >= low) & (f <= high), 2 * spectrum, 0)))
