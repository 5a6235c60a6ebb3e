"""NumPy signal kernels that Spark calls once per series, in Arrow batches (inventory 2.11, 2.13).

Each kernel takes one series as an array; ``per_series`` and ``filtered`` spread
them over the rows of a DataFrame with an array column.  A kernel that fails
gives a null and the status of its error, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import register, status_of

# ---- filters -----------------------------------------------------------------


@register
def butterworth(order: int, cutoff: float, fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second and first order sections of a digital Butterworth filter (bilinear transform with prewarping)."""
    w = np.tan(np.pi * min(max(cutoff / fs, 1e-9), 0.499999))
    sections = []
    for k in range(order // 2):
        q = 2 * np.cos(np.pi * (2 * k + 1) / (2 * order)) if order % 2 == 0 else 2 * np.cos(np.pi * (k + 1) / order)
        a0 = 1 + q * w + w * w
        a = np.array([1.0, 2 * (w * w - 1) / a0, (1 - q * w + w * w) / a0])
        b = np.array([1.0, 2.0, 1.0]) * w * w / a0 if kind == "low" else np.array([1.0, -2.0, 1.0]) / a0
        sections.append((b, a))
    if order % 2:
        a = np.array([1.0, (w - 1) / (w + 1), 0.0])
        b = np.array([w, w, 0.0]) / (w + 1) if kind == "low" else np.array([1.0, -1.0, 0.0]) / (w + 1)
        sections.append((b, a))
    return sections


@lru_cache(64)
def block_matrices(b: tuple[float, ...], a: tuple[float, ...], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block's samples give to the block and to the state behind it, and what the state before it gives to the block and to the state."""
    step, kick = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(powers[-1] @ step)
    free = np.stack([p[0] for p in powers[:size]])
    impulse = np.append(b[0], free[:-1] @ kick)
    lag = np.arange(size)[:, None] - np.arange(size)
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0).T, np.stack([p @ kick for p in powers[size - 1 :: -1]]), free, powers[size]


def run_section(b: np.ndarray, a: np.ndarray, x: np.ndarray, size: int = 64) -> np.ndarray:
    """One section over a series, started in its steady state for the first value.

    Blocks of ``size`` samples are matrix products; only the two state values go
    from block to block.
    """
    gain = b.sum() / a.sum()
    z2 = (b[2] - a[2] * gain) * x[0]
    state = np.array([(b[1] - a[1] * gain) * x[0] + z2, z2])
    v = np.concatenate([x, np.zeros(-len(x) % size)]).reshape(-1, size)
    inside, onward, free, power = block_matrices(tuple(map(float, b)), tuple(map(float, a)), size)
    own, moved = v @ inside, v @ onward
    for i in range(len(v)):
        own[i] += free @ state
        state = power @ state + moved[i]
    return own.reshape(-1)[: len(x)]


@register
def zero_phase(x: np.ndarray, sections: list) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    for b, a in sections:
        y = run_section(b, a, y)
    y = y[::-1]
    for b, a in sections:
        y = run_section(b, a, y)
    y = y[::-1]
    return y[pad : pad + len(x)]


@register
def band_pass(x: np.ndarray, fs: float, high: float | None, low: float | None, order: int = 2) -> np.ndarray:
    """High-pass at ``high``, then low-pass at ``low`` (either may be left out)."""
    if high:
        x = zero_phase(x, butterworth(order, high, fs, "high"))
    if low:
        x = zero_phase(x, butterworth(order, low, fs, "low"))
    return x


@register
def resample(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """Windowed-sinc resampling to another rate."""
    n = int(np.floor(len(x) * target / fs))
    at = np.arange(n) * fs / target
    cut, half = min(1.0, target / fs), 16
    base = np.floor(at).astype(int)
    offset = np.arange(-half + 1, half + 1)
    index = base[:, None] + offset
    t = at[:, None] - index
    weight = cut * np.sinc(cut * t) * np.cos(np.pi * np.clip(t / (half + 1), -0.5, 0.5)) ** 2
    weight /= weight.sum(axis=1, keepdims=True)
    return (x[np.clip(index, 0, len(x) - 1)] * weight).sum(axis=1)


@register
def cubic_resample(x: np.ndarray, n: int) -> np.ndarray:
    """A natural cubic spline through the series, at n even places."""
    m = len(x)
    if m < 3:
        return np.interp(np.linspace(0, m - 1, n), np.arange(m), x)
    rhs = 6 * np.diff(x, 2)
    c, d = np.empty(m - 2), np.empty(m - 2)
    c[0], d[0] = 0.25, rhs[0] / 4
    for i in range(1, m - 2):
        denominator = 4 - c[i - 1]
        c[i], d[i] = 1 / denominator, (rhs[i] - d[i - 1]) / denominator
    second = np.zeros(m)
    for i in range(m - 3, -1, -1):
        second[i + 1] = d[i] - c[i] * second[i + 2]
    at = np.linspace(0, m - 1, n)
    k = np.minimum(at.astype(int), m - 2)
    u = at - k
    v = 1 - u
    return v * x[k] + u * x[k + 1] + ((v**3 - v) * second[k] + (u**3 - u) * second[k + 1]) / 6


# ---- spectra -------------------------------------------------------------------


@register
def welch(x: np.ndarray, fs: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density by averaging half-overlapping Hann windows."""
    size = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(1, size // 2)
    parts = np.stack([x[i : i + size] for i in range(0, len(x) - size + 1, step)])
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    density = power.mean(axis=0) / (fs * (window**2).sum())
    density[1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / fs), density


@register
def spectral_centroid(x: np.ndarray, fs: float) -> float:
    f, p = welch(x, fs)
    return float((f * p).sum() / p.sum()) if p.sum() else 0.0


#: Fixed band limits in Hz.
BANDS = {"ULF": (0.0, 0.0033), "VLF": (0.0033, 0.04), "LF": (0.04, 0.15), "HF": (0.15, 0.4), "VHF": (0.4, 0.5)}


@register
def band_powers(nn: np.ndarray, rate: float = 4.0) -> dict[str, float]:
    """Power in each band of the intervals (ms) interpolated to an even rate, and their ratios."""
    t = np.cumsum(nn) / 1000
    even = np.interp(np.arange(t[0], t[-1], 1 / rate), t, nn)
    f, p = welch(even, rate, 1024)
    out = {k: float(p[(f >= a) & (f < b)].sum() * (f[1] - f[0])) for k, (a, b) in BANDS.items()}
    total = sum(out.values())
    out["TP"] = total
    out["LFHF"] = out["LF"] / out["HF"] if out["HF"] else np.nan
    out["LFn"], out["HFn"] = (out["LF"] / total, out["HF"] / total) if total else (np.nan, np.nan)
    out["LnHF"] = float(np.log(out["HF"])) if out["HF"] > 0 else np.nan
    return out


# ---- non-linear ------------------------------------------------------------------


def embedded(x: np.ndarray, m: int, delay: int = 1) -> np.ndarray:
    n = len(x) - (m - 1) * delay
    return np.stack([x[i * delay : i * delay + n] for i in range(m)], 1)


def chebyshev(e: np.ndarray) -> np.ndarray:
    out = np.zeros((len(e), len(e)))
    for k in range(e.shape[1]):
        np.maximum(out, np.abs(e[:, k, None] - e[None, :, k]), out=out)
    return out


@register
def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    tolerance = r * x.std(ddof=1)
    n = len(x) - m
    a = (chebyshev(embedded(x, m + 1)) <= tolerance).sum() - n
    b = (chebyshev(embedded(x, m)[:n]) <= tolerance).sum() - n
    return float(-np.log(a / b)) if a and b else float("nan")


@register
def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    tolerance = r * x.std(ddof=1)
    phi = lambda k: float(np.log((chebyshev(embedded(x, k)) <= tolerance).mean(axis=1)).mean())
    return phi(m) - phi(m + 1)


@register
def fuzzy_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, power: float = 2.0) -> float:
    tolerance = r * x.std(ddof=1)
    n = len(x) - m

    def phi(k: int) -> float:
        e = embedded(x, k)[:n]
        e = e - e.mean(axis=1, keepdims=True)
        s = np.exp(-((chebyshev(e) / tolerance) ** power))
        return float((s.sum() - n) / (n * (n - 1)))

    a, b = phi(m + 1), phi(m)
    return float(np.log(b / a)) if a and b else float("nan")


@register
def shannon_entropy(x: np.ndarray) -> float:
    """In bits, of the distribution of the values."""
    p = np.unique(x, return_counts=True)[1] / len(x)
    return float(-(p * np.log2(p)).sum())


@register
def coarse(x: np.ndarray, scale: int) -> np.ndarray:
    n = len(x) // scale
    return x[: n * scale].reshape(n, scale).mean(axis=1)


@register
def fluctuation_exponent(x: np.ndarray, scales: range) -> float:
    """Slope of log F(n) on log n after removing a line from each window of the summed series."""
    y = np.cumsum(x - x.mean())
    logs = []
    for n in scales:
        k = len(y) // n
        if k < 1 or n < 3:
            continue
        w = y[: k * n].reshape(k, n)
        t = np.arange(n) - (n - 1) / 2
        slope = (w * t).sum(axis=1) / (t * t).sum()
        rest = w - w.mean(axis=1, keepdims=True) - slope[:, None] * t
        f = np.sqrt((rest**2).mean())
        if f > 0:
            logs.append((np.log(n), np.log(f)))
    return float(np.polyfit(*zip(*logs, strict=True), 1)[0]) if len(logs) > 1 else float("nan")


@register
def dfa_alpha1(x: np.ndarray) -> float:
    return fluctuation_exponent(x, range(4, 12))


@register
def dfa_alpha2(x: np.ndarray) -> float:
    last = int((len(x) + 1) / 10)
    return fluctuation_exponent(x, range(12, last + 1)) if last >= 13 else float("nan")


@register
def higuchi(x: np.ndarray, k_max: int = 10) -> float:
    n, logs = len(x), []
    for k in range(1, min(k_max, n // 2) + 1):
        lengths = []
        for m in range(k):
            part = x[m::k]
            if len(part) > 1:
                lengths.append(np.abs(np.diff(part)).sum() * (n - 1) / ((len(part) - 1) * k) / k)
        if lengths and np.mean(lengths) > 0:
            logs.append((np.log(1 / k), np.log(np.mean(lengths))))
    return float(np.polyfit(*zip(*logs, strict=True), 1)[0]) if len(logs) > 1 else float("nan")


@register
def katz(x: np.ndarray) -> float:
    step = np.abs(np.diff(x))
    length, far = step.sum(), np.abs(x - x[0]).max()
    n = np.log10(len(step))
    return float(n / (n + np.log10(far / length))) if length and far else float("nan")


@register
def lempel_ziv(x: np.ndarray) -> float:
    """Complexity of the series cut at its median, over that of random bits."""
    s = (x > np.median(x)).astype(np.uint8).tobytes()
    i = count = 0
    while i < len(s):
        size = 1
        while i + size <= len(s) and s[i : i + size] in s[: i + size - 1]:
            size += 1
        count += 1
        i += size
    return count * np.log2(len(s)) / len(s)


@register
def correlation_dimension(x: np.ndarray, m: int = 2, delay: int = 1) -> float:
    d = chebyshev(embedded(x, m, delay))
    d = d[np.triu_indices(len(d), 1)]
    d = d[d > 0]
    radii = np.quantile(d, [0.05, 0.1, 0.2, 0.3, 0.5]) if len(d) else np.empty(0)
    radii = np.unique(radii)
    if len(radii) < 2:
        return float("nan")
    return float(np.polyfit(np.log(radii), np.log([(d <= r).mean() for r in radii]), 1)[0])


def lines(mask: np.ndarray, least: int = 2) -> int:
    """Number of set points in runs of at least ``least`` along the first axis of the columns."""
    padded = np.zeros((mask.shape[0] + 2, mask.shape[1]), np.int8)
    padded[1:-1] = mask
    edge = np.diff(padded, axis=0)
    start, stop = np.nonzero((edge == 1).T)[1], np.nonzero((edge == -1).T)[1]
    size = stop - start
    return int(size[size >= least].sum())


@register
def recurrence(x: np.ndarray, m: int = 7, delay: int = 1) -> dict[str, float]:
    """Recurrence rate, determinism and laminarity of the detrended series; tolerance is half the mean distance."""
    t = np.arange(len(x))
    x = x - np.polyval(np.polyfit(t, x, 1), t)
    tolerance = 0.5 * np.sqrt(2) * np.abs(x[:, None] - x[None, :]).mean()
    e = embedded(x, m, delay)
    d = np.sqrt(np.maximum(((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2), 0))
    hit = d <= tolerance
    total = hit.sum()
    n = len(hit)
    skew = np.zeros((n, 2 * n - 1), bool)  # each diagonal as a column
    for k in range(-n + 1, n):
        own = np.diagonal(hit, k)
        skew[: len(own), k + n - 1] = own
    return {"REC": float(total / hit.size), "DET": float(lines(skew) / total) if total else float("nan"), "LAM": float(lines(hit) / total) if total else float("nan")}


@register
def triangle_base(nn: np.ndarray, width: float = 7.8125) -> float:
    """Base of the best triangle on the histogram of the intervals (TINN)."""
    count, edge = np.histogram(nn, np.arange(nn.min(), nn.max() + 2 * width, width))
    middle = (edge[:-1] + edge[1:]) / 2
    top = int(count.argmax())
    best = (np.inf, 0.0)
    for left in range(top + 1):
        for right in range(top, len(count)):
            line = np.interp(middle, [middle[left], middle[top], middle[right]], [0 if left < top else count[top], count[top], 0 if right > top else count[top]], 0, 0)
            best = min(best, (((count - line) ** 2).sum(), middle[right] - middle[left]))
    return float(best[1])


@register
def multifractal(x: np.ndarray, scales: range, powers: Sequence[float] = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)) -> dict[str, float]:
    """Spectrum of the generalised fluctuation exponents h(q): its width, peak, mean, greatest height, difference of the ends' heights, asymmetry, and the range and mean squared step of h."""
    y = np.cumsum(x - x.mean())
    q = np.array(powers, float)
    logs, sizes = [], []
    for n in scales:
        k = len(y) // n
        if k < 2 or n < 3:
            continue
        w = y[: k * n].reshape(k, n)
        t = np.arange(n) - (n - 1) / 2
        rest = w - w.mean(axis=1, keepdims=True) - ((w * t).sum(axis=1) / (t * t).sum())[:, None] * t
        f = (rest**2).mean(axis=1)
        if (f > 0).all():
            logs.append([np.log((f ** (p / 2)).mean()) / p for p in q])
            sizes.append(np.log(n))
    if len(sizes) < 3:
        return dict.fromkeys(MULTIFRACTAL, float("nan"))
    h = np.polyfit(sizes, np.array(logs), 1)[0]
    alpha = np.gradient(q * h - 1, q)
    height = q * alpha - (q * h - 1)
    peak, low, high = alpha[height.argmax()], alpha.argmin(), alpha.argmax()
    width = alpha[high] - alpha[low]
    found = (width, peak, alpha.mean(), height.max(), height[high] - height[low], (peak - alpha[low]) / width if width else np.nan, h.max() - h.min(), (np.diff(h) ** 2).mean())
    return dict(zip(MULTIFRACTAL, map(float, found), strict=True))


MULTIFRACTAL = "Width Peak Mean Max Delta Asymmetry Fluctuation Increment".split()


def _multifractal_of(x: np.ndarray) -> dict[str, float]:
    last = int((len(x) + 1) / 10)
    both = {"alpha1": range(4, 12), "alpha2": range(12, last + 1)}
    return {f"MFDFA_{a}_{k}": v for a, scales in both.items() for k, v in multifractal(x, scales).items()}


def _sample_entropy_at(x: np.ndarray, tolerance: float, m: int = 2) -> tuple[int, int]:
    """Matching pairs of m + 1 and of m values."""
    n = len(x) - m
    if n < 2:
        return 0, 0
    return int((chebyshev(embedded(x, m + 1)) <= tolerance).sum() - n), int((chebyshev(embedded(x, m)[:n]) <= tolerance).sum() - n)


@register
def multiscale(x: np.ndarray, scales: int = 20, r: float = 0.2) -> dict[str, float]:
    """Sample entropy at each scale (MSE_k), their mean (MSEn), the mean over shifted (CMSEn) and over pooled shifted series (RCMSEn)."""
    tolerance = r * x.std(ddof=1)
    entropy = lambda a, b: float(-np.log(a / b)) if a and b else float("nan")
    plain, shifted, pooled = [], [], []
    for k in range(1, scales + 1):
        counts = [_sample_entropy_at(coarse(x[s:], k), tolerance) for s in range(k)]
        plain.append(entropy(*counts[0]))
        each = [e for e in (entropy(*c) for c in counts) if np.isfinite(e)]
        shifted.append(float(np.mean(each)) if each else float("nan"))
        pooled.append(entropy(*map(sum, zip(*counts, strict=True))))
    mean = lambda v: float(np.nanmean(v)) if np.isfinite(v).any() else float("nan")
    return {f"MSE_{k}": v for k, v in enumerate(plain)} | {"MSEn": mean(plain), "CMSEn": mean(shifted), "RCMSEn": mean(pooled)}


#: Kernels by the name of their value, or by the names of the values that one call gives.
NONLINEAR: dict[str | tuple[str, ...], Callable] = {
    "SampEn": sample_entropy, "ApEn": approximate_entropy, "FuzzyEn": fuzzy_entropy, "ShanEn": shannon_entropy, "DFA_alpha1": dfa_alpha1, "DFA_alpha2": dfa_alpha2,
    "HFD": higuchi, "KFD": katz, "LZC": lempel_ziv, "CD": correlation_dimension, ("REC", "DET", "LAM"): recurrence,
    tuple(f"MFDFA_{a}_{k}" for a in ("alpha1", "alpha2") for k in MULTIFRACTAL): _multifractal_of,
}
MULTISCALE = {(*(f"MSE_{k}" for k in range(20)), "MSEn", "CMSEn", "RCMSEn"): multiscale}
FREQUENCY = {(*BANDS, "TP", "LFHF", "LFn", "HFn", "LnHF"): band_powers}


# ---- pulses -------------------------------------------------------------------------


@register
def find_peaks(x: np.ndarray, distance: int = 1, height: float | None = None) -> np.ndarray:
    """Local maxima, the higher ones first, no two within ``distance``."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    if height is not None:
        at = at[x[at] >= height]
    kept = np.ones(len(at), bool)
    for i in np.argsort(-x[at], kind="stable"):
        if kept[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            kept &= ~near
    return at[kept]


@register
def pulse_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Systolic peaks: where a short moving average of the squared signal exceeds a long one."""
    y = np.clip(x - np.median(x), 0, None) ** 2
    mean = lambda w: np.convolve(y, np.ones(w) / w, "same")
    short, long_ = max(1, round(0.111 * fs)), max(1, round(0.667 * fs))
    inside = mean(short) > mean(long_) + 0.02 * y.mean()
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    blocks = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= short]
    out: list[int] = []
    for a, b in blocks:
        p = a + int(x[a:b].argmax())
        if not out or p - out[-1] > 0.3 * fs:
            out.append(p)
    return np.array(out, int)


@register
def feet(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """The least sample between consecutive peaks."""
    return np.array([a + int(x[a:b].argmin()) for a, b in zip(peaks[:-1], peaks[1:], strict=True)], int)


@register
def beat_shape(beats: Sequence[np.ndarray], n: int = 1000) -> list[float | None]:
    """Centre frequency of the first component of beats stretched to n places (a second), and their three largest eigenvalues."""
    stretched = np.stack([cubic_resample(b, n) for b in beats if len(b) > 3], 1) if any(len(b) > 3 for b in beats) else np.empty((n, 0))
    if stretched.shape[1] < 2:
        return [None] * 4
    centred = stretched - stretched.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    first = u[:, 0] * s[0]
    first = first - first.mean()
    most = np.abs(first).max()
    values = [float(x) for x in (s[:3] ** 2 / (n - 1))]
    return [spectral_centroid(first / most, n) if most else 0.0, *values, *[None] * (3 - len(values))]


# ---- DataFrame forms -------------------------------------------------------------------


def _array(values) -> np.ndarray:
    x = np.asarray([v for v in values if v is not None], float) if values is not None else np.empty(0)
    return x[np.isfinite(x)]


def per_series(df: DataFrame, key: str, values: str, kernels: Mapping[str | tuple[str, ...], Callable], keep: Sequence[str] = ()) -> DataFrame:
    """One row per series with its key, the columns ``keep``, a column per value and a status; NaN becomes null.

    A kernel under several names gives all these values in one call.
    """
    groups = [(n if isinstance(n, tuple) else (n,), f) for n, f in kernels.items()]
    names, kept = [n for own, _ in groups for n in own], [key, *keep]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", " + ", ".join(f"`{n}` double" for n in names) + ", status string"

    def run(batches):
        for batch in batches:
            rows = []
            for item in batch.column(values).to_pylist():
                x, error, row = _array(item), None, []
                for own, f in groups:
                    try:
                        with np.errstate(all="ignore"):
                            found = f(x)
                        found = [float(found[n]) for n in own] if isinstance(found, dict) else [float(found)]
                        row += [v if np.isfinite(v) else None for v in found]
                    except MemoryError:  # not a fault of the series: the task fails
                        raise
                    except Exception as e:  # noqa: BLE001  the class becomes the row's status
                        error = error or e
                        row += [None] * len(own)
                rows.append([*row, status_of(error) if len(x) else "no_signals"])
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns, pa.array([r[-1] for r in rows], pa.string())], [*kept, *names, "status"])

    return df.select(*kept, values).mapInArrow(run, schema)


def filtered(df: DataFrame, key: str, values: str, fs: float, low: float | None, high: float | None, order: int = 2, keep: Sequence[str] = (), core: str | None = None) -> DataFrame:
    """Each series band-passed without phase shift; with ``core`` only the values it marks are returned."""
    kept = [key, *keep]

    def run(batches):
        for batch in batches:
            out = []
            marks = batch.column(core).to_pylist() if core else [None] * len(batch)
            for item, mark in zip(batch.column(values).to_pylist(), marks, strict=True):
                y = band_pass(x, fs, high, low, order) if len(x := _array(item)) > 3 else x
                out.append((y if mark is None else y[np.asarray(mark, bool)]).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.list_(pa.float64()))], [*kept, "filtered"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, values, *([core] if core else [])).mapInArrow(run, f"{schema}, filtered array<double>")


#: Values of a segment, and those of its neighbours that a filter sees besides.
SEGMENT, MARGIN = 1024, 512


def numbered(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows (key, r, v): the finite values in order, numbered from 0; a key without any has one row with a null ``v``."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = df.where(finite).select(key, v.alias("v"), (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("r"))
    none = df.groupBy(key).agg(F.max(finite.cast("int")).alias("some")).where("some = 0").select(key, F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("r"))
    return rows.unionByName(none)


def segments(df: DataFrame, key: str, order: Sequence[str], value: str, margin: int = 0) -> DataFrame:
    """Rows (key, segment, values, core): arrays of SEGMENT values and up to ``margin`` of each neighbour, which ``core`` doesn't mark."""
    rows = numbered(df, key, order, value)
    first, last = F.floor(F.greatest(F.col("r") - margin, F.lit(0)) / SEGMENT), F.floor((F.col("r") + margin) / SEGMENT)
    cut = rows.withColumn("segment", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    cut = cut.withColumn("core", F.floor(F.col("r") / SEGMENT) == F.col("segment"))
    out = cut.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("r", "v", "core")))).alias("x"), F.max("core").alias("own"))
    return out.where("own").select(key, "segment", F.col("x.v").alias("values"), F.col("x.core").alias("core"))


def welch_centroids(df: DataFrame, key: str, order: Sequence[str], value: str, fs: float, size: int = 256) -> DataFrame:
    """One row (key, center_freq, status) per series: ``spectral_centroid`` from periodograms of its windows, averaged in Spark."""
    rows = numbered(df, key, order, value)
    step = size // 2
    rows = rows.join(rows.groupBy(key).agg(F.count("v").alias("n")), key)
    at = F.floor(F.col("r") / step).cast("long")
    cut = rows.where("v is not null").withColumn("k", F.explode(F.sequence(F.greatest(at - 1, F.lit(0).cast("long")), at)))
    cut = cut.where((F.col("k") * step + size <= F.col("n")) | ((F.col("n") < size) & (F.col("k") == 0)))
    windows = cut.groupBy(key, "k").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("x")).select(key, F.col("x.v").alias("x"))

    def run(batches):
        for batch in batches:
            done = [welch(np.asarray(x, float), fs, size) for x in batch.column("x").to_pylist()]
            both = [pa.array([d[i].tolist() for d in done], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *both], [key, "f", "p"])

    kind = df.schema[key].dataType.simpleString()
    power = windows.mapInArrow(run, f"{key} {kind}, f array<double>, p array<double>").select(key, F.explode(F.arrays_zip("f", "p")).alias("z"))
    power = power.groupBy(key, F.col("z.f").alias("f")).agg(F.avg("z.p").alias("p"))
    centre = power.groupBy(key).agg(F.sum(F.col("f") * F.col("p")).alias("fp"), F.sum("p").alias("p"))
    value = F.when(F.col("p") > 0, F.col("fp") / F.nullif(F.col("p"), F.lit(0.0))).when(F.col("p") == 0, 0.0)
    out = rows.groupBy(key).agg(F.max("n").alias("n")).join(centre, key, "left")
    return out.select(key, value.alias("center_freq"), F.when(F.col("n") > 0, status_of(None)).otherwise("no_signals").alias("status"))
