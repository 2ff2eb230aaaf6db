"""Trend removal, decomposition, peaks, seasonal strength over time, and changepoints of one series."""

from __future__ import annotations

import math

import numpy as np

from .models import moving_trend, mstl, seasonal_strength

EPS = np.finfo(float).eps


def loess(v: np.ndarray, span: float = 0.3, degree: int = 1) -> np.ndarray:
    """Local regression with tricube weights; the window holds a share `span` of the points."""
    n = len(v)
    k = min(n, max(degree + 2, math.ceil(span * n)))
    x, out = np.arange(n, dtype=float), np.empty(n)
    for i in range(n):
        lo = min(max(0, i - k // 2), n - k)
        at = x[lo : lo + k] - i
        w = (1 - np.minimum(np.abs(at) / (np.abs(at).max() + 1), 1) ** 3) ** 3
        X = at[:, None] ** np.arange(degree + 1)
        out[i] = np.linalg.lstsq(X * np.sqrt(w)[:, None], v[lo : lo + k] * np.sqrt(w), rcond=None)[0][0]
    return out


DETREND = "struct<trend:array<double>,detrended:array<double>,method:string,coefficients:array<double>,rss:double,n_params:bigint>"


def detrend(values: np.ndarray, method: str = "auto") -> dict:
    """linear, poly (degree 2), diff, diff2, loess or auto (the least AIC of the first two and loess); what is unknown
    means auto."""
    v = values[~np.isnan(values)]
    n, x = len(v), np.arange(len(v))
    name = {"linear": "linear", "polynomial": "polynomial", "poly": "polynomial", "poly2": "polynomial", "diff": "diff", "diff1": "diff", "difference": "diff", "diff2": "diff2", "loess": "loess"}.get(method.strip().lower(), "auto")
    if n < 3:
        raise ValueError("three values are needed")
    if name in ("diff", "diff2"):
        d = np.diff(v, 1 if name == "diff" else 2)
        trend = v[: len(d)] if name == "diff" else 2 * v[1:-1] - v[:-2]
        return {"trend": trend.tolist(), "detrended": d.tolist(), "method": name, "coefficients": None, "rss": float(d @ d), "n_params": 1 if name == "diff" else 2}

    def one(kind):
        if kind == "loess":
            return loess(v), None, max(2, round(1 / 0.3 * 2))
        deg = 1 if kind == "linear" else 2
        c = np.polyfit(x, v, min(deg, n - 1))
        return np.polyval(c, x), c[::-1], deg + 1

    fits = {k: one(k) for k in (("linear", "polynomial", "loess") if name == "auto" else (name,))}
    cost = {k: n * math.log(max(((v - f[0]) ** 2).mean(), 1e-300)) + 2 * f[2] for k, f in fits.items()}
    best = min(cost, key=cost.get)
    trend, c, k = fits[best]
    return {"trend": trend.tolist(), "detrended": (v - trend).tolist(), "method": best, "coefficients": None if c is None else c.tolist(), "rss": float(((v - trend) ** 2).sum()), "n_params": int(k)}


DECOMPOSED = "struct<trend:array<double>,seasonal:array<double>,remainder:array<double>,period:double,method:string>"


def decompose_seasonal(values: np.ndarray, period: float, method: str = "additive") -> dict:
    """Loess trend and three Fourier harmonics; multiplicative through logarithms of a positive series."""
    v = values[~np.isnan(values)]
    mult = method.lower().startswith("mult")
    if period < 2 or len(v) < 2 * period:
        raise ValueError("two periods of at least two values are needed")
    if mult and v.min() <= 0:
        raise ValueError("a multiplicative decomposition needs positive values")
    y = np.log(v) if mult else v
    trend = loess(y)
    t = 2 * np.pi * np.arange(len(v)) / period
    X = np.column_stack([f(k * t) for k in range(1, min(3, int(period // 2)) + 1) for f in (np.cos, np.sin)])
    s = X @ np.linalg.lstsq(X, y - trend, rcond=None)[0]
    rest = y - trend - s
    parts = (np.exp(a) for a in (trend, s, rest)) if mult else (trend, s, rest)
    a, b, c = (p.tolist() for p in parts)
    return {"trend": a, "seasonal": b, "remainder": c, "period": float(period), "method": "multiplicative" if mult else "additive"}


MSTL = "struct<trend:array<double>,seasonal:array<array<double>>,remainder:array<double>,periods:array<int>>"


def mstl_decomposition(values: np.ndarray, periods: list[int] | None = None, insufficient: str = "fail") -> dict | None:
    """Trend, one component a period, remainder. A series too short for every period fails, keeps a trend alone
    ('trend') or has no components ('none'). Without periods there are trend and remainder only."""
    v = values[~np.isnan(values)]
    wanted = [p for p in periods or [] if p > 1]
    if len(v) < 4 or (wanted and len(v) < 2 * min(wanted)):
        if insufficient == "none":
            return {"trend": None, "seasonal": [], "remainder": None, "periods": []}
        if insufficient != "trend" or len(v) < 2:
            raise ValueError("the series is too short")
        wanted = []
    trend, seasons, rest, used = mstl(v, wanted)
    return {"trend": trend.tolist(), "seasonal": [s.tolist() for s in seasons], "remainder": rest.tolist(), "periods": [int(p) for p in used]}


# ------------------------------------------------------------------ peaks

PEAKS = "struct<peaks:array<struct<index:bigint,time:double,value:double,prominence:double>>,n_peaks:bigint,inter_peak_distances:array<double>,mean_period:double>"


def prominence(v: np.ndarray, i: int) -> float:
    """Height over the higher of the lowest points towards the next higher value on each side."""
    left, right = np.flatnonzero(v[:i] > v[i]), np.flatnonzero(v[i + 1 :] > v[i])
    lo = v[left[-1] if len(left) else 0 : i + 1].min()
    hi = v[i : i + 2 + (right[0] if len(right) else len(v))].min()
    return float(v[i] - max(lo, hi))


def detect_peaks(values: np.ndarray, min_distance: float | None = None, min_prominence: float | None = None, smooth: bool = False) -> dict:
    v = values[~np.isnan(values)]
    if len(v) < 3:
        raise ValueError("three values are needed")
    y = np.convolve(np.pad(v, 1, "edge"), np.ones(3) / 3, "valid") if smooth else v
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    found = [(int(i), prominence(y, int(i))) for i in at]
    if min_prominence is not None:
        found = [f for f in found if f[1] >= min_prominence]
    if min_distance and min_distance > 1:
        kept: list[tuple[int, float]] = []
        for f in sorted(found, key=lambda f: (-y[f[0]], f[0])):  # the higher peak stays
            if all(abs(f[0] - k[0]) >= min_distance for k in kept):
                kept.append(f)
        found = sorted(kept)
    gaps = np.diff([f[0] for f in found]).astype(float)
    return {"peaks": [{"index": i, "time": float(i), "value": float(v[i]), "prominence": p} for i, p in found], "n_peaks": len(found), "inter_peak_distances": gaps.tolist(), "mean_period": float(gaps.mean()) if len(gaps) else float("nan")}


TIMING = "struct<peak_times:array<double>,peak_values:array<double>,normalized_timing:array<double>,n_peaks:bigint,mean_timing:double,std_timing:double,range_timing:double,variability_score:double,timing_trend:double,is_stable:boolean>"


def peak_timing(values: np.ndarray, period: float) -> dict:
    """Where in each cycle the highest value lies, as a share of the period."""
    v = values[~np.isnan(values)]
    p = max(2, int(round(period)))
    if len(v) < 3 or period < 2:
        raise ValueError("three values and a period of two are needed")
    at = np.array([i + int(np.argmax(v[i : i + p])) for i in range(0, len(v) - p + 1, p)] or [int(np.argmax(v))])
    share = (at % p) / p
    sd, k = float(share.std()), len(share)
    slope = float(np.polyfit(np.arange(k), share, 1)[0]) if k > 1 else 0.0
    return {"peak_times": at.astype(float).tolist(), "peak_values": v[at].tolist(), "normalized_timing": share.tolist(), "n_peaks": k, "mean_timing": float(share.mean()), "std_timing": sd, "range_timing": float(np.ptp(share)), "variability_score": min(1.0, sd / 0.2887), "timing_trend": slope, "is_stable": sd < 0.1}


# ------------------------------------------------------------------ seasonal strength


def strength(values: np.ndarray, period: float, method: str = "variance") -> float:
    """Share of the detrended variance that is seasonal: by seasonal means, by spectral power at the period and its
    harmonics, or by a Morlet wavelet's power at the period."""
    v = values[~np.isnan(values)]
    p = max(2, int(round(period)))
    if len(v) < 2 * p:
        raise ValueError("two periods are needed")
    if method.lower() == "spectral":
        x = v - np.polyval(np.polyfit(np.arange(len(v)), v, 1), np.arange(len(v)))
        power = np.abs(np.fft.rfft(x))[1:] ** 2
        f = np.arange(1, len(power) + 1) * period / len(v)  # in cycles a period
        near = (np.abs(f - np.round(f)) < 0.5 * period / len(v) + 0.05) & (np.round(f) >= 1)
        return float(power[near].sum() / power.sum()) if power.sum() > EPS else 0.0
    if method.lower() == "wavelet":
        x = v - moving_trend(v, p)
        a = wavelet_amplitude(x, period)
        return float(min(1.0, (a**2 / 2).mean() / x.var())) if x.var() > EPS else 0.0
    return seasonal_strength(v, p)


def wavelet_amplitude(x: np.ndarray, period: float) -> np.ndarray:
    """Amplitude over time of the oscillation with the period, by a complex Morlet wavelet."""
    scale = period * 6 / (2 * np.pi)
    half = min(int(3 * scale) + 1, len(x) - 1)
    t = np.arange(-half, half + 1)
    envelope = np.exp(-((t / scale) ** 2) / 2)
    wave = envelope * np.exp(2j * np.pi * t / period)
    full = np.convolve(x, wave, "same") if len(x) >= len(wave) else np.convolve(x, wave, "full")[half : half + len(x)]
    weight = np.convolve(np.ones(len(x)), envelope, "same") if len(x) >= len(wave) else np.convolve(np.ones(len(x)), envelope, "full")[half : half + len(x)]
    return 2 * np.abs(full) / np.maximum(weight, EPS)


def strength_windowed(values: np.ndarray, period: float, window: int | None = None, method: str = "variance") -> list[float]:
    """The strength in each window (of two periods), one a step of a quarter window at most."""
    v = values[~np.isnan(values)]
    w = int(window or 2 * round(period))
    if len(v) < w or w < 2 * round(period):
        raise ValueError("a window of two periods is needed")
    return [strength(v[i : i + w], period, method) for i in range(len(v) - w + 1)]


CHANGES = "struct<change_points:array<struct<index:bigint,time:double,change_type:string,strength_before:double,strength_after:double>>,n_changes:bigint,strength_curve:array<double>>"


def seasonality_changes(values: np.ndarray, period: float, threshold: float = 0.3, window: int | None = None, min_duration: int | None = None) -> dict:
    """Where the windowed strength crosses the threshold and stays there: onset or cessation."""
    w = int(window or 2 * round(period))
    curve = np.array(strength_windowed(values, period, w))
    stay = int(min_duration or max(1, round(period)))
    on, state, out = curve >= threshold, bool(curve[0] >= threshold), []
    for i in range(1, len(on)):
        if on[i] != state and (on[i : i + stay] == on[i]).all():
            at = i + w // 2
            out.append({"index": at, "time": float(at), "change_type": "onset" if on[i] else "cessation", "strength_before": float(curve[i - 1]), "strength_after": float(curve[min(i + stay - 1, len(curve) - 1)])})
            state = bool(on[i])
    return {"change_points": out, "n_changes": len(out), "strength_curve": curve.tolist()}


CLASSES = "struct<timing_classification:string,modulation_type:string,has_stable_timing:boolean,timing_variability:double,seasonal_strength:double,is_seasonal:boolean,cycle_strengths:array<double>,weak_seasons:array<bigint>>"
MODULATION = "struct<is_seasonal:boolean,seasonal_strength:double,has_modulation:boolean,modulation_type:string,modulation_score:double,amplitude_trend:double,wavelet_amplitude:array<double>,time_points:array<double>,scale:double>"


def modulation(values: np.ndarray, period: float, threshold: float = 0.15, seasonal_threshold: float = 0.3) -> dict:
    """How the seasonal amplitude moves: stable, emerging, fading, oscillating; non_seasonal without a season."""
    v = values[~np.isnan(values)]
    p = max(2, int(round(period)))
    s = strength(v, period)
    x = v - moving_trend(v, p)
    amp = wavelet_amplitude(x, period)
    edge = min(p // 2, len(amp) // 4)
    mid = amp[edge : len(amp) - edge] if len(amp) > 2 * edge + 2 else amp
    score = float(mid.std() / mid.mean()) if mid.mean() > EPS else 0.0
    t = np.linspace(0, 1, len(mid))
    trend = float(np.polyfit(t, mid / max(mid.mean(), EPS), 1)[0]) if len(mid) > 2 else 0.0
    seasonal = s >= seasonal_threshold
    moved = seasonal and score > threshold
    kind = "non_seasonal" if not seasonal else "stable" if not moved else "emerging" if trend > 0.5 else "fading" if trend < -0.5 else "oscillating"
    return {"is_seasonal": bool(seasonal), "seasonal_strength": s, "has_modulation": bool(moved), "modulation_type": kind, "modulation_score": score, "amplitude_trend": trend, "wavelet_amplitude": amp.tolist(), "time_points": np.arange(len(v), dtype=float).tolist(), "scale": float(period * 6 / (2 * np.pi))}


def classify(values: np.ndarray, period: float, strength_threshold: float = 0.3, timing_threshold: float = 0.05) -> dict:
    """Whether and how regularly a season recurs: by strength, by the peaks' timing and by each cycle's strength."""
    v = values[~np.isnan(values)]
    p = max(2, int(round(period)))
    s = strength(v, period)
    timing = peak_timing(v, period)
    trend = moving_trend(v, p)
    x = v - trend
    figure = np.array([x[k::p].mean() for k in range(p)])
    cycles = []
    for i in range(0, len(v) - p + 1, p):
        part = x[i : i + p]
        total = part @ part
        cycles.append(float(max(0.0, 1 - ((part - figure) ** 2).sum() / total)) if total > EPS else 0.0)
    weak = [i for i, c in enumerate(cycles) if c < strength_threshold]
    stable = timing["std_timing"] <= timing_threshold
    seasonal = bool(s >= strength_threshold)
    label = "non_seasonal" if not seasonal else "stable_seasonal" if stable and not weak else "intermittent_seasonal" if len(weak) > len(cycles) / 3 else "variable_timing" if not stable else "stable_seasonal"
    return {"timing_classification": label, "modulation_type": modulation(v, period)["modulation_type"], "has_stable_timing": bool(stable), "timing_variability": timing["std_timing"], "seasonal_strength": s, "is_seasonal": seasonal, "cycle_strengths": cycles, "weak_seasons": weak}


INSTANT = "struct<periods:array<double>,frequencies:array<double>,amplitudes:array<double>>"


def instantaneous_period(values: np.ndarray) -> dict:
    """Period and amplitude over time from the analytic signal."""
    v = values[~np.isnan(values)]
    n = len(v)
    if n < 4:
        raise ValueError("four values are needed")
    x = v - np.polyval(np.polyfit(np.arange(n), v, 1), np.arange(n))
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    z = np.fft.ifft(np.fft.fft(x) * gain)
    f = np.gradient(np.unwrap(np.angle(z))) / (2 * np.pi)
    period = np.where(f > EPS, 1 / np.where(f > EPS, f, 1), np.nan)
    return {"periods": [float(p) for p in period], "frequencies": f.tolist(), "amplitudes": np.abs(z).tolist()}


# ------------------------------------------------------------------ changepoints

BOCPD = "struct<is_changepoint:array<boolean>,changepoint_probability:array<double>,changepoint_indices:array<bigint>>"
PELT = "struct<changepoints:array<bigint>,n_changepoints:bigint,cost:double>"
#: Weak normal-gamma prior (mean 0), flagging threshold, and run lengths that are followed.
KAPPA = ALPHA = BETA = 0.01
FLAG, RUNS = 0.5, 500


def bocpd(values: np.ndarray, hazard_lambda: float = 250.0, include_probabilities: bool = True) -> dict:
    """Bayesian online changepoint detection (Adams and MacKay 2007): the probability that a run of one value has just
    begun. The predictive density is Student's t without its constant."""
    v = values[~np.isnan(values)]
    if len(v) < 3:
        raise ValueError("three values are needed")
    hazard = 1 / max(hazard_lambda, 1.0)
    prob, s1, s2, count = np.ones(1), np.zeros(1), np.zeros(1), np.zeros(1)
    signal = np.zeros(len(v))
    for t, x in enumerate(v):
        kappa, alpha = KAPPA + count, ALPHA + count / 2
        mu = s1 / kappa
        ss = np.maximum(s2 - s1 * s1 / np.maximum(count, 1), 0)
        beta = BETA + 0.5 * ss + KAPPA * count * mu * mu / (2 * kappa)
        z = (x - mu) / np.maximum(np.sqrt(beta * (kappa + 1) / (alpha * kappa)), 1e-10)
        grown = prob * (1 + z * z / (2 * alpha)) ** (-(2 * alpha + 1) / 2)
        prob = np.r_[hazard * grown.sum(), (1 - hazard) * grown]
        total = prob.sum()
        if total > 1e-300:
            prob = prob / total
        signal[t] = prob[1]
        prob = prob[:RUNS]
        s1, s2, count = (np.r_[0.0, a][:RUNS] for a in (s1 + x, s2 + x * x, count + 1))
    flag = signal > FLAG
    flag[0] = False
    return {"is_changepoint": flag.tolist(), "changepoint_probability": (signal if include_probabilities else np.zeros(len(v))).tolist(), "changepoint_indices": np.flatnonzero(flag).tolist()}


def pelt(values: np.ndarray, penalty: float | None = None, cost: str = "l2", min_size: int = 2) -> dict:
    """Optimal segmentation with pruning (Killick et al. 2012). cost: l1, l2 or normal; penalty 2 ln n by default."""
    v = values[~np.isnan(values)]
    n = len(v)
    if n < 2 * min_size:
        raise ValueError("two segments are needed")
    pen = 2 * math.log(n) if penalty is None else penalty
    a, b = np.r_[0, np.cumsum(v)], np.r_[0, np.cumsum(v * v)]

    def segment(i: np.ndarray, j: int) -> np.ndarray:
        k = j - i
        if cost == "l1":
            return np.array([np.abs(v[x:j] - np.median(v[x:j])).sum() for x in i])
        ss = np.maximum(b[j] - b[i] - (a[j] - a[i]) ** 2 / k, 0)
        return ss if cost == "l2" else k * np.log(np.maximum(ss / k, 1e-10))

    best, last, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -pen
    for j in range(min_size, n + 1):
        ok = live[j - live >= min_size]
        c = best[ok] + segment(ok, j)
        i = int(np.argmin(c))
        best[j], last[j] = c[i] + pen, ok[i]
        live = np.r_[ok[c <= best[j]], live[j - live < min_size], j - min_size + 1]
    cuts, j = [], n
    while last[j] > 0:
        cuts.append(int(last[j]))
        j = last[j]
    return {"changepoints": cuts[::-1], "n_changepoints": len(cuts), "cost": float(best[n])}
