"""Period estimation of one series: thirteen methods with one result form."""

from __future__ import annotations

import math

import numpy as np

from .models import detect_periods, moving_trend, seasonal_strength

EPS = np.finfo(float).eps
NAN = float("nan")
#: Method names and their other spellings; what is unknown means fft.
METHODS = {
    "fft": "fft", "periodogram": "fft", "acf": "acf", "autocorrelation": "acf", "regression": "regression", "fourier": "regression", "multi": "multi", "multiple": "multi", "auto": "auto",
    "autoperiod": "autoperiod", "ap": "autoperiod", "cfd": "cfd_autoperiod", "cfdautoperiod": "cfd_autoperiod", "cfd_autoperiod": "cfd_autoperiod",
    "lombscargle": "lomb_scargle", "lomb_scargle": "lomb_scargle", "lomb-scargle": "lomb_scargle", "ls": "lomb_scargle", "aic": "aic", "aic_comparison": "aic", "ssa": "ssa", "singular_spectrum": "ssa",
    "stl": "stl", "stl_period": "stl", "seasonal_trend": "stl", "matrix_profile": "matrix_profile", "matrixprofile": "matrix_profile", "mp": "matrix_profile", "sazed": "sazed", "zero_padded": "sazed", "enhanced_dft": "sazed",
}
LONGEST, FFT_THRESHOLD, OTHER_THRESHOLD = 365, 5.0, 0.3


def _need(v: np.ndarray, n: int) -> None:
    if len(v) < n:
        raise ValueError(f"{n} values are needed")


def autocorrelation(v: np.ndarray, most: int) -> np.ndarray:
    """Biased autocorrelations at lags 0 to most."""
    c = v - v.mean()
    total = c @ c
    if total < EPS:
        return np.zeros(most + 1)
    size = 1 << (2 * len(v)).bit_length()
    f = np.fft.rfft(c, size)
    return np.fft.irfft(np.abs(f) ** 2, size)[: most + 1] / total


def _estimate(period, power, confidence, method) -> dict:
    return {"period": float(period), "frequency": float(1 / period) if period and np.isfinite(period) else NAN, "power": float(power), "confidence": float(confidence), "method": method}


def fft(v: np.ndarray, longest: int | None = None) -> dict:
    """The periodogram's peak; confidence is its power over the mean power."""
    _need(v, 4)
    p = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
    period = len(v) / np.arange(1, len(p) + 1)
    ok = (period <= (longest or len(v))) & (period >= 2)
    if not ok.any() or p.sum() < EPS:
        return _estimate(NAN, 0.0, 0.0, "fft")
    i = int(np.argmax(np.where(ok, p, -1)))
    return _estimate(period[i], p[i], p[i] / p.mean(), "fft")


def acf(v: np.ndarray, most: int | None = None) -> dict:
    """The highest local maximum of the autocorrelation."""
    _need(v, 4)
    r = autocorrelation(v, min(most or len(v) // 2, len(v) - 2) + 1)
    peak = np.flatnonzero((r[1:-1] > r[:-2]) & (r[1:-1] >= r[2:])) + 1
    peak = peak[peak >= 2]
    if not len(peak):
        return _estimate(NAN, 0.0, 0.0, "acf")
    k = peak[int(np.argmax(r[peak]))]
    return _estimate(k, r[k], max(r[k], 0), "acf")


def _harmonic_fit(v: np.ndarray, period: float, harmonics: int) -> float:
    """Share of the variance that a harmonic regression explains."""
    t = 2 * np.pi * np.arange(len(v)) / period
    top = max(1, min(harmonics, int(period / 2)))  # higher ones would be aliases of lower ones
    X = np.column_stack([np.ones(len(v)), *[f(k * t) for k in range(1, top + 1) for f in (np.cos, np.sin)]])
    rest = v - X @ np.linalg.lstsq(X, v, rcond=None)[0]
    total = ((v - v.mean()) ** 2).sum()
    return float(1 - rest @ rest / total) if total > EPS else 0.0


def regression(v: np.ndarray, longest: int | None = None, candidates: int = 50, harmonics: int = 3) -> dict:
    _need(v, 8)
    grid = np.linspace(2, min(longest or len(v) / 2, len(v) / 2), candidates)
    fits = [(_harmonic_fit(v, p, harmonics), p) for p in grid]
    best = max(fits)
    for k in (1, 2, 3):  # a multiple of the period fits as well, through its higher harmonics
        fits += [(_harmonic_fit(v, p, harmonics), p) for p in np.linspace(0.95, 1.05, 21) * best[1] / k if p >= 2]
    top = max(fits)[0]
    first = min(p for f, p in fits if f >= top - 0.1 * abs(top))
    r2, period = max((f, p) for f, p in fits if p <= 1.1 * first)
    return _estimate(period, r2, r2, "regression")


def multiple(v: np.ndarray, most: int = 5, min_confidence: float = 2.0, min_strength: float = 0.1) -> list[dict]:
    """Periods found one after another, each sinusoid subtracted before the next."""
    _need(v, 8)
    rest, found = v - v.mean(), []
    total = (rest**2).sum()
    for k in range(most):
        if total < EPS or (rest**2).sum() < 1e-12 * total:
            break
        f = fft(rest)
        if not np.isfinite(f["period"]) or f["confidence"] < min_confidence:
            break
        t = 2 * np.pi * np.arange(len(v)) / f["period"]
        X = np.column_stack([np.cos(t), np.sin(t)])
        b = np.linalg.lstsq(X, rest, rcond=None)[0]
        fit = X @ b
        strength = float(max(0.0, 1 - ((rest - fit) ** 2).sum() / (rest**2).sum()))
        if strength < min_strength:
            break
        found.append({"period": f["period"], "confidence": f["confidence"], "strength": strength, "amplitude": float(math.hypot(*b)), "phase": float(math.atan2(-b[1], b[0])), "iteration": k + 1})
        rest = rest - fit
    return found


def autoperiod(v: np.ndarray, threshold: float = 0.3, differenced: bool = False) -> dict:
    """The periodogram's peak, kept if the autocorrelation near it is high enough (Vlachos et al. 2005); the
    differenced form looks for the peak in first differences."""
    _need(v, 8)
    f = fft(np.diff(v) if differenced else v)
    name = "cfd_autoperiod" if differenced else "autoperiod"
    if not np.isfinite(f["period"]):
        return {"period": NAN, "fft_confidence": 0.0, "acf_validation": 0.0, "detected": False, "method": name}
    r = autocorrelation(v, len(v) - 1)
    near = np.arange(max(2, math.floor(f["period"] * 0.85)), min(len(r) - 1, math.ceil(f["period"] * 1.15)) + 1)
    k = int(near[np.argmax(r[near])]) if len(near) else int(round(f["period"]))
    value = float(r[min(k, len(r) - 1)])
    return {"period": float(k if value > threshold else f["period"]), "fft_confidence": f["confidence"], "acf_validation": value, "detected": bool(value > threshold), "method": name}


def lomb_scargle(v: np.ndarray, shortest: float | None = None, longest: float | None = None, n_freq: int = 1000) -> dict:
    """Lomb-Scargle periodogram over a grid of frequencies, with the false-alarm probability of its peak."""
    n = len(v)
    _need(v, 4)
    y, var, t = v - v.mean(), v.var(), np.arange(n)
    if var < EPS:
        return {"period": NAN, "frequency": NAN, "power": 0.0, "false_alarm_prob": 1.0, "method": "lomb_scargle"}
    freq = np.linspace(1 / (longest or (n - 1) / 2), 1 / (shortest or 2.0), n_freq)
    w = 2 * np.pi * freq
    tau = np.arctan2(np.sin(2 * np.outer(w, t)).sum(1), np.cos(2 * np.outer(w, t)).sum(1)) / (2 * w)
    arg = w[:, None] * (t - tau[:, None])
    c, s = np.cos(arg), np.sin(arg)
    cc, ss = (c * c).sum(1), (s * s).sum(1)
    good = (cc > EPS) & (ss > EPS)
    power = np.where(good, 0.5 * ((c @ y) ** 2 / np.where(good, cc, 1) + (s @ y) ** 2 / np.where(good, ss, 1)) / var, 0.0)
    i = int(np.argmax(power))
    fap = -math.expm1(n_freq * math.log1p(-math.exp(-power[i]))) if power[i] > 0 else 1.0
    return {"period": float(1 / freq[i]), "frequency": float(freq[i]), "power": float(power[i]), "false_alarm_prob": float(fap), "method": "lomb_scargle"}


def aic(v: np.ndarray, shortest: float | None = None, longest: float | None = None, candidates: int = 50) -> dict:
    """The candidate period whose sinusoid has the least AIC (three parameters)."""
    n = len(v)
    _need(v, 8)
    grid = np.linspace(shortest or 2.0, longest or n / 2, candidates)
    y, t = v - v.mean(), np.arange(n)
    arg = 2 * np.pi * t / grid[:, None]
    c, s = np.cos(arg), np.sin(arg)
    cc, ss = (c * c).sum(1), (s * s).sum(1)
    a, b = np.where(cc > EPS, c @ y / np.maximum(cc, EPS), 0), np.where(ss > EPS, s @ y / np.maximum(ss, EPS), 0)
    rss = ((y - a[:, None] * c - b[:, None] * s) ** 2).sum(1)
    i = int(np.argmin(rss))
    base = n * math.log(max(rss[i] / n, 1e-300))
    total = y @ y
    return {"period": float(grid[i]), "aic": base + 6, "bic": base + 3 * math.log(n), "rss": float(rss[i]), "r_squared": float(1 - rss[i] / total) if total > EPS else 0.0, "method": "aic"}


def ssa(v: np.ndarray, window: int | None = None, components: int = 10) -> dict:
    """Singular spectrum analysis: the period of the leading eigenvector that oscillates, by its zero crossings."""
    n = len(v)
    _need(v, 8)
    L = min(max(4, window or n // 3), n - 2)
    X = np.lib.stride_tricks.sliding_window_view(v - v.mean(), L)
    w, U = np.linalg.eigh(X.T @ X / len(X))
    w, U = np.maximum(w[::-1], 0), U[:, ::-1]
    k = min(components, L)
    total = w.sum()
    best = {"period": NAN, "variance_explained": 0.0, "n_eigenvalues": int(k), "method": "ssa"}
    for i in range(k):
        u = U[:, i] - U[:, i].mean()
        cross = np.flatnonzero(np.sign(u[1:]) * np.sign(u[:-1]) < 0)
        if len(cross) >= 2:
            at = cross + u[cross] / (u[cross] - u[cross + 1])
            return best | {"period": float(2 * np.diff(at).mean()), "variance_explained": float(w[i : i + 2].sum() / total) if total > EPS else 0.0}
    return best


def stl(v: np.ndarray, shortest: int | None = None, longest: int | None = None, candidates: int = 50) -> dict:
    """The candidate period with the greatest seasonal strength, a tie going to the shortest."""
    n = len(v)
    _need(v, 16)
    top = min(longest or n // 3, n // 2)
    grid = np.unique(np.round(np.linspace(shortest or 4, max(top, shortest or 4), candidates)).astype(int))
    s = np.array([seasonal_strength(v, int(p)) for p in grid])
    i = int(np.flatnonzero(s >= s.max() - 0.01)[0])
    rest = v - moving_trend(v, int(grid[i]))
    strength = max(0.0, 1 - rest.var() / v.var()) if v.var() > EPS else 0.0
    return {"period": float(grid[i]), "seasonal_strength": float(s[i]), "trend_strength": float(strength), "method": "stl"}


def matrix_profile(v: np.ndarray, length: int | None = None, exclusion: float = 0.5) -> dict:
    """The most frequent distance between a window and its nearest other one, both z-normalised."""
    n = len(v)
    m = length or max(4, n // 10)
    _need(v, max(16, 2 * m))
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    sd = w.std(1, keepdims=True)
    z = (w - w.mean(1, keepdims=True)) / np.where(sd > EPS, sd, 1)
    k, skip = len(z), max(1, int(m * exclusion))
    near = np.empty(k, np.int64)
    for i in range(0, k, 512):
        corr = z[i : i + 512] @ z.T
        gap = np.abs(np.arange(i, min(i + 512, k))[:, None] - np.arange(k))
        near[i : i + 512] = np.argmax(np.where(gap < skip, -np.inf, corr - 1e-9 * gap), axis=1)
    lag = np.abs(near - np.arange(k))
    lag = lag[lag > 0]
    if not len(lag):
        return {"period": NAN, "confidence": 0.0, "n_motifs": 0, "subsequence_length": m, "method": "matrix_profile"}
    times = np.bincount(lag)
    p = int(np.argmax(times))
    return {"period": float(p), "confidence": float(times[p] / len(lag)), "n_motifs": int(times[p]), "subsequence_length": int(m), "method": "matrix_profile"}


def sazed(v: np.ndarray, padding: int = 4, shortest: float = 2.0, longest: float | None = None) -> dict:
    """The peak of a Hann-windowed, zero-padded spectrum, with its ratio to the median."""
    n = len(v)
    _need(v, 8)
    p = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(n), n * padding))[1:] ** 2
    period = n * padding / np.arange(1, len(p) + 1)
    ok = (period >= shortest) & (period <= (longest or n / 2))
    if not ok.any() or p.sum() < EPS:
        return {"period": NAN, "power": 0.0, "snr": 0.0, "method": "sazed"}
    i = int(np.argmax(np.where(ok, p, -1)))
    noise = np.median(p[ok])
    return {"period": float(period[i]), "power": float(p[i]), "snr": float(p[i] / noise) if noise > EPS else float("inf"), "method": "sazed"}


def single(v: np.ndarray, method: str, longest: int) -> tuple[float, float]:
    """(period, confidence) by one of the single-period methods."""
    if method == "fft":
        r = fft(v, longest)
        return r["period"], r["confidence"]
    if method == "acf":
        r = acf(v, min(longest, len(v) // 2))
        return r["period"], r["confidence"]
    if method == "regression":
        r = regression(v, longest)
        return r["period"], r["confidence"]
    if method in ("autoperiod", "cfd_autoperiod"):
        r = autoperiod(v, 0.25 if method[0] == "c" else 0.3, method[0] == "c")
        return r["period"], r["acf_validation"]
    if method == "lomb_scargle":
        r = lomb_scargle(v, None, min(longest, (len(v) - 1) / 2))
        return r["period"], 1 - r["false_alarm_prob"]
    if method == "aic":
        r = aic(v, None, min(longest, len(v) / 2))
        return r["period"], r["r_squared"]
    if method == "ssa":
        r = ssa(v)
        return r["period"], r["variance_explained"]
    if method == "stl":
        r = stl(v, None, min(longest, len(v) // 3))
        return r["period"], r["seasonal_strength"]
    if method == "matrix_profile":
        r = matrix_profile(v)
        return r["period"], r["confidence"]
    r = sazed(v, 4, 2.0, min(longest, len(v) / 2))
    return r["period"], 1 - 1 / max(r["snr"], 1.0)


DETECTED = "struct<periods:array<struct<period:double,confidence:double,strength:double,amplitude:double,phase:double,iteration:bigint,matches_expected:boolean,matched_expected_period:double,match_deviation:double>>,n_periods:bigint,primary_period:double,method:string>"


def detect(values: np.ndarray, method: str = "fft", longest: int = LONGEST, min_confidence: float | None = None, expected: list[float] | None = None, tolerance: float = 0.1) -> dict:
    """Periods by any method, marked by the expected period that they are near to."""
    v = values[~np.isnan(values)]
    name = METHODS.get(method.strip().lower(), "fft")
    least = min_confidence if min_confidence is not None else FFT_THRESHOLD if name == "fft" else OTHER_THRESHOLD
    if name == "multi":
        rows = [r for r in multiple(v) if r["period"] <= longest]
    else:
        used = name
        if name == "auto":
            f, a = single(v, "fft", longest), single(v, "acf", longest)
            used = "acf" if np.isfinite(a[0]) and a[1] > OTHER_THRESHOLD and (not np.isfinite(f[0]) or f[1] < FFT_THRESHOLD) else "fft"
            least = min_confidence if min_confidence is not None else FFT_THRESHOLD if used == "fft" else OTHER_THRESHOLD
        p, c = single(v, used, longest)
        rows = [{"period": p, "confidence": c, "strength": seasonal_strength(v, max(2, int(round(p)))), "amplitude": float(v.std() * math.sqrt(2)), "phase": 0.0, "iteration": 1}] if np.isfinite(p) and p <= longest and c >= least else []
    for r in rows:
        near = min(expected or [], key=lambda e: abs(r["period"] - e) / e, default=None)
        gap = abs(r["period"] - near) / near if near else None
        hit = gap is not None and gap <= tolerance
        r |= {"matches_expected": hit if expected else None, "matched_expected_period": near if hit else None, "match_deviation": gap if hit else None}
    return {"periods": rows, "n_periods": len(rows), "primary_period": float(rows[0]["period"]) if rows else NAN, "method": name}


def seasonality(values: np.ndarray) -> dict:
    """Lags with high autocorrelation, the strongest one's value, and the trend's share of the variance."""
    v = values[~np.isnan(values)]
    _need(v, 4)
    found = detect_periods(v)
    r = autocorrelation(v, len(v) - 1)
    x = np.arange(len(v))
    trend = abs(np.corrcoef(x, v)[0, 1]) if v.std() > EPS else 0.0
    return {"detected_periods": found, "primary_period": found[0] if found else 0, "seasonal_strength": float(np.clip(r[found[0]], 0, 1)) if found else 0.0, "trend_strength": float(trend)}
