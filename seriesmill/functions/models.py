"""The forecasting models: names, dispatch, and the bodies that are no exponential smoothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from . import smoothing as es

EPS = np.finfo(float).eps
#: The names of all models.
MODELS = (
    "AutoETS", "AutoARIMA", "AutoTheta", "AutoMFLES", "AutoMSTL", "AutoTBATS", "Naive", "SMA", "SeasonalNaive", "SES", "SESOptimized", "RandomWalkDrift", "Holt", "HoltWinters",
    "SeasonalES", "SeasonalESOptimized", "SeasonalWindowAverage", "Theta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta", "ETS", "ARIMA", "MFLES", "MSTL", "TBATS",
    "CrostonClassic", "CrostonOptimized", "CrostonSBA", "ADIDA", "IMAPA", "TSB", "Laplace",
)
#: Other spellings. Lower case without underscores of every name is accepted too.
ALIASES = {"randomwalkwithdrift": "RandomWalkDrift", "drift": "RandomWalkDrift", "rwd": "RandomWalkDrift", "snaive": "SeasonalNaive", "hw": "HoltWinters", "swa": "SeasonalWindowAverage", "otm": "OptimizedTheta", "dstm": "DynamicTheta", "dotm": "DynamicOptimizedTheta", "croston": "CrostonClassic", "sba": "CrostonSBA", "auto": "AutoETS"}
NOT_SEASONAL = frozenset("Naive SES SESOptimized Holt RandomWalkDrift ARIMA CrostonClassic CrostonOptimized CrostonSBA TSB ADIDA IMAPA".split())
#: Interval width factor by least confidence level.
Z = ((0.99, 2.576), (0.95, 1.96), (0.90, 1.645), (0.80, 1.28))
LAPLACE_VARIANTS = ("auto", "auto_aid", "skaters")


#: Theta models that forecast many series at once.
THETA = ("Theta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta")


class InputError(ValueError):
    """A request that is wrong for every series: it stops the query."""

    fatal = True


def model_name(text: str) -> str:
    plain = text.strip().lower().replace("_", "")
    for name in MODELS:
        if name == text or name.lower() == plain:
            return name
    if plain in ALIASES:
        return ALIASES[plain]
    raise InputError(f"unknown model: {text!r}")


@dataclass
class Options:
    model: str = "AutoETS"
    spec: str | None = None
    seasonal_period: int = 0
    seasonal_periods: list[int] = field(default_factory=list)
    confidence_level: float = 0.90
    window: int = 0
    model_pool: str = "reduced"
    detect: bool = True
    laplace_variant: str = "auto"
    laplace_seasonal_batch_init: bool = False


def interpolate(v: np.ndarray) -> np.ndarray:
    """NaN becomes the straight line between its neighbours, at the edges the nearest value."""
    bad = np.isnan(v)
    if not bad.any():
        return v
    if bad.all():
        return v[:0]
    at = np.arange(len(v))
    return np.interp(at, at[~bad], v[~bad])


def detect_periods(v: np.ndarray, most: int | None = None) -> list[int]:
    """Up to five lags at which the autocorrelation has a local maximum over 0.1, the strongest first."""
    n = len(v)
    top = min(most or n // 2, n // 2)
    c = v - v.mean()
    total = c @ c
    if n < 4 or top < 2 or total < EPS:
        return []
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(c, size)
    r = np.fft.irfft(f * np.conj(f), size)[1 : top + 1] / total
    mid = r[1:-1]
    at = np.flatnonzero((mid > r[:-2] + 1e-12) & (mid > r[2:] + 1e-12) & (mid > 0.1)) + 1
    return [int(i) + 1 for i in at[np.argsort(-r[at], kind="stable")][:5]]


# ------------------------------------------------------------------ simple models


def naive(v, h):
    return np.full(h, v[-1])


def seasonal_naive(v, h, m):
    p = max(1, min(m, len(v)))
    return v[-p:][np.arange(h) % p]


def drift(v, h):
    return v[-1] + (v[-1] - v[0]) / (len(v) - 1) * np.arange(1, h + 1)


def seasonal_mean(v, h, m):
    p = min(max(m, 2), len(v))
    k = max(len(v) // p, 1)
    return v[-k * p :].reshape(k, p).mean(0)[np.arange(h) % p]


def fixed_arima(v, h):
    """First differences return to their mean by half each step."""
    if len(v) < 5:
        return naive(v, h)
    d = np.diff(v)
    return v[-1] + np.cumsum(d.mean() + 0.5 ** np.arange(1, h + 1) * (d[-1] - d.mean()))


# ------------------------------------------------------------------ intermittent demand


def _demand(v):
    at = np.flatnonzero(v != 0)
    return v[at], np.diff(np.r_[-1, at]).astype(float)


def _smooth(x, alpha):
    level = x[0]
    for y in x[1:]:
        level += alpha * (y - level)
    return level


def _best_alpha(x):
    grid = np.linspace(0.05, 0.95, 19)
    level, sse = np.full(19, x[0]), np.zeros(19)
    for y in x[1:]:
        sse += (y - level) ** 2
        level = level + grid * (y - level)
    return float(grid[int(np.argmin(sse))])


def croston(v, h, kind="classic"):
    size, gap = _demand(v)
    if not len(size):
        return np.zeros(h)
    a, b = (_best_alpha(size), _best_alpha(gap)) if kind == "optimized" else (0.1, 0.1)
    rate = _smooth(size, a) / _smooth(gap, b)
    return np.full(h, rate * (0.95 if kind == "sba" else 1.0))


def tsb(v, h, a=0.1, b=0.1):
    on = (v != 0).astype(float)
    if not on.any():
        return np.zeros(h)
    size, prob = v[on > 0][0], on[0]
    for y, z in zip(v, on):
        prob += b * (z - prob)
        if z:
            size += a * (y - size)
    return np.full(h, prob * size)


def _aggregate(v, k):
    n = len(v) // k * k
    return v[len(v) - n :].reshape(-1, k).sum(1)


def adida(v, h):
    gap = _demand(v)[1]
    k = max(1, min(int(round(gap.mean())) if len(gap) else 1, len(v) // 2 or 1))
    x = _aggregate(v, k)
    return np.full(h, _smooth(x, _best_alpha(x)) / k)


def imapa(v, h):
    gap = _demand(v)[1]
    top = max(1, min(int(round(gap.mean())) if len(gap) else 1, len(v) // 2 or 1))
    return np.full(h, np.mean([_smooth(x, _best_alpha(x)) / k for k in range(1, top + 1) for x in [_aggregate(v, k)]]))


# ------------------------------------------------------------------ ARIMA


def _lags(x, ks, start):
    return [x[start - k : len(x) - k] for k in ks]


def _integrate(v, d, D, s):
    """Differenced series and what is needed to undo it."""
    x, undo = v, []
    for _ in range(D):
        undo.append((s, x[-s:]))
        x = x[s:] - x[:-s]
    for _ in range(d):
        undo.append((1, x[-1:]))
        x = np.diff(x)
    return x, undo


def _solve(X, y):
    """Least squares by the normal equations, with a trace of ridge for collinear columns."""
    G = X.T @ X
    return np.linalg.solve(G + 1e-10 * max(np.trace(G), 1e-300) * np.eye(len(G)), X.T @ y)


def _shocks(x, most):
    """Residuals of a long autoregression, which stand in for the shocks (Hannan and Rissanen 1982), and its order."""
    n = len(x)
    k = min(max(most, int(10 * math.log10(n))), n // 3)
    e = np.zeros(n)
    if n - k >= k + 3:
        X = np.column_stack([np.ones(n - k), *_lags(x, range(1, k + 1), k)])
        e[k:] = x[k:] - X @ _solve(X, x[k:])
    return e, k


def _arma(x, shocks, p, q, P, Q, s, constant):
    """Two-step least squares of a seasonal ARMA model."""
    n, (e, long) = len(x), shocks
    far = max([p, P * s, 1])
    if q or Q:
        if not e.any():
            return None
        far = max(far, long + max(q, Q * s))
    ar, ma = [*range(1, p + 1), *(s * k for k in range(1, P + 1))], [*range(1, q + 1), *(s * k for k in range(1, Q + 1))]
    cols = [*([np.ones(n - far)] if constant else []), *_lags(x, ar, far), *_lags(e, ma, far)]
    y = x[far:]
    if len(y) < len(cols) + 3:
        return None
    if cols:
        X = np.column_stack(cols)
        beta = _solve(X, y)
        r = y - X @ beta
    else:
        beta, r = np.zeros(0), y
    sigma = max(float(r @ r) / len(r), 1e-12)
    c = int(constant)
    phi, theta = beta[c : c + len(ar)], beta[c + len(ar) :]
    if any(len(b) and np.abs(b).max() > 1.5 for b in (phi, theta)):
        return None
    if len(phi):
        full = np.zeros(max(ar))
        full[np.array(ar) - 1] = phi
        if np.max(np.abs(np.roots(np.r_[1, -full]))) > 0.999:
            return None
    e = e.copy()
    e[far:] = r
    k = len(beta) + 1
    loss = len(r) * math.log(sigma)
    return {"const": float(beta[0]) if constant else 0.0, "ar": ar, "phi": phi, "ma": ma, "theta": theta, "e": e, "sigma2": sigma, "aicc": (loss + 2 * k + 2 * k * (k + 1) / max(len(r) - k - 1, 1)) / len(r), "aic": loss + 2 * k, "bic": loss + k * math.log(len(r)), "residuals": r}


def _roll(x, f, h):
    keep = max([*f["ar"], *f["ma"], 1])
    xs, es_ = list(x[-keep:]), list(f["e"][-keep:])
    held = len(xs)
    for _ in range(h):
        y = f["const"] + sum(c * xs[-k] for c, k in zip(f["phi"], f["ar"]) if k <= len(xs)) + sum(c * es_[-k] for c, k in zip(f["theta"], f["ma"]) if k <= len(es_))
        xs.append(y)
        es_.append(0.0)
    return np.array(xs[held:])


def auto_arima(v, h, m):
    """Differences by unit-root heuristics, then stepwise search over orders by AICc (Hyndman and Khandakar 2008)."""
    n = len(v)
    if n < 10:
        return fixed_arima(v, h), "AutoARIMA(1,1,0)", {"order": (1, 1, 0), "seasonal_order": (0, 0, 0, 0)}
    s = m if m > 1 and n >= 3 * m else 1
    D = int(s > 1 and seasonal_strength(v, s) > 0.64)
    x = v[s:] - v[:-s] if D else v
    d = 0
    while d < 2 and len(x) > 6 and np.diff(x).std() < 0.9 * x.std() and _level_statistic(x) > 0.463:
        x, d = np.diff(x), d + 1
    x, undo = _integrate(v, d, D, s)
    if x.std() < 1e-9:
        point, order = np.full(h, x[-1] if len(x) else 0.0), (0, d, 0, 0, D, 0)
        best = None
    else:
        P, Q = (1, 1) if s > 1 and len(x) > 4 * s else (0, 0)
        tried, best, order, shocks = {}, None, None, _shocks(x, 4)

        def attempt(p, q, a, b, c):
            nonlocal best, order
            key = (p, q, a, b, c)
            if key in tried or min(key) < 0 or p > 3 or q > 3 or a > P or b > Q:
                return False
            tried[key] = f = _arma(x, shocks, p, q, a, b, s, bool(c))
            if f is not None and (best is None or f["aicc"] < best["aicc"] - 1e-9):
                best, order = f, (p, d, q, a, D, b)
                return True
            return False

        c = int(d + D < 2)
        for key in ((2, 2, P, Q, c), (0, 0, 0, 0, c), (1, 0, P, 0, c), (0, 1, 0, Q, c)):
            attempt(*key)
        improved = best is not None
        while improved:
            p, _, q, a, _, b = order
            improved = any([attempt(p + i, q + j, a + k, b + g, c) for i, j, k, g in ((1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (1, 1, 0, 0), (-1, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1))])
        if best is None:
            return fixed_arima(v, h), "AutoARIMA(1,1,0)", {"order": (1, 1, 0), "seasonal_order": (0, 0, 0, 0)}
        point = _roll(x, best, h)
    for step, tail in reversed(undo):
        out = list(tail)
        for y in point:
            out.append(y + out[-step])
        point = np.array(out[step:])
    p, _, q, a, _, b = order
    name = f"AutoARIMA({p},{d},{q})" + (f"({a},{D},{b})[{s}]" if s > 1 and (a or b or D) else "")
    return point, name, {"order": (p, d, q), "seasonal_order": (a, D, b, s if s > 1 else 0), "fit": best}


def _level_statistic(x):
    """KPSS statistic for a constant level (Kwiatkowski et al. 1992)."""
    c = x - x.mean()
    n, k = len(c), int(4 * (len(c) / 100) ** 0.25)
    var = c @ c / n + 2 * sum((1 - j / (k + 1)) * (c[j:] @ c[:-j]) / n for j in range(1, k + 1))
    return float((np.cumsum(c) ** 2).sum() / (n * n * var)) if var > EPS else 0.0


# ------------------------------------------------------------------ decomposition models


def moving_trend(v, m):
    """Centred moving average over a period, the ends continued by their own slope."""
    n = len(v)
    kernel = np.ones(m) / m if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    if n < len(kernel) + 2:
        x = np.arange(n)
        return np.polyval(np.polyfit(x, v, 1), x) if n > 1 else v.copy()
    mid = np.convolve(v, kernel, "valid")
    k = len(kernel) // 2
    q = min(len(mid), max(2, m))
    left, right = np.polyfit(np.arange(q), mid[:q], 1), np.polyfit(np.arange(q), mid[-q:], 1)
    return np.r_[np.polyval(left, np.arange(-k, 0)), mid, np.polyval(right, np.arange(q, q + n - len(mid) - k))]


def seasonal_strength(v, m):
    """1 less the remainder's share of the variance of the detrended series, at least 0."""
    if len(v) < 2 * m:
        return 0.0
    x = v - moving_trend(v, m)
    s = np.array([x[k::m].mean() for k in range(m)])[np.arange(len(v)) % m]
    return float(max(0.0, 1 - np.var(x - s) / np.var(x))) if np.var(x) > EPS else 0.0


def mstl(v, periods):
    """Trend, seasonal components (shortest period first) and remainder by repeated moving-average decomposition."""
    usable = sorted({int(p) for p in periods if p > 1 and len(v) >= 2 * p})
    parts = {p: np.zeros(len(v)) for p in usable}
    trend = moving_trend(v, max(usable)) if usable else moving_trend(v, min(max(3, len(v) // 5), max(len(v) - 2, 1)))
    for _ in range(2):
        for p in reversed(usable):
            x = v - sum(parts[q] for q in usable if q != p)
            rest = x - moving_trend(x, p)
            s = np.array([rest[k::p].mean() for k in range(p)])
            parts[p] = (s - s.mean())[np.arange(len(v)) % p]
        if usable:
            trend = moving_trend(v - sum(parts.values()), max(usable))
    return trend, [parts[p] for p in usable], v - trend - sum(parts.values(), np.zeros(len(v))), usable


def mstl_many(series, h, periods):
    """Forecasts of equally long series: a damped trend for what is not seasonal, the last season repeated."""
    parts = [mstl(v, periods) for v in series]
    base = [v - sum(p[1], np.zeros(len(v))) for v, p in zip(series, parts)]
    spec = es.Spec("A", "A", True, "N") if len(series[0]) >= 10 else es.Spec("A", "N", False, "N")
    out = []
    for f, (_, seasons, _, used) in zip(es.fit_many(base, spec, count=40, rounds=3, details=False), parts):
        point = f.forecast(h)
        for p, s in zip(used, seasons):
            point = point + s[-p:][np.arange(h) % p]
        out.append(point)
    return out


def mstl_forecast(v, h, periods):
    return mstl_many([v], h, periods)[0]


def _fourier(t, periods, most=5):
    cols = []
    for p in periods:
        for k in range(1, min(most, p // 2) + 1):
            cols += [np.sin(2 * np.pi * k * t / p), np.cos(2 * np.pi * k * t / p)]
    return np.column_stack(cols) if cols else np.zeros((len(t), 0))


def mfles(v, h, periods, rounds=50, rate=0.9):
    """Boosting (Blume 2023): median, then rounds of trend, Fourier seasons and smoothed level on what is left."""
    n = len(v)
    used = [p for p in periods if p > 1 and n >= 2 * p]
    scale = v.std() or 1.0
    x, t, ahead = (v - np.median(v)) / scale, np.arange(n), np.arange(n, n + h)
    S, SA = _fourier(t, used), _fourier(ahead, used)
    X, XA = np.column_stack([np.ones(n), t / n]), np.column_stack([np.ones(h), ahead / n])
    hat, out, done = np.zeros(n), np.zeros(h), 0
    trend, season = np.zeros(n), np.zeros(n)
    last = np.inf
    for done in range(1, rounds + 1):
        r = x - hat
        w = 1 / np.maximum(np.abs(r - np.median(r)), 0.1 * (np.abs(r).mean() or 1))  # resists outliers
        b = np.linalg.lstsq(X * np.sqrt(w)[:, None], r * np.sqrt(w), rcond=None)[0] * rate * 0.5
        hat, out, trend = hat + X @ b, out + XA @ b, trend + X @ b
        if S.shape[1]:
            r = x - hat
            g = np.linalg.solve(S.T @ S + 0.1 * np.eye(S.shape[1]), S.T @ r) * rate
            hat, out, season = hat + S @ g, out + SA @ g, season + S @ g
        now = float(((x - hat) ** 2).mean())
        if last - now < 1e-4 * max(last, 1e-12) and done > 5:
            break
        last = now
    r = x - hat
    level = _smooth(r, _best_alpha(r)) * 0.5 if n > 2 else 0.0
    m = np.median(v)
    return (out + level) * scale + m, {"iterations": done, "max_rounds": rounds, "penalty": 0.1, "trend": trend * scale + m, "season": season * scale, "fitted": hat * scale + m, "periods": used}


def box_cox(v, lam):
    return np.log(v) if abs(lam) < 1e-6 else (v**lam - 1) / lam


def unbox(x, lam):
    return np.exp(np.clip(x, -700, 700)) if abs(lam) < 1e-6 else np.maximum(lam * x + 1, 1e-12) ** (1 / lam)


def _trig(series, h, periods, harmonics, damped):
    """Innovations model with level, damped trend and trigonometric seasons (De Livera et al. 2011), for equally long
    series at once: (point, AIC, parameters) of each."""
    freq = np.array([2 * np.pi * k / p for p, n in zip(periods, harmonics) for k in range(1, n + 1)])
    x = np.array(series).T
    (n, S), J = x.shape, len(freq)
    t = np.arange(n)
    X = np.column_stack([np.ones(n), t, *[np.cos(f * t) for f in freq], *[np.sin(f * t) for f in freq]])
    head = min(n, max(3 * (2 + 2 * J), n // 2))
    begin = np.linalg.lstsq(X[:head], x[:head], rcond=None)[0]
    grid = [(a, b, g) for a in (0.05, 0.2, 0.5, 0.9) for b in (0.0, 0.01, 0.1) for g in (0.0, 0.002, 0.02)]
    a, b, g = (np.array(c)[:, None] for c in zip(*grid))
    phi = 0.97 if damped else 1.0
    shape = (len(grid), S)
    level, trend = np.broadcast_to(begin[0] - begin[1], shape).copy(), np.broadcast_to(begin[1], shape).copy()
    turn = np.exp(-1j * freq)[:, None, None]
    # each harmonic's phasor: its real part is the season's part; at first the step before the series
    z = np.broadcast_to(((begin[2 : 2 + J] - 1j * begin[2 + J :]) * np.exp(-1j * freq)[:, None])[:, None], (J, *shape)).copy()
    turn = np.conj(turn)
    sse = np.zeros(shape)
    for y in x:
        z = z * turn
        base = level + phi * trend
        e = y - base - z.real.sum(0)
        sse += e * e
        level, trend = base + a * e, phi * trend + b * e
        z += g * e
    best = np.argmin(np.where(np.isfinite(sse), sse, np.inf), axis=0)
    k, count, out = np.arange(1, h + 1), 3 + damped + 2 * J + 2, []
    for i in range(S):
        j = best[i]
        season = (z[:, j, i][:, None] * np.exp(1j * np.outer(freq, k))).real.sum(0)
        out.append((level[j, i] + np.cumsum(phi**k) * trend[j, i] + season, n * math.log(max(sse[j, i] / n, 1e-12)) + 2 * count, {"alpha": float(a[j, 0]), "beta": float(b[j, 0]), "gamma": float(g[j, 0]), "phi": phi}))
    return out


def tbats_many(series, h, periods, search=False):
    """Of each of equally long series the configuration with the least AIC: Box-Cox parameter, damping, harmonics."""
    used = [p for p in periods if p > 1 and len(series[0]) >= 2 * p]
    best: list = [None] * len(series)
    for lam in (1.0, 0.0, 0.5) if search else (1.0,):
        own = [i for i, v in enumerate(series) if lam == 1.0 or v.min() > 0]
        if not own:
            continue
        x = [series[i] if lam == 1.0 else box_cox(series[i], lam) for i in own]
        for damped in (False, True) if search else (True,):
            for top in ((1, 2, 3) if used else (1,)) if search else (3,):
                k = [max(1, min(top, (p - 1) // 2 or 1)) for p in used]
                for i, (point, aic, par) in zip(own, _trig(x, h, used, k, damped)):
                    if lam != 1.0:  # likelihood on the original scale
                        aic -= 2 * (lam - 1) * np.log(series[i]).sum()
                        point = unbox(point, lam)
                    if best[i] is None or aic < best[i][1]:
                        best[i] = point, aic, par | {"lambda": lam, "harmonics": k, "periods": used, "damped": damped}
    return best


def tbats(v, h, periods, search=False):
    return tbats_many([v], h, periods, search)[0]


def laplace(v, h, m, variant="auto"):
    """A mixture of simple forecasters weighted by the likelihood of their past one-step errors (Laplace density)."""
    n = len(v)
    leaves: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for a in (0.05, 0.1, 0.3, 0.6, 0.9):
        f = es.fit(v, es.Spec("A", "N", False, "N"), fixed={"alpha": a})
        leaves[f"ema({a})"] = f.fitted, f.forecast(h)
    k = np.arange(n)
    slope = np.where(k > 1, (np.r_[v[0], v[:-1]] - v[0]) / np.maximum(k - 1, 1), 0.0)
    leaves["drift"] = np.r_[v[0], v[:-1]] + slope, drift(v, h)
    c = v - v.mean()
    r = float(np.clip(c[1:] @ c[:-1] / max(c @ c, EPS), -0.99, 0.99))
    leaves["ar1"] = np.r_[v.mean(), v.mean() + r * c[:-1]], v.mean() + c[-1] * r ** np.arange(1, h + 1)
    f = es.fit(v, es.Spec("A", "A", True, "N"), count=30, rounds=2)
    leaves["damped_holt"] = f.fitted, f.forecast(h)
    if m > 1 and n >= 2 * m and variant != "skaters":
        leaves[f"seasonal({m})"] = np.r_[v[:m], v[:-m]], seasonal_naive(v, h, m)
    if variant == "auto_aid" and (v == 0).mean() > 0.3:
        leaves["tsb"] = np.full(n, v.mean()), tsb(v, h)
    names, half = list(leaves), max(2, m if m > 1 and n >= 2 * m else 2)
    spread = np.array([max(np.abs(v - leaves[k][0])[half:].mean(), 1e-9 * (np.abs(v).mean() + 1)) for k in names])
    score = -np.log(2 * spread) * max(n - half, 1) - max(n - half, 1)
    w = np.exp(np.clip((score - score.max()) / max(1.0, math.sqrt(n)), -700, 0))
    w /= w.sum()
    points = np.array([leaves[k][1] for k in names])
    return w @ points, {"leaf_names": names, "leaf_weights": w, "variant": variant, "spread": float(w @ spread)}


# ------------------------------------------------------------------ dispatch


def season_of(v: np.ndarray, o: Options) -> int:
    if o.seasonal_period > 0:
        return o.seasonal_period
    if o.model in NOT_SEASONAL:
        return 1
    if o.seasonal_periods:
        return int(o.seasonal_periods[0])
    if o.detect:
        found = detect_periods(v)
        return found[0] if found else 1
    return 1


def seasons_of(many: list[np.ndarray], o: Options) -> list[int]:
    """season_of many series; periods are looked for in all series of a length at once."""
    if o.seasonal_period > 0 or o.model in NOT_SEASONAL or o.seasonal_periods or not o.detect:
        return [season_of(v, o) for v in many]
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(many):
        lengths.setdefault(len(v), []).append(i)
    out = [1] * len(many)
    for n, own in lengths.items():
        if n < 4:
            continue
        step = max(1, 500_000 // n)
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            v = np.array([many[i] for i in part])
            c = v - v.mean(1)[:, None]
            total = np.vecdot(c, c)
            f = np.fft.rfft(c, 1 << (2 * n - 1).bit_length(), axis=1)
            r = np.fft.irfft(f * np.conj(f), 1 << (2 * n - 1).bit_length(), axis=1)[:, 1 : n // 2 + 1] / np.where(total < EPS, 1.0, total)[:, None]
            mid = r[:, 1:-1]
            top = (mid > r[:, :-2] + 1e-12) & (mid > r[:, 2:] + 1e-12) & (mid > 0.1) & ~(total < EPS)[:, None]
            best = np.where(top, mid, -np.inf).argmax(1) + 2 if mid.shape[1] else np.ones(len(part), int)
            for i, p, on in zip(part, best.tolist(), top.any(1).tolist()):
                out[i] = p if on else 1
    return out


def _ets(v, h, m, spec):
    if spec:
        try:
            s = es.parse_spec(spec)
        except ValueError as e:
            raise InputError(str(e)) from e
        if not s.stable:
            raise InputError(f"ETS model {spec!r} is an unstable combination")
        return es.fit(v, s, m).forecast(h)
    s = es.Spec("A", "A", False, "A") if m > 1 and len(v) >= 2 * m else es.Spec("A", "A", False, "N") if len(v) >= 10 else None
    return es.fit(v, s, m).forecast(h) if s else ses(v, h)


def ses(v, h, alpha=0.3):
    return np.full(h, _smooth(v, alpha))


def point_forecast(v: np.ndarray, h: int, o: Options) -> tuple[np.ndarray, str]:
    """Point forecasts and the model's name for a series without NaN."""
    if len(v) < 3:
        raise ValueError("a forecast needs three values")
    m, name, model = season_of(v, o), o.model, o.model
    if o.seasonal_period > 1 and name in NOT_SEASONAL:
        raise InputError(f"model {name} does not use seasonal_period")
    periods = o.seasonal_periods or [m]
    S = es.Spec
    if model == "Naive":
        p = naive(v, h)
    elif model == "SeasonalNaive":
        p = seasonal_naive(v, h, m)
    elif model == "SMA":
        p = np.full(h, v[-min(o.window or max(m, 3), len(v)) :].mean())
    elif model == "RandomWalkDrift":
        p = drift(v, h)
    elif model == "SES":
        p = ses(v, h)
    elif model == "SESOptimized":
        p = es.fit(v, S("A", "N", False, "N")).forecast(h)
    elif model == "Holt":
        p = es.fit(v, S("A", "A", False, "N")).forecast(h)
    elif model == "HoltWinters":
        p = es.fit(v, S("A", "A", False, "A"), max(m, 2)).forecast(h)
    elif model in ("SeasonalES", "SeasonalESOptimized"):
        p = es.fit(v, S("A", "N", False, "A"), max(m, 2), {} if model.endswith("Optimized") else {"alpha": 0.3, "gamma": 0.1}).forecast(h)
    elif model == "SeasonalWindowAverage":
        p = seasonal_mean(v, h, m)
    elif model == "ETS":
        p = _ets(v, h, m, o.spec)
    elif model == "AutoETS":
        try:
            f = es.auto(v, m, o.model_pool)
            p, name = f.forecast(h), f"AutoETS({f.spec.name})"
        except (ValueError, np.linalg.LinAlgError) as e:
            if o.model_pool not in es.POOLS:
                raise InputError(str(e)) from e
            p = _ets(v, h, m, None)
    elif model in ("Theta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta"):
        p = es.theta(v, h, m, "Optimized" in model, "Dynamic" in model, 0.1 if model == "DynamicTheta" and m < 2 else None)[0]
    elif model == "AutoTheta":
        kinds = {k: es.theta(v, h, m, "Optimized" in k, "Dynamic" in k) for k in ("Theta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta")}
        best = min(kinds, key=lambda k: kinds[k][1]["sse"])
        p, name = kinds[best][0], f"AutoTheta({best})"
    elif model == "ARIMA":
        p = fixed_arima(v, h)
    elif model == "AutoARIMA":
        p, name, _ = auto_arima(v, h, m)
    elif model in ("MFLES", "AutoMFLES"):
        p = mfles(v, h, periods)[0]
    elif model in ("MSTL", "AutoMSTL"):
        p = mstl_forecast(v, h, periods if max(periods) > 1 else [12])
    elif model in ("TBATS", "AutoTBATS"):
        p = tbats(v, h, periods, model == "AutoTBATS")[0]
    elif model.startswith("Croston"):
        p = croston(v, h, model[7:].lower())
    elif model == "TSB":
        p = tsb(v, h)
    elif model == "ADIDA":
        p = adida(v, h)
    elif model == "IMAPA":
        p = imapa(v, h)
    else:
        p = laplace(v, h, m, o.laplace_variant)[0]
    if not np.isfinite(p).all():
        raise ValueError("no finite forecast")
    return p, name


def _batched(o: Options, n: int, m: int, each: list[int]):
    """What forecasts many equally long series at once, of period m or, for theta models, of the periods `each`: function
    of (series, horizon) giving (points, name) of each;
    None for a model that takes them one by one."""
    S, seasonal = es.Spec, m > 1 and n >= 2 * m
    fixed = {"SESOptimized": (S("A", "N", False, "N"), {}), "Holt": (S("A", "A", False, "N"), {})}
    if n >= 2 * max(m, 2):
        fixed |= {"HoltWinters": (S("A", "A", False, "A"), {}), "SeasonalES": (S("A", "N", False, "A"), {"alpha": 0.3, "gamma": 0.1}), "SeasonalESOptimized": (S("A", "N", False, "A"), {})}
    if o.model == "ETS" and not o.spec and n >= 10:
        fixed["ETS"] = (S("A", "A", False, "A" if seasonal else "N"), {})
    periods = o.seasonal_periods or [m]
    if o.model == "AutoETS":
        return lambda x, h: [(f.forecast(h), f"AutoETS({f.spec.name})") for f in es.auto_many(x, m, o.model_pool)]
    if o.model in fixed:
        spec, kept = fixed[o.model]
        return lambda x, h: [(f.forecast(h), o.model) for f in es.fit_many(x, spec, max(m, 2) if spec.season != "N" else 1, kept, details=False)]
    if o.model in THETA:
        return lambda x, h: [(p, o.model) for p, _ in es.theta_many(x, h, each, "Optimized" in o.model, "Dynamic" in o.model, 0.1 if o.model == "DynamicTheta" and m < 2 else None)]
    if o.model in ("TBATS", "AutoTBATS"):
        return lambda x, h: [(p[0], o.model) for p in tbats_many(x, h, periods, o.model == "AutoTBATS")]
    if o.model in ("MSTL", "AutoMSTL"):
        return lambda x, h: [(p, o.model) for p in mstl_many(x, h, periods if max(periods) > 1 else [12])]
    return None


def point_forecasts(many: list[np.ndarray], horizons: list[int], o: Options) -> list[tuple[np.ndarray, str] | None]:
    """point_forecast of many series, None where it fails. Series of the same length and period go together where the
    model allows it."""
    out: list = [None] * len(many)
    long = [i for i, v in enumerate(many) if len(v) >= 3]
    season = dict(zip(long, seasons_of([many[i] for i in long], o)))
    groups: dict[tuple[int, int], list[int]] = {}
    for i in long:  # theta models take periods series by series; which alpha a DynamicTheta has depends on a period's being there
        groups.setdefault((len(many[i]), min(season[i], 2) if o.model in THETA else season[i]), []).append(i)
    if o.seasonal_period > 1 and o.model in NOT_SEASONAL and groups:
        raise InputError(f"model {o.model} does not use seasonal_period")
    for (n, m), own in groups.items():
        together = _batched(o, n, m, [season[i] for i in own]) if len(own) > 1 else None
        try:
            got = together([many[i] for i in own], max(horizons[i] for i in own)) if together else [None] * len(own)
        except (ValueError, AttributeError, np.linalg.LinAlgError):  # one series spoils the batch: one by one
            got = [None] * len(own)
        for i, g in zip(own, got):
            try:
                g = point_forecast(many[i], horizons[i], o) if g is None else (g[0][: horizons[i]], g[1])
                out[i] = g if np.isfinite(g[0]).all() else None
            except InputError:
                raise
            except Exception:
                out[i] = None
    return out


def bounds(p: np.ndarray, v: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The interval is the same for every model: a random walk of the history's standard deviation."""
    z = next((z for least, z in Z if level >= least), 1.0)
    width = z * v.std() * np.sqrt(np.arange(1, len(p) + 1))
    return p - width, p + width


def fitted(v: np.ndarray, model: str, m: int) -> np.ndarray:
    """In-sample values: the lag, the seasonal lag, the running seasonal mean, or else smoothing with weight 0.3."""
    n = len(v)
    if model == "Naive":
        return np.r_[v[0], v[:-1]]
    p = max(1, min(m, n))
    if model == "SeasonalNaive":
        return np.r_[np.full(p, v[0]), v[:-p]] if n > p else np.full(n, v[0])
    if model == "SeasonalWindowAverage":
        out = v.copy()
        for k in range(p):
            x = v[k::p]
            out[k::p][1:] = (np.cumsum(x) / np.arange(1, len(x) + 1))[:-1]
        return out
    out, level = np.empty(n), v[0]
    for t in range(n):
        out[t] = level
        level = 0.3 * v[t] + 0.7 * level if t else v[0]
    return out


def with_regressors(v: np.ndarray, h: int, o: Options, past: np.ndarray, future: np.ndarray) -> tuple[np.ndarray, str]:
    """ARIMA, Theta and MFLES models forecast what a linear regression leaves, and add its effect; others ignore the
    regressors. past: (n, k), future: (h, k)."""
    kind = {"ARIMA": "ARIMAX", "AutoARIMA": "ARIMAX", "Theta": "ThetaX", "OptimizedTheta": "ThetaX", "DynamicTheta": "ThetaX", "AutoTheta": "ThetaX", "MFLES": "MFLESX", "AutoMFLES": "MFLESX"}.get(o.model)
    if kind is None or not past.shape[1]:
        return point_forecast(v, h, o)
    X = np.column_stack([np.ones(len(v)), past])
    beta = np.linalg.lstsq(X, v, rcond=None)[0]
    rest = v - X @ beta
    m = season_of(v, o)
    p = fixed_arima(rest, h) if kind == "ARIMAX" else es.theta(rest, h, m)[0] if kind == "ThetaX" else mfles(rest, h, o.seasonal_periods or [m])[0]
    return p + np.column_stack([np.ones(h), future]) @ beta, kind
