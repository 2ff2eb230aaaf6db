"""Exponential smoothing in state-space form (Hyndman et al. 2008), and the theta methods (Fiorucci et al. 2016).

A recursion runs over time once for a whole set of candidate parameters, so a fit is a few passes of array operations
instead of an optimiser's many single runs.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np

TINY = 1e-10


@dataclass(frozen=True)
class Spec:
    error: str
    trend: str
    damped: bool
    season: str

    @property
    def name(self) -> str:
        return f"{self.error}{self.trend}{'d' if self.damped else ''}{self.season}"

    @property
    def stable(self) -> bool:
        """A multiplicative error doesn't go with additive parts other than a trend of multiplicative company, nor an
        additive error with a multiplicative part."""
        if self.error == "A":
            return self.trend != "M" and self.season != "M"
        return self.season != "A" and not (self.trend == "A" and self.season == "A")


def parse_spec(text: str) -> Spec:
    """A notation such as AAA, MNM or AAdA; ValueError otherwise."""
    t = text.strip()
    damped = len(t) == 4 and t[2] == "d"
    if not (len(t) == 3 or damped) or t[0] not in "AM" or t[1] not in "AMN" or t[-1] not in "AMN" or (damped and t[1] == "N"):
        raise ValueError(f"no ETS notation: {text!r}")
    return Spec(t[0], t[1], damped, t[-1])


@dataclass
class Fit:
    spec: Spec
    period: int
    alpha: float
    beta: float
    gamma: float
    phi: float
    level: float
    trend: float
    season: np.ndarray
    loss: float
    aic: float
    aicc: float
    bic: float
    fitted: np.ndarray
    states: dict = field(default_factory=dict)

    def forecast(self, h: int) -> np.ndarray:
        k = np.arange(1, h + 1)
        if self.spec.trend == "N":
            base = np.full(h, self.level)
        elif self.spec.trend == "A":
            base = self.level + np.cumsum(self.phi**k) * self.trend
        else:
            base = self.level * self.trend ** np.cumsum(self.phi**k)
        if self.spec.season == "N":
            return base
        s = self.season[(k - 1) % self.period]
        return base + s if self.spec.season == "A" else base * s


def start(v: np.ndarray, spec: Spec, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend (series) and seasonal figures (m, series) from the first seasons; v is (series, steps)."""
    mult, (rows, n) = spec.trend == "M", v.shape
    zero = np.zeros(rows)
    if spec.season != "N":
        k = min(n // m, 3)
        x = v[:, : k * m].reshape(rows, k, m)
        means = x.mean(2)
        s = (x - means[:, :, None]).mean(1) if spec.season == "A" else (x / np.where(np.abs(means) < TINY, TINY, means)[:, :, None]).mean(1)
        first, last = means[:, 0], means[:, -1]
        b = zero + 1.0 if mult else zero
        if k > 1:
            up = (first > 0) & (last > 0)
            b = np.where(up, np.where(up, last, 1.0) / np.where(up, first, 1.0), 1.0) ** (1 / (m * (k - 1))) if mult else (last - first) / (m * (k - 1))
        return first - (0 if mult else b * (m + 1) / 2), b, s.T
    level = v[:, 0]
    if spec.trend == "N":
        return level, zero, np.zeros((0, rows))
    q = min(n, 10)
    x, mean = np.arange(q) - (q - 1) / 2, v[:, :q].mean(1)
    slope = (v[:, :q] - mean[:, None]) @ x / max(x @ x, TINY)
    cut = mean - slope * (q - 1) / 2
    if mult:
        up = (level > 0) & (v[:, q - 1] > 0)
        b = np.where(up, np.where(up, v[:, q - 1], 1.0) / np.where(up, level, 1.0), 1.0) ** (1 / (q - 1))
        return np.maximum(cut, TINY), np.clip(b, 0.8, 1.25), np.zeros((0, rows))
    return cut - slope, slope, np.zeros((0, rows))


def _additive(v: np.ndarray, spec: Spec, m: int, a, b, g, phi, level, trend, season):
    """The recursion of `run` for additive errors and parts, in place: losses, and the states are left in their arrays."""
    a, ab, e, w, sq = np.ascontiguousarray(a), a * b, np.empty(a.shape), np.empty(a.shape), np.zeros(a.shape)
    g, phi = np.ascontiguousarray(g), np.ascontiguousarray(phi)
    for t in range(len(v)):
        if spec.trend == "A":
            if spec.damped:
                np.multiply(phi, trend, out=trend)
            np.add(level, trend, out=level)
        np.subtract(v[t], level, out=e)
        if season is not None:
            s = season[t % m]
            np.subtract(e, s, out=e)
        np.multiply(e, e, out=w)
        np.add(sq, w, out=sq)
        np.multiply(a, e, out=w)
        np.add(level, w, out=level)
        if spec.trend == "A":
            np.multiply(ab, e, out=w)
            np.add(trend, w, out=trend)
        if season is not None:
            np.multiply(g, e, out=e)
            np.add(s, e, out=s)
    return sq


def run(v: np.ndarray, spec: Spec, m: int, a: np.ndarray, b: np.ndarray, g: np.ndarray, phi: np.ndarray, first, keep: bool = False):
    """Losses (-2 log likelihood up to a constant), final states and, with keep, one-step forecasts and states.

    v is (steps, series); the parameters are (candidates, series), and so are all states; first is the start of each
    series: level and trend (series), seasonal figures (m, series).
    """
    n = len(v)
    l0, b0, s0 = first
    level, trend = np.broadcast_to(l0, a.shape).copy(), np.broadcast_to(b0, a.shape).copy()
    season = np.broadcast_to(s0[:, None], (len(s0), *a.shape)).copy() if len(s0) else None
    sq, logs, ab = np.zeros(a.shape), 0.0, a * b
    fits, levels, trends, seasons = [], [], [], []
    quick = not keep and spec.error == "A" and spec.trend != "M" and spec.season != "M"
    if quick:
        sq = _additive(v, spec, m, a, b, g, phi, level, trend, season)
    for t in () if quick else range(n):
        y = v[t]
        if spec.trend == "N":
            base = level
        elif spec.trend == "A":
            damp = phi * trend if spec.damped else trend
            base = level + damp
        else:
            damp = np.abs(trend) ** phi if spec.damped else trend
            base = level * damp
        s = None if season is None else season[t % m]
        hat = base if s is None else base + s if spec.season == "A" else base * s
        if spec.error == "A":
            e = y - hat
            sq += e * e
        else:
            safe = np.where(np.abs(hat) < TINY, TINY, hat)
            sq += ((y - hat) / safe) ** 2
            logs = logs + np.log(np.abs(safe))
        if keep:
            fits.append(hat.copy())
        # Updates in the observation form, which is the same for both kinds of error.
        clean = y if s is None else y - s if spec.season == "A" else y / np.where(np.abs(s) < TINY, TINY, s)
        off = clean - base
        if spec.trend == "A":
            trend = damp + ab * off
        elif spec.trend == "M":
            trend = np.clip(damp + ab * off / np.where(np.abs(level) < TINY, TINY, level), 0.5, 2.0)
        level = base + a * off
        if season is not None:
            ratio = y - base if spec.season == "A" else y / np.where(np.abs(base) < TINY, TINY, base)
            season[t % m] = s + g * (ratio - s)
        if keep:
            levels.append(level.copy())
            trends.append(trend.copy())
            seasons.append(np.zeros(a.shape) if season is None else season[t % m].copy())
    with np.errstate(all="ignore"):
        loss = n * np.log(np.maximum(sq, TINY)) + 2 * logs
    if season is not None:  # the next step's figure first
        season = np.roll(season, -(n % m), axis=0)
    return np.where(np.isfinite(loss), loss, np.inf), level, trend, season, (fits, levels, trends, seasons)


def _points(spec: Spec, count: int, rng) -> list[np.ndarray]:
    u = rng.random((count, 4))
    alpha = 0.01 + 0.98 * u[:, 0]
    beta = 0.01 + 0.6 * u[:, 1] ** 2 if spec.trend != "N" else np.zeros(count)
    gamma = (1 - alpha) * (0.01 + 0.9 * u[:, 2]) if spec.season != "N" else np.zeros(count)
    phi = 0.8 + 0.18 * u[:, 3] if spec.damped else np.ones(count)
    return [alpha, beta, gamma, phi]


def possible(v: np.ndarray, spec: Spec, m: int) -> bool:
    """Whether a series allows the specification: two seasons, and positive values for a multiplicative part."""
    return not ((spec.season != "N" and (m < 2 or len(v) < 2 * m)) or ("M" in (spec.error, spec.trend, spec.season) and v.min() <= 0))


#: Series that a search runs over at once, so that its arrays stay in a core's cache.
SIDE_BY_SIDE = 256


def _search(v: np.ndarray, spec: Spec, m: int, fixed: dict | None, count: int, rounds: int, keep: bool) -> tuple:
    """Parameters (4, series), losses, number of free figures, level, trend, seasonal figures and what `run` keeps, by a
    shrinking random search (a fixed seed) that runs over all series at once; `fixed` parameters stay. v is (series,
    steps)."""
    first = start(v, spec, m)
    v = np.ascontiguousarray(v.T)
    k_series = v.shape[1]
    rng, fixed = np.random.default_rng(13), fixed or {}
    names = ["alpha", "beta", "gamma", "phi"]
    free = [k for k, on in zip(names, (True, spec.trend != "N", spec.season != "N", spec.damped)) if on and k not in fixed]
    pts = _points(spec, count if free else 1, rng)
    pts = [np.broadcast_to(np.full(len(p), fixed[k]) if k in fixed else p, (k_series, len(p))).T for k, p in zip(names, pts)]
    best, at, width = np.full(k_series, np.inf), [p[0].copy() for p in pts], 0.25
    for _ in range(rounds if free else 1):
        loss = run(v, spec, m, *pts, first=first)[0]
        i = np.argmin(loss, axis=0)
        low = np.take_along_axis(loss, i[None], 0)[0]
        better = low < best
        best = np.where(better, low, best)
        at = [np.where(better, np.take_along_axis(p, i[None], 0)[0], x) for p, x in zip(pts, at)]
        floor, top = {"phi": 0.8}, {"phi": 0.98}
        step = {k: width * rng.uniform(-1, 1, (count // 2, 1)) for k in free}
        pts = [np.clip(x[None] + step[k], floor.get(k, 1e-3), top.get(k, 0.999)) if k in free else np.broadcast_to(x, (count // 2, k_series)) for k, x in zip(names, at)]
        width /= 3
    loss, level, trend, season, kept = run(v, spec, m, *(x[None] for x in at), first=first, keep=keep)
    k = len(free) + 1 + (spec.trend != "N") + (m if spec.season != "N" else 0) + 1
    return np.array(at), loss[0], k, level[0], trend[0], season[:, 0] if season is not None else np.zeros((0, k_series)), kept


def _fit_of(got: tuple, i: int, spec: Spec, m: int, n: int) -> Fit:
    """The fit of one series of a search."""
    at, loss, k, level, trend, season, kept = got
    aic = float(loss[i]) + 2 * k
    fits, levels, trends, seasons = (np.array(x)[:, 0, i] if x else np.zeros(0) for x in kept)
    return Fit(
        spec, m, *(float(x[i]) for x in at), float(level[i]), float(trend[i]), season[:, i], float(loss[i]), aic,
        aic + 2 * k * (k + 1) / max(n - k - 1, 1), float(loss[i]) + k * math.log(n), fits, {"level": levels, "trend": trends, "season": seasons},
    )


def fit_many(series: list[np.ndarray], spec: Spec, m: int = 1, fixed: dict | None = None, count: int = 80, rounds: int = 4, details: bool = True) -> list[Fit]:
    """Fits of equally long series, all of which allow the specification: the best parameters of each."""
    out = []
    for at in range(0, len(series), SIDE_BY_SIDE):
        v = np.array(series[at : at + SIDE_BY_SIDE], float)
        got = _search(v, spec, m, fixed, count, rounds, details)
        out += [_fit_of(got, i, spec, m, v.shape[1]) for i in range(len(v))]
    return out


def fit(v: np.ndarray, spec: Spec, m: int = 1, fixed: dict | None = None, count: int = 80, rounds: int = 4) -> Fit:
    """fit_many of one series; ValueError if it does not allow the specification."""
    if not possible(v, spec, m):
        raise ValueError("the series does not allow the specification")
    return fit_many([v], spec, m, fixed, count, rounds)[0]


POOLS = ("complete", "no_multiplicative_trend", "damped_trend_only", "match_error_seasonal", "reduced")


def pool(name: str, positive: bool, seasonal: bool) -> list[Spec]:
    if name not in POOLS:
        raise ValueError(f"model_pool must be one of {POOLS}")
    out = []
    for e, t, d, s in itertools.product("AM", "NAM", (False, True), "NAM"):
        spec = Spec(e, t, d, s)
        if (d and t == "N") or not spec.stable or (s != "N" and not seasonal) or ("M" in (e, t, s) and not positive):
            continue
        if name in ("no_multiplicative_trend", "reduced") and t == "M":
            continue
        if name == "damped_trend_only" and t != "N" and not d:
            continue
        if name in ("match_error_seasonal", "reduced") and s != "N" and s != e:
            continue
        out.append(spec)
    return out


def auto_many(series: list[np.ndarray], m: int, pool_name: str = "reduced") -> list[Fit]:
    """Of each of equally long series the specification of the pool with the least AICc."""
    n = len(series[0])
    seasonal = m > 1 and n >= 2 * m
    out: list[Fit | None] = [None] * len(series)
    for at in range(0, len(series), SIDE_BY_SIDE):
        some = series[at : at + SIDE_BY_SIDE]
        low, best = np.full(len(some), np.inf), [None] * len(some)
        for spec in pool(pool_name, True, seasonal):
            own = [i for i, v in enumerate(some) if possible(v, spec, m)]
            if not own:
                continue
            got = _search(np.array([some[i] for i in own], float), spec, m, None, 40, 3, False)
            k = got[2]
            aicc = got[1] + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
            for j in np.flatnonzero(np.isfinite(aicc) & (aicc < low[own])):
                low[own[j]], best[own[j]] = aicc[j], (got, int(j), spec)
        out[at : at + len(some)] = [None if b is None else _fit_of(*b, m, n) for b in best]
    return out


def auto(v: np.ndarray, m: int, pool_name: str = "reduced") -> Fit:
    """auto_many of one series, with the fitted values and states."""
    f = auto_many([v], m, pool_name)[0]
    return fit(v, f.spec, m, count=40, rounds=3)


# ------------------------------------------------------------------ theta


def seasonal_many(v: np.ndarray, periods: list[int]) -> np.ndarray:
    """Whether lag `period` of each series is significant; v is (series, steps)."""
    n, m = v.shape[1], np.array(periods)
    out = (m >= 2) & (n >= 2 * m)
    if not out.any():
        return out
    c = v - v.mean(1)[:, None]
    total = np.vecdot(c, c)
    out &= total >= TINY
    r = np.array([np.vecdot(c[:, k:], c[:, :-k]) for k in range(1, int(m[out].max(initial=1)) + 1)]) / np.where(total < TINY, 1.0, total)
    before = np.cumsum(r * r, axis=0)
    own = np.flatnonzero(out)
    out[own] = np.abs(r[m[own] - 1, own]) > 1.645 * np.sqrt((1 + 2 * before[m[own] - 2, own]) / n)
    return out


def deseasonalised_many(v: np.ndarray, periods: list[int]) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The series without their multiplicative (additive if not positive) seasonal figures, if lag `period` is
    significant."""
    return [_deseasonalised(x, m) if on else (x, None) for x, m, on in zip(v, periods, seasonal_many(v, periods))]


def deseasonalised(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray | None]:
    """deseasonalised_many of one series."""
    return deseasonalised_many(v[None], [m])[0]


def _deseasonalised(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    kernel = np.full(m, 1 / m) if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    trend = np.convolve(v, kernel, "valid")
    at = np.arange(len(kernel) // 2, len(kernel) // 2 + len(trend))
    ratio = v.min() > 0 and trend.min() > 0
    raw = v[at] / trend if ratio else v[at] - trend
    s = np.bincount(at % m, raw, m) / np.bincount(at % m, minlength=m)
    s = s / s.mean() if ratio else s - s.mean()
    full = s[np.arange(len(v)) % m]
    return (v / full if ratio else v - full), (np.r_[s, 1.0] if ratio else np.r_[s, 0.0])


def _reseason(point: np.ndarray, s: np.ndarray | None, n: int) -> np.ndarray:
    if s is None:
        return point
    f = s[:-1][(n + np.arange(len(point))) % (len(s) - 1)]
    return point * f if s[-1] == 1.0 else point + f


def theta_many(series: list[np.ndarray], h: int, m: int | list[int], optimise_theta: bool = False, dynamic: bool = False, alpha: float | None = None) -> list[tuple[np.ndarray, dict]]:
    """Point forecasts and the parameters used, for equally long series at once, m being their periods. theta is 2 unless it is optimised; a
    dynamic model updates its line with every value."""
    if len(series) > SIDE_BY_SIDE:
        several = [m] * len(series) if isinstance(m, int) else m
        return [x for i in range(0, len(series), SIDE_BY_SIDE) for x in theta_many(series[i : i + SIDE_BY_SIDE], h, several[i : i + SIDE_BY_SIDE], optimise_theta, dynamic, alpha)]
    parts = deseasonalised_many(np.array(series, float), [m] * len(series) if isinstance(m, int) else m)
    x = np.array([p[0] for p in parts]).T  # (steps, series)
    n, k_series = x.shape
    alphas = np.array([alpha]) if alpha is not None else np.linspace(0.02, 0.98, 25)
    thetas = np.array([1.0, 1.5, 2.0, 3.0, 5.0, 10.0]) if optimise_theta else np.array([2.0])
    a, th = (g.reshape(-1, 1) for g in np.meshgrid(alphas, thetas))
    w, t = 1 - 1 / th, np.arange(1, n + 1)
    slope = 6 * (2 * (t @ x) / n - (1 + n) * x.mean(0)) / (n * n - 1)
    cut = x.mean(0) - (n + 1) * slope / 2
    level = x[0] * (a + (1 - a) / th)  # so that a constant stays one
    sse, power = np.zeros(level.shape), 1 - a
    mean, line_a, line_b = x[0].copy(), (x[0].copy() if dynamic else cut), (np.zeros(k_series) if dynamic else slope)
    for k in range(1, n):
        e = x[k] - level - w * (power * line_a + (1 - power * (1 - a)) / a * line_b)
        if not dynamic or k > 2:
            sse += e * e
        level = level + a * (x[k] - level)
        power = power * (1 - a)
        if dynamic:
            j, old = k + 1, mean
            mean = mean + (x[k] - mean) / j
            line_b = ((j - 2) * line_b + 6 * (x[k] - old) / j) / (j + 1)
            line_a = mean - (j + 1) / 2 * line_b
    best = np.argmin(sse, axis=0)
    out = []
    for i, p in enumerate(parts):
        b = best[i]
        al, q = float(a[b, 0]), (1 - float(a[b, 0])) ** n
        point = level[b, i] + w[b, 0] * (q * line_a[i] + (np.arange(h) + (1 - q * (1 - al)) / al) * line_b[i])
        out.append((_reseason(point, p[1], n), {"alpha": al, "theta": float(th[b, 0]), "sse": float(sse[b, i]), "intercept": float(cut[i]), "slope": float(slope[i])}))
    return out


def theta(v: np.ndarray, h: int, m: int, optimise_theta: bool = False, dynamic: bool = False, alpha: float | None = None) -> tuple[np.ndarray, dict]:
    """theta_many of one series."""
    return theta_many([v], h, m, optimise_theta, dynamic, alpha)[0]
