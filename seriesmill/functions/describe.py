"""Numeric kernels for statistics, quality scores and features of one series (numpy arrays without gaps in order)."""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
NAN = float("nan")

STATS_SCHEMA = (
    "struct<length:bigint,n_nulls:bigint,n_nan:bigint,n_zeros:bigint,n_positive:bigint,n_negative:bigint,n_unique_values:bigint,is_constant:boolean,"
    "n_zeros_start:bigint,n_zeros_end:bigint,plateau_size:bigint,plateau_size_nonzero:bigint,mean:double,median:double,std_dev:double,variance:double,"
    "min:double,max:double,range:double,sum:double,skewness:double,kurtosis:double,tail_index:double,bimodality_coef:double,trimmed_mean:double,"
    "coef_variation:double,q1:double,q3:double,iqr:double,autocorr_lag1:double,trend_strength:double,seasonality_strength:double,entropy:double,stability:double>"
)
_COUNTS = "length n_nulls n_nan n_zeros n_positive n_negative n_unique_values n_zeros_start n_zeros_end plateau_size plateau_size_nonzero".split()
_MEASURES = "mean median std_dev variance min max range sum skewness kurtosis tail_index bimodality_coef trimmed_mean coef_variation q1 q3 iqr autocorr_lag1 trend_strength seasonality_strength entropy stability".split()


def acf(v: np.ndarray, lag: int) -> float:
    """Biased autocorrelation, 0 for a constant series."""
    return float(_acf(v[None] - v.mean(), lag)[0])


# Below, v is a matrix of equally long series, one a row, and c the same less each row's mean.


def _acf(c: np.ndarray, lag: int) -> np.ndarray:
    n, total = c.shape[1], np.vecdot(c, c)
    if n <= lag:
        return np.zeros(len(c))
    return np.where(total > EPS, np.vecdot(c[:, lag:], c[:, : n - lag]) / np.where(total > EPS, total, 1.0), 0.0)


def longest_run(same: np.ndarray) -> np.ndarray:
    """Length of the longest run of true values of each row."""
    run, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for x in np.ascontiguousarray(same.T):
        run = (run + 1) * x
        np.maximum(best, run, out=best)
    return best


def _share_entropy(code: np.ndarray, kinds: int) -> np.ndarray:
    """Entropy of the shares of the codes from 0 to kinds - 1 in each row."""
    k, n = code.shape
    p = np.bincount((code + np.arange(k)[:, None] * kinds).ravel(), minlength=k * kinds).reshape(k, kinds) / n
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)


def binned_entropy(v: np.ndarray, bins: int = 10) -> np.ndarray:
    lo, span = v.min(1)[:, None], (v.max(1) - v.min(1))[:, None]
    flat = span < EPS
    # halves away from zero, as the bins are defined
    at = np.minimum(np.floor((v - lo) / np.where(flat, 1.0, span) * (bins - 1) + 0.5).astype(int), bins - 1)
    return np.where(flat[:, 0], 0.0, _share_entropy(at, bins))


def line(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and squared correlation with the index."""
    n = v.shape[1]
    if n < 2:
        return np.zeros(len(v)), v[:, 0], np.zeros(len(v))
    x, mean = np.arange(n) - (n - 1) / 2, v.mean(1)
    c = v - mean[:, None]
    xx, xy, yy = x @ x, np.vecdot(c, x), np.vecdot(c, c)
    slope = xy / xx
    r2 = np.where(yy > EPS, np.clip(xy * xy / (xx * np.where(yy > EPS, yy, 1.0)), 0.0, 1.0), 0.0)
    return slope, mean - slope * (n - 1) / 2, r2


def hill(v: np.ndarray) -> np.ndarray:
    out = np.full(len(v), NAN)
    a = np.sort(np.abs(v), axis=1)[:, ::-1]
    count = (a > EPS).sum(1)
    if v.shape[1] < 10:
        return out
    top = np.minimum(np.maximum(np.sqrt(count).astype(int), 2), count - 1)
    for k in np.unique(top[count >= 10]):
        own = np.flatnonzero((count >= 10) & (top == k))
        h = np.log(a[own, :k] / a[own, k, None]).mean(1)
        out[own] = np.where(h > EPS, 1 / np.where(h > EPS, h, 1.0), NAN)
    return out


def stability(v: np.ndarray) -> np.ndarray:
    n = v.shape[1]
    if n < 10:
        return np.full(len(v), NAN)
    w = max(n // 5, 3)
    means = sum(v[:, i : n - w + 1 + i] * (1 / w) for i in range(w))
    m = np.abs(means.mean(1))
    return np.where(m > EPS, 1 / (means.std(1) / np.where(m > EPS, m, 1.0) + 0.01), NAN)


def _repeats(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (by their bits) of each row: how many, and of all rows in order the row, the value and its count."""
    k, n = v.shape
    bits = np.sort(v.view(np.int64), axis=1)
    new = np.ones((k, n), bool)
    new[:, 1:] = bits[:, 1:] != bits[:, :-1]
    at = np.flatnonzero(new)
    return new.sum(1), at // n, bits.ravel()[at].view(np.float64), np.diff(np.r_[at, k * n])


def _alike_series(keys: list) -> dict:
    groups: dict = {}
    for i, key in enumerate(keys):
        groups.setdefault(key, []).append(i)
    return groups


def _together(parts: list[tuple], block, size: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Results of many series: which have one, and by name the values and which of them are missing.

    parts has a tuple of arrays for each series; those of the same lengths go through block as matrices, a row a series,
    and it gives (values, missing or None) by name. Series on which a whole block fails are tried one by one, as are
    those with infinite values."""
    present, values, missing = np.zeros(len(parts), bool), {}, {}

    def put(own, got):
        present[own] = True
        for name, (x, gone) in got.items():
            if name not in values:
                values[name], missing[name] = np.full(len(parts), NAN), np.ones(len(parts), bool)
            values[name][own], missing[name][own] = x, False if gone is None else gone

    todo = [(lengths, own[i : i + size]) for lengths, own in _alike_series([(*map(len, p), 0 if np.isfinite(p[0]).all() else i + 1) for i, p in enumerate(parts)]).items() for i in range(0, len(own), size)]
    with np.errstate(all="ignore"):
        for _, own in todo:
            for some in (own, *([i] for i in own)):
                try:
                    put(some, block(*(np.array([parts[i][j] for i in some]) for j in range(len(parts[0])))))
                except (ValueError, IndexError, ArithmeticError):
                    continue
                if some is own:
                    break
    return present, values, missing


def statistics_many(values: list[np.ndarray], nulls: list[np.ndarray]) -> tuple:
    """The 34 statistics that need no dates, of many series. `nulls` marks nulls, which stand as NaN in values."""
    present, got, missing = _together([(x[~np.isnan(x)], x, null > 0) for x, null in zip(values, nulls)], _statistics, 256)
    return present, got, missing


def statistics(values: np.ndarray, null: np.ndarray) -> dict:
    """statistics_many of one series; ValueError if it has none."""
    present, got, _ = statistics_many([values], [null])
    if not present[0]:
        raise ValueError("no statistics")
    return {k: bool(x[0]) if k == "is_constant" else float(x[0]) if k in _MEASURES else int(x[0]) for k, x in got.items()}


def _statistics(v: np.ndarray, values: np.ndarray, null: np.ndarray) -> dict:
    rows, n = v.shape
    out: dict = dict.fromkeys(_COUNTS, 0) | dict.fromkeys(_MEASURES, NAN) | {"length": values.shape[1], "n_nulls": null.sum(1), "n_nan": (np.isnan(values) & ~null).sum(1), "is_constant": False}
    if n:
        _measure(v, (values == 0) & ~null, out)
    return {k: (np.broadcast_to(x, rows), None) for k, x in out.items()}


def _measure(v: np.ndarray, zero: np.ndarray, out: dict) -> None:
    n = v.shape[1]
    end = np.zeros((len(v), 1), bool)
    out |= {"n_zeros": (v == 0).sum(1), "n_positive": (v > 0).sum(1), "n_negative": (v < 0).sum(1), "n_unique_values": _repeats(v)[0]}
    out["is_constant"] = out["n_unique_values"] == 1
    out["n_zeros_start"] = np.argmin(np.hstack([zero, end]), axis=1)
    out["n_zeros_end"] = np.argmin(np.hstack([zero[:, ::-1], end]), axis=1)
    same = v[:, 1:] == v[:, :-1]
    out["plateau_size"] = longest_run(same) + 1
    out["plateau_size_nonzero"] = np.where((v != 0).any(1), longest_run(same & (v[:, 1:] != 0)) + 1, 0)
    mean, s = v.mean(1), np.sort(v, axis=1)
    c = v - mean[:, None]
    var = np.vecdot(c, c) / (n - 1) if n > 1 else np.zeros(len(v))
    sd = np.sqrt(var)
    q1, med, q3 = np.quantile(s, [0.25, 0.5, 0.75], axis=1)
    cut = int(n * 0.1)
    out |= {"mean": mean, "median": med, "std_dev": sd, "variance": var, "min": s[:, 0], "max": s[:, -1], "range": s[:, -1] - s[:, 0], "sum": v.sum(1), "q1": q1, "q3": q3, "iqr": q3 - q1, "trimmed_mean": s[:, cut : n - cut].mean(1)}
    out["coef_variation"] = np.where(np.abs(mean) > EPS, sd / np.abs(mean), NAN)
    varied = sd > EPS
    if n > 2:
        out["skewness"] = np.where(varied, (c**3).mean(1) / sd**3 * math.sqrt(n * (n - 1)) / (n - 2), NAN)
    if n > 3:
        g2 = (c**4).mean(1) / sd**4 - 3
        out["kurtosis"] = np.where(varied, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), NAN)
        out["bimodality_coef"] = np.where(varied, (out["skewness"] ** 2 + 1) / (out["kurtosis"] + 3), NAN)
    out["tail_index"] = hill(v)
    out["autocorr_lag1"] = _acf(c, 1)
    out["trend_strength"] = np.sqrt(line(v)[2]) if n >= 4 else 0.0
    out["seasonality_strength"] = np.minimum(np.fmax.reduce([np.zeros(len(v)), *(np.abs(_acf(c, k)) for k in (2, 4, 7, 12) if n > k)]), 1.0) if n >= 4 else 0.0
    out["entropy"] = binned_entropy(v) if n >= 10 else NAN
    out["stability"] = stability(v)


QUALITY_SCHEMA = "struct<structural_score:double,temporal_score:double,magnitude_score:double,behavioral_score:double,overall_score:double,n_gaps:bigint,n_missing:bigint,is_constant:boolean>"


def quality(values: np.ndarray, null: np.ndarray) -> dict:
    """Scores from 0 to 1. Dates are not looked at, so there are no gaps."""
    v, n = values[~(null > 0)], len(values)
    k = len(v)
    unit = lambda x: float(min(1.0, max(0.0, x)))
    structural = unit(0.7 * k / n + 0.3 * min(k / 30, 1)) if k else 0.0
    magnitude, behavioral = 0.0, 0.5
    if k:
        s = np.sort(v)
        q1, q3 = s[int(k * 0.25)], s[int(k * 0.75)]
        far = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        extreme = np.abs(v - v.mean()) > 4 * v.std()
        magnitude = unit(1 - 2 * far.mean() - 3 * extreme.mean())
    if k >= 3:
        behavioral = 0.0 if v.var() < EPS else 0.8 if abs(acf(v, 1)) > 0.95 else 1.0
    constant = bool(k < 2 or (np.abs(v - v[0]) < EPS).all())
    scores = structural, 1.0, magnitude, behavioral
    return {"structural_score": structural, "temporal_score": 1.0, "magnitude_score": magnitude, "behavioral_score": behavioral, "overall_score": sum(scores) / 4, "n_gaps": 0, "n_missing": n - k, "is_constant": constant}


# ------------------------------------------------------------------ features

#: The expected shares of leading digits, rounded to three places.
BENFORD = np.array([0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046])


def feature_names() -> list[str]:
    """All features, in the order of the result."""
    lags = lambda name, n: [f"{name}{k}" for k in range(1, n + 1)]
    return [
        *"length sum mean minimum maximum range variance standard_deviation variation_coefficient large_standard_deviation median".split(),
        *(f"quantile_{q}" for q in (0.1, 0.25, 0.75, 0.9)),
        *"skewness kurtosis count_above_mean count_below_mean percentage_above_mean zero_crossing_rate mean_change mean_abs_change".split(),
        *lags("autocorrelation_lag", 10), *lags("partial_autocorrelation_lag", 5),
        *"first_value last_value first_location_of_maximum last_location_of_maximum first_location_of_minimum last_location_of_minimum abs_energy root_mean_square mean_second_derivative_central cid_ce absolute_sum_of_changes longest_strike_above_mean longest_strike_below_mean number_peaks number_peaks_threshold_1 number_peaks_threshold_2 benford_correlation linear_trend_slope linear_trend_intercept linear_trend_r_squared binned_entropy sample_entropy approximate_entropy permutation_entropy".split(),
        *lags("ratio_beyond_r_sigma_", 3),
        *"count_unique ratio_value_number_to_length has_duplicate has_duplicate_max has_duplicate_min percentage_of_reoccurring_datapoints_to_all_datapoints percentage_of_reoccurring_values_to_all_values sum_of_reoccurring_values sum_of_reoccurring_datapoints".split(),
        *lags("time_reversal_asymmetry_stat_", 3), *lags("c3_lag", 3), "lempel_ziv_complexity",
        *(f"fft_coefficient_{k}_{part}" for k in range(10) for part in ("real", "imag", "abs")),
        *"spectral_centroid spectral_variance agg_linear_trend_slope agg_linear_trend_intercept agg_linear_trend_rvalue agg_linear_trend_stderr".split(),
    ]


def alike(v: np.ndarray, m: int, r: float) -> tuple[np.ndarray, np.ndarray]:
    """For windows of length m and of length m + 1 each: how many windows lie within r of every window, itself included,
    counted over all windows and over all but the last. Windows are taken in blocks, so that memory stays small."""
    n = len(v)
    k = n - m + 1
    out = np.zeros((2, 2, k), np.int64)  # length m or m + 1; all windows or all but the last
    step = max(m + 1, 4_000_000 // max(1, n))
    for i in range(0, k, step):
        hi = min(i + step, k)
        near = np.ones((hi - i, k), bool)
        for d in range(m):
            near &= np.abs(v[i + d : hi + d, None] - v[None, d : k + d]) <= r
        out[0, 0, i:hi], out[0, 1, i:hi] = near.sum(1), near[:, :-1].sum(1)
        top = min(hi, k - 1)
        if top > i:
            longer = near[: top - i, : k - 1] & (np.abs(v[i + m : top + m, None] - v[None, m : k - 1 + m]) <= r)
            out[1, 0, i:top], out[1, 1, i:top] = longer.sum(1), longer[:, :-1].sum(1)
    return out[0], out[1]


def entropies(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample entropy and approximate entropy of windows of 2 values. Series are taken in blocks, so that the matrices of
    all pairs of values stay small; a long one goes through `alike`."""
    m, (rows, n) = 2, v.shape
    sample, approximate = np.full(rows, NAN), np.full(rows, NAN)
    if n < m + 1:
        return sample, approximate
    step, k = max(1, 250_000 // (n * n)), n - m + 1
    for i in range(0, rows, step):
        x, far = v[i : i + step], r[i : i + step]
        if n > 2000:
            short, long = (a[:, None] for a in alike(x[0], m, far[0]))
            long = long[:, :, : k - 1]
        else:
            near = np.abs(x[:, :, None] - x[:, None, :]) <= far[:, None, None]
            two = near[:, :k, :k] & near[:, 1:, 1:]
            three = two[:, : k - 1, : k - 1] & near[:, 2:, 2:]
            # near is symmetric, so that sums by the middle axis are sums by the last
            short, long = ((w.sum(1, dtype=np.int32), w[:, :-1].sum(1, dtype=np.int32)) for w in (two, three))
        phi = np.log(short[0] / k).mean(1), np.log(long[0] / (k - 1)).mean(1)
        on = far > 0
        approximate[i : i + step] = np.where(on | np.isnan(far), phi[0] - phi[1], NAN)
        if n >= m + 3:
            pairs = [(c[1][:, : n - w].sum(1) - (n - w)) // 2 for c, w in ((short, m), (long, m + 1))]
            norm = [(n - w) * (n - w - 1) // 2 for w in (m, m + 1)]
            some = on & (pairs[0] > 0) & (pairs[1] > 0)
            sample[i : i + step] = np.where(some, -np.log(pairs[1] / norm[1] / (pairs[0] / norm[0])), NAN)
    return sample, approximate


def permutation_entropy(v: np.ndarray) -> np.ndarray:
    """Of the orders of three neighbours; equal ones count as rising."""
    if v.shape[1] < 3:
        return np.full(len(v), NAN)
    a, b, c = v[:, :-2], v[:, 1:-1], v[:, 2:]
    return _share_entropy(4 * (a <= b) + 2 * (b <= c) + (a <= c), 8) / math.log(6)


def phrase_complexity(bits: bytes) -> float:
    """Number of phrases of a row of bits, times log2(n) / n. A phrase grows while it occurs in what starts before it; the
    next begins after the longest tried length."""
    n, phrases, at = len(bits), 1, 1
    while at < n:
        k = 1
        while at + k <= n and bits[at : at + k] in bits[: at + k - 1]:
            k += 1
        if at + k > n:
            break
        phrases, at = phrases + 1, at + k
    return phrases * math.log2(n) / n if n > 1 else 0.0


def _leads() -> np.ndarray:
    """The least double of each leading digit and power of ten, from 1 on."""
    least = np.array([float(f"{d}e{e}") for e in range(309) for d in range(1, 10) if (d, e) < (2, 308) or e < 308])
    return np.array([x if f"{x:.17e}"[0] == str(i % 9 + 1) else np.nextafter(x, np.inf) for i, x in enumerate(least)])


LEADS = _leads()


def benford(v: np.ndarray) -> np.ndarray:
    a = np.abs(v)
    row, at = np.nonzero((a >= 1) & np.isfinite(a))
    lead = (np.searchsorted(LEADS, a[row, at], "right") - 1) % 9
    count = np.bincount(row * 9 + lead, minlength=len(v) * 9).reshape(-1, 9)
    share = count / np.maximum(count.sum(1), 1)[:, None]
    x, y = BENFORD - BENFORD.mean(), share - share.mean(1)[:, None]
    uneven = share.std(1) > EPS
    return np.where(uneven, np.clip(y @ x / math.sqrt(x @ x) / np.sqrt(np.where(uneven, np.vecdot(y, y), 1.0)), -1.0, 1.0), 0.0)


def features_many(values: list[np.ndarray], names: tuple[str, ...] | None = None) -> tuple:
    """The features `names`, or all, of many series without their NaN; a feature that a series is too short or too flat
    for is missing."""
    wanted = tuple(feature_names() if names is None else names)
    present, got, missing = _together([(x[~np.isnan(x)],) for x in values], lambda v: _features(v, wanted), 256)
    none = np.full(len(values), NAN), np.ones(len(values), bool)
    return present, {k: got.get(k, none[0]) for k in wanted}, {k: missing.get(k, none[1]) for k in wanted}


def features(values: np.ndarray, names: tuple[str, ...] | None = None) -> dict | None:
    """features_many of one series: a value or None by name; None for a series without values."""
    present, got, missing = features_many([values], names)
    return {k: None if missing[k][0] else float(x[0]) for k, x in got.items()} if present[0] else None


def _features(v: np.ndarray, wanted: tuple[str, ...]) -> dict:
    need = lambda *starts: any(n.startswith(starts) for n in wanted)
    n = v.shape[1]
    if not n:
        raise ValueError("no values")
    f: dict = {}
    mean, lo, hi, s = v.mean(1), v.min(1), v.max(1), np.sort(v, axis=1)
    c, sd, d = v - mean[:, None], v.std(1), np.diff(v, axis=1)
    f |= {"length": n, "sum": v.sum(1), "mean": mean, "minimum": lo, "maximum": hi, "range": hi - lo, "variance": v.var(1), "standard_deviation": sd}
    f |= {"variation_coefficient": np.where(np.abs(mean) > EPS, sd / np.abs(mean), NAN), "large_standard_deviation": sd > 0.25 * (hi - lo), "median": np.median(s, axis=1)}
    if need("quantile"):
        f |= dict(zip((f"quantile_{q}" for q in (0.1, 0.25, 0.75, 0.9)), np.quantile(s, (0.1, 0.25, 0.75, 0.9), axis=1)))
    if need("skewness", "kurtosis"):
        z = c / sd[:, None]
        f |= {"skewness": (z**3).mean(1), "kurtosis": (z**4).mean(1) - 3}
    above, below = v > mean[:, None], v < mean[:, None]
    f |= {"count_above_mean": above.sum(1), "count_below_mean": below.sum(1), "percentage_above_mean": above.mean(1)}
    sign = np.sign(v)
    f["zero_crossing_rate"] = (sign[:, 1:] * sign[:, :-1] < 0).sum(1) / max(n - 1, 1)
    if n > 1:
        f |= {"mean_change": d.mean(1), "mean_abs_change": np.abs(d).mean(1), "cid_ce": np.sqrt(np.vecdot(d, d)), "absolute_sum_of_changes": np.abs(d).sum(1)}
    r = {k: _acf(c, k) for k in range(1, 11) if n > k} if need("autocorrelation", "partial_auto") else {}
    f |= {f"autocorrelation_lag{k}": x for k, x in r.items()}
    for k in range(1, 6):
        if n > k + 1 and r:  # beyond the first, every lag has the second one's formula
            rest = 1 - r[1] ** 2
            f[f"partial_autocorrelation_lag{k}"] = r[1] if k == 1 else np.where(np.abs(rest) < EPS, 0.0, (r[2] - r[1] ** 2) / rest)
    f |= {"first_value": v[:, 0], "last_value": v[:, -1]}
    for name, x in (("maximum", hi), ("minimum", lo)):
        at = np.abs(v - x[:, None]) < EPS
        f |= {f"first_location_of_{name}": at.argmax(1) / n, f"last_location_of_{name}": np.where(at.any(1), n - 1 - at[:, ::-1].argmax(1), 0) / n}
        f[f"has_duplicate_{name[:3]}"] = at.sum(1) > 1
    energy = np.vecdot(v, v)
    f |= {"abs_energy": energy, "root_mean_square": np.sqrt(energy / n)}
    if n > 2:
        f["mean_second_derivative_central"] = np.diff(d, axis=1).mean(1)
    f |= {"longest_strike_above_mean": longest_run(above), "longest_strike_below_mean": longest_run(below)}
    top = (v[:, 1:-1] > v[:, :-2]) & (v[:, 1:-1] > v[:, 2:]) if n > 2 else np.zeros((len(v), 0), bool)
    f["number_peaks"] = top.sum(1)
    for k in (1, 2):
        f[f"number_peaks_threshold_{k}"] = (top & (np.abs(c[:, 1:-1]) > (k * sd)[:, None])).sum(1) if n > 2 else 0
    if need("benford"):
        f["benford_correlation"] = benford(v)
    f["linear_trend_slope"], f["linear_trend_intercept"], f["linear_trend_r_squared"] = line(v)
    if need("sample_entropy", "approximate_entropy"):
        f["sample_entropy"], f["approximate_entropy"] = entropies(v, 0.2 * sd)
    if need("binned_entropy", "permutation_entropy"):
        f |= {"binned_entropy": binned_entropy(v), "permutation_entropy": permutation_entropy(v)}
    f |= {f"ratio_beyond_r_sigma_{k}": (np.abs(c) > (k * sd)[:, None]).mean(1) for k in (1, 2, 3)}
    unique, row, value, times = _repeats(v)
    row, value, times = (x[times > 1] for x in (row, value, times))
    each = lambda x: np.bincount(row, x, len(v))
    f |= {"count_unique": unique, "ratio_value_number_to_length": unique / n, "has_duplicate": unique < n}
    f["percentage_of_reoccurring_datapoints_to_all_datapoints"] = each(times) / n
    f["percentage_of_reoccurring_values_to_all_values"] = np.bincount(row, minlength=len(v)) / unique
    f["sum_of_reoccurring_values"] = each(value)
    f["sum_of_reoccurring_datapoints"] = each(value * times)
    for k in (1, 2, 3):
        if n > 2 * k and need("time_reversal", "c3_"):
            a, b, e = v[:, : n - 2 * k], v[:, k : n - k], v[:, 2 * k :]
            f[f"time_reversal_asymmetry_stat_{k}"] = (e * e * b - a * b * b).mean(1)
            f[f"c3_lag{k}"] = (a * b * e).mean(1)
    if need("lempel"):
        f["lempel_ziv_complexity"] = [phrase_complexity(x.tobytes()) for x in v >= mean[:, None]]
    if need("fft_", "spectral_"):
        z = np.fft.fft(v, axis=1) / n
        size = np.abs(z)
        for k in range(min(10, n)):
            f |= {f"fft_coefficient_{k}_real": z[:, k].real, f"fft_coefficient_{k}_imag": z[:, k].imag, f"fft_coefficient_{k}_abs": size[:, k]}
        power, at = size**2, np.arange(n)
        total = power.sum(1)
        some, whole = total > EPS, np.where(total > EPS, total, 1.0)
        centre = np.where(some, (at * power).sum(1) / whole, 0.0)
        f |= {"spectral_centroid": centre, "spectral_variance": np.where(some, ((at - centre[:, None]) ** 2 * power).sum(1) / whole, 0.0)}
    if need("agg_"):
        f |= dict(zip(("agg_linear_trend_slope", "agg_linear_trend_intercept", "agg_linear_trend_rvalue", "agg_linear_trend_stderr"), chunk_trend(v, max(n // 10, 2))))
    flat = ~(sd > EPS)
    return {k: (f[k], flat if k in ("skewness", "kurtosis") else None) for k in wanted if k in f}


def chunk_trend(v: np.ndarray, size: int) -> tuple:
    """Slope, intercept, correlation and standard error of the line through the means of chunks."""
    n = v.shape[1]
    if n < size:
        return 0.0, 0.0, 0.0, 0.0
    m = np.stack([v[:, i : i + size].mean(1) for i in range(0, n, size)], axis=1)
    k = m.shape[1]
    if k < 2:
        return 0.0, m[:, 0], 0.0, 0.0
    slope, intercept, r2 = line(m)
    x = np.arange(k)
    rest = ((m - intercept[:, None] - slope[:, None] * x) ** 2).sum(1)
    xx = ((x - x.mean()) ** 2).sum()
    return slope, intercept, np.sqrt(r2), np.sqrt(rest / (k - 2) / xx) if k > 2 else 0.0
