"""DuckDB SQL that computes periods, seasonal measures, peaks, changepoints and intervals from their definitions.

Each function returns a query over a source of (id, ds, y). Series are numbered i = 0 .. n-1 by date; m is their mean.
"""

from __future__ import annotations


def rows(source: str) -> str:
    return f"r AS (SELECT id, ds, y, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, avg(y) OVER (PARTITION BY id) AS m FROM {source})"


def _periodogram(rows_of: str, out: str) -> str:
    """out: id, n, k, p of the frequencies k / n above 0."""
    arg = "2 * pi() * k * i / k.n"
    return (
        f"{out}_k AS (SELECT DISTINCT id, n, unnest(range(1, n // 2 + 1)) AS k FROM {rows_of}), "
        f"{out} AS (SELECT k.id, k.n, k.k, pow(sum((y - m) * cos({arg})), 2) + pow(sum((y - m) * sin({arg})), 2) AS p FROM {out}_k k JOIN {rows_of} x USING (id) GROUP BY ALL)"
    )


def _peak(power: str, out: str, longest: int) -> str:
    ok = f"FILTER (n / k >= 2 AND n / k <= {longest})"
    return f"{out} AS (SELECT id, max(n) AS n, arg_max(n / k, p) {ok} AS period, max(p) {ok} AS power, max(p) {ok} / avg(p) AS confidence FROM {power} GROUP BY id)"


#: ac: id, lag, r of all lags.
_ACF = (
    "lg AS (SELECT DISTINCT id, n, unnest(range(0, n)) AS lag FROM r), tot AS (SELECT id, sum((y - m) * (y - m)) AS d FROM r GROUP BY id), "
    "ac AS (SELECT lg.id, lg.n, lg.lag, sum((a.y - a.m) * (b.y - b.m)) / max(d) AS r FROM lg JOIN tot USING (id) JOIN r a ON a.id = lg.id JOIN r b ON b.id = lg.id AND b.i = a.i + lg.lag GROUP BY ALL), "
    "acn AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM ac WINDOW w AS (PARTITION BY id ORDER BY lag)), "
    "af AS (SELECT id, arg_max(lag, r) AS period, max(r) AS power, greatest(max(r), 0) AS confidence FROM acn WHERE lag >= 2 AND lag <= least(n // 2, n - 2) AND r > before AND r >= after GROUP BY id)"
)
_FFT = _periodogram("r", "pw") + ", " + _peak("pw", "ff", 365)


def _auto(differenced: bool, out: str) -> str:
    """The periodogram's peak, moved to the best lag near it if the autocorrelation there is high enough."""
    source = "r"
    before = ""
    if differenced:
        before = f"{out}_d AS (SELECT id, i - 1 AS i, n - 1 AS n, y - lag(y) OVER (PARTITION BY id ORDER BY i) AS y FROM r QUALIFY i > 0), {out}_r AS (SELECT *, avg(y) OVER (PARTITION BY id) AS m FROM {out}_d), "
        source = f"{out}_r"
    near = f"JOIN ac ON ac.id = f.id AND lag BETWEEN greatest(2, floor(period * CAST(0.85 AS DOUBLE))) AND least(ac.n - 1, ceil(period * CAST(1.15 AS DOUBLE)))"
    least = 0.25 if differenced else 0.3
    return (
        f"{before}{_periodogram(source, out + '_p')}, {_peak(out + '_p', out + '_f', 1000000)}, "
        f"{out}_n AS (SELECT f.id, any_value(f.period) AS fp, any_value(f.confidence) AS fft_confidence, arg_max(lag, r) AS k, max(r) AS value FROM {out}_f f {near} GROUP BY f.id), "
        f"{out} AS (SELECT id, CASE WHEN value > {least} THEN CAST(k AS DOUBLE) ELSE fp END AS period, fft_confidence, value AS confidence, value > {least} AS detected FROM {out}_n)"
    )


_LOMB = (
    "g AS (SELECT id, n, f0 + (0.5 - f0) * j / 999 AS f FROM (SELECT DISTINCT id, n, 2 / (n - 1) AS f0, unnest(range(0, 1000)) AS j FROM r)), "
    "tau AS (SELECT g.id, f, 2 * pi() * f AS w, atan2(sum(sin(4 * pi() * f * i)), sum(cos(4 * pi() * f * i))) / (4 * pi() * f) AS tau, var_pop(y) AS v FROM g JOIN r USING (id) GROUP BY g.id, f), "
    "ls AS (SELECT tau.id, f, 0.5 * (pow(sum((y - m) * cos(w * (i - tau))), 2) / sum(pow(cos(w * (i - tau)), 2)) + pow(sum((y - m) * sin(w * (i - tau))), 2) / sum(pow(sin(w * (i - tau)), 2))) / any_value(v) AS p, least(sum(pow(cos(w * (i - tau)), 2)), sum(pow(sin(w * (i - tau)), 2))) AS ok FROM tau JOIN r USING (id) GROUP BY tau.id, f), "
    "lo AS (SELECT id, 1 / arg_max(f, p) AS period, arg_max(f, p) AS frequency, max(p) AS power, 1 - pow(1 - exp(-max(p)), 1000) AS false_alarm_prob FROM ls WHERE ok > 2.3e-16 GROUP BY id)"
)
_AIC = (
    "g AS (SELECT id, n, 2.0 + (n / 2 - 2.0) * j / 49 AS p FROM (SELECT DISTINCT id, n, unnest(range(0, 50)) AS j FROM r)), "
    "q AS (SELECT r.id, g.p, y - m AS y, cos(2 * pi() * i / g.p) AS c, sin(2 * pi() * i / g.p) AS s, r.n FROM r JOIN g USING (id)), "
    "co AS (SELECT id, p, CASE WHEN sum(c * c) > 2.3e-16 THEN sum(c * y) / sum(c * c) ELSE 0 END AS a, CASE WHEN sum(s * s) > 2.3e-16 THEN sum(s * y) / sum(s * s) ELSE 0 END AS b FROM q GROUP BY id, p), "
    "fit AS (SELECT id, p, max(n) AS n, sum(pow(y - a * c - b * s, 2)) AS rss, sum(y * y) AS total FROM q JOIN co USING (id, p) GROUP BY id, p), "
    "ai AS (SELECT id, arg_min(p, rss) AS period, min(rss) AS rss, 1 - min(rss) / max(total) AS r_squared, max(n) * ln(min(rss) / max(n)) + 6 AS aic, max(n) * ln(min(rss) / max(n)) + 3 * ln(max(n)) AS bic FROM fit GROUP BY id)"
)
_SAZED = (
    "k AS (SELECT DISTINCT id, n, unnest(range(1, 2 * n + 1)) AS k FROM r), h AS (SELECT id, i, (y - m) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM r), "
    "pw AS (SELECT k.id, k.n, k.k, pow(sum(x * cos(2 * pi() * k * i / (4 * k.n))), 2) + pow(sum(x * sin(2 * pi() * k * i / (4 * k.n))), 2) AS p FROM k JOIN h USING (id) GROUP BY ALL), "
    "sa AS (SELECT id, arg_max(4 * n / k, p) AS period, max(p) AS power, max(p) / median(p) AS snr FROM pw WHERE 4 * n / k BETWEEN 2 AND n / 2 GROUP BY id)"
)
_PROFILE = (
    "w AS (SELECT a.id, a.n, a.i, b.i - a.i AS j, b.y, greatest(4, a.n // 10) AS m FROM r a JOIN r b ON a.id = b.id AND b.i BETWEEN a.i AND a.i + greatest(4, a.n // 10) - 1 WHERE a.i + greatest(4, a.n // 10) <= a.n), "
    "z AS (SELECT id, i, j, m, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS z FROM w WINDOW p AS (PARTITION BY id, i)), "
    "cr AS (SELECT a.id, a.i AS a, b.i AS b, max(a.m) AS m, sum(a.z * b.z) AS c FROM z a JOIN z b ON a.id = b.id AND a.j = b.j AND abs(a.i - b.i) >= greatest(1, a.m // 2) GROUP BY a.id, a.i, b.i), "
    "ne AS (SELECT id, a, max(m) AS m, abs(a - arg_max(b, c - 1e-9 * abs(a - b))) AS lag FROM cr GROUP BY id, a), "
    "ct AS (SELECT id, lag, max(m) AS m, count(*) AS times, sum(count(*)) OVER (PARTITION BY id) AS total FROM ne GROUP BY id, lag), "
    "mp AS (SELECT id, CAST(arg_max(lag, times * 100000 - lag) AS DOUBLE) AS period, max(times) / max(total) AS confidence, max(times) AS n_motifs, max(m) AS subsequence_length FROM ct GROUP BY id)"
)


def strengths(wanted: str, rows_of: str = "r", tag: str = "") -> str:
    """tr: id, p, i, n, y, trend, x (detrended), s (seasonal means) and st: id, p, strength, trend_strength, of the
    periods `wanted` (id, p); tag goes before the names. The trend is a centred moving average over the period, its ends
    continued by their slope."""
    g = tag
    return (
        f"{g}t0 AS (SELECT c.id, c.p, c.p // 2 AS h, a.i, a.y, a.n FROM {wanted} c JOIN {rows_of} a USING (id)), "
        f"{g}mid AS (SELECT t.id, t.p, t.i, t.n, t.h, sum(b.y * CASE WHEN t.p % 2 = 0 AND abs(b.i - t.i) = t.h THEN 0.5 ELSE 1.0 END) / t.p AS v FROM {g}t0 t JOIN {rows_of} b ON b.id = t.id AND abs(b.i - t.i) <= t.h WHERE t.i BETWEEN t.h AND t.n - 1 - t.h GROUP BY t.id, t.p, t.i, t.n, t.h), "
        f"{g}ends AS (SELECT id, p, regr_slope(v, i) FILTER (i < h + q) AS ls, regr_intercept(v, i) FILTER (i < h + q) AS li, regr_slope(v, i) FILTER (i >= n - h - q) AS rs, regr_intercept(v, i) FILTER (i >= n - h - q) AS ri FROM (SELECT *, least(n - 2 * h, greatest(2, p)) AS q FROM {g}mid) GROUP BY id, p), "
        f"{g}t1 AS (SELECT t.id, t.p, t.i, t.n, t.y, CASE WHEN t.i < t.h THEN li + ls * t.i WHEN t.i > t.n - 1 - t.h THEN ri + rs * t.i ELSE v END AS trend FROM {g}t0 t JOIN {g}ends USING (id, p) LEFT JOIN {g}mid m ON m.id = t.id AND m.p = t.p AND m.i = t.i), "
        f"{g}tr AS (SELECT *, y - trend AS x, avg(y - trend) OVER (PARTITION BY id, p, i % p) AS s FROM {g}t1), "
        f"{g}st AS (SELECT id, p, CASE WHEN var_pop(x) > 2.3e-16 AND max(n) >= 2 * p THEN greatest(0, 1 - var_pop(x - s) / var_pop(x)) ELSE 0.0 END AS strength, greatest(0, 1 - var_pop(x) / var_pop(y)) AS trend_strength FROM {g}tr GROUP BY id, p)"
    )


_STL = (
    "gr AS (SELECT DISTINCT id, CAST(round_even(4 + (top - 4) * j / 49, 0) AS BIGINT) AS p FROM (SELECT DISTINCT id, greatest(4, least(n // 3, n // 2)) AS top, unnest(range(0, 50)) AS j FROM r)), "
    + strengths("gr", tag="g_")
    + ", sb AS (SELECT id, max(strength) AS best FROM g_st GROUP BY id), sl AS (SELECT id, CAST(arg_min(p, p) AS DOUBLE) AS period, arg_min(strength, p) AS strength, arg_min(trend_strength, p) AS trend_strength FROM g_st JOIN sb USING (id) WHERE strength >= best - 0.01 GROUP BY id)"
)

_R4 = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)

#: Method -> CTEs after r, and the relation and confidence that hold its result.
_METHODS = {
    "fft": (_FFT, "ff", "confidence"), "acf": (_ACF, "af", "confidence"), "autoperiod": (f"{_ACF}, {_auto(False, 'au')}", "au", "confidence"), "cfd_autoperiod": (f"{_ACF}, {_auto(True, 'au')}", "au", "confidence"),
    "lomb_scargle": (_LOMB, "lo", "1 - false_alarm_prob"), "aic": (_AIC, "ai", "r_squared"), "sazed": (_SAZED, "sa", "1 - 1 / greatest(snr, 1)"), "matrix_profile": (_PROFILE, "mp", "confidence"), "stl": (_STL, "sl", "strength"),
    "auto": (f"{_FFT}, {_ACF}, ua AS (SELECT id, CASE WHEN af.confidence > 0.3 AND ff.confidence < 5 THEN af.period ELSE ff.period END AS period, CASE WHEN af.confidence > 0.3 AND ff.confidence < 5 THEN af.confidence ELSE ff.confidence END AS confidence FROM ff LEFT JOIN af USING (id))", "ua", "confidence"),
}


def detected(method: str, source: str = "{daily}", least: float = 0.0, expected: float | None = 7.0, method_name: str | None = None) -> str:
    """One row a series: the number of periods and the first one with its measures, null if there is none."""
    ctes, relation, confidence = _METHODS[method]
    near = f"abs(period - {expected}) / {expected}" if expected else "NULL"
    hit = f"{near} <= 0.1" if expected else "CAST(NULL AS BOOLEAN)"
    return (
        f"WITH {rows(source)}, {ctes}, e AS (SELECT id, CAST(period AS DOUBLE) AS period, CAST({confidence} AS DOUBLE) AS confidence FROM {relation} WHERE {confidence} >= {least} AND period <= 365), "
        f"c AS (SELECT id, CAST(greatest(2, round_even(period, 0)) AS BIGINT) AS p FROM e), {strengths('c')}, am AS (SELECT id, stddev_pop(y) * sqrt(2) AS amplitude FROM r GROUP BY id), "
        f"f AS (SELECT e.*, coalesce(strength, 0.0) AS strength, {hit} AS matches_expected, CASE WHEN {hit} THEN CAST({expected or 'NULL'} AS DOUBLE) END AS matched_expected_period, CASE WHEN {hit} THEN CAST({near} AS DOUBLE) END AS match_deviation FROM e LEFT JOIN st USING (id)) "
        f"SELECT am.id, CAST(CASE WHEN period IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_periods, '{method_name or method}' AS method, {_R4('period', 'confidence', 'strength')}, CASE WHEN period IS NOT NULL THEN round(amplitude, 4) END AS amplitude, matches_expected, matched_expected_period, round(match_deviation, 4) AS match_deviation FROM am LEFT JOIN f USING (id)"
    )


def _simple(ctes: str, relation: str, select: str, source: str = "{daily}") -> str:
    return f"WITH {rows(source)}, {ctes} SELECT id, {select} FROM {relation}"


ARRAYS = {
    "estimate_period_fft": _simple(_FFT, "ff", f"{_R4('period')}, round(1 / period, 4) AS frequency, round(power, 2) AS power, {_R4('confidence')}, 'fft' AS method"),
    "estimate_period_acf": _simple(_ACF, "af", f"CAST(period AS DOUBLE) AS period, round(1 / period, 4) AS frequency, {_R4('power', 'confidence')}, 'acf' AS method"),
    "autoperiod": _simple(f"{_ACF}, {_auto(False, 'au')}", "au", f"{_R4('period', 'fft_confidence')}, round(confidence, 4) AS acf_validation, detected, 'autoperiod' AS method"),
    "cfd_autoperiod": _simple(f"{_ACF}, {_auto(True, 'au')}", "au", f"{_R4('period', 'fft_confidence')}, round(confidence, 4) AS acf_validation, detected, 'cfd_autoperiod' AS method"),
    "lomb_scargle": _simple(_LOMB, "lo", f"{_R4('period', 'frequency', 'power', 'false_alarm_prob')}, 'lomb_scargle' AS method"),
    "aic_period": _simple(_AIC, "ai", f"{_R4('period', 'aic', 'bic')}, round(rss, 2) AS rss, {_R4('r_squared')}, 'aic' AS method"),
    "sazed_period": _simple(_SAZED, "sa", f"{_R4('period')}, round(power, 2) AS power, {_R4('snr')}, 'sazed' AS method"),
    "matrix_profile_period": _simple(_PROFILE, "mp", f"period, {_R4('confidence')}, CAST(n_motifs AS BIGINT) AS n_motifs, CAST(subsequence_length AS BIGINT) AS subsequence_length, 'matrix_profile' AS method"),
    "stl_period": _simple(_STL, "sl", "period, round(strength, 4) AS seasonal_strength, round(trend_strength, 4) AS trend_strength, 'stl' AS method"),
}

_LAGS = "f AS (SELECT id, lag, r, row_number() OVER (PARTITION BY id ORDER BY r DESC) AS rank FROM acn WHERE lag BETWEEN 2 AND n // 2 - 1 AND r > before + 1e-12 AND r > after + 1e-12 AND r > 0.1 QUALIFY rank <= 5)"
SEASONALITY = f"WITH {rows('{daily}')}, {_ACF}, {_LAGS} SELECT id, CAST(rank AS INTEGER) AS rank, CAST(lag AS INTEGER) AS period FROM f"
ANALYZED = f"WITH {rows('{daily}')}, {_ACF}, {_LAGS}, c AS (SELECT id, abs(corr(i, y)) AS t FROM r GROUP BY id) SELECT c.id, CAST(coalesce(lag, 0) AS INTEGER) AS primary_period, round(coalesce(least(greatest(r, 0), 1), 0.0), 4) AS seasonal_strength, round(t, 4) AS trend_strength FROM c LEFT JOIN f ON f.id = c.id AND rank = 1"

_SEVEN = "c AS (SELECT DISTINCT id, CAST(7 AS BIGINT) AS p FROM r)"
STRENGTH = f"WITH {rows('{daily}')}, {_SEVEN}, {strengths('c')} SELECT id, round(strength, 4) AS strength FROM st"
WINDOWED = (
    f"WITH {rows('{daily}').replace('r AS', 'r0 AS', 1)}, s AS (SELECT DISTINCT id, unnest(range(0, n - 13)) AS s FROM r0), r AS (SELECT r0.id || '@' || s AS id, y, i - s AS i, 14 AS n FROM r0 JOIN s ON s.id = r0.id AND i BETWEEN s AND s + 13), {_SEVEN}, {strengths('c')} "
    "SELECT string_split(id, '@')[1] AS id, CAST(string_split(id, '@')[2] AS INTEGER) AS pos, round(strength, 4) AS strength FROM st"
)
SPECTRAL = (
    f"WITH {rows('{daily}')}, l AS (SELECT id, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM r GROUP BY id), x AS (SELECT id, i, n, y - a - b * i AS y, 0.0 AS m FROM r JOIN l USING (id)), {_periodogram('x', 'pw')}, "
    "f AS (SELECT *, k * 7.0 / n AS f FROM pw) SELECT id, round(sum(p) FILTER (abs(f - round_even(f, 0)) < 3.5 / n + 0.05 AND round_even(f, 0) >= 1) / sum(p), 4) AS strength FROM f GROUP BY id"
)

_CYCLES = "cy AS (SELECT id, i // 7 AS c, arg_max(i, y) AS spot, max(y) AS top FROM r WHERE i // 7 < n // 7 GROUP BY ALL), sh AS (SELECT *, (spot % 7) / 7 AS share FROM cy), tm AS (SELECT id, count(*) AS n_peaks, avg(share) AS mean_timing, stddev_pop(share) AS sd, max(share) - min(share) AS range_timing, regr_slope(share, c) AS timing_trend FROM sh GROUP BY id)"
TIMING = f"WITH {rows('{daily}')}, {_CYCLES} SELECT id, n_peaks, round(mean_timing, 4) AS mean_timing, round(sd, 4) AS std_timing, round(range_timing, 4) AS range_timing, round(least(1.0, sd / 0.2887), 4) AS variability_score, round(timing_trend, 4) AS timing_trend, sd < 0.1 AS is_stable FROM tm"
PEAK_TIMES = f"WITH {rows('{daily}')}, {_CYCLES} SELECT id, CAST(spot AS DOUBLE) AS peak_times, top AS peak_values, round(share, 4) AS normalized_timing FROM sh"
PEAKS = (
    f"WITH {rows('{daily}')}, b AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM r WINDOW w AS (PARTITION BY id ORDER BY i)), k AS (SELECT id, i, y FROM b WHERE y > before AND y >= after), "
    "e AS (SELECT k.id, k.i, k.y, coalesce(max(r.i) FILTER (r.i < k.i AND r.y > k.y), 0) AS lo, coalesce(min(r.i) FILTER (r.i > k.i AND r.y > k.y), max(r.i)) AS hi FROM k JOIN r USING (id) GROUP BY ALL), "
    "p AS (SELECT e.id, e.i, e.y, e.y - greatest(min(r.y) FILTER (r.i BETWEEN lo AND e.i), min(r.y) FILTER (r.i BETWEEN e.i AND hi)) AS prominence FROM e JOIN r USING (id) GROUP BY e.id, e.i, e.y, lo, hi) "
    'SELECT id, i AS "index", y AS value, round(prominence, 4) AS prominence, count(*) OVER (PARTITION BY id) AS n_peaks, round((max(i) OVER (PARTITION BY id) - min(i) OVER (PARTITION BY id)) / (count(*) OVER (PARTITION BY id) - 1), 4) AS mean_period FROM p'
)
CLASSES = (
    f"WITH {rows('{daily}')}, {_CYCLES}, {_SEVEN}, {strengths('c')}, cs AS (SELECT id, i // 7 AS c, greatest(0, 1 - sum((x - s) * (x - s)) / sum(x * x)) AS strength FROM tr WHERE i // 7 < n // 7 GROUP BY ALL), "
    "ws AS (SELECT id, count(*) FILTER (strength < 0.3) AS weak, count(*) AS k, sum(strength) AS total FROM cs GROUP BY id) "
    "SELECT id, CASE WHEN strength < 0.3 THEN 'non_seasonal' WHEN sd <= 0.05 AND weak = 0 THEN 'stable_seasonal' WHEN weak > k / 3 THEN 'intermittent_seasonal' WHEN sd > 0.05 THEN 'variable_timing' ELSE 'stable_seasonal' END AS timing_classification, "
    "sd <= 0.05 AS has_stable_timing, round(sd, 4) AS timing_variability, round(strength, 4) AS seasonal_strength, strength >= 0.3 AS is_seasonal, CAST(weak AS INTEGER) AS n_weak, round(total, 4) AS cycle_strengths_sum FROM st JOIN tm USING (id) JOIN ws USING (id)"
)
LOESS = (
    f"WITH {rows('{daily}')}, k AS (SELECT *, CAST(least(n, greatest(3, ceil(CAST(0.3 AS DOUBLE) * n))) AS BIGINT) AS k FROM r), w0 AS (SELECT *, least(greatest(0, i - k // 2), n - k) AS lo FROM k), "
    "w1 AS (SELECT a.id, a.i, a.y, b.i - a.i AS x, b.y AS v, max(abs(b.i - a.i)) OVER (PARTITION BY a.id, a.i) + 1 AS far FROM w0 a JOIN r b ON b.id = a.id AND b.i BETWEEN a.lo AND a.lo + a.k - 1), "
    "w2 AS (SELECT *, pow(1 - pow(abs(x) / far, 3), 3) AS w FROM w1), "
    "f AS (SELECT id, i, any_value(y) AS y, (sum(w * x * x) * sum(w * v) - sum(w * x) * sum(w * x * v)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) AS trend FROM w2 GROUP BY id, i) "
    "SELECT id, CAST(i AS INTEGER) AS pos, round(trend, 4) AS trend, round(y - trend, 4) AS detrended FROM f"
)
TREND = f"WITH {rows('{daily}')}, c AS (SELECT DISTINCT id, least(greatest(3, n // 5), greatest(n - 2, 1)) AS p FROM r), {strengths('c')} SELECT id, CAST(i AS INTEGER) AS pos, round(trend, 4) AS trend, round(x, 4) AS remainder FROM tr"

_K, _A = "(0.01 + j - 1)", "(0.01 + (j - 1) / 2)"
_MU = f"(s1[j] / {_K})"
_BETA = f"(0.01 + 0.5 * greatest(s2[j] - s1[j] * s1[j] / greatest(j - 1, 1), 0) + 0.01 * (j - 1) * {_MU} * {_MU} / (2 * {_K}))"
_Z = f"((ys[t + 1] - {_MU}) / greatest(sqrt({_BETA} * ({_K} + 1) / ({_A} * {_K})), 1e-10))"


def changepoints(source: str, select: str) -> str:
    """Bayesian online changepoint detection over lists by run length; sg: id, t (0-based), signal."""
    return (
        f"WITH RECURSIVE {rows(source)}, a AS (SELECT id, list(y ORDER BY i) AS ys, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY id), "
        "b AS (SELECT id, ys, n, CAST(0 AS BIGINT) AS t, [CAST(1 AS DOUBLE)] AS prob, [CAST(0 AS DOUBLE)] AS s1, [CAST(0 AS DOUBLE)] AS s2, CAST(0 AS DOUBLE) AS signal FROM a "
        "UNION ALL SELECT id, ys, n, t + 1, list_transform(p, lambda x: x / list_sum(p)), list_prepend(CAST(0 AS DOUBLE), list_transform(s1, lambda x: x + ys[t + 1])), list_prepend(CAST(0 AS DOUBLE), list_transform(s2, lambda x: x + ys[t + 1] * ys[t + 1])), p[2] / list_sum(p) "
        "FROM (SELECT *, list_prepend(list_sum(g) / 250, list_transform(g, lambda x: x * (1 - CAST(1 AS DOUBLE) / 250))) AS p FROM (SELECT *, "
        f"list_transform(range(1, len(prob) + 1), lambda j: prob[j] * pow(1 + {_Z} * {_Z} / (2 * {_A}), -(2 * {_A} + 1) / 2)) AS g FROM b WHERE t < n))), "
        f"sg AS (SELECT id, t - 1 AS t, signal FROM b WHERE t > 0) {select}"
    )


CHANGES = changepoints("{daily}", "SELECT r.id, ds, y, signal > 0.5 AND t > 0 AS is_changepoint, round(signal, 4) AS changepoint_probability FROM r JOIN sg ON sg.id = r.id AND sg.t = r.i")
PELT = (
    f"WITH RECURSIVE {rows('{daily}')}, q AS (SELECT *, sum(y) OVER w AS c1, sum(y * y) OVER w AS c2 FROM r WINDOW w AS (PARTITION BY id ORDER BY i)), "
    "a AS (SELECT id, list_prepend(CAST(0 AS DOUBLE), list(c1 ORDER BY i)) AS c1, list_prepend(CAST(0 AS DOUBLE), list(c2 ORDER BY i)) AS c2, CAST(count(*) AS BIGINT) AS n, 2 * ln(count(*)) AS pen FROM q GROUP BY id), "
    "b AS (SELECT id, c1, c2, n, pen, CAST(1 AS BIGINT) AS j, [-pen, CAST('inf' AS DOUBLE)] AS best, [CAST(0 AS BIGINT), CAST(0 AS BIGINT)] AS prev FROM a "
    "UNION ALL SELECT id, c1, c2, n, pen, j + 1, list_append(best, list_min(c) + pen), list_append(prev, CAST(list_position(c, list_min(c)) - 1 AS BIGINT)) "
    "FROM (SELECT *, list_transform(range(0, j), lambda i: best[i + 1] + greatest(c2[j + 2] - c2[i + 1] - pow(c1[j + 2] - c1[i + 1], 2) / (j + 1 - i), 0)) AS c FROM b WHERE j < n)), "
    "f AS (SELECT * FROM b WHERE j = n), k AS (SELECT id, prev, prev[n + 1] AS cut FROM f UNION ALL SELECT id, prev, prev[cut + 1] FROM k WHERE cut > 0) "
    "SELECT f.id, (SELECT count(*) FROM k WHERE k.id = f.id AND cut > 0) AS n_changepoints, (SELECT coalesce(string_agg(CAST(cut AS VARCHAR), ',' ORDER BY cut), '') FROM k WHERE k.id = f.id AND cut > 0) AS changepoints, round(best[n + 1], 2) AS cost FROM f"
)


# ------------------------------------------------------------------ intervals


def quantile(values: str, alpha: float) -> str:
    """The conformal score of a sorted list; 0 for an empty one."""
    n = f"len({values})"
    at = f"(least(1.0, ceil(round(({n} + 1) * (1 - CAST({alpha} AS DOUBLE)), 9)) / {n}) * ({n} - 1))"
    get = lambda k: f"list_extract({values}, CAST({k} AS INTEGER))"
    lo = f"floor({at})"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE {get(lo + ' + 1')} + ({get(f'least({lo} + 2, {n})')} - {get(lo + ' + 1')}) * ({at} - {lo}) END"


_PAIRS = "WITH z0 AS (SELECT id, ds, y, lag(y) OVER (PARTITION BY id ORDER BY ds) AS f FROM {daily}), z AS (SELECT *, y - f AS r FROM z0 WHERE f IS NOT NULL), l AS (SELECT id, count(*) AS n, min(ds) AS d0, list(abs(r) ORDER BY abs(r)) AS absolute, coalesce(list(-r ORDER BY -r) FILTER (r < 0), []) AS down, coalesce(list(r ORDER BY r) FILTER (r > 0), []) AS up, list(f ORDER BY ds) AS fs FROM z GROUP BY id) "
ASYMMETRIC = _PAIRS + f"SELECT id AS group_col, round((({quantile('down', 0.1)}) + ({quantile('up', 0.1)})) / 2, 4) AS conformity_score, CAST(0.8 AS DOUBLE) AS coverage, 'asymmetric_conformal' AS method, round(list_min(fs) - ({quantile('down', 0.1)}), 4) AS lower, round(list_max(fs) + ({quantile('up', 0.1)}), 4) AS upper, CAST(n AS INTEGER) AS n FROM l"
LEARNED = _PAIRS + f"SELECT id, round({quantile('absolute', 0.1)}, 4) AS score_10, round({quantile('absolute', 0.2)}, 4) AS score_20, round((({quantile('down', 0.05)}) + ({quantile('up', 0.05)})) / 2, 4) AS asymmetric, CAST(2 AS INTEGER) AS levels, round(fs[1] - ({quantile('absolute', 0.2)}), 4) AS first_lower_20 FROM l"
PER_STEP = (
    _PAIRS + ", p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS j, count(*) OVER (PARTITION BY id) AS n FROM z), w AS (SELECT id, (j + 3 * (n - 4)) % 4 AS k, list(abs(r) ORDER BY abs(r)) AS l FROM p WHERE j < n - 4 GROUP BY ALL) "
    f"SELECT p.id, CAST(k AS INTEGER) AS step, round(f, 4) AS point, round({quantile('l', 0.1)}, 4) AS half_width, round(f - ({quantile('l', 0.1)}), 4) AS lower, round(f + ({quantile('l', 0.1)}), 4) AS upper FROM p JOIN w ON w.id = p.id AND w.k = p.j - p.n + 4 WHERE p.n - 4 >= 8 "
    "UNION ALL SELECT DISTINCT id, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM p WHERE n - 4 < 8"
)


# ------------------------------------------------------------------ intermittent demand

FILLED = "(WITH u AS {demand}, g AS (SELECT id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds FROM u GROUP BY id) SELECT g.id, g.ds, coalesce(u.y, 0.0) AS y FROM g LEFT JOIN u USING (id, ds))"
_SMOOTH = lambda values, alpha: f"list_reduce({values}, lambda a, b: a + {alpha} * (b - a))"


def _best(values: str) -> str:
    """The level at the end with the smoothing constant of least squared one-step error among 0.05, 0.1 .. 0.95."""
    error = f"list_reduce(list_transform({values}, lambda x: {{'l': CAST(x AS DOUBLE), 's': CAST(0 AS DOUBLE)}}), lambda a, b: {{'l': a.l + g * (b.l - a.l), 's': a.s + pow(b.l - a.l, 2)}})"
    tried = f"list_transform(range(1, 20), lambda e: list_transform([e / 20], lambda g: {{'s': ({error}).s, 'e': e, 'l': ({error}).l}})[1])"
    return f"list_sort({tried})[1].l"


def intermittent(model: str, source: str, step: str, horizon: int) -> str:
    """Forecasts of an intermittent-demand model with the history's spread as interval."""
    block = "greatest(1, least(CAST(round_even(list_avg(gap), 0) AS BIGINT), greatest(len(ys) // 2, 1)))"
    sums = lambda k: f"list_transform(range(0, len(ys) // {k}), lambda c: list_sum(ys[CAST(len(ys) % {k} + c * {k} + 1 AS BIGINT):CAST(len(ys) % {k} + (c + 1) * {k} AS BIGINT)]))"
    value = {
        "CrostonClassic": f"{_SMOOTH('size', 0.1)} / {_SMOOTH('gap', 0.1)}",
        "CrostonSBA": f"0.95 * {_SMOOTH('size', 0.1)} / {_SMOOTH('gap', 0.1)}",
        "CrostonOptimized": f"{_best('size')} / {_best('gap')}",
        "TSB": f"{_SMOOTH('size', 0.1)} * {_SMOOTH('[CASE WHEN ys[1] <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END] || list_transform(ys, lambda x: CASE WHEN x <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)', 0.1)}",
        "ADIDA": f"{_best('sums')} / block",
    }[model]
    need = f", b AS (SELECT *, {block} AS block FROM d), v0 AS (SELECT *, {sums('block')} AS sums FROM b)" if model == "ADIDA" else ", v0 AS (SELECT * FROM d)"
    return (
        f"WITH {rows(source)}, s AS (SELECT id, max(ds) AS last, stddev_pop(y) AS sd, list(y ORDER BY i) AS ys, list(y ORDER BY i) FILTER (y <> 0) AS size FROM r GROUP BY id), z AS (SELECT id, i, CAST(i - coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), -1) AS DOUBLE) AS g FROM r WHERE y <> 0), "
        f"d AS (SELECT s.*, gap FROM s JOIN (SELECT id, list(g ORDER BY i) AS gap FROM z GROUP BY id) USING (id)){need}, v AS (SELECT id, last, sd, {value} AS f FROM v0), k AS (SELECT unnest(range(1, {horizon + 1})) AS k) "
        f"SELECT id, CAST(k AS INTEGER) AS forecast_step, CAST(last + {step} AS DATE) AS ds, round(f, 4) AS yhat, round(f - 1.645 * sd * sqrt(k), 4) AS yhat_lower, round(f + 1.645 * sd * sqrt(k), 4) AS yhat_upper, '{model}' AS model_name FROM v, k"
    )
