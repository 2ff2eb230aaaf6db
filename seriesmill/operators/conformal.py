"""Conformal and bootstrap prediction intervals.

Array functions are Column expressions that stay in the JVM; only the bootstrap draws in Python. Grouped forms collect
the residuals of a group, or, where only a quantile is wanted, rank them with a window.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import series

METHODS, STRATEGIES = ("symmetric", "asymmetric", "adaptive"), ("split", "crossval", "jackknife_plus")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _values(c) -> Column:
    """Doubles without null and NaN."""
    return F.filter(_col(c).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))


def _number(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else _col(x)


def _rank(sorted_values: Column, alpha: Column) -> Column:
    """The value at the level ceil((n + 1)(1 - alpha)) / n, at most 1, between neighbours on a straight line."""
    n = F.size(sorted_values)
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n))
    at = level * (n - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, F.least(lo + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (at - lo))


def _valid(alpha: Column) -> Column:
    return (alpha >= 0) & (alpha < 1)


def conformal_quantile(residuals, alpha) -> Column:
    """The score that a share 1 - alpha of the absolute residuals does not exceed, corrected for their number. Null for
    no residuals or an alpha outside [0, 1)."""
    a = _number(alpha)
    return F.when(_valid(a), _rank(F.array_sort(F.transform(_values(residuals), F.abs)), a))


def conformal_intervals(forecasts, score) -> Column:
    """struct<lower, upper>: forecasts less and plus the score."""
    f, s = _col(forecasts).cast("array<double>"), _number(score)
    return F.struct(F.transform(f, lambda x: x - s).alias("lower"), F.transform(f, lambda x: x + s).alias("upper"))


def _result(f: Column, lo: Column, hi: Column, alpha: Column, score: Column, method: str) -> Column:
    got = F.struct(f.alias("point"), F.transform(f, lambda x: x - lo).alias("lower"), F.transform(f, lambda x: x + hi).alias("upper"), (1 - alpha).alias("coverage"), score.alias("conformity_score"), F.lit(method).alias("method"))
    return F.when(score.isNotNull(), got)


def conformal_predict(residuals, forecasts, alpha) -> Column:
    """struct<point, lower, upper, coverage, conformity_score, method> with one width on both sides."""
    a = _number(alpha)
    s = conformal_quantile(residuals, a)
    return _result(_col(forecasts).cast("array<double>"), s, s, a, s, "split_conformal")


def _tails(residuals, alpha: Column) -> tuple[Column, Column]:
    v = _values(residuals)
    tail = lambda test: F.coalesce(_rank(F.array_sort(F.transform(F.filter(v, test), F.abs)), alpha / 2), F.lit(0.0))
    return tail(lambda x: x < 0), tail(lambda x: x > 0)


def conformal_predict_asymmetric(residuals, forecasts, alpha) -> Column:
    """The same with a width for each side, from the residuals of its sign at half of alpha."""
    a = _number(alpha)
    lo, hi = _tails(residuals, a)
    score = F.when(_valid(a) & (F.size(_values(residuals)) > 0), (lo + hi) / 2)
    return _result(_col(forecasts).cast("array<double>"), lo, hi, a, score, "asymmetric_conformal")


def conformal_predict_adaptive(residuals, difficulty, forecasts, forecast_difficulty, alpha) -> Column:
    """Widths in proportion to each forecast's difficulty; residuals are scored relative to their own."""
    a = _number(alpha)
    scaled = F.zip_with(_col(residuals).cast("array<double>"), _col(difficulty).cast("array<double>"), lambda r, d: r / d)
    s = conformal_quantile(scaled, a)
    f = _col(forecasts).cast("array<double>")
    width = F.transform(_col(forecast_difficulty).cast("array<double>"), lambda d: d * s)
    got = F.struct(f.alias("point"), F.zip_with(f, width, lambda x, w: x - w).alias("lower"), F.zip_with(f, width, lambda x, w: x + w).alias("upper"), (1 - a).alias("coverage"), s.alias("conformity_score"), F.lit("adaptive_conformal").alias("method"))
    return F.when(s.isNotNull(), got)


def conformal_predict_multi(residuals, forecasts, alphas: list[float]) -> Column:
    """array of conformal_predict for each alpha."""
    return F.array(*[conformal_predict(residuals, forecasts, a) for a in alphas])


def conformal_learn(residuals, alphas: list[float], method: str = "symmetric", strategy: str = "split") -> Column:
    """A profile: struct<method, strategy, alphas, state_vector, scores_lower, scores_upper, n_residuals>."""
    if method not in METHODS or strategy not in STRATEGIES:
        raise ValueError(f"method must be one of {METHODS}, strategy one of {STRATEGIES}")
    if strategy == "jackknife_plus" and method == "asymmetric":
        raise ValueError("jackknife_plus does not go with asymmetric")
    if not alphas or any(not 0 <= a < 1 for a in alphas):
        raise ValueError("alphas lie in [0, 1), and there is one at least")
    pairs = [_tails(residuals, F.lit(float(a))) if method == "asymmetric" else (conformal_quantile(residuals, a),) * 2 for a in alphas]
    lo, hi = F.array(*[p[0] for p in pairs]), F.array(*[p[1] for p in pairs])
    state = F.array_sort(F.transform(_values(residuals), F.abs)) if strategy == "jackknife_plus" else F.concat(lo, hi)
    n = F.size(_values(residuals)).cast("long")
    return F.when(n > 0, F.struct(F.lit(method).alias("method"), F.lit(strategy).alias("strategy"), F.array(*map(F.lit, map(float, alphas))).alias("alphas"), state.alias("state_vector"), lo.alias("scores_lower"), hi.alias("scores_upper"), n.alias("n_residuals")))


def conformal_apply(forecasts, profile, difficulty=None) -> Column:
    """struct<point, lower, upper, coverage, method>: lower and upper have an array for each level of the profile. An
    adaptive profile needs each forecast's difficulty, which is taken relative to its mean."""
    f, p = _col(forecasts).cast("array<double>"), _col(profile)
    if difficulty is None:
        d = F.transform(f, lambda x: F.when(p["method"] != "adaptive", 1.0))
    else:
        raw = _col(difficulty).cast("array<double>")
        mean = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x) / F.size(raw)
        d = F.transform(raw, lambda x: F.when(p["method"] == "adaptive", x / mean).otherwise(1.0))
    lower = F.transform(p["scores_lower"], lambda s: F.zip_with(f, d, lambda x, w: x - s * w))
    upper = F.transform(p["scores_upper"], lambda s: F.zip_with(f, d, lambda x, w: x + s * w))
    return F.when(F.size(f) > 0, F.struct(f.alias("point"), lower.alias("lower"), upper.alias("upper"), F.transform(p["alphas"], lambda a: 1 - a).alias("coverage"), p["method"].alias("method")))


def _triples(actuals, lower, upper) -> tuple[Column, Column]:
    a, lo, hi = (_col(c).cast("array<double>") for c in (actuals, lower, upper))
    z = F.arrays_zip(a.alias("a"), lo.alias("l"), hi.alias("u"))
    return z, (F.size(a) > 0) & (F.size(a) == F.size(lo)) & (F.size(a) == F.size(hi))


def _mean(z: Column, term) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda s, x: s + term(x)) / F.size(z)


def conformal_coverage(actuals, lower, upper) -> Column:
    z, ok = _triples(actuals, lower, upper)
    return F.when(ok, _mean(z, lambda x: ((x["a"] >= x["l"]) & (x["a"] <= x["u"])).cast("double")))


def mean_interval_width(lower, upper) -> Column:
    z = F.arrays_zip(_col(lower).cast("array<double>").alias("l"), _col(upper).cast("array<double>").alias("u"))
    return F.when(F.size(z) > 0, _mean(z, lambda x: x["u"] - x["l"]))


def interval_width(lower, upper) -> Column:
    return F.zip_with(_col(lower).cast("array<double>"), _col(upper).cast("array<double>"), lambda a, b: b - a)


def conformal_evaluate(actuals, lower, upper, alpha) -> Column:
    """struct<coverage, violation_rate, mean_width, winkler_score, n_observations>."""
    z, ok = _triples(actuals, lower, upper)
    a = _number(alpha)
    outside = lambda x: F.greatest(x["l"] - x["a"], x["a"] - x["u"], F.lit(0.0))
    winkler = _mean(z, lambda x: x["u"] - x["l"] + 2.0 / a * outside(x))
    c = conformal_coverage(actuals, lower, upper)
    return F.when(ok, F.struct(c.alias("coverage"), (1 - c).alias("violation_rate"), mean_interval_width(lower, upper).alias("mean_width"), winkler.alias("winkler_score"), F.size(z).cast("long").alias("n_observations")))


def conformal_predict_per_step(fold_forecasts, fold_actuals, point, alpha, horizon: int) -> Column:
    """struct<point, lower, upper, half_widths, coverage>: a width for each step from that step's residuals in all folds.

    The folds are flattened one after another, each of `horizon` values; two folds at least, else null."""
    a = _number(alpha)
    r = F.zip_with(_col(fold_actuals).cast("array<double>"), _col(fold_forecasts).cast("array<double>"), lambda x, f: x - f)
    p = _col(point).cast("array<double>")
    step = lambda k: F.filter(r, lambda x, i: (i % horizon) == k)
    half = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: conformal_quantile(step(k), a))
    n = F.size(r)
    side = lambda sign: F.transform(p, lambda x, i: x + sign * F.get(half, F.least(i, F.lit(horizon - 1))))
    return F.when((n >= 2 * horizon) & (n % horizon == 0), F.struct(p.alias("point"), side(-1).alias("lower"), side(1).alias("upper"), half.alias("half_widths"), (1 - a).alias("coverage")))


# ------------------------------------------------------------------ grouped


def conformal_by(df: DataFrame, group: str, actual: str, forecast: str, point_forecast: str, params: dict | None = None) -> DataFrame:
    """group_col, point, lower, upper, coverage, conformity_score, method; forecasts are ordered by value."""
    p = {"alpha": 0.1, "method": "symmetric"} | (params or {})
    both = F.col(actual).isNotNull() & F.col(forecast).isNotNull()
    listed = df.groupBy(F.col(group).alias("group_col")).agg(F.collect_list(F.when(both, (F.col(actual) - F.col(forecast)).cast("double"))).alias("r"), F.array_sort(F.collect_list(F.col(point_forecast).cast("double"))).alias("f"))
    build = conformal_predict_asymmetric if p["method"] == "asymmetric" else conformal_predict
    listed = listed.where((F.size("r") > 0) & (F.size("f") > 0))
    return listed.select("group_col", build("r", "f", float(p["alpha"])).alias("c")).select("group_col", "c.*")


def conformal_rows_by(df: DataFrame, group: str, actual: str, forecast: str, point_forecast: str, alpha: float = 0.1) -> DataFrame:
    """All columns of df with lower and upper around each row's point forecast, from the group's residuals."""
    score = "_score" + "_" * max(len(c) for c in df.columns)  # longer than any column's name
    scores = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).groupBy(group).agg(conformal_quantile(F.collect_list((F.col(actual) - F.col(forecast)).cast("double")), alpha).alias(score))
    return df.join(scores, group, "left").withColumns({"lower": F.col(point_forecast) - F.col(score), "upper": F.col(point_forecast) + F.col(score)}).drop(score)


def order_statistic(df: DataFrame, column: str, k: int, small: int = 10_000) -> float:
    """The k-th smallest value (from 0) of a column without null or NaN, exactly.

    Approximate percentiles bracket it, counts tell what lies below the bracket, and the bracket shrinks until at most
    `small` values are left for the driver; every pass is an aggregation, whatever the number of rows.
    """
    v, inside, below = F.col(column), F.lit(True), 0
    while True:
        part = df.where(inside)
        n = part.count()
        if n <= small:
            return sorted(r[0] for r in part.select(v).collect())[k - below]
        at = (k - below) / (n - 1)
        a, b = part.agg(F.percentile_approx(v, [max(0.0, at - 2e-4), min(1.0, at + 2e-4)], 10_000)).first()[0]
        c = part.agg(*[F.count(F.when(x, 1)) for x in (v < a, v <= a, v < b, v <= b)]).first()
        here = k - below
        if c[0] <= here < c[1]:
            return a
        if c[2] <= here < c[3]:
            return b
        if here < c[0]:
            inside = inside & (v < a)
        elif here >= c[3]:
            inside, below = inside & (v > b), below + c[3]
        else:
            inside, below = inside & (v > a) & (v < b), below + c[1]


def conformal_calibrate(df: DataFrame, actual: str, forecast: str, params: dict | None = None) -> DataFrame:
    """One row: conformity_score, coverage, n_residuals of the whole table. The score is computed when this is called."""
    alpha = float((params or {}).get("alpha", 0.1))
    if not 0 <= alpha < 1:
        raise ValueError("alpha lies in [0, 1)")
    r = df.select(F.abs((F.col(actual) - F.col(forecast)).cast("double")).alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r"))
    # Several passes read the residuals; kept on executors' disks, so that what they are made from runs once. A lost
    # executor's part is made again.
    r.persist(StorageLevel.DISK_ONLY)
    try:
        n, score = r.count(), None
        if n:
            at = min(1.0, math.ceil(round((n + 1) * (1 - alpha), 9)) / n) * (n - 1)
            lo = math.floor(at)
            score = order_statistic(r, "r", lo)
            if at > lo:
                score += (order_statistic(r, "r", lo + 1) - score) * (at - lo)
    finally:
        r.unpersist()
    return df.sparkSession.createDataFrame([(score, 1 - alpha, n)], "conformity_score double, coverage double, n_residuals long")


def conformal_apply_by(df: DataFrame, group: str, forecast: str, score: float) -> DataFrame:
    """group_col, lower, upper: arrays ordered by forecast."""
    listed = df.where(F.col(forecast).isNotNull()).groupBy(F.col(group).alias("group_col")).agg(F.array_sort(F.collect_list(F.col(forecast).cast("double"))).alias("f"))
    return listed.select("group_col", conformal_intervals("f", score).alias("c")).select("group_col", "c.lower", "c.upper")


def interval_width_by(df: DataFrame, group: str, lower: str, upper: str) -> DataFrame:
    """group_col, mean_width, n_intervals."""
    both = df.where(F.col(lower).isNotNull() & F.col(upper).isNotNull())
    return both.groupBy(F.col(group).alias("group_col")).agg(F.avg(F.col(upper).cast("double") - F.col(lower).cast("double")).alias("mean_width"), F.count(F.lit(1)).alias("n_intervals"))


# ------------------------------------------------------------------ bootstrap


def paths(residuals: np.ndarray, forecasts: np.ndarray, n_paths: int, seed: int | None) -> np.ndarray:
    """(n_paths, steps): forecasts plus residuals drawn with replacement. Without a seed, one made from the data."""
    r = residuals[~np.isnan(residuals)]
    if not len(r) or not len(forecasts) or n_paths < 1:
        raise ValueError("residuals, forecasts and paths are needed")
    if seed is None or seed < 0:
        seed = zlib.crc32(r.tobytes() + forecasts.tobytes())
    return forecasts + np.random.default_rng(seed).choice(r, (n_paths, len(forecasts)))


def bootstrap_intervals(df: DataFrame, residuals: str, forecasts: str, n_paths: int = 1000, coverage: float = 0.9, seed: int | None = 42, out: str = "intervals") -> DataFrame:
    """df with a struct<point, lower, upper, coverage>: the middle share of the paths at each step."""
    if not 0 < coverage < 1:
        raise ValueError("coverage lies between 0 and 1")

    def kernel(r: np.ndarray, f: np.ndarray) -> dict:
        lo, hi = np.quantile(paths(r, f, n_paths, seed), [(1 - coverage) / 2, (1 + coverage) / 2], axis=0)
        return {"point": f.tolist(), "lower": lo.tolist(), "upper": hi.tolist(), "coverage": coverage}

    return series.apply(df, [residuals, forecasts], kernel, "struct<point:array<double>,lower:array<double>,upper:array<double>,coverage:double>", out)


def bootstrap_quantiles(df: DataFrame, residuals: str, forecasts: str, n_paths: int = 1000, quantiles: list[float] = (0.1, 0.5, 0.9), seed: int | None = 42, out: str = "quantiles") -> DataFrame:
    """df with a struct<point, quantiles, values>: the values of all steps for each quantile, one after another."""
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1, and there is one at least")

    def kernel(r: np.ndarray, f: np.ndarray) -> dict:
        got = np.quantile(paths(r, f, n_paths, seed), list(quantiles), axis=0)
        return {"point": f.tolist(), "quantiles": list(quantiles), "values": got.ravel().tolist()}

    return series.apply(df, [residuals, forecasts], kernel, "struct<point:array<double>,quantiles:array<double>,values:array<double>>", out)
