"""Forecast accuracy: grouped metrics over rows, and the same metrics over arrays.

Row metrics take the names of the columns and group by all others; pairs with a null or NaN are left out. They are
algebraic aggregates, combined on the map side. Array metrics pair elements by position and drop such pairs likewise;
arrays of unequal length give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _sound(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b).otherwise(F.lit(float("nan")))


def _mae(a, f):
    return F.avg(F.abs(a - f))


def _mse(a, f):
    return F.avg((a - f) * (a - f))


def _mape(a, f):
    return F.coalesce(100.0 * F.avg(F.when(F.abs(a) > EPS, F.abs(a - f) / F.abs(a))), F.lit(float("nan")))


def _smape(a, f):
    total = F.abs(a) + F.abs(f)
    return F.coalesce(100.0 * F.avg(F.when(total > EPS, 2.0 * F.abs(a - f) / total)), F.lit(float("nan")))


def _r2(a, f):
    n = F.count(a)
    # var_pop is the stable form of the total sum of squares
    return F.when(F.var_pop(a) * n > EPS, 1.0 - F.sum((a - f) * (a - f)) / (F.var_pop(a) * n)).otherwise(F.lit(float("nan")))


def _grouped(df: DataFrame, date: str | None, used: list[str], name: str, measure) -> DataFrame:
    groups = [c for c in df.columns if c not in {date, *used}]
    cols = [F.col(c).cast("double") for c in used]
    good = df.where(reduce(lambda x, y: x & y, map(_sound, cols)))
    return good.groupBy(*groups).agg(measure(*cols).alias(name))


def mae_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "mae", _mae)


def mse_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "mse", _mse)


def rmse_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "rmse", lambda a, f: F.sqrt(_mse(a, f)))


def mape_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "mape", _mape)


def smape_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "smape", _smape)


def r2_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "r2", _r2)


def bias_by(df, date, actual, forecast):
    return _grouped(df, date, [actual, forecast], "bias", lambda a, f: F.avg(f - a))


def mase_by(df, date, actual, forecast, baseline):
    return _grouped(df, date, [actual, forecast, baseline], "mase", lambda a, f, b: _ratio(_mae(a, f), _mae(a, b)))


def rmae_by(df, date, actual, pred1, pred2):
    return _grouped(df, date, [actual, pred1, pred2], "rmae", lambda a, p, q: _ratio(_mae(a, p), _mae(a, q)))


def quantile_loss_by(df, date, actual, forecast, quantile: float):
    return _grouped(df, date, [actual, forecast], "quantile_loss", lambda a, f: F.avg(F.greatest(quantile * (a - f), (quantile - 1.0) * (a - f))))


def coverage_by(df, date, actual, lower, upper):
    return _grouped(df, date, [actual, lower, upper], "coverage", lambda a, lo, hi: F.avg(((a >= lo) & (a <= hi)).cast("double")))


# ------------------------------------------------------------------ arrays


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _zipped(*arrays) -> tuple[Column, Column]:
    """Pairs without null or NaN, and whether the arrays are of one length."""
    arrays = [_col(a).cast("array<double>") for a in arrays]
    z = F.arrays_zip(*[a.alias(f"x{i}") for i, a in enumerate(arrays)])
    good = F.filter(z, lambda s: reduce(lambda x, y: x & y, [_sound(s[f"x{i}"]) for i in range(len(arrays))]))
    same = reduce(lambda x, y: x & y, [F.size(a) == F.size(arrays[0]) for a in arrays])
    return good, same & (F.size(good) > 0)


def _mean(good: Column, term) -> Column:
    n = F.aggregate(good, F.lit(0.0), lambda s, x: s + F.when(term(x).isNotNull(), 1.0).otherwise(0.0))
    return F.when(n > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + F.coalesce(term(x), F.lit(0.0))) / n)


def array_mae(a, f) -> Column:
    g, ok = _zipped(a, f)
    return F.when(ok, _mean(g, lambda x: F.abs(x["x0"] - x["x1"])))


def array_mse(a, f) -> Column:
    g, ok = _zipped(a, f)
    return F.when(ok, _mean(g, lambda x: (x["x0"] - x["x1"]) * (x["x0"] - x["x1"])))


def array_rmse(a, f) -> Column:
    return F.sqrt(array_mse(a, f))


def array_mape(a, f) -> Column:
    g, ok = _zipped(a, f)
    return F.when(ok, F.coalesce(100.0 * _mean(g, lambda x: F.when(F.abs(x["x0"]) > EPS, F.abs(x["x0"] - x["x1"]) / F.abs(x["x0"]))), F.lit(float("nan"))))


def array_smape(a, f) -> Column:
    g, ok = _zipped(a, f)
    total = lambda x: F.abs(x["x0"]) + F.abs(x["x1"])
    return F.when(ok, F.coalesce(100.0 * _mean(g, lambda x: F.when(total(x) > EPS, 2.0 * F.abs(x["x0"] - x["x1"]) / total(x))), F.lit(float("nan"))))


def array_bias(a, f) -> Column:
    g, ok = _zipped(a, f)
    return F.when(ok, _mean(g, lambda x: x["x1"] - x["x0"]))


def array_r2(a, f) -> Column:
    g, ok = _zipped(a, f)
    mean = _mean(g, lambda x: x["x0"])
    total = F.aggregate(g, F.lit(0.0), lambda s, x: s + (x["x0"] - mean) * (x["x0"] - mean))
    rest = F.aggregate(g, F.lit(0.0), lambda s, x: s + (x["x0"] - x["x1"]) * (x["x0"] - x["x1"]))
    return F.when(ok, F.when(total > EPS, 1.0 - rest / total).otherwise(float("nan")))


def array_mase(a, f, baseline) -> Column:
    g, ok = _zipped(a, f, baseline)
    return F.when(ok, _ratio(_mean(g, lambda x: F.abs(x["x0"] - x["x1"])), _mean(g, lambda x: F.abs(x["x0"] - x["x2"]))))


def array_rmae(a, p1, p2) -> Column:
    return array_mase(a, p1, p2)


def array_quantile_loss(a, f, q) -> Column:
    g, ok = _zipped(a, f)
    q = F.lit(q) if isinstance(q, (int, float)) else _col(q)
    return F.when(ok, _mean(g, lambda x: F.greatest(q * (x["x0"] - x["x1"]), (q - 1.0) * (x["x0"] - x["x1"]))))


def array_mqloss(a, f, q) -> Column:
    """f: one array of forecasts for each quantile of the array q."""
    both = F.zip_with(_col(f), _col(q), lambda row, level: array_quantile_loss(a, row, level))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both)


def array_coverage(a, lower, upper) -> Column:
    g, ok = _zipped(a, lower, upper)
    return F.when(ok, _mean(g, lambda x: ((x["x0"] >= x["x1"]) & (x["x0"] <= x["x2"])).cast("double")))


#: Bytes a row of the split table, a collected value and an output row of a backtest.
SPLIT_ROW, LISTED_VALUE, OUTPUT_ROW = 40, 8, 88


def estimate_backtest_memory(n_series: int, n_dates: int, folds: int, horizon: int) -> int:
    """Whole MB that a backtest takes: the splits, half of the dates as collected training values, and the output."""
    splits = n_series * n_dates * folds * SPLIT_ROW
    listed = n_series * folds * (n_dates // 2) * LISTED_VALUE
    return (splits + listed + n_series * folds * horizon * OUTPUT_ROW) // 2**20
