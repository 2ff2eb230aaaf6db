"""The functions in SQL: array functions as scalar functions, aggregates for GROUP BY, metrics as SQL functions, tables
through `call`.

register(spark, prefix) makes, for instance, ts_detect_peaks(values), ts_mae(actual, forecast) and
ts_forecast_values(values, 'Theta', 12) known to spark.sql; call(spark, 'ts_fill_gaps_by', 'sales', ...) runs a table
function on a table name or a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import describe, models
from ..operators import analysis, conformal, crossval, forecast, keys, metrics, prep, stats
from .aggregates import aggregates
from .tables import by_name

#: Table functions by their SQL names; their arguments are those of the Python functions after the table.
TABLE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    **{f"ts_{n}_by": getattr(prep, n) for n in "drop_constant drop_short drop_gappy drop_zeros drop_leading_zeros drop_trailing_zeros drop_edge_zeros fill_nulls_const fill_nulls_forward fill_nulls_backward fill_nulls_mean diff fill_gaps fill_forward mark_unknown fill_unknown validate_timestamps".split()},
    "ts_fill_forward_operator": prep.fill_forward,
    "ts_validate_timestamps_summary_by": prep.validate_timestamps_summary,
    **{f"ts_{n}": getattr(keys, n) for n in "validate_separator combine_keys aggregate_hierarchy split_keys".split()},
    **{f"ts_{n}_by": getattr(metrics, f"{n}_by") for n in "mae mse rmse mape smape mase r2 bias rmae quantile_loss coverage".split()},
    **{f"ts_{n}": getattr(stats, n) for n in "stats_by stats_agg stats_summary quality_report data_quality_by data_quality_agg data_quality_summary features_by features_table features_agg".split()},
    "ts_stats": stats.stats_by,
    "ts_data_quality": stats.data_quality_by,
    "ts_features": stats.features_agg,
    **{f"ts_{n}": getattr(analysis, n) for n in "detect_periods detect_periods_by detect_periods_agg classify_seasonality classify_seasonality_by classify_seasonality_agg detect_peaks detect_peaks_by analyze_peak_timing analyze_peak_timing_by detrend_by mstl_decomposition_by detect_changepoints detect_changepoints_by detect_changepoints_agg".split()},
    **{f"ts_{n}": getattr(forecast, n) for n in "forecast forecast_by forecast_agg forecast_exog forecast_exog_by forecast_inspect_by forecast_explain_by cv_forecast_by backtest_auto_by".split()},
    **{f"ts_{n}_by": getattr(crossval, n) for n in "cv_folds cv_split cv_split_folds cv_split_index cv_hydrate".split()},
    "ts_check_leakage": crossval.check_leakage,
    **{f"ts_{n}": getattr(conformal, n) for n in "conformal_by conformal_calibrate conformal_apply_by interval_width_by bootstrap_intervals bootstrap_quantiles".split()},
}


def call(spark: SparkSession, name: str, source: str | DataFrame, *args, **options) -> DataFrame:
    """A table function on a table name, view name or DataFrame; further tables may be names too."""
    if name not in TABLE_FUNCTIONS:
        raise ValueError(f"unknown table function: {name}")
    return TABLE_FUNCTIONS[name](by_name(spark, source), *args, **options)


def _array_udf(kernel: Callable, schema: str, options: list[str]):
    """A vectorised function of an array and up to three options."""
    kind = T._parse_datatype_string(schema)

    def one(values, extra):
        if values is None:
            return None
        given = {k: (x.tolist() if isinstance(x, np.ndarray) else x) for k, x in zip(options, extra) if x is not None}
        try:
            return kernel(np.array([np.nan if x is None else x for x in values], float), **given)
        except models.InputError:
            raise
        except Exception:
            return None

    if isinstance(kind, T.StructType):

        def run(values: pd.Series, *extra: pd.Series) -> pd.DataFrame:
            rows = [one(v, e) for v, *e in zip(values, *extra)]
            return pd.DataFrame([{f: None for f in kind.names} | (r or {}) for r in rows], columns=kind.names)

    else:

        def run(values: pd.Series, *extra: pd.Series) -> pd.Series:
            return pd.Series([one(v, e) for v, *e in zip(values, *extra)])

    return F.pandas_udf(run, schema)


#: Options that the SQL forms take after the array, by position.
POSITIONS = {
    "estimate_period_acf": ["most"], "detect_multiple_periods": ["most", "min_confidence", "min_strength"], "autoperiod": ["threshold"], "cfd_autoperiod": ["threshold"], "lomb_scargle": ["shortest", "longest", "n_freq"],
    "aic_period": ["shortest", "longest", "candidates"], "ssa_period": ["window", "components"], "stl_period": ["shortest", "longest", "candidates"], "matrix_profile_period": ["length", "exclusion"], "sazed_period": ["padding", "shortest", "longest"],
    "detect_periods": ["method", "longest", "min_confidence", "expected", "tolerance"], "classify_seasonality": ["period", "strength_threshold", "timing_threshold"], "seasonal_strength": ["period", "method"], "seasonal_strength_windowed": ["period", "window", "method"],
    "detect_seasonality_changes": ["period", "threshold", "window", "min_duration"], "detect_amplitude_modulation": ["period", "threshold", "seasonal_threshold"], "detect_peaks": ["min_distance", "min_prominence", "smooth"], "analyze_peak_timing": ["period"],
    "detrend": ["method"], "decompose_seasonal": ["period", "method"], "mstl_decomposition": ["periods", "insufficient"], "detect_changepoints_bocpd": ["hazard_lambda", "include_probabilities"], "detect_changepoints_pelt": ["penalty", "cost"],
}

#: Metrics as SQL function bodies over arrays a, f (and b or q).
_PAIR = "filter(arrays_zip(a, f), x -> x.a is not null and x.f is not null and not isnan(x.a) and not isnan(x.f))"


def register(spark: SparkSession, prefix: str = "ts_") -> list[str]:
    """Make the scalar functions and aggregates known to spark.sql; returns their names."""
    names = []

    def put(name: str, udf) -> None:
        spark.udf.register(prefix + name, udf)
        names.append(prefix + name)

    for name, (kernel, schema) in analysis.ARRAY_FUNCTIONS.items():
        put(name, _array_udf(kernel, schema, POSITIONS.get(name, [])))
    put("features_values", _array_udf(describe.features, "struct<" + ",".join(f"`{n}`:double" for n in describe.feature_names()) + ">", []))

    def points(v, method="AutoETS", horizon=12):
        o = forecast.options(method, None, detect=False, level=0.95)
        return forecast._kernel(v, h=int(horizon), o=o, in_sample=True)

    for name, udf in aggregates():
        put(name, udf)
    put("forecast_values", _array_udf(points, forecast._POINTS, ["method", "horizon"]))
    total = lambda term: f"aggregate({_PAIR}, 0D, (s, x) -> s + {term})"
    ok = f"size(a) = size(f) and size({_PAIR}) > 0"
    n = f"size({_PAIR})"
    bodies = {
        "mae": f"{total('abs(x.a - x.f)')} / {n}",
        "mse": f"{total('(x.a - x.f) * (x.a - x.f)')} / {n}",
        "rmse": f"sqrt({total('(x.a - x.f) * (x.a - x.f)')} / {n})",
        "bias": f"{total('(x.f - x.a)')} / {n}",
        "mape": f"100 * {total('case when abs(x.a) > 2.3e-16 then abs((x.a - x.f) / x.a) else 0D end')} / nullif({total('case when abs(x.a) > 2.3e-16 then 1D else 0D end')}, 0)",
        "smape": f"100 * {total('case when abs(x.a) + abs(x.f) > 2.3e-16 then 2 * abs(x.a - x.f) / (abs(x.a) + abs(x.f)) else 0D end')} / nullif({total('case when abs(x.a) + abs(x.f) > 2.3e-16 then 1D else 0D end')}, 0)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(a array<double>, f array<double>) RETURNS double RETURN case when {ok} then {body} end")
        names.append(prefix + name)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}estimate_backtest_memory(s bigint, d bigint, k bigint, h bigint) RETURNS bigint RETURN (s * d * k * {metrics.SPLIT_ROW} + s * k * (d div 2) * {metrics.LISTED_VALUE} + s * k * h * {metrics.OUTPUT_ROW}) div 1048576")
    names.append(f"{prefix}estimate_backtest_memory")
    for name, (arguments, returns, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {body}")
        names.append(prefix + name)
    return names


_A, _D = "array<double>", "double"
_SOUND = "x is not null and not isnan(x)"


def _with(value: str, name: str, body: str) -> str:
    """body with value computed once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _rank(values: str, alpha: str) -> str:
    """The conformal score of a sorted array, null for an empty one."""
    at = f"least(1D, greatest(0D, ceil(round((size({values}) + 1) * (1 - {alpha}), 9)) / size({values}))) * (size({values}) - 1)"
    lo, hi = f"get({values}, cast(floor(p) as int))", f"get({values}, least(cast(floor(p) as int) + 1, size({values}) - 1))"
    return f"case when size({values}) > 0 and {alpha} >= 0 and {alpha} < 1 then {_with(at, 'p', f'{lo} + ({hi} - {lo}) * (p - floor(p))')} end"


def _score(residuals: str, alpha: str, sign: str = "") -> str:
    test = f"{_SOUND} and x {sign} 0" if sign else _SOUND
    return _with(f"array_sort(transform(filter({residuals}, x -> {test}), x -> abs(x)))", "s", _rank("s", alpha))


def _sides(lower: str, upper: str, score: str, method: str) -> str:
    return f"case when {score} is not null then named_struct('point', f, 'lower', transform(f, x -> x - {lower}), 'upper', transform(f, x -> x + {upper}), 'coverage', 1 - alpha, 'conformity_score', {score}, 'method', '{method}') end"


_TRIPLES = "filter(arrays_zip(a, f, g), x -> x.a is not null and x.f is not null and x.g is not null and not isnan(x.a) and not isnan(x.f) and not isnan(x.g))"
_LEVEL3 = "size(a) = size(f) and size(a) = size(g)"
_PREDICTED = f"struct<point:{_A},lower:{_A},upper:{_A},coverage:{_D},conformity_score:{_D},method:string>"


def _sum(items: str, term: str) -> str:
    return f"aggregate({items}, 0D, (s, x) -> s + {term})"


def _learned(lower: str, upper: str) -> str:
    return f"case when size(filter(r, x -> {_SOUND})) > 0 then named_struct('method', 'symmetric', 'strategy', 'split', 'alphas', alphas, 'state_vector', concat({lower}, {upper}), 'scores_lower', {lower}, 'scores_upper', {upper}, 'n_residuals', cast(size(filter(r, x -> {_SOUND})) as bigint)) end"


_RATIO = _with(_TRIPLES, "z", f"case when size(z) > 0 and {_LEVEL3} then {_sum('z', 'abs(x.a - x.f)')} / nullif({_sum('z', 'abs(x.a - x.g)')}, 0) end")
_LOSS = "greatest(q * (x.a - x.f), (q - 1) * (x.a - x.f))"
_OUT = "greatest(x.l - x.a, x.a - x.u, 0D)"
_BOUNDS = "arrays_zip(a, l, u)"
_LEVEL = "size(a) > 0 and size(a) = size(l) and size(a) = size(u)"
_SYMMETRIC = _with("array_sort(transform(filter(r, x -> " + _SOUND + "), x -> abs(x)))", "s", f"transform(alphas, alpha -> {_rank('s', 'alpha')})")
_STEP = _with(f"array_sort(transform(filter(zip_with(actuals, forecasts, (x, y) -> x - y), (x, i) -> i % horizon = k and {_SOUND}), x -> abs(x)))", "s", _rank("s", "alpha"))
#: Scalar functions: parameters, result type and body.
_SCALARS: dict[str, tuple[str, str, str]] = {
    "r2": (f"a {_A}, f {_A}", _D, _with(_PAIR, "z", f"case when size(a) = size(f) and size(z) > 0 then {_with(_sum('z', 'x.a') + ' / size(z)', 'm', 'case when ' + _sum('z', '(x.a - m) * (x.a - m)') + ' > 2.3e-16 then 1 - ' + _sum('z', '(x.a - x.f) * (x.a - x.f)') + ' / ' + _sum('z', '(x.a - m) * (x.a - m)') + chr(32) + 'else double(' + repr('NaN') + ') end')} end")),
    "mase": (f"a {_A}, f {_A}, g {_A}", _D, _RATIO),
    "rmae": (f"a {_A}, f {_A}, g {_A}", _D, _RATIO),
    "quantile_loss": (f"a {_A}, f {_A}, q {_D}", _D, _with(_PAIR, "z", f"case when size(a) = size(f) and size(z) > 0 then {_sum('z', _LOSS)} / size(z) end")),
    "mqloss": (f"a {_A}, fs array<{_A}>, qs {_A}", _D, f"aggregate(zip_with(fs, qs, (f, q) -> {_with(_PAIR, 'z', 'case when size(a) = size(f) and size(z) > 0 then ' + _sum('z', _LOSS) + ' / size(z) end')}), 0D, (t, y) -> t + y) / size(qs)"),
    "coverage": (f"a {_A}, f {_A}, g {_A}", _D, _with(_TRIPLES, "z", f"case when size(z) > 0 and {_LEVEL3} then {_sum('z', 'case when x.a >= x.f and x.a <= x.g then 1D else 0D end')} / size(z) end")),
    "conformal_quantile": (f"r {_A}, alpha {_D}", _D, _score("r", "alpha")),
    "conformal_intervals": (f"f {_A}, score {_D}", f"struct<lower:{_A},upper:{_A}>", "named_struct('lower', transform(f, x -> x - score), 'upper', transform(f, x -> x + score))"),
    "conformal_predict": (f"r {_A}, f {_A}, alpha {_D}", _PREDICTED, _with(_score("r", "alpha"), "w", _sides("w", "w", "w", "split_conformal"))),
    "conformal_predict_asymmetric": (f"r {_A}, f {_A}, alpha {_D}", _PREDICTED, _with(f"named_struct('d', coalesce({_score('r', '(alpha / 2)', '<')}, 0D), 'u', coalesce({_score('r', '(alpha / 2)', '>')}, 0D))", "w", _sides("w.d", "w.u", f"(case when size(filter(r, x -> {_SOUND})) > 0 and alpha >= 0 and alpha < 1 then (w.d + w.u) / 2 end)", "asymmetric_conformal"))),
    "conformal_learn": (f"r {_A}, alphas {_A}", f"struct<method:string,strategy:string,alphas:{_A},state_vector:{_A},scores_lower:{_A},scores_upper:{_A},n_residuals:bigint>", _with(_SYMMETRIC, "w", _learned("w", "w"))),
    "conformal_apply": (f"f {_A}, scores_lower {_A}, scores_upper {_A}", f"struct<point:{_A},lower:array<{_A}>,upper:array<{_A}>>", "case when size(f) > 0 then named_struct('point', f, 'lower', transform(scores_lower, w -> transform(f, x -> x - w)), 'upper', transform(scores_upper, w -> transform(f, x -> x + w))) end"),
    "conformal_coverage": (f"a {_A}, l {_A}, u {_A}", _D, f"case when {_LEVEL} then {_sum(_BOUNDS, 'case when x.a >= x.l and x.a <= x.u then 1D else 0D end')} / size(a) end"),
    "mean_interval_width": (f"l {_A}, u {_A}", _D, f"case when size(l) > 0 then {_sum('arrays_zip(l, u)', 'x.u - x.l')} / size(l) end"),
    "conformal_evaluate": (f"a {_A}, l {_A}, u {_A}, alpha {_D}", f"struct<coverage:{_D},violation_rate:{_D},mean_width:{_D},winkler_score:{_D},n_observations:bigint>", f"case when {_LEVEL} then {_with(_sum(_BOUNDS, 'case when x.a >= x.l and x.a <= x.u then 1D else 0D end') + ' / size(a)', 'c', 'named_struct(' + repr('coverage') + ', c, ' + repr('violation_rate') + ', 1 - c, ' + repr('mean_width') + ', ' + _sum(_BOUNDS, 'x.u - x.l') + ' / size(a), ' + repr('winkler_score') + ', ' + _sum(_BOUNDS, 'x.u - x.l + 2 / alpha * ' + _OUT) + ' / size(a), ' + repr('n_observations') + ', cast(size(a) as bigint))')} end"),
    "conformal_predict_per_step": (f"forecasts {_A}, actuals {_A}, point {_A}, alpha {_D}, horizon int", f"struct<point:{_A},lower:{_A},upper:{_A},half_widths:{_A},coverage:{_D}>", f"case when size(actuals) >= 2 * horizon and size(actuals) % horizon = 0 then {_with(f'transform(sequence(0, horizon - 1), k -> {_STEP})', 'h', 'named_struct(' + repr('point') + ', point, ' + repr('lower') + ', transform(point, (x, i) -> x - get(h, least(i, horizon - 1))), ' + repr('upper') + ', transform(point, (x, i) -> x + get(h, least(i, horizon - 1))), ' + repr('half_widths') + ', h, ' + repr('coverage') + ', 1 - alpha)')} end"),
}
