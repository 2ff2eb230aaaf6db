"""Periods, seasonality, peaks, decomposition and changepoints of every series of a long table.

Each operator has three forms: over a table (one series, or one a group), over a column of arrays, and as a struct a
group. All are the same collect and kernel; what a kernel can't do for one series is null there alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods as p
from ..functions import shape as s
from ..plans import series

_SINGLE = "struct<period:double,frequency:double,power:double,confidence:double,method:string>"
_AUTO = "struct<period:double,fft_confidence:double,acf_validation:double,detected:boolean,method:string>"
_MULTI = "array<struct<period:double,confidence:double,strength:double,amplitude:double,phase:double,iteration:bigint>>"
_SEASONS = "struct<detected_periods:array<int>,primary_period:int,seasonal_strength:double,trend_strength:double>"


def _clean(f: Callable) -> Callable:
    def run(values: np.ndarray, **options):
        return f(values[~np.isnan(values)], **options)

    return run


#: Array functions: name -> (kernel with keyword options, result type).
ARRAY_FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "estimate_period_fft": (_clean(p.fft), _SINGLE),
    "estimate_period_acf": (_clean(p.acf), _SINGLE),
    "estimate_period_regression": (_clean(p.regression), _SINGLE),
    "detect_multiple_periods": (_clean(p.multiple), _MULTI),
    "autoperiod": (_clean(p.autoperiod), _AUTO),
    "cfd_autoperiod": (_clean(lambda v, threshold=0.25: p.autoperiod(v, threshold, True)), _AUTO),
    "lomb_scargle": (_clean(p.lomb_scargle), "struct<period:double,frequency:double,power:double,false_alarm_prob:double,method:string>"),
    "aic_period": (_clean(p.aic), "struct<period:double,aic:double,bic:double,rss:double,r_squared:double,method:string>"),
    "ssa_period": (_clean(p.ssa), "struct<period:double,variance_explained:double,n_eigenvalues:bigint,method:string>"),
    "stl_period": (_clean(p.stl), "struct<period:double,seasonal_strength:double,trend_strength:double,method:string>"),
    "matrix_profile_period": (_clean(p.matrix_profile), "struct<period:double,confidence:double,n_motifs:bigint,subsequence_length:bigint,method:string>"),
    "sazed_period": (_clean(p.sazed), "struct<period:double,power:double,snr:double,method:string>"),
    "detect_periods": (p.detect, p.DETECTED),
    "detect_seasonality": (_clean(p.detect_periods), "array<int>"),
    "analyze_seasonality": (p.seasonality, _SEASONS),
    "classify_seasonality": (s.classify, s.CLASSES),
    "seasonal_strength": (s.strength, "double"),
    "seasonal_strength_windowed": (s.strength_windowed, "array<double>"),
    "detect_seasonality_changes": (s.seasonality_changes, s.CHANGES),
    "instantaneous_period": (s.instantaneous_period, s.INSTANT),
    "detect_amplitude_modulation": (s.modulation, s.MODULATION),
    "detect_peaks": (s.detect_peaks, s.PEAKS),
    "analyze_peak_timing": (s.peak_timing, s.TIMING),
    "detrend": (s.detrend, s.DETREND),
    "decompose_seasonal": (s.decompose_seasonal, s.DECOMPOSED),
    "mstl_decomposition": (s.mstl_decomposition, s.MSTL),
    "detect_changepoints_bocpd": (s.bocpd, s.BOCPD),
    "detect_changepoints_pelt": (s.pelt, s.PELT),
}


def _wrapped(kernel: Callable, schema: str, options: dict) -> tuple[Callable, str, bool]:
    """series.apply wants a struct; other results travel in a field of one."""
    f = partial(kernel, **options)
    return (f, schema, True) if schema.startswith("struct") else (lambda v: {"value": f(v)}, f"struct<value:{schema}>", False)


def over_arrays(df: DataFrame, values: str, function: str, out: str | None = None, **options) -> DataFrame:
    """df with the function's result for an array column; null where the function fails."""
    kernel, schema = ARRAY_FUNCTIONS[function]
    f, kind, plain = _wrapped(kernel, schema, options)
    out = out or function
    got = series.apply(df.withColumn("_values", F.col(values).cast("array<double>")), ["_values"], f, kind, "_r").drop("_values")
    return got.withColumn(out, F.col("_r") if plain else F.col("_r.value")).drop("_r") if out != "_r" else got


def per_series(df: DataFrame, group: str | list[str] | None, date: str, value: str, function: str, **options) -> DataFrame:
    """group columns, dates (array `_d`), values (`_v`) and the result as column `function`."""
    kernel, schema = ARRAY_FUNCTIONS[function]
    f, kind, plain = _wrapped(kernel, schema, options)
    got = series.apply(series.collect(df, group, date, value), ["_v"], f, kind)
    return got.withColumn(function, F.col("_r") if plain else F.col("_r.value")).drop("_r")


def _expanded(df: DataFrame, group: str | None, date: str, value: str, function: str, **options) -> DataFrame:
    got = per_series(df, group, date, value, function, **options)
    return got.where(F.col(function).isNotNull()).select(*([group] if group else []), f"{function}.*")


def detect_periods(df: DataFrame, date: str, value: str, params: dict | None = None) -> DataFrame:
    """One row: periods, n_periods, primary_period, method. params: method, max_period, min_confidence,
    expected_periods, tolerance."""
    return detect_periods_by(df, None, date, value, params)


def _period_options(params: dict | None) -> dict:
    params = dict(params or {})
    names = {"method": "method", "max_period": "longest", "min_confidence": "min_confidence", "expected_periods": "expected", "tolerance": "tolerance"}
    if odd := set(params) - set(names):
        raise ValueError(f"unknown parameters: {sorted(odd)}")
    return {names[k]: v for k, v in params.items()}


def detect_periods_by(df: DataFrame, group: str | None, date: str, value: str, params: dict | None = None) -> DataFrame:
    return _expanded(df, group, date, value, "detect_periods", **_period_options(params))


def classify_seasonality(df: DataFrame, date: str, value: str, period: float) -> DataFrame:
    return _expanded(df, None, date, value, "classify_seasonality", period=period)


def classify_seasonality_by(df: DataFrame, group: str, date: str, value: str, period: float) -> DataFrame:
    return _expanded(df, group, date, value, "classify_seasonality", period=period)


def detect_peaks(df: DataFrame, date: str, value: str, params: dict | None = None) -> DataFrame:
    return _expanded(df, None, date, value, "detect_peaks", **_peak_options(params))


def detect_peaks_by(df: DataFrame, group: str, date: str, value: str, params: dict | None = None) -> DataFrame:
    """group, peaks, n_peaks, inter_peak_distances, mean_period. params: min_distance, min_prominence, smooth_first."""
    return _expanded(df, group, date, value, "detect_peaks", **_peak_options(params))


def _peak_options(params: dict | None) -> dict:
    names = {"min_distance": "min_distance", "min_prominence": "min_prominence", "smooth_first": "smooth", "smooth": "smooth"}
    if odd := set(params or {}) - set(names):
        raise ValueError(f"unknown parameters: {sorted(odd)}")
    return {names[k]: v for k, v in (params or {}).items()}


def analyze_peak_timing(df: DataFrame, date: str, value: str, period: float) -> DataFrame:
    return _expanded(df, None, date, value, "analyze_peak_timing", period=period)


def analyze_peak_timing_by(df: DataFrame, group: str, date: str, value: str, period: float) -> DataFrame:
    return _expanded(df, group, date, value, "analyze_peak_timing", period=period)


def detrend_by(df: DataFrame, group: str, date: str, value: str, method: str = "auto") -> DataFrame:
    return _expanded(df, group, date, value, "detrend", method=method)


def mstl_decomposition_by(df: DataFrame, group: str, date: str, value: str, params: dict | None = None) -> DataFrame:
    """group, trend, seasonal (an array a period), remainder, periods. params: insufficient_data (fail, trend, none) and,
    beyond the default of trend and remainder alone, seasonal_periods."""
    params = dict(params or {})
    mode = params.pop("insufficient_data", params.pop("insufficient_data_mode", "fail"))
    periods = params.pop("seasonal_periods", None)
    if params or mode not in ("fail", "trend", "none"):
        raise ValueError(f"unknown parameters or mode: {sorted(params)}, {mode!r}")
    return _expanded(df, group, date, value, "mstl_decomposition", periods=periods, insufficient=mode)


def _changepoint_options(params: dict | None) -> dict:
    params = dict(params or {})
    names = {"hazard_lambda": "hazard_lambda", "include_probabilities": "include_probabilities"}
    if odd := set(params) - set(names):
        raise ValueError(f"unknown parameters: {sorted(odd)}")
    out = {"hazard_lambda": float(params.get("hazard_lambda", 250.0)), "include_probabilities": str(params.get("include_probabilities", False)).lower() in ("true", "1")}
    return out


def detect_changepoints_by(df: DataFrame, group: str | None, date: str, value: str, params: dict | None = None) -> DataFrame:
    """group, date, value, is_changepoint, changepoint_probability of every row with a value; a series that fails has
    null flags."""
    keys = [group] if group else []
    rows = df.where(F.col(value).isNotNull())
    got = per_series(rows, group, date, value, "detect_changepoints_bocpd", **_changepoint_options(params))
    r = F.col("detect_changepoints_bocpd")
    z = F.arrays_zip(F.col("_d").alias(date), F.col("_v").alias(value), F.coalesce(r["is_changepoint"], F.transform("_v", lambda x: F.lit(None).cast("boolean"))).alias("is_changepoint"), F.coalesce(r["changepoint_probability"], F.transform("_v", lambda x: F.lit(None).cast("double"))).alias("changepoint_probability"))
    return got.select(*keys, F.inline(z))


def detect_changepoints(df: DataFrame, date: str, value: str, params: dict | None = None) -> DataFrame:
    return detect_changepoints_by(df, None, date, value, params)


def detect_changepoints_agg(df: DataFrame, keys: list[str], date: str, value: str, params: dict | None = None) -> DataFrame:
    """keys and an array of struct<timestamp, value, is_changepoint, changepoint_probability>."""
    got = per_series(df.where(F.col(value).isNotNull()), keys, date, value, "detect_changepoints_bocpd", **_changepoint_options(params))
    r = F.col("detect_changepoints_bocpd")
    z = F.arrays_zip(F.col("_d").alias("timestamp"), F.col("_v").alias("value"), r["is_changepoint"].alias("is_changepoint"), r["changepoint_probability"].alias("changepoint_probability"))
    return got.select(*keys, z.alias("changepoints"))


def detect_periods_agg(df: DataFrame, keys: list[str], date: str, value: str, method: str = "fft") -> DataFrame:
    """keys and one struct column detect_periods."""
    return per_series(df, keys, date, value, "detect_periods", method=method).drop("_d", "_v")


def classify_seasonality_agg(df: DataFrame, keys: list[str], date: str, value: str, period: float) -> DataFrame:
    """keys and one struct column classify_seasonality."""
    return per_series(df, keys, date, value, "classify_seasonality", period=period).drop("_d", "_v")
