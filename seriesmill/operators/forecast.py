"""Forecasting of every series of a long table: plain, with regressors, inspection and explanation.

Rows are grouped once (collect), each series goes through one Arrow-batched kernel, and dates, bounds and rows are made
by SQL expressions around it. A series on which a model fails gives no rows; a wrong request stops the query.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as m
from ..functions import smoothing as es
from ..plans import frequency as fq
from ..plans import series

ALLOWED = ("model", "seasonal_period", "seasonal_periods", "confidence_level", "window", "model_pool", "laplace_variant", "laplace_seasonal_batch_init")


def options(method: str, params: dict | None, detect: bool = True, level: float = 0.90) -> m.Options:
    """Options from a method such as 'ETS' or 'ETS:AAA' and its parameters; an unknown name or bad value is an error."""
    params = dict(params or {})
    if odd := sorted(set(params) - set(ALLOWED)):
        raise m.InputError(f"unknown parameters: {odd}; allowed: {list(ALLOWED)}")
    name, _, spec = method.partition(":")
    periods = params.get("seasonal_periods") or []
    if isinstance(periods, str):
        periods = json.loads(periods)
    period = int(params.get("seasonal_period") or 0)
    if period < 0 or any(int(p) < 1 for p in periods):
        raise m.InputError("seasonal periods are positive")
    o = m.Options(
        model=m.model_name(name),
        spec=params.get("model") or spec or None,
        seasonal_period=period,
        seasonal_periods=[int(p) for p in periods],
        confidence_level=float(params.get("confidence_level", level)),
        window=int(params.get("window") or 0),
        model_pool=params.get("model_pool") or "reduced",
        detect=detect and not period and not periods,
        laplace_variant=params.get("laplace_variant") or "auto",
        laplace_seasonal_batch_init=str(params.get("laplace_seasonal_batch_init", "0")).lower() in ("1", "true"),
    )
    if o.spec and o.model == "ETS":
        try:
            if not es.parse_spec(o.spec).stable:
                raise m.InputError(f"ETS model {o.spec!r} is an unstable combination")
        except m.InputError:
            raise
        except ValueError as e:
            raise m.InputError(str(e)) from e
    if o.model_pool not in es.POOLS:
        raise m.InputError(f"model_pool must be one of {es.POOLS}")
    if o.laplace_variant not in m.LAPLACE_VARIANTS:
        raise m.InputError(f"laplace_variant must be one of {m.LAPLACE_VARIANTS}")
    if not 0 < o.confidence_level < 1:
        raise m.InputError("confidence_level lies between 0 and 1")
    return o


_POINTS = "struct<yhat:array<double>,lower:array<double>,upper:array<double>,model_name:string,fitted:array<double>,residuals:array<double>,mse:double>"


def _kernel(values: np.ndarray, *more, h: int, o: m.Options, in_sample: bool = False) -> dict:
    v = m.interpolate(values)
    if more:
        past, future = (np.array([np.nan_to_num(np.asarray(x, float)) for x in side], float).T.reshape(-1, len(side)) for side in (more[0::2], more[1::2]))
        if len(past) != len(v):
            raise ValueError("regressors are of another length")
        h = min(h, len(future))
        p, name = m.with_regressors(v, h, o, past, future[:h])
    else:
        p, name = m.point_forecast(v, h, o)
    lo, hi = m.bounds(p, v, o.confidence_level)
    out = {"yhat": p.tolist(), "lower": lo.tolist(), "upper": hi.tolist(), "model_name": name}
    if in_sample:
        f = m.fitted(v, o.model, m.season_of(v, o))
        out |= {"fitted": f.tolist(), "residuals": (v - f).tolist(), "mse": float(((v - f) ** 2).mean())}
    return out


def _kernels(values: list[np.ndarray], steps: list[np.ndarray] | None = None, h: int = 0, o: m.Options = None) -> list[dict | None]:
    """_kernel of many series at once, without regressors; steps, if given, are as long as each forecast shall be."""
    many = [m.interpolate(v) for v in values]
    out = []
    for v, got in zip(many, m.point_forecasts(many, [h] * len(many) if steps is None else [len(x) for x in steps], o)):
        if got is None:
            out.append(None)
            continue
        lo, hi = m.bounds(got[0], v, o.confidence_level)
        out.append({"yhat": got[0].tolist(), "lower": lo.tolist(), "upper": hi.tolist(), "model_name": got[1]})
    return out


def _ahead(kind, freq: fq.Frequency) -> Column:
    """array<struct<forecast_step, ds, yhat, ...>> from _r and the last of _d."""
    last = F.element_at("_d", -1)
    steps = F.arrays_zip(F.col("_r.yhat").alias("yhat"), F.col("_r.lower").alias("yhat_lower"), F.col("_r.upper").alias("yhat_upper"))
    return F.transform(steps, lambda x, i: F.struct((i + 1).cast("int").alias("forecast_step"), fq.shift(last, freq, kind, i + 1).alias("ds"), x["yhat"].alias("yhat"), x["yhat_lower"].alias("yhat_lower"), x["yhat_upper"].alias("yhat_upper"), F.col("_r.model_name").alias("model_name")))


def _check(df: DataFrame, date: str, horizon: int):
    if horizon < 1:
        raise m.InputError("the horizon is 1 or more")
    return fq.check_date(df, date)


def forecast_by(df: DataFrame, group: str, date: str, target: str, method: str, horizon: int, freq: str | int = "1d", params: dict | None = None, fill: float | None = None, dealt: bool = False) -> DataFrame:
    """group, forecast_step, ds, yhat, yhat_lower, yhat_upper, model_name. With `fill`, missing dates and values of the
    history count as that number; for `dealt` see series.collect."""
    kind, o, f = _check(df, date, horizon), options(method, params), fq.parse(freq)
    rows = series.collect(df, group, date, target, fill=None if fill is None else (f, fill), dealt=dealt).select(group, F.array(F.element_at("_d", -1)).alias("_d"), "_v")
    got = series.apply(rows, ["_v"], partial(_kernels, h=horizon, o=o), _POINTS, together=True, keep=[group, "_d"])
    return got.where(F.col("_r").isNotNull()).select(group, F.inline(_ahead(kind, f)))


def forecast(df: DataFrame, date: str, target: str, method: str, horizon: int, params: dict | None = None) -> DataFrame:
    """One row for the table as one series: arrays and in-sample values; the period isn't detected, the level is 0.95."""
    _check(df, date, horizon)
    spec = (params or {}).get("model")
    o = options(method, {"model": spec} if spec else {}, detect=False, level=0.95)
    got = series.apply(series.collect(df, None, date, target), ["_v"], partial(_kernel, h=horizon, o=o, in_sample=True), _POINTS)
    none = F.lit(None).cast("double")
    return got.where(F.col("_r").isNotNull()).select(F.col("_r.yhat").alias("point"), F.col("_r.lower").alias("lower"), F.col("_r.upper").alias("upper"), F.col("_r.fitted").alias("fitted"), F.col("_r.residuals").alias("residuals"), F.col("_r.model_name").alias("model"), none.alias("aic"), none.alias("bic"), F.col("_r.mse").alias("mse"))


def forecast_agg(df: DataFrame, keys: list[str], date: str, target: str, method: str, horizon: int, params: dict | None = None, freq: str | int = "1d") -> DataFrame:
    """keys and a struct `forecast` of lists; lower and upper are named after the level, such as lower_90. A series that
    fails has null lists and an error message."""
    kind, o, f = _check(df, date, horizon), options(method, params), fq.parse(freq)
    got = series.apply(series.collect(df, keys, date, target), ["_v"], partial(_kernel, h=horizon, o=o, in_sample=True), _POINTS)
    level = round(o.confidence_level * 100)
    r = F.col("_r")
    step = F.transform(r["yhat"], lambda _, i: (i + 1).cast("int"))
    stamp = F.transform(r["yhat"], lambda _, i: fq.shift(F.element_at("_d", -1), f, kind, i + 1))
    return got.select(*keys, F.struct(step.alias("forecast_step"), stamp.alias("forecast_timestamp"), r["yhat"].alias("point_forecast"), r["lower"].alias(f"lower_{level}"), r["upper"].alias(f"upper_{level}"), r["model_name"].alias("model_name"), r["fitted"].alias("insample_fitted"), F.col("_d").alias("date_col_name"), F.when(r.isNull(), "the model failed on this series").alias("error_message")).alias("forecast"))


def forecast_exog_by(df: DataFrame, group: str | None, date: str, target: str, xreg: list[str], future: DataFrame, future_date: str, future_xreg: list[str], freq: str | int = "1d", method: str = "AutoARIMA", horizon: int = 12, params: dict | None = None) -> DataFrame:
    """group, forecast_step, date, yhat, yhat_lower, yhat_upper, model_name. Regressors pair by the order of their names."""
    kind, o, f = _check(df, date, horizon), options(method, params, detect=False), fq.parse(freq)
    if len(xreg) != len(future_xreg):
        raise m.InputError("as many future regressors as past ones are needed")
    past, ahead = sorted(xreg), sorted(future_xreg)
    keys = [group] if group else []
    mine = series.collect(df, group, date, target, {f"_x{i}": c for i, c in enumerate(past)})
    when = future.where(F.col(future_date).isNotNull()).select(*keys, F.struct(F.col(future_date).alias("d"), *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(ahead)]).alias("s"))
    listed = when.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s")).select(*keys, *[F.col("s")[f"z{i}"].alias(f"_z{i}") for i in range(len(ahead))])
    both = mine.join(listed, keys, "left") if keys else mine.crossJoin(listed)  # one row a side
    cols = [x for i in range(len(past)) for x in (f"_x{i}", f"_z{i}")]
    got = series.apply(both, ["_v", *cols], partial(_kernel, h=horizon, o=o), _POINTS)
    out = got.where(F.col("_r").isNotNull()).select(*keys, F.inline(_ahead(kind, f)))
    return out.withColumnRenamed("ds", "date")


def forecast_exog(df: DataFrame, date: str, target: str, xreg: list[str], future: DataFrame, future_date: str, future_xreg: list[str], method: str = "AutoARIMA", horizon: int = 12, params: dict | None = None, freq: str | int = "1d") -> DataFrame:
    return forecast_exog_by(df, None, date, target, xreg, future, future_date, future_xreg, freq, method, horizon, params)


# ------------------------------------------------------------------ inspection

_TEXT = "spec variant backend selected_config".split()
_NUMBERS = "alpha beta gamma phi theta aic bic r_squared intercept intercept_std_error box_cox_lambda penalty".split()
_WHOLE = "seasonal_period iterations max_rounds order_p order_d order_q seasonal_order_P seasonal_order_D seasonal_order_Q seasonal_order_s".split()
_LISTS = "coefficients coef_std_errors leaf_weights fitted_values residuals trend_component seasonal_component".split()
INSPECTION = (
    "struct<model_family:string," + ",".join(f"{n}:string" for n in _TEXT) + "," + ",".join(f"{n}:double" for n in _NUMBERS) + ",seasonal_period:bigint,seasonal_periods:array<bigint>,iterations:bigint,max_rounds:bigint,multiplicative:boolean,"
    + ",".join(f"{n}:bigint" for n in _WHOLE[3:]) + ",coefficients:array<double>,coef_std_errors:array<double>,feature_names:array<string>,leaf_weights:array<double>,leaf_names:array<string>,"
    + ",".join(f"{n}:array<double>" for n in _LISTS[3:]) + ",horizon_dists_json:string,raw_json:string>"
)


def inspect(values: np.ndarray, o: m.Options) -> dict:
    """What a fitted model holds. AutoETS, AutoARIMA, AutoTheta, AutoTBATS, MFLES, MSTL and Laplace only."""
    v = m.interpolate(values)
    if len(v) < 3:
        raise ValueError("a fit needs three values")
    p = m.season_of(v, o)
    out: dict = {"backend": "numpy", "seasonal_period": p}
    model, h = o.model, 1
    if model == "AutoETS":
        f = es.auto(v, p, o.model_pool)
        out |= {"model_family": "ETS", "spec": f.spec.name, "alpha": f.alpha, "beta": f.beta or None, "gamma": f.gamma or None, "phi": f.phi if f.spec.damped else None, "aic": f.aic, "bic": f.bic, "multiplicative": f.spec.season == "M", "fitted_values": f.fitted, "residuals": v - f.fitted, "trend_component": f.states["level"], "seasonal_component": f.states["season"] if f.spec.season != "N" else None}
    elif model == "AutoARIMA":
        _, name, d = m.auto_arima(v, h, p)
        (a, b, c), so, fit = d["order"], d["seasonal_order"], d.get("fit")
        out |= {"model_family": "ARIMA", "spec": name, "order_p": a, "order_d": b, "order_q": c, **{f"seasonal_order_{k}": x for k, x in zip("PDQs", so)}}
        if fit:
            out |= {"aic": fit["aic"], "bic": fit["bic"], "intercept": fit["const"], "coefficients": np.r_[fit["phi"], fit["theta"]], "residuals": fit["residuals"], "feature_names": [*(f"ar{k}" for k in fit["ar"]), *(f"ma{k}" for k in fit["ma"])]}
    elif model == "AutoTheta":
        kinds = {k: es.theta(v, h, p, "Optimized" in k, "Dynamic" in k)[1] for k in ("Theta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta")}
        best = min(kinds, key=lambda k: kinds[k]["sse"])
        d = kinds[best]
        out |= {"model_family": "Theta", "variant": best, "alpha": d["alpha"], "theta": d["theta"], "intercept": d["intercept"], "coefficients": np.array([d["slope"]])}
    elif model == "AutoTBATS":
        _, aic, d = m.tbats(v, h, o.seasonal_periods or [p], True)
        out |= {"model_family": "TBATS", "aic": aic, "alpha": d["alpha"], "beta": d["beta"], "gamma": d["gamma"], "phi": d["phi"], "box_cox_lambda": d["lambda"], "seasonal_periods": d["periods"], "selected_config": json.dumps({"harmonics": d["harmonics"], "damped": d["damped"]})}
    elif model in ("MFLES", "AutoMFLES"):
        _, d = m.mfles(v, h, o.seasonal_periods or [p])
        rest = v - d["fitted"]
        out |= {"model_family": "MFLES", "iterations": d["iterations"], "max_rounds": d["max_rounds"], "penalty": d["penalty"], "multiplicative": False, "seasonal_periods": d["periods"], "fitted_values": d["fitted"], "residuals": rest, "trend_component": d["trend"], "seasonal_component": d["season"], "r_squared": float(1 - rest.var() / v.var()) if v.var() > 0 else None}
    elif model in ("MSTL", "AutoMSTL"):
        trend, seasons, rest, used = m.mstl(v, o.seasonal_periods or [p if p > 1 else 12])
        out |= {"model_family": "MSTL", "seasonal_periods": used, "fitted_values": v - rest, "residuals": rest, "trend_component": trend, "seasonal_component": sum(seasons, np.zeros(len(v)))}
    elif model == "Laplace":
        _, d = m.laplace(v, h, p, o.laplace_variant)
        out |= {"model_family": "Laplace", "variant": d["variant"], "leaf_names": d["leaf_names"], "leaf_weights": d["leaf_weights"], "horizon_dists_json": json.dumps([{"step": 1, "scale": d["spread"]}])}
    else:
        raise m.InputError(f"model {model} can't be inspected")
    out = {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in out.items()}
    return out | {"raw_json": json.dumps({out["model_family"]: {k: x for k, x in out.items() if k != "model_family" and x is not None}})}


def forecast_inspect_by(df: DataFrame, group: str, date: str, target: str, method: str, params: dict | None = None) -> DataFrame:
    """group_col and a struct `inspection` of 41 nullable fields."""
    o = options(method, params)
    if o.model not in ("AutoETS", "AutoARIMA", "AutoTheta", "AutoTBATS", "MFLES", "AutoMFLES", "MSTL", "AutoMSTL", "Laplace"):
        raise m.InputError(f"model {o.model} can't be inspected")
    got = series.apply(series.collect(df, group, date, target), ["_v"], partial(inspect, o=o), INSPECTION)
    return got.where(F.col("_r").isNotNull()).select(F.col(group).alias("group_col"), F.col("_r").alias("inspection"))


EXPLANATION = "struct<model_family:string,point:array<double>,level:array<double>,trend:array<double>,seasonal:array<double>,residual:array<double>,components:array<struct<name:string,values:array<double>>>>"


def explain(values: np.ndarray, h: int, o: m.Options) -> dict:
    """A forecast as the sum of its parts: ETS (AAA unless specified), MSTL and Theta only."""
    v = m.interpolate(values)
    if len(v) < 3:
        raise ValueError("a forecast needs three values")
    p = m.season_of(v, o)
    zero = np.zeros(h)
    if o.model == "ETS":
        spec = es.parse_spec(o.spec or "AAA")
        if spec.season != "N" and p < 2:
            p = max(2, min(12, len(v) // 2))
        f = es.fit(v, spec, p)
        point, level = f.forecast(h), np.full(h, f.level)
        flat = es.Fit(**{**f.__dict__, "spec": es.Spec(spec.error, spec.trend, spec.damped, "N")}).forecast(h)
        trend, season = flat - level, point - flat
        family = "ETS"
    elif o.model in ("MSTL", "AutoMSTL"):
        periods = o.seasonal_periods or [p if p > 1 else 12]
        _, seasons, _, used = m.mstl(v, periods)
        point = m.mstl_forecast(v, h, periods)
        season = sum((s[-q:][np.arange(h) % q] for q, s in zip(used, seasons)), zero)
        base = point - season
        level, trend, family = np.full(h, base[0]), base - base[0], "MSTL"
    elif o.model in ("Theta", "AutoTheta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta"):
        x, s = es.deseasonalised(v, p)
        point, _ = es.theta(v, h, p)
        base, _ = es.theta(x, h, 1)
        level, trend, season, family = np.full(h, base[0]), base - base[0], point - base, "Theta"
    else:
        raise m.InputError(f"model {o.model} can't be explained")
    rest = point - level - trend - season
    parts = {"level": level, "trend": trend, "seasonal": season, "residual": rest}
    return {"model_family": family, "point": point.tolist(), **{k: x.tolist() for k, x in parts.items()}, "components": [{"name": k, "values": x.tolist()} for k, x in parts.items()]}


def forecast_explain_by(df: DataFrame, group: str, date: str, target: str, method: str, horizon: int, params: dict | None = None) -> DataFrame:
    """group_col, model_family, point, level, trend, seasonal, residual (arrays) and named components."""
    _check(df, date, horizon)
    o = options(method, params)
    if o.model not in ("ETS", "MSTL", "AutoMSTL", "Theta", "AutoTheta", "OptimizedTheta", "DynamicTheta", "DynamicOptimizedTheta"):
        raise m.InputError(f"model {o.model} can't be explained")
    got = series.apply(series.collect(df, group, date, target), ["_v"], partial(explain, h=horizon, o=o), EXPLANATION)
    return got.where(F.col("_r").isNotNull()).select(F.col(group).alias("group_col"), "_r.*")


# ------------------------------------------------------------------ backtests


def cv_forecast_by(folds: DataFrame, group: str, date: str, target: str, method: str, params: dict | None = None, level_zero: bool = False) -> DataFrame:
    """fold_id, group, date, target, split, yhat, yhat_lower, yhat_upper, model_name of the test rows: each fold's
    training rows forecast as many steps as it has test rows, matched by position. A null target counts as 0."""
    if missing := {"fold_id", "split"} - set(folds.columns):
        raise m.InputError(f"the folds lack the columns {sorted(missing)}")
    o = options(method, params, detect=not level_zero)
    if level_zero:
        o.confidence_level = 0.0
    rows = folds.where(F.col(date).isNotNull()).select("fold_id", group, F.col("split"), F.struct(F.col(date).alias("d"), F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("v")).alias("s"))
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("split") == name, F.col("s"))))
    listed = series.spread(rows, ["fold_id", group]).groupBy("fold_id", group).agg(part("train").alias("a"), part("test").alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    listed = listed.select("fold_id", group, F.col("a.v").alias("_v"), F.col("b.d").alias("_d"), F.col("b.v").alias("_y"))
    got = series.apply(listed, ["_v", "_y"], partial(_kernels, o=o), _POINTS, together=True).where(F.col("_r").isNotNull())
    z = F.arrays_zip(F.col("_d").alias("d"), F.col("_y").alias("y"), F.col("_r.yhat").alias("yhat"), F.col("_r.lower").alias("lower"), F.col("_r.upper").alias("upper"))
    out = got.select("fold_id", group, F.col("_r.model_name").alias("model_name"), F.inline(z))
    return out.select("fold_id", group, F.col("d").alias(date), F.col("y").alias(target), F.lit("test").alias("split"), "yhat", F.col("lower").alias("yhat_lower"), F.col("upper").alias("yhat_upper"), "model_name")


METRICS = ("mae", "mse", "rmse", "mape", "smape", "bias", "r2", "coverage")


def _score(metric: str, y: Column, f: Column, lo: Column, hi: Column) -> Column:
    e = f - y
    if metric == "r2":
        total = F.var_pop(y) * F.count(y)
        return F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(float("nan"))
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": 100 * F.avg(F.when(y != 0, F.abs(e / y))),
        "smape": 200 * F.avg(F.when(F.abs(y) + F.abs(f) > 0, F.abs(e) / (F.abs(y) + F.abs(f)))),
        "bias": F.avg(e),
        "coverage": F.avg(((y >= lo) & (y <= hi)).cast("double")),
    }[metric]


def backtest_auto_by(df: DataFrame, group: str, date: str, target: str, horizon: int, folds: int = 5, method: str = "AutoETS", params: dict | None = None, metric: str = "rmse") -> DataFrame:
    """fold_id, group, date, yhat, actual, error, abs_error, yhat_lower, yhat_upper, model_name, fold_metric_score.

    Folds are cut on the distinct dates of all groups. Besides model parameters, params takes gap, embargo, window_type,
    min_train_size, initial_train_size, skip_length and clip_horizon. Rows without a value take no part.
    """
    if metric not in METRICS:
        raise m.InputError(f"metric must be one of {METRICS}")
    params = dict(params or {})
    cut = {k: params.pop(k) for k in ("gap", "embargo", "window_type", "min_train_size", "initial_train_size", "skip_length", "clip_horizon") if k in params}
    rows = df.select(group, date, F.col(target).cast("double").alias(target)).where(F.col(date).isNotNull() & F.col(target).isNotNull())
    dates = rows.select(date).distinct()
    tagged = _global_folds(dates, date, folds, horizon, cut)
    cvd = rows.join(tagged, date)
    got = cv_forecast_by(cvd, group, date, target, method, params, level_zero=True)
    out = got.select("fold_id", group, date, "yhat", F.col(target).alias("actual"), (F.col("yhat") - F.col(target)).alias("error"), F.abs(F.col("yhat") - F.col(target)).alias("abs_error"), "yhat_lower", "yhat_upper", "model_name")
    score = out.groupBy("fold_id").agg(_score(metric, F.col("actual"), F.col("yhat"), F.col("yhat_lower"), F.col("yhat_upper")).alias("fold_metric_score"))
    return out.join(score, "fold_id")


def _global_folds(dates: DataFrame, date: str, folds: int, horizon: int, params: dict) -> DataFrame:
    """date, fold_id, split: positions among all distinct dates. The dates of a calendar are few next to the rows, so
    one window without partitions ranks them."""
    from .crossval import cv_folds

    one = dates.select(F.lit(0).alias("_g"), date, F.lit(0.0).alias("_t"))
    return cv_folds(one, "_g", date, "_t", folds, horizon, params | {"apply_embargo": bool(params.get("embargo"))}).select(date, "fold_id", "split")
