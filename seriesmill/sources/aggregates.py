"""Aggregates over (date, value) in spark.sql, such as SELECT id, ts_stats_agg(ds, y) FROM sales GROUP BY id.

The rows of a group meet in one task, as for the functions of `operators` with the same names, which plan better on
large tables. Dates are dates or timestamps; rows without a date are left out, equal dates are ordered by value, and a
group that has no rows left or that the kernel fails on gives null. A wrong request raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import describe, models
from ..operators import analysis, forecast

DAY = 86_400_000_000
#: forecast_timestamp goes on by the median step of the dates, a day where there is one date only.
FORECAST = "struct<forecast_step:array<int>,forecast_timestamp:array<timestamp>,point_forecast:array<double>,lower_90:array<double>,upper_90:array<double>,model_name:string,insample_fitted:array<double>,date_col_name:string,error_message:string>"
CHANGEPOINTS = "array<struct<timestamp:timestamp,value:double,is_changepoint:boolean,changepoint_probability:double>>"


def ordered(dates: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Microseconds, values (null is NaN) and nulls as 1, in order; equal dates by value, null first and NaN last."""
    if pa.types.is_date32(dates.type):
        at = dates.cast(pa.int32()).cast(pa.int64()).fill_null(0).to_numpy() * DAY
    elif pa.types.is_timestamp(dates.type):
        at = dates.cast(pa.timestamp("us", dates.type.tz)).cast(pa.int64()).fill_null(0).to_numpy()
    else:
        raise models.InputError("aggregates take dates or timestamps")
    v, valid = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((v, np.isnan(v), valid, at))
    order = order[dates.is_valid().to_numpy(zero_copy_only=False)[order]]
    return at[order], v[order], (~valid[order]).astype(float)


def _aggregate(solve: Callable, schema: str):
    """solve(dates, values, nulls, *options) -> result of the SQL type `schema`; options are constant in a group."""
    kind = T._parse_datatype_string(schema)
    result = to_arrow_schema(T.StructType([T.StructField("r", kind)])).field(0).type

    def run(*columns: pa.Array) -> pa.Scalar:
        at, v, null = ordered(columns[0], columns[1])
        if not len(at):
            return None
        given = [c[0].as_py() if len(c) else None for c in columns[2:]]
        try:
            got = solve(at, v, null, *given)
        except Exception as e:
            if getattr(e, "fatal", False):
                raise
            got = None
        return None if got is None else pa.scalar(got, result)  # pyarrow can't put null lists together

    return F.arrow_udf(run, kind)


def _typed(kernel: Callable, schema: str) -> Callable:
    """kernel(values, nulls) with numbers of numpy as those of Python, by the fields' types."""
    cast = {"double": float, "bigint": int, "boolean": bool}
    casts = {f.name: cast.get(f.dataType.simpleString(), lambda x: x) for f in T._parse_datatype_string(schema)}

    def run(at, v, null) -> dict | None:
        got = kernel(v, null)
        return got and {n: None if got.get(n) is None else to(got[n]) for n, to in casts.items()}

    return run


def _features(at, v, null, selection=None, overrides=None) -> dict | None:
    """All features, or those selected and null for the others; overrides are accepted and have no effect."""
    every = describe.feature_names()
    names = tuple(n for n in every if selection is None or n in selection)
    got = describe.features(v, names) or {}
    return {n: got.get(n) if n in names else None for n in every} if got else None


def _forecast(at, v, null, method, horizon, params=None) -> dict:
    if horizon is None or horizon < 1:
        raise models.InputError("the horizon is 1 or more")
    o = forecast.options(method, dict(params or {}))
    step = int(np.sort(np.diff(at))[(len(at) - 1) // 2]) if len(at) > 1 else DAY
    try:
        got = forecast._kernel(v, h=int(horizon), o=o, in_sample=True)
    except models.InputError:
        raise
    except Exception as e:
        return {"error_message": str(e) or type(e).__name__}
    n = len(got["yhat"])
    return {
        "forecast_step": list(range(1, n + 1)),
        "forecast_timestamp": [int(at[-1]) + step * k for k in range(1, n + 1)],
        "point_forecast": got["yhat"],
        "lower_90": got["lower"],
        "upper_90": got["upper"],
        "model_name": got["model_name"],
        "insample_fitted": got["fitted"],
        "date_col_name": "date",
        "error_message": "",
    }


def _changepoints(at, v, null, params=None) -> list[dict]:
    keep = null == 0
    at, v = at[keep], v[keep]
    got = analysis.ARRAY_FUNCTIONS["detect_changepoints_bocpd"][0](v, **analysis._changepoint_options(dict(params or {})))
    p = got.get("changepoint_probability")
    return [{"timestamp": int(a), "value": float(x), "is_changepoint": bool(c), "changepoint_probability": None if q is None else float(q)} for a, x, c, q in zip(at, v, got["is_changepoint"], [None] * len(at) if p is None else p)]


def aggregates() -> Iterator[tuple[str, Callable]]:
    """(name without prefix, function) of each aggregate."""
    features = "struct<" + ",".join(f"`{n}`:double" for n in describe.feature_names()) + ">"
    periods, period_kind = analysis.ARRAY_FUNCTIONS["detect_periods"]
    classify, class_kind = analysis.ARRAY_FUNCTIONS["classify_seasonality"]
    yield "stats_agg", _aggregate(_typed(describe.statistics, describe.STATS_SCHEMA), describe.STATS_SCHEMA)
    yield "data_quality_agg", _aggregate(_typed(describe.quality, describe.QUALITY_SCHEMA), describe.QUALITY_SCHEMA)
    for name in ("features_agg", "features"):
        yield name, _aggregate(_features, features)
    yield "forecast_agg", _aggregate(_forecast, FORECAST)
    yield "detect_periods_agg", _aggregate(lambda at, v, null, method=None: periods(v, method=method or "fft"), period_kind)
    yield "classify_seasonality_agg", _aggregate(lambda at, v, null, period: classify(v, period=float(period)), class_kind)
    yield "detect_changepoints_agg", _aggregate(_changepoints, CHANGEPOINTS)
