"""Statistics, data quality and features of every series of a long table."""

from __future__ import annotations

import csv
import json
import warnings
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import describe as k
from ..plans import frequency as fq
from ..plans import series



def _measured(collected: DataFrame, keep: list[str]) -> DataFrame:
    return series.apply(collected, ["_v"], k.statistics_many, k.STATS_SCHEMA, together=True, nulls=True, keep=keep)


def _steps(kind, freq: fq.Frequency) -> tuple[Column, Column]:
    """expected_length and n_gaps from the ordered dates _d."""
    d = F.col("_d")
    pairs = F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    if freq.calendar and not fq.is_integer(kind):
        months = fq.CALENDAR[freq.unit]
        at = lambda x: F.floor((F.year(x) * 12 + F.month(x) - 1) / months)
        expected = at(F.element_at(d, -1)) - at(d[0]) + 1
        gap = lambda p: at(p["b"]) - at(p["a"]) > 1
    else:
        step, num = fq.number_step(freq, kind), lambda x: fq.as_number(x, kind)
        expected = F.floor((num(F.element_at(d, -1)) - num(d[0])) / step) + 1
        gap = lambda p: num(p["b"]) - num(p["a"]) > int(step * 1.5)
    many = F.size(d) >= 2
    return F.when(many, expected).otherwise(F.size(d)).cast("long"), F.when(many, F.size(F.filter(pairs, gap))).otherwise(0).cast("long")


def stats_by(df: DataFrame, group: str, date: str, value: str, freq: str | int = "1d", fill: float | None = None, dealt: bool = False) -> DataFrame:
    """group and 36 statistics of each series. With `fill`, missing dates and values count as that number; for `dealt`
    see series.collect."""
    kind, f = fq.check_date(df, date), fq.parse(freq)
    expected, gaps = _steps(kind, f)
    if fill is not None:  # the points that were put in leave no gap
        gaps = F.lit(0).cast("long")
    rows = series.collect(df, group, date, value, fill=None if fill is None else (f, fill), dealt=dealt).select(group, "_v", expected.alias("expected_length"), gaps.alias("n_gaps"))
    got = _measured(rows, [group, "expected_length", "n_gaps"])
    return got.select(group, "_r.*", "expected_length", "n_gaps")


def stats_agg(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """keys and one struct column `stats`."""
    got = _measured(series.collect(df, keys, date, value), keys)
    return got.select(*keys, F.col("_r").alias("stats"))


def stats_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n_series"), F.avg("length").alias("avg_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("n_nulls").alias("total_nulls"), F.sum("n_nan").alias("total_nans"))


def quality_report(stats: DataFrame, min_length: int) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return stats.agg(n((F.col("length") >= min_length) & ~F.col("is_constant")).alias("n_passed"), n(F.col("n_nan") > 0).alias("n_nan_issues"), n(F.col("n_nulls") > 0).alias("n_missing_issues"), n(F.col("is_constant")).alias("n_constant"), F.count(F.lit(1)).alias("n_total"))


def data_quality_by(df: DataFrame, group: str, date: str, value: str, n_short: int | None = None, freq: str | int | None = None) -> DataFrame:
    """unique_id and the quality scores. n_short and freq are accepted and have no effect."""
    got = series.apply(series.collect(df, group, date, value), ["_v"], k.quality, k.QUALITY_SCHEMA, nulls=True, keep=[group])
    return got.select(F.col(group).alias("unique_id"), "_r.*")


def data_quality_agg(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """keys and one struct column `quality`."""
    got = series.apply(series.collect(df, keys, date, value), ["_v"], k.quality, k.QUALITY_SCHEMA, nulls=True, keep=keys)
    return got.select(*keys, F.col("_r").alias("quality"))


def data_quality_summary(df: DataFrame, group: str, date: str, value: str, n_short: int | None = None) -> DataFrame:
    s = F.col("overall_score")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return data_quality_by(df, group, date, value).agg(F.count(F.lit(1)).alias("n_total"), n(s >= 0.8).alias("n_good"), n((s >= 0.5) & (s < 0.8)).alias("n_fair"), n(s < 0.5).alias("n_poor"), F.avg(s).alias("avg_score"))


# ------------------------------------------------------------------ features


def _featured(collected: DataFrame, names: list[str]) -> DataFrame:
    """collected with the features `names`, and no others, as struct _r."""
    keep = [c for c in collected.columns if c not in ("_d", "_v")]
    return series.apply(collected, ["_v"], partial(k.features_many, names=tuple(names)), "struct<" + ",".join(f"`{n}`:double" for n in names) + ">", together=True, keep=keep)


def _selected(names: list[str] | None) -> list[str]:
    every = k.feature_names()
    if names is None:
        return every
    if odd := [n for n in names if n not in every]:
        warnings.warn(f"unknown features are left out: {odd}", stacklevel=3)
    return [n for n in names if n in every]


def features_by(df: DataFrame, group: str | list[str] | None, date: str, value: str, names: list[str] | None = None, freq: str | int = "1d", fill: float | None = None, dealt: bool = False) -> DataFrame:
    """group and one column a feature, all of them or those in `names`. With `fill`, the dates of the frequency that are
    missing, and missing values, count as that number; for `dealt` see series.collect."""
    chosen = _selected(names)
    got = _featured(series.collect(df, group, date, value, fill=None if fill is None else (fq.parse(freq), fill), dealt=dealt).drop("_d"), chosen)
    keys = [] if group is None else [group] if isinstance(group, str) else group
    return got.where(F.col("_r").isNotNull()).select(*keys, *[F.col("_r")[n].alias(n) for n in chosen])


def features_table(df: DataFrame, date: str, value: str) -> DataFrame:
    """One row: the features of the whole table as one series."""
    return features_by(df, None, date, value)


def features_agg(df: DataFrame, keys: list[str], date: str, value: str, names: list[str] | None = None) -> DataFrame:
    """keys and one struct column `features`."""
    return _featured(series.collect(df, keys, date, value), _selected(names)).select(*keys, F.col("_r").alias("features"))


def _parts(name: str) -> tuple[str, str, dict]:
    """Feature family, parameter suffix and default parameters of a column."""
    for stem, key in (("autocorrelation_lag", "lag"), ("partial_autocorrelation_lag", "lag"), ("c3_lag", "lag"), ("time_reversal_asymmetry_stat_", "lag"), ("ratio_beyond_r_sigma_", "r"), ("number_peaks_threshold_", "threshold"), ("quantile_", "q")):
        if name.startswith(stem):
            value = name[len(stem) :]
            return stem.removesuffix("_lag").rstrip("_"), value, {key: float(value) if key == "q" else int(value)}
    if name.startswith("fft_coefficient_"):
        _, _, coeff, part = name.split("_")
        return "fft_coefficient", f"{coeff}_{part}", {"coeff": int(coeff), "attr": part}
    return name, "", {}


def features_list(spark: SparkSession) -> DataFrame:
    """column_name, feature_name, parameter_suffix, default_parameters, parameter_keys."""
    rows = [(n, *_parts(n)[:2], json.dumps(p := _parts(n)[2]), sorted(p)) for n in k.feature_names()]
    return spark.createDataFrame(rows, "column_name string, feature_name string, parameter_suffix string, default_parameters string, parameter_keys array<string>")


def features_config_template(spark: SparkSession) -> DataFrame:
    """feature, params_json."""
    return spark.createDataFrame([(n, json.dumps(_parts(n)[2])) for n in k.feature_names()], "feature string, params_json string")


def _config(rows: list[tuple[str, dict]]) -> dict:
    names = _selected([r[0] for r in rows])
    return {"feature_names": names, "overrides": [{"feature": n, "params_json": json.dumps(p)} for n, p in rows if p and n in names]}


def features_config_from_json(path: str) -> dict:
    """feature_names and overrides of a JSON file: a list of names, or an object from name to parameters."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    return _config([(n, {}) for n in got] if isinstance(got, list) else [(n, p or {}) for n, p in got.items()])


def features_config_from_csv(path: str) -> dict:
    """The same from a CSV file with the columns feature and params_json."""
    with open(path, encoding="utf-8", newline="") as f:
        return _config([(r["feature"], json.loads(r.get("params_json") or "{}")) for r in csv.DictReader(f)])
