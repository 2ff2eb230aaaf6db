"""Registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as _models
from ..operators import analysis, conformal, crossval, forecast, keys, metrics, prep, stats
from ..sources import sql
from ..sources import tables as t
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; oracle may use {daily}, {users}, {monthly} and {demand} for the derived series."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.replace("{daily}", f"({t.DAILY})").replace("{users}", f"({t.USERS})").replace("{monthly}", f"({t.MONTHLY})").replace("{demand}", f"({t.DEMAND})")
        return f

    return put


def simple(name: str, source, build: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    query(name, oracle)(lambda spark, sf_dir: build(source(spark, sf_dir)))


# ------------------------------------------------------------------ preparation

simple("drop_constant", t.users, lambda d: prep.drop_constant(d, "id", "y"), "SELECT * FROM {users} QUALIFY min(y) OVER (PARTITION BY id) IS DISTINCT FROM max(y) OVER (PARTITION BY id) OR min(y) OVER (PARTITION BY id) IS NULL")
simple("drop_short", t.users, lambda d: prep.drop_short(d, "id", 4), "SELECT * FROM {users} QUALIFY count(*) OVER (PARTITION BY id) >= 4")
simple("drop_gappy", t.users, lambda d: prep.drop_gappy(d, "id", "y", 0.2), "SELECT * FROM {users} QUALIFY avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY id) <= 0.2")
simple("drop_zeros", t.users, lambda d: prep.drop_zeros(d, "id", "y"), "SELECT u.* FROM {users} u WHERE id IN (SELECT id FROM {users} WHERE y <> 0)")
_EDGE = "WITH u AS {users}, b AS (SELECT id, min(ds) FILTER (y <> 0) AS lo, max(ds) FILTER (y <> 0) AS hi FROM u GROUP BY id) SELECT u.* FROM u JOIN b USING (id) WHERE "
simple("drop_leading_zeros", t.users, lambda d: prep.drop_leading_zeros(d, "id", "ds", "y"), _EDGE + "ds >= lo")
simple("drop_trailing_zeros", t.users, lambda d: prep.drop_trailing_zeros(d, "id", "ds", "y"), _EDGE + "ds <= hi")
simple("drop_edge_zeros", t.users, lambda d: prep.drop_edge_zeros(d, "id", "ds", "y"), _EDGE + "ds BETWEEN lo AND hi")
simple("fill_nulls_const", t.users, lambda d: prep.fill_nulls_const(d, "id", "ds", "y", -1.5), "SELECT *, coalesce(y, -1.5) AS filled_value FROM {users}")
simple("fill_nulls_forward", t.users, lambda d: prep.fill_nulls_forward(d, "id", "ds", "y"), "SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_value FROM {users}")
simple("fill_nulls_backward", t.users, lambda d: prep.fill_nulls_backward(d, "id", "ds", "y"), "SELECT *, first_value(y IGNORE NULLS) OVER (PARTITION BY id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled_value FROM {users}")
simple("fill_nulls_mean", t.users, lambda d: prep.fill_nulls_mean(d, "id", "ds", "y").withColumn("filled_value", F.round("filled_value", 6)), "SELECT *, round(coalesce(y, avg(y) OVER (PARTITION BY id)), 6) AS filled_value FROM {users}")
simple("diff", t.users, lambda d: prep.diff(d, "id", "ds", "y", 2).withColumn("diff_value", F.round("diff_value", 6)), "SELECT *, round(y - lag(y, 2) OVER (PARTITION BY id ORDER BY ds), 6) AS diff_value FROM {users}")
simple("fill_gaps", t.users, lambda d: prep.fill_gaps(d, "id", "ds", "y", "1d"), "WITH u AS {users}, g AS (SELECT id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM u GROUP BY id) SELECT g.id, g.ds, u.y FROM g LEFT JOIN u USING (id, ds)")
simple("fill_gaps_monthly", t.demand, lambda d: prep.fill_gaps(d, "id", "ds", "y", "1mo"), "WITH u AS {demand}, g AS (SELECT id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds FROM u GROUP BY id) SELECT g.id, g.ds, u.y FROM g LEFT JOIN u USING (id, ds)")
simple("fill_forward", t.daily, lambda d: prep.fill_forward(d, "id", "ds", "y", "2025-03-01", "1d"), "WITH u AS {daily} SELECT id, ds, y FROM u UNION ALL SELECT id, CAST(unnest(generate_series(CAST(m + 1 AS TIMESTAMP), TIMESTAMP '2025-03-01', INTERVAL 1 DAY)) AS DATE), NULL FROM (SELECT id, max(ds) AS m FROM u GROUP BY id)")
simple("fill_forward_monthly", t.monthly, lambda d: prep.fill_forward(d, "id", "ds", "y", "2002-06-01", "1mo"), "WITH u AS {monthly} SELECT id, ds, y FROM u UNION ALL SELECT id, CAST(unnest(generate_series(m + INTERVAL 1 MONTH, TIMESTAMP '2002-06-01', INTERVAL 1 MONTH)) AS DATE), NULL FROM (SELECT id, max(ds) AS m FROM u GROUP BY id)")
simple("detect_frequency", t.users, lambda d: prep.detect_frequency(d, "id", "ds"), "WITH s AS (SELECT id, CAST(ds - lag(ds) OVER (PARTITION BY id ORDER BY ds) AS BIGINT) AS step FROM {users}), c AS (SELECT id, step, count(*) AS n FROM s WHERE step > 0 GROUP BY 1, 2) SELECT id, step FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, step) = 1")
_MID = "2024-01-16"
simple("mark_unknown", t.users, lambda d: prep.mark_unknown(d, "id", "ds", _MID), f"SELECT *, ds > DATE '{_MID}' AS is_unknown, max(ds) FILTER (ds <= DATE '{_MID}') OVER (PARTITION BY id) AS last_known_date FROM {{users}}")
simple("fill_unknown", t.users, lambda d: prep.fill_unknown(d, "id", "ds", "y", _MID), f"SELECT id AS group_col, ds AS date_col, CASE WHEN ds <= DATE '{_MID}' THEN y ELSE last_value(CASE WHEN ds <= DATE '{_MID}' THEN y END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS value_col FROM {{users}}")
simple("fill_unknown_default", t.users, lambda d: prep.fill_unknown(d, "id", "ds", "y", _MID, "default", 9.0), f"SELECT id AS group_col, ds AS date_col, CASE WHEN ds <= DATE '{_MID}' THEN y ELSE 9.0 END AS value_col FROM {{users}}")
_EXPECT = ["2024-01-03", "2024-01-10", "2024-01-20"]
_VALID = "WITH u AS {users}, e AS (SELECT unnest([DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-20']) AS d), v AS (SELECT g.id, e.d, EXISTS (FROM u WHERE u.id = g.id AND u.ds = e.d) AS found FROM (SELECT DISTINCT id FROM u) g, e), r AS (SELECT id AS group_col, bool_and(found) AS is_valid, count(*) AS n_expected, CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS n_found, CAST(sum(CASE WHEN found THEN 0 ELSE 1 END) AS BIGINT) AS n_missing, list(CAST(d AS VARCHAR) ORDER BY d) FILTER (NOT found) AS missing FROM v GROUP BY id) "
simple("validate_timestamps", t.users, lambda d: prep.validate_timestamps(d, "id", "ds", _EXPECT).withColumn("missing_timestamps", F.array_join("missing_timestamps", ",")), _VALID + "SELECT group_col, is_valid, n_expected, n_found, n_missing, array_to_string(missing, ',') AS missing_timestamps FROM r")
simple("validate_timestamps_summary", t.users, lambda d: prep.validate_timestamps_summary(d, "id", "ds", _EXPECT).withColumn("invalid_groups", F.array_join(F.col("invalid_groups").cast("array<string>"), ",")), _VALID + "SELECT bool_and(is_valid) AS all_valid, count(*) AS n_groups, CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid_groups, CAST(sum(CASE WHEN is_valid THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid_groups, array_to_string(list(group_col ORDER BY group_col) FILTER (NOT is_valid), ',') AS invalid_groups FROM r")

# ------------------------------------------------------------------ keys and hierarchies


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda n: t.parquet(spark, sf_dir, n)
    j = p("orders").join(p("customer"), F.col("o_custkey") == F.col("c_custkey")).join(p("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(p("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.trunc("o_orderdate", "YEAR").alias("ds"), F.round("o_totalprice", 0).alias("y"))


_GEO = "(SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(date_trunc('year', o_orderdate) AS DATE) AS ds, round(o_totalprice, 0) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_IDS = ["region", "nation", "segment"]
_SEP = "WITH g AS {geo}, v AS (SELECT DISTINCT unnest([region, nation, segment]) AS v FROM g), b AS (SELECT coalesce(list(v ORDER BY v) FILTER (contains(v, 'A')), []) AS bad FROM v) SELECT 'A' AS separator, len(bad) = 0 AS is_valid, CAST(len(bad) AS BIGINT) AS n_conflicts, array_to_string(bad, ',') AS conflicting_values FROM b"
simple("validate_separator", _geography, lambda d: keys.validate_separator(d, _IDS, "A").select("separator", "is_valid", "n_conflicts", F.array_join("conflicting_values", ",").alias("conflicting_values")), _SEP.replace("{geo}", _GEO))
simple("combine_keys", _geography, lambda d: keys.combine_keys(d, "ds", "y", _IDS), f"SELECT concat_ws('|', region, nation, segment) AS unique_id, ds, y FROM {_GEO}")
simple("aggregate_hierarchy", _geography, lambda d: keys.aggregate_hierarchy(d, "ds", "y", _IDS), f"WITH g AS {_GEO} SELECT unique_id, ds, sum(y) AS y FROM (SELECT unnest(['AGGREGATED|AGGREGATED|AGGREGATED', concat_ws('|', region, 'AGGREGATED', 'AGGREGATED'), concat_ws('|', region, nation, 'AGGREGATED'), concat_ws('|', region, nation, segment)]) AS unique_id, ds, y FROM g) GROUP BY 1, 2")
simple("split_keys", _geography, lambda d: keys.split_keys(keys.aggregate_hierarchy(d, "ds", "y", ["region", "segment"]), "unique_id", "ds", "y", "|", ["a", "b", "c"]), f"WITH g AS {_GEO}, h AS (SELECT unnest([{{'a': 'AGGREGATED', 'b': 'AGGREGATED'}}, {{'a': region, 'b': 'AGGREGATED'}}, {{'a': region, 'b': segment}}]) AS k, ds, y FROM g) SELECT k.a AS a, k.b AS b, '' AS c, ds, sum(y) AS y FROM h GROUP BY 1, 2, 3, 4")

# ------------------------------------------------------------------ metrics


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual values with the lag-1 and lag-7 forecasts and a band around the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("ds")
    d = t.daily(spark, sf_dir)
    return d.select("id", "ds", "y", F.lag("y", 1).over(w).alias("f"), F.lag("y", 2).over(w).alias("g")).withColumns({"lo": F.col("f") * 0.9, "hi": F.col("f") * 1.1})


_P = "WITH p0 AS (SELECT id, ds, y, lag(y, 1) OVER (PARTITION BY id ORDER BY ds) AS f, lag(y, 2) OVER (PARTITION BY id ORDER BY ds) AS g FROM {daily}), p AS (SELECT *, f * 0.9 AS lo, f * 1.1 AS hi FROM p0) "
_two = lambda f: (lambda d: f(d.select("id", "ds", "y", "f"), "ds", "y", "f"))
_METRICS = {
    "mae": (metrics.mae_by, "avg(abs(y - f))"),
    "mse": (metrics.mse_by, "avg((y - f) * (y - f))"),
    "rmse": (metrics.rmse_by, "sqrt(avg((y - f) * (y - f)))"),
    "mape": (metrics.mape_by, "100 * avg(abs(y - f) / abs(y)) FILTER (abs(y) > 2.3e-16)"),
    "smape": (metrics.smape_by, "100 * avg(2 * abs(y - f) / (abs(y) + abs(f)))"),
    "r2": (metrics.r2_by, "1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*))"),
    "bias": (metrics.bias_by, "avg(f - y)"),
}
for _name, (_f, _sql) in _METRICS.items():
    simple(f"{_name}_by", _pairs, lambda d, f=_f, n=_name: _two(f)(d).withColumn(n, F.round(n, 5)), _P + f"SELECT id, round({_sql}, 5) AS {_name} FROM p WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY id")
simple("mase_by", _pairs, lambda d: metrics.mase_by(d.select("id", "ds", "y", "f", "g"), "ds", "y", "f", "g").withColumn("mase", F.round("mase", 6)), _P + "SELECT id, round(avg(abs(y - f)) / avg(abs(y - g)), 6) AS mase FROM p WHERE g IS NOT NULL GROUP BY id")
simple("rmae_by", _pairs, lambda d: metrics.rmae_by(d.select("id", "ds", "y", "f", "g"), "ds", "y", "f", "g").withColumn("rmae", F.round("rmae", 6)), _P + "SELECT id, round(avg(abs(y - f)) / avg(abs(y - g)), 6) AS rmae FROM p WHERE g IS NOT NULL GROUP BY id")
simple("quantile_loss_by", _pairs, lambda d: metrics.quantile_loss_by(d.select("id", "ds", "y", "f"), "ds", "y", "f", 0.9).withColumn("quantile_loss", F.round("quantile_loss", 5)), _P + "SELECT id, round(avg(greatest(0.9 * (y - f), (0.9 - 1.0) * (y - f))), 5) AS quantile_loss FROM p WHERE f IS NOT NULL GROUP BY id")
simple("coverage_by", _pairs, lambda d: metrics.coverage_by(d.select("id", "ds", "y", "lo", "hi"), "ds", "y", "lo", "hi").withColumn("coverage", F.round("coverage", 6)), _P + "SELECT id, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM p WHERE f IS NOT NULL GROUP BY id")


def _array_metrics(d: DataFrame) -> DataFrame:
    z = d.where("g IS NOT NULL").groupBy("id").agg(*[F.collect_list(F.struct("ds", c)).alias(c) for c in ("y", "f", "g", "lo", "hi")])
    z = z.select("id", *[F.array_sort(c)[c].alias(c) for c in ("y", "f", "g", "lo", "hi")])
    m = metrics
    measures = {"mae": m.array_mae("y", "f"), "mse": m.array_mse("y", "f"), "rmse": m.array_rmse("y", "f"), "mape": m.array_mape("y", "f"), "smape": m.array_smape("y", "f"), "bias": m.array_bias("y", "f"), "r2": m.array_r2("y", "f"), "mase": m.array_mase("y", "f", "g"), "rmae": m.array_rmae("y", "f", "g"), "quantile_loss": m.array_quantile_loss("y", "f", 0.25), "mqloss": m.array_mqloss("y", F.array("f", "g"), F.array(F.lit(0.25), F.lit(0.75))), "coverage": m.array_coverage("y", "lo", "hi")}
    return z.select("id", *[F.round(c, 5).alias(n) for n, c in measures.items()])


simple("array_metrics", _pairs, _array_metrics, _P + "SELECT id, round(avg(abs(y - f)), 5) AS mae, round(avg((y - f) * (y - f)), 5) AS mse, round(sqrt(avg((y - f) * (y - f))), 5) AS rmse, round(100 * avg(abs(y - f) / abs(y)), 5) AS mape, round(100 * avg(2 * abs(y - f) / (abs(y) + abs(f))), 5) AS smape, round(avg(f - y), 5) AS bias, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 5) AS r2, round(avg(abs(y - f)) / avg(abs(y - g)), 5) AS mase, round(avg(abs(y - f)) / avg(abs(y - g)), 5) AS rmae, round(avg(greatest(0.25 * (y - f), -0.75 * (y - f))), 5) AS quantile_loss, round((avg(greatest(0.25 * (y - f), -0.75 * (y - f))) + avg(greatest(0.75 * (y - g), -0.25 * (y - g)))) / 2, 5) AS mqloss, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 5) AS coverage FROM p WHERE g IS NOT NULL GROUP BY id")

# ------------------------------------------------------------------ cross-validation

_POS = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n FROM {daily}), "
simple("cv_folds", t.daily, lambda d: crossval.cv_folds(d, "id", "ds", "y", 3, 3), _POS + "f AS (SELECT unnest([0, 1, 2]) AS k), b AS (SELECT r.*, k, greatest(n - 9, 1) - 1 + k * 3 AS e FROM r, f) SELECT id, ds, y, CAST(k + 1 AS BIGINT) AS fold_id, CASE WHEN pos <= e THEN 'train' ELSE 'test' END AS split FROM b WHERE e + 3 < n AND pos <= e + 3")
simple("cv_folds_fixed", t.daily, lambda d: crossval.cv_folds(d, "id", "ds", "y", 2, 4, {"gap": 1, "window_type": "fixed", "min_train_size": 5, "initial_train_size": 12, "skip_length": 6, "clip_horizon": True}), _POS + "f AS (SELECT unnest([0, 1]) AS k), b AS (SELECT r.*, k, 11 + k * 6 AS e FROM r, f) SELECT id, ds, y, CAST(k + 1 AS BIGINT) AS fold_id, CASE WHEN pos <= e THEN 'train' ELSE 'test' END AS split FROM b WHERE e + 2 < n AND ((pos <= e AND pos > e - 5) OR pos BETWEEN e + 2 AND e + 5)")
_ENDS = ["2024-01-10", "2024-01-20"]
simple("cv_split", t.daily, lambda d: crossval.cv_split(d, "id", "ds", "y", _ENDS, 3), _POS + "c AS (SELECT unnest([1, 2]) AS k, unnest([DATE '2024-01-10', DATE '2024-01-20']) AS d), e AS (SELECT k, id, max(pos) AS e FROM r, c WHERE ds <= d GROUP BY 1, 2) SELECT r.id, ds, y, CAST(k AS BIGINT) AS fold_id, CASE WHEN pos <= e THEN 'train' ELSE 'test' END AS split FROM r JOIN e USING (id) WHERE pos <= e + 3")
simple("cv_split_folds", t.daily, lambda d: crossval.cv_split_folds(d, "ds", _ENDS, 3, "1d", {"gap": 1, "embargo": 1}), "WITH m AS (SELECT CAST(min(ds) AS TIMESTAMP) AS first FROM {daily}), f AS (SELECT unnest([1, 2]) AS fold_id, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20']) AS train_end), g AS (SELECT *, train_end + INTERVAL 2 DAY AS test_start, train_end + INTERVAL 4 DAY AS test_end FROM f) SELECT CAST(fold_id AS BIGINT) AS fold_id, greatest(first, coalesce(lag(test_end) OVER (ORDER BY fold_id) + INTERVAL 1 DAY, first)) AS train_start, train_end, test_start, test_end, CAST(3 AS BIGINT) AS horizon, CAST(1 AS BIGINT) AS gap, CAST(1 AS BIGINT) AS embargo FROM g, m")
simple("cv_split_index", t.daily, lambda d: crossval.cv_split_index(d, "id", "ds", _ENDS, 3, "1d", {"window_type": "sliding", "min_train_size": 4}), "WITH f AS (SELECT unnest([1, 2]) AS k, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20']) AS e), s AS (SELECT DISTINCT id, CAST(ds AS TIMESTAMP) AS d FROM {daily}) SELECT id AS group_col, d AS date_col, CAST(k AS BIGINT) AS fold_id, CASE WHEN d <= e THEN 'train' ELSE 'test' END AS split FROM s, f WHERE (d BETWEEN e - INTERVAL 4 DAY AND e) OR (d BETWEEN e + INTERVAL 1 DAY AND e + INTERVAL 3 DAY)")
simple("cv_hydrate", t.daily, lambda d: crossval.cv_hydrate(crossval.cv_folds(d, "id", "ds", "y", 2, 3), d.withColumn("dow", F.dayofmonth("ds")), "id", "ds", ["dow"]), _POS + "f AS (SELECT unnest([0, 1]) AS k), b AS (SELECT r.*, k, greatest(n - 6, 1) - 1 + k * 3 AS e FROM r, f), c AS (SELECT *, CASE WHEN pos <= e THEN 'train' ELSE 'test' END AS split FROM b WHERE e + 3 < n AND pos <= e + 3) SELECT id, ds, y, CAST(k + 1 AS BIGINT) AS fold_id, split, CAST(day(CASE WHEN split = 'train' THEN ds ELSE max(ds) FILTER (split = 'train') OVER (PARTITION BY id, k) END) AS VARCHAR) AS dow FROM c")
simple("check_leakage", t.daily, lambda d: crossval.check_leakage(d.withColumn("is_test", F.col("ds") > F.lit("2024-01-20").cast("date")), "is_test").drop("recommendation"), "SELECT 'Leakage check complete' AS status, CAST(count(*) FILTER (ds > DATE '2024-01-20') AS BIGINT) AS test_row_count, CAST(count(*) FILTER (ds <= DATE '2024-01-20') AS BIGINT) AS train_row_count FROM {daily}")
query("estimate_backtest_memory", "SELECT CAST((1000 * 365 * 5 * 40 + 1000 * 5 * (365 // 2) * 8 + 1000 * 5 * 14 * 88) // 1048576 AS BIGINT) AS mb")(lambda spark, sf_dir: spark.createDataFrame([(metrics.estimate_backtest_memory(1000, 365, 5, 14),)], "mb long"))

# ------------------------------------------------------------------ statistics

_R = lambda names: [F.round(n, 5).alias(n) for n in names]
_EXPECTED = ", CASE WHEN count(*) >= 2 THEN max(ds) - min(ds) + 1 ELSE count(*) END AS expected_length"
_STAT_SQL = """SELECT id, count(*) AS length, count(*) FILTER (y IS NULL) AS n_nulls, count(*) FILTER (y = 0) AS n_zeros, count(*) FILTER (y > 0) AS n_positive, count(DISTINCT y) AS n_unique_values,
coalesce(round(avg(y), 5), 'NaN') AS mean, coalesce(round(median(y), 5), 'NaN') AS median, coalesce(round(min(y), 5), 'NaN') AS min, coalesce(round(max(y), 5), 'NaN') AS max, coalesce(round(sum(y), 5), 'NaN') AS sum, coalesce(round(CASE WHEN count(y) = 1 THEN 0 ELSE stddev_samp(y) END, 5), 'NaN') AS std_dev,
coalesce(round(quantile_cont(y, 0.25), 5), 'NaN') AS q1, coalesce(round(quantile_cont(y, 0.75), 5), 'NaN') AS q3, CASE WHEN count(*) >= 2 THEN max(ds) - min(ds) + 1 ELSE count(*) END AS expected_length FROM {users} GROUP BY id"""
simple("stats_by", t.users, lambda d: stats.stats_by(d, "id", "ds", "y", "1d").select("id", "length", "n_nulls", "n_zeros", "n_positive", "n_unique_values", *_R(["mean", "median", "min", "max", "sum", "std_dev", "q1", "q3"]), "expected_length"), _STAT_SQL)
simple("stats_all", t.daily, lambda d: stats.stats_by(d, "id", "ds", "y", "1d"))
simple("stats_agg", t.daily, lambda d: stats.stats_agg(d, ["id"], "ds", "y").select("id", F.col("stats.length").alias("length"), F.round("stats.mean", 5).alias("mean")), "SELECT id, count(*) AS length, round(avg(y), 5) AS mean FROM {daily} GROUP BY id")
simple("stats_summary", t.users, lambda d: stats.stats_summary(stats.stats_by(d, "id", "ds", "y")).withColumn("avg_length", F.round("avg_length", 6)), "WITH s AS (SELECT id, count(*) AS n, count(*) FILTER (y IS NULL) AS z FROM {users} GROUP BY id) SELECT count(*) AS n_series, round(avg(n), 6) AS avg_length, min(n) AS min_length, max(n) AS max_length, CAST(sum(z) AS BIGINT) AS total_nulls, CAST(0 AS BIGINT) AS total_nans FROM s")
simple("quality_report", t.users, lambda d: stats.quality_report(stats.stats_by(d, "id", "ds", "y"), 3), "WITH s AS (SELECT id, count(*) AS n, count(*) FILTER (y IS NULL) AS z, count(DISTINCT y) = 1 AS c FROM {users} GROUP BY id) SELECT CAST(count(*) FILTER (n >= 3 AND NOT c) AS BIGINT) AS n_passed, CAST(0 AS BIGINT) AS n_nan_issues, CAST(count(*) FILTER (z > 0) AS BIGINT) AS n_missing_issues, CAST(count(*) FILTER (c) AS BIGINT) AS n_constant, count(*) AS n_total FROM s")
simple("data_quality_by", t.users, lambda d: stats.data_quality_by(d, "id", "ds", "y").select("unique_id", F.round("structural_score", 6).alias("structural_score"), "n_gaps", "n_missing"), "SELECT id AS unique_id, round(CASE WHEN count(y) = 0 THEN 0.0 ELSE 0.7 * count(y) / count(*) + 0.3 * least(count(y) / 30.0, 1) END, 6) AS structural_score, CAST(0 AS BIGINT) AS n_gaps, count(*) FILTER (y IS NULL) AS n_missing FROM {users} GROUP BY id")
_QUALITY = """WITH u AS {users}, v AS (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY ds) AS i FROM u WHERE y IS NOT NULL),
m AS (SELECT id, avg(y) AS mu, stddev_pop(y) AS sd, count(*) AS k, list(y ORDER BY y) AS l, min(y) AS lo, max(y) AS hi FROM v GROUP BY id),
b AS (SELECT *, l[CAST(floor(k * 0.25) AS BIGINT) + 1] AS q1, l[CAST(floor(k * 0.75) AS BIGINT) + 1] AS q3 FROM m),
o AS (SELECT v.id, avg(CASE WHEN y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS far, avg(CASE WHEN abs(y - mu) > 4 * sd THEN 1.0 ELSE 0.0 END) AS extreme FROM v JOIN b USING (id) GROUP BY v.id),
p AS (SELECT v.id, y - mu AS c, lag(y - mu) OVER (PARTITION BY v.id ORDER BY i) AS d FROM v JOIN b USING (id)), r AS (SELECT id, sum(c * d) / nullif(sum(c * c), 0) AS acf FROM p GROUP BY id),
n AS (SELECT id, count(*) AS n FROM u GROUP BY id),
q AS (SELECT n.id, CASE WHEN k IS NULL THEN 0.0 ELSE 0.7 * k / n + 0.3 * least(k / 30.0, 1) END AS structural_score, 1.0 AS temporal_score, CASE WHEN k IS NULL THEN 0.0 ELSE greatest(0, 1 - 2 * far - 3 * extreme) END AS magnitude_score,
CASE WHEN k IS NULL OR k < 3 THEN 0.5 WHEN sd * sd < 2.3e-16 THEN 0.0 WHEN abs(acf) > 0.95 THEN 0.8 ELSE 1.0 END AS behavioral_score, CAST(0 AS BIGINT) AS n_gaps, n - coalesce(k, 0) AS n_missing, coalesce(k < 2 OR lo = hi, true) AS is_constant FROM n LEFT JOIN b USING (id) LEFT JOIN o USING (id) LEFT JOIN r USING (id)),
z AS (SELECT *, (structural_score + temporal_score + magnitude_score + behavioral_score) / 4 AS overall_score FROM q) """
_SCORES = ["structural_score", "temporal_score", "magnitude_score", "behavioral_score", "overall_score"]
simple("data_quality_agg", t.users, lambda d: stats.data_quality_agg(d, ["id"], "ds", "y").select("id", "quality.*").withColumns({c: F.round(c, 6) for c in _SCORES}), _QUALITY + "SELECT id, " + ", ".join(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in _SCORES) + ", n_gaps, n_missing, is_constant FROM z")
simple("data_quality_summary", t.users, lambda d: stats.data_quality_summary(d, "id", "ds", "y").withColumn("avg_score", F.round("avg_score", 6)), _QUALITY + "SELECT count(*) AS n_total, count(*) FILTER (overall_score >= 0.8) AS n_good, count(*) FILTER (overall_score >= 0.5 AND overall_score < 0.8) AS n_fair, count(*) FILTER (overall_score < 0.5) AS n_poor, CAST(round(avg(overall_score), 6) AS DOUBLE) AS avg_score FROM z")

_SHAPE = ["variance", "range", "iqr", "coef_variation", "skewness", "kurtosis", "bimodality_coef", "trimmed_mean", "autocorr_lag1", "trend_strength", "entropy"]
_SHAPE_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS i, row_number() OVER (PARTITION BY id ORDER BY y) AS k, count(*) OVER (PARTITION BY id) AS n, avg(y) OVER (PARTITION BY id) AS m, lag(y) OVER (PARTITION BY id ORDER BY ds) AS p, min(y) OVER (PARTITION BY id) AS lo, max(y) OVER (PARTITION BY id) AS hi FROM {daily}),
s AS (SELECT id, max(n) AS n, var_samp(y) AS v, stddev_samp(y) AS sd, avg(pow(y - m, 3)) AS m3, avg(pow(y - m, 4)) AS m4, abs(corr(y, i)) AS trend, sum((y - m) * (p - m)) / sum((y - m) * (y - m)) AS acf, avg(y) FILTER (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)) AS trimmed, max(hi) - max(lo) AS range, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, stddev_samp(y) / abs(avg(y)) AS cv FROM r GROUP BY id),
e AS (SELECT id, -sum(c / n * ln(c / n)) AS entropy FROM (SELECT id, least(floor((y - lo) / (hi - lo) * 9 + 0.5), 9) AS b, count(*) AS c, max(n) AS n FROM r GROUP BY 1, 2) GROUP BY id),
x AS (SELECT *, m3 / pow(sd, 3) * sqrt(n * (n - 1)) / (n - 2) AS sk, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / pow(sd, 4) - 3) + 6) AS ku FROM s)
SELECT id, round(v, 4) AS variance, round(range, 4) AS range, round(iqr, 4) AS iqr, round(cv, 4) AS coef_variation, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round((sk * sk + 1) / (ku + 3), 4) AS bimodality_coef, round(trimmed, 4) AS trimmed_mean, round(acf, 4) AS autocorr_lag1, round(trend, 4) AS trend_strength, round(entropy, 4) AS entropy FROM x JOIN e USING (id)"""
simple("stats_shape", t.daily, lambda d: stats.stats_by(d, "id", "ds", "y").select("id", *[F.round(c, 4).alias(c) for c in _SHAPE]), _SHAPE_SQL)
_MORE = {
    "variation_coefficient": "stddev_pop(y) / abs(avg(y))", "skewness": "avg(pow((y - m) / sd, 3))", "kurtosis": "avg(pow((y - m) / sd, 4)) - 3", "count_below_mean": "CAST(count(*) FILTER (y < m) AS DOUBLE)", "percentage_above_mean": "avg(CASE WHEN y > m THEN 1.0 ELSE 0.0 END)",
    "mean_abs_change": "avg(abs(y - p))", "cid_ce": "sqrt(sum((y - p) * (y - p)))", "mean_second_derivative_central": "avg(y - 2 * p + pp)", "ratio_beyond_r_sigma_1": "avg(CASE WHEN abs(y - m) > sd THEN 1.0 ELSE 0.0 END)", "ratio_beyond_r_sigma_2": "avg(CASE WHEN abs(y - m) > 2 * sd THEN 1.0 ELSE 0.0 END)",
    "number_peaks": "CAST(count(*) FILTER (p > pp AND p > y) AS DOUBLE)", "number_peaks_threshold_1": "CAST(count(*) FILTER (p > pp AND p > y AND abs(p - m) > sd) AS DOUBLE)", "linear_trend_intercept": "regr_intercept(y, i)", "linear_trend_r_squared": "regr_r2(y, i)",
    "autocorrelation_lag2": "sum((y - m) * (pp - m)) / sum((y - m) * (y - m))", "has_duplicate": "CASE WHEN count(DISTINCT y) < count(*) THEN 1.0 ELSE 0.0 END", "ratio_value_number_to_length": "count(DISTINCT y) / count(*)", "fft_coefficient_0_real": "avg(y)", "fft_coefficient_1_real": "avg(y * cos(2 * pi() * i / n))", "fft_coefficient_1_imag": "-avg(y * sin(2 * pi() * i / n))",
    "first_location_of_maximum": "arg_max(i, y) / max(n)", "first_location_of_minimum": "arg_min(i, y) / max(n)",
}
_MORE_SQL = "WITH r AS (SELECT *, row_number() OVER w - 1 AS i, lag(y) OVER w AS p, lag(y, 2) OVER w AS pp, avg(y) OVER g AS m, stddev_pop(y) OVER g AS sd, count(*) OVER g AS n FROM {daily} WINDOW w AS (PARTITION BY id ORDER BY ds), g AS (PARTITION BY id)) SELECT id, " + ", ".join(f'round(CAST({e} AS DOUBLE), 4) AS "{n}"' for n, e in _MORE.items()) + " FROM r GROUP BY id"
simple("features_more", t.daily, lambda d: stats.features_by(d, "id", "ds", "y", list(_MORE)).select("id", *[F.round(F.col(n), 4).alias(n) for n in _MORE]), _MORE_SQL)
_FEATS = ["length", "sum", "mean", "minimum", "maximum", "variance", "standard_deviation", "median", "quantile_0.1", "quantile_0.9", "abs_energy", "root_mean_square", "count_above_mean", "linear_trend_slope", "mean_change", "absolute_sum_of_changes", "first_value", "last_value", "count_unique", "autocorrelation_lag1", "c3_lag1"]
_FEAT_SQL = "WITH r AS (SELECT *, row_number() OVER w - 1 AS i, lag(y) OVER w AS p, lag(y, 2) OVER w AS pp, avg(y) OVER (PARTITION BY id) AS m FROM {daily} WINDOW w AS (PARTITION BY id ORDER BY ds)) SELECT id, " + ", ".join(
    f'round({e}, 4) AS "{n}"'
    for n, e in zip(_FEATS, ["CAST(count(*) AS DOUBLE)", "sum(y)", "avg(y)", "min(y)", "max(y)", "var_pop(y)", "stddev_pop(y)", "median(y)", "quantile_cont(y, 0.1)", "quantile_cont(y, 0.9)", "sum(y * y)", "sqrt(avg(y * y))", "CAST(count(*) FILTER (y > m) AS DOUBLE)", "regr_slope(y, i)", "avg(y - p)", "sum(abs(y - p))", "arg_min(y, ds)", "arg_max(y, ds)", "CAST(count(DISTINCT y) AS DOUBLE)", "sum((y - m) * (p - m)) / sum((y - m) * (y - m))", "avg(y * p * pp)"])
) + " FROM r GROUP BY id"
simple("features_by", t.daily, lambda d: stats.features_by(d, "id", "ds", "y", _FEATS).select("id", *[F.round(F.col(f"`{n}`"), 4).alias(n) for n in _FEATS]), _FEAT_SQL)
simple("features_all", t.daily, lambda d: stats.features_by(d, "id", "ds", "y"))
simple("features_table", t.daily, lambda d: stats.features_table(d, "ds", "y"))
simple("features_agg", t.daily, lambda d: stats.features_agg(d, ["id"], "ds", "y", ["mean", "length"]).select("id", F.round("features.mean", 5).alias("mean"), "features.length"), "SELECT id, round(avg(y), 5) AS mean, CAST(count(*) AS DOUBLE) AS length FROM {daily} GROUP BY id")
query("features_list")(lambda spark, sf_dir: stats.features_list(spark))
query("features_config_template")(lambda spark, sf_dir: stats.features_config_template(spark))


# ------------------------------------------------------------------ forecasting

_HIST = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds) AS i, count(*) OVER (PARTITION BY id) AS n FROM {daily}), s AS (SELECT id, max(n) AS n, max(ds) AS last, stddev_pop(y) AS sd, arg_min(y, ds) AS y1, arg_max(y, ds) AS yn, avg(y) FILTER (i > n - 3) AS m3, list(y ORDER BY ds) AS ys FROM r GROUP BY id), k AS (SELECT unnest([1, 2, 3, 4]) AS k) "


def _forecast_sql(expr: str, name: str) -> str:
    return _HIST + f"SELECT id, CAST(k AS INTEGER) AS forecast_step, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, round({expr}, 4) AS yhat, round({expr} - 1.645 * sd * sqrt(k), 4) AS yhat_lower, round({expr} + 1.645 * sd * sqrt(k), 4) AS yhat_upper, '{name}' AS model_name FROM s, k"


def _forecast(method: str, params: dict | None = None, horizon: int = 4):
    return lambda d: forecast.forecast_by(d, "id", "ds", "y", method, horizon, "1d", params).withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")})


_SIMPLE = {
    "Naive": "yn",
    "SeasonalNaive": "list_extract(ys, n - 7 + CAST(k AS INTEGER))",
    "SMA": "m3",
    "RandomWalkDrift": "yn + (yn - y1) / (n - 1) * k",
    "SES": "list_reduce(ys, lambda a, b: 0.7 * a + 0.3 * b)",
    # no day without events: demand comes at every step
    "CrostonClassic": "list_reduce(ys, lambda a, b: 0.9 * a + 0.1 * b)",
    "CrostonSBA": "0.95 * list_reduce(ys, lambda a, b: 0.9 * a + 0.1 * b)",
    "TSB": "list_reduce(ys, lambda a, b: 0.9 * a + 0.1 * b)",
    "ARIMA": "yn + k * ((yn - y1) / (n - 1)) + (list_extract(ys, n) - list_extract(ys, n - 1) - (yn - y1) / (n - 1)) * (1 - pow(0.5, k))",
}
for _name in _models.MODELS:
    _params = {"seasonal_period": 7} if _name == "SeasonalNaive" else {"window": 3} if _name == "SMA" else None
    _sql = _forecast_sql(_SIMPLE[_name], _name) if _name in _SIMPLE else oracles.intermittent(_name, "{daily}", "CAST(k AS INTEGER)", 4) if _name in ("CrostonOptimized", "ADIDA") else None
    simple(f"forecast_{_name}", t.daily, _forecast(_name, _params), _sql)
simple("forecast_seasonal_window", t.daily, _forecast("SeasonalWindowAverage", {"seasonal_period": 7}), _HIST + "SELECT id, CAST(k AS INTEGER) AS forecast_step, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, round(f, 4) AS yhat, round(f - 1.645 * sd * sqrt(k), 4) AS yhat_lower, round(f + 1.645 * sd * sqrt(k), 4) AS yhat_upper, 'SeasonalWindowAverage' AS model_name FROM (SELECT id, last, sd, k, (SELECT avg(x) FROM (SELECT unnest(ys) AS x, generate_subscripts(ys, 1) AS j) WHERE j > n - (n // 7) * 7 AND (j - n - 1 + (n // 7) * 7) % 7 = CAST(k AS INTEGER) - 1) AS f FROM s, k)")
simple("forecast_ets_spec", t.daily, _forecast("ETS", {"model": "MAdM", "seasonal_period": 7}))
simple("forecast_monthly", t.monthly, lambda d: forecast.forecast_by(prep.fill_gaps(d, "id", "ds", "y", "1mo"), "id", "ds", "y", "AutoETS", 6, "1mo", {"seasonal_period": 12}))


def _total(d: DataFrame) -> DataFrame:
    """All series as one: ds, y."""
    return d.groupBy("ds").agg(F.round(F.sum("y"), 3).alias("y"))


def _digits(x: Column) -> Column:
    """A double of up to four decimals as DuckDB writes it: all its digits below 1e16, where Spark's cast takes to
    exponents from 1e7 on and under 1e-3."""
    full = F.regexp_replace(x.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.replace(F.lower(F.regexp_replace(x.cast("string"), r"(\.0)?E", "e+")), F.lit("infinity"), F.lit("inf"))
    return F.when((F.abs(x) < 1e16) & (x != 0), full).otherwise(short)


simple("forecast_one", t.daily, lambda d: forecast.forecast(_total(d), "ds", "y", "Naive", 3).select("model", F.array_join(F.transform("point", lambda x: _digits(F.round(x, 4))), ",").alias("point")), "SELECT 'Naive' AS model, array_to_string([v, v, v], ',') AS point FROM (SELECT CAST(arg_max(y, ds) AS VARCHAR) AS v FROM (SELECT ds, round(sum(y), 3) AS y FROM {daily} GROUP BY ds))")
simple("forecast_agg", t.daily, lambda d: forecast.forecast_agg(d, ["id"], "ds", "y", "Theta", 3))


def _exog(method: str):
    def build(d: DataFrame) -> DataFrame:
        x = d.withColumns({"dow": F.dayofweek("ds").cast("double"), "trend": F.datediff("ds", F.lit("2024-01-01")).cast("double")})
        last = d.groupBy("id").agg(F.max("ds").alias("m"))
        future = last.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.date_add("m", k))).alias("fd")).withColumns({"dow": F.dayofweek("fd").cast("double"), "trend": F.datediff("fd", F.lit("2024-01-01")).cast("double")})
        return forecast.forecast_exog_by(x, "id", "ds", "y", ["dow", "trend"], future, "fd", ["dow", "trend"], "1d", method, 5)

    return build


simple("forecast_exog", t.daily, _exog("ARIMA"))
simple("forecast_exog_theta", t.daily, _exog("Theta"))
simple("forecast_exog_mfles", t.daily, _exog("MFLES"))
simple("forecast_inspect", t.daily, lambda d: forecast.forecast_inspect_by(d, "id", "ds", "y", "AutoETS"))
simple("forecast_explain", t.daily, lambda d: forecast.forecast_explain_by(d, "id", "ds", "y", "MSTL", 7, {"seasonal_period": 7}))

_CV_SQL = _POS + "f AS (SELECT unnest([0, 1]) AS k), b AS (SELECT r.*, k, greatest(n - 6, 1) - 1 + k * 3 AS e FROM r, f), c AS (SELECT * FROM b WHERE e + 3 < n), l AS (SELECT id, k, arg_max(y, pos) AS yhat, stddev_pop(y) AS sd FROM c WHERE pos <= e GROUP BY 1, 2) SELECT CAST(c.k + 1 AS BIGINT) AS fold_id, c.id, c.ds, c.y, 'test' AS split, round(l.yhat, 4) AS yhat, round(l.yhat - 1.645 * sd * sqrt(pos - e), 4) AS yhat_lower, round(l.yhat + 1.645 * sd * sqrt(pos - e), 4) AS yhat_upper, 'Naive' AS model_name FROM c JOIN l ON c.id = l.id AND c.k = l.k WHERE pos BETWEEN e + 1 AND e + 3"
simple("cv_forecast", t.daily, lambda d: forecast.cv_forecast_by(crossval.cv_folds(d, "id", "ds", "y", 2, 3), "id", "ds", "y", "Naive").withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")}), _CV_SQL)
_BT_SQL = "WITH d AS {daily}, g AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ds FROM d)), f AS (SELECT unnest([0, 1]) AS k), b AS (SELECT g.*, k, greatest(n - 6, 1) - 1 + k * 3 AS e FROM g, f), c AS (SELECT d.*, pos, k, e FROM d JOIN b USING (ds) WHERE e + 3 < n), l AS (SELECT id, k, arg_max(y, pos) AS yhat FROM c WHERE pos <= e GROUP BY 1, 2), o AS (SELECT c.k + 1 AS fold_id, c.id, c.ds, l.yhat, c.y AS actual FROM c JOIN l ON c.id = l.id AND c.k = l.k WHERE pos BETWEEN e + 1 AND e + 3) SELECT CAST(fold_id AS BIGINT) AS fold_id, id, ds, round(yhat, 4) AS yhat, actual, round(abs(yhat - actual), 4) AS abs_error, round(avg(abs(yhat - actual)) OVER (PARTITION BY fold_id), 4) AS fold_metric_score FROM o"
simple("backtest", t.daily, lambda d: forecast.backtest_auto_by(d, "id", "ds", "y", 3, 2, "Naive", metric="mae").select("fold_id", "id", "ds", F.round("yhat", 4).alias("yhat"), "actual", F.round("abs_error", 4).alias("abs_error"), F.round("fold_metric_score", 4).alias("fold_metric_score")), _BT_SQL)
simple("backtest_theta", t.daily, lambda d: forecast.backtest_auto_by(d, "id", "ds", "y", 3, 3, "Theta", {"gap": 1, "window_type": "sliding", "min_train_size": 15}, "smape"))

# ------------------------------------------------------------------ many series


#: Monthly demand of every part; months without any count as 0 (`fill`), and the table deals its rows out by part.
_DEMAND_MODELS = ("CrostonClassic", "CrostonSBA", "CrostonOptimized", "TSB", "ADIDA")
for _name in _DEMAND_MODELS:
    simple(f"demand_{_name}", t.demand, lambda d, n=_name: forecast.forecast_by(d, "id", "ds", "y", n, 6, "1mo", fill=0.0, dealt=True).withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")}), oracles.intermittent(_name, oracles.FILLED, "to_months(CAST(k AS INTEGER))", 6))
for _name in ("AutoETS", "Theta"):
    simple(f"demand_{_name}", t.demand, lambda d, n=_name: forecast.forecast_by(d, "id", "ds", "y", n, 6, "1mo", {"seasonal_period": 12} if n == "AutoETS" else None, 0.0, True))
simple("demand_stats", t.demand, lambda d: stats.stats_by(d, "id", "ds", "y", "1mo", 0.0, True))
simple("demand_features", t.demand, lambda d: stats.features_by(d, "id", "ds", "y", freq="1mo", fill=0.0, dealt=True))

# ------------------------------------------------------------------ conformal

def _level_join(d: DataFrame) -> DataFrame:
    return d.where("f IS NOT NULL").select("id", "ds", "y", "f")


_RANK = "WITH p0 AS (SELECT id, ds, y, lag(y, 1) OVER (PARTITION BY id ORDER BY ds) AS f FROM {daily}), p AS (SELECT id, abs(y - f) AS r FROM p0 WHERE f IS NOT NULL), a AS (SELECT id, list(r ORDER BY r) AS l, count(*) AS n FROM p GROUP BY id), b AS (SELECT *, least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1) AS pos_ FROM a), s AS (SELECT id, l[CAST(floor(pos_) AS INTEGER) + 1] + (l[least(CAST(floor(pos_) AS INTEGER) + 2, n)] - l[CAST(floor(pos_) AS INTEGER) + 1]) * (pos_ - floor(pos_)) AS s, n FROM b) "
simple("conformal_by", _pairs, lambda d: conformal.conformal_by(_level_join(d), "id", "y", "f", "f").select("group_col", F.round("conformity_score", 4).alias("conformity_score"), F.round("coverage", 6).alias("coverage"), "method", F.size("lower").alias("n")), _RANK + "SELECT id AS group_col, round(s, 4) AS conformity_score, CAST(0.9 AS DOUBLE) AS coverage, 'split_conformal' AS method, CAST(n AS INTEGER) AS n FROM s")
simple("conformal_rows", _pairs, lambda d: conformal.conformal_rows_by(_level_join(d), "id", "y", "f", "f").withColumns({c: F.round(c, 4) for c in ("lower", "upper")}), _RANK + "SELECT p0.id, ds, y, f, round(f - s, 4) AS lower, round(f + s, 4) AS upper FROM p0 JOIN s USING (id) WHERE f IS NOT NULL")
simple("conformal_asymmetric", _pairs, lambda d: conformal.conformal_by(_level_join(d), "id", "y", "f", "f", {"method": "asymmetric", "alpha": 0.2}).select("group_col", F.round("conformity_score", 4).alias("conformity_score"), "coverage", "method", F.round(F.array_min("lower"), 4).alias("lower"), F.round(F.array_max("upper"), 4).alias("upper"), F.size("lower").alias("n")), oracles.ASYMMETRIC)
simple("conformal_calibrate", _pairs, lambda d: conformal.conformal_calibrate(_level_join(d), "y", "f").select(F.round("conformity_score", 4).alias("conformity_score"), F.round("coverage", 6).alias("coverage"), "n_residuals"), "WITH p0 AS (SELECT id, y, lag(y, 1) OVER (PARTITION BY id ORDER BY ds) AS f FROM {daily}), p AS (SELECT abs(y - f) AS r FROM p0 WHERE f IS NOT NULL), a AS (SELECT list(r ORDER BY r) AS l, count(*) AS n FROM p), b AS (SELECT *, least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1) AS pos_ FROM a) SELECT round(l[CAST(floor(pos_) AS INTEGER) + 1] + (l[least(CAST(floor(pos_) AS INTEGER) + 2, n)] - l[CAST(floor(pos_) AS INTEGER) + 1]) * (pos_ - floor(pos_)), 4) AS conformity_score, CAST(0.9 AS DOUBLE) AS coverage, n AS n_residuals FROM b")
simple("conformal_apply_by", _pairs, lambda d: conformal.conformal_apply_by(_level_join(d), "id", "f", 5.0).select("group_col", F.round(F.col("lower")[0], 4).alias("lower"), F.round(F.element_at("upper", -1), 4).alias("upper")), "WITH p AS (SELECT id, lag(y, 1) OVER (PARTITION BY id ORDER BY ds) AS f FROM {daily}) SELECT id AS group_col, round(min(f) - 5, 4) AS lower, round(max(f) + 5, 4) AS upper FROM p GROUP BY id")
simple("interval_width_by", _pairs, lambda d: conformal.interval_width_by(d, "id", "lo", "hi").withColumn("mean_width", F.round("mean_width", 4)), _P + "SELECT id AS group_col, round(avg(hi - lo), 4) AS mean_width, count(*) AS n_intervals FROM p WHERE f IS NOT NULL GROUP BY id")


def _arrays(d: DataFrame) -> DataFrame:
    z = _level_join(d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ds", "y", "f"))).alias("s"))
    return z.select("id", F.col("s.y").alias("a"), F.col("s.f").alias("f"), F.zip_with("s.y", "s.f", lambda x, y: x - y).alias("r"))


def _conformal_arrays(d: DataFrame) -> DataFrame:
    c = conformal
    z = _arrays(d).withColumn("profile", c.conformal_learn("r", [0.1, 0.2])).withColumn("applied", c.conformal_apply("f", "profile")).withColumn("bounds", c.conformal_intervals("f", c.conformal_quantile("r", 0.1)))
    return z.select("id", c.conformal_evaluate("a", "bounds.lower", "bounds.upper", 0.1).alias("e"), "profile", c.conformal_predict_asymmetric("r", "f", 0.1)["conformity_score"].alias("asymmetric"), F.size("applied.lower").alias("levels")).select("id", "e.*", "profile.scores_lower", "asymmetric", "levels")


_EVALUATED = _RANK + ", e AS (SELECT p0.id, count(*) AS n, avg(CASE WHEN y BETWEEN f - s AND f + s THEN 1.0 ELSE 0.0 END) AS c, avg(2 * s + 20.0 * greatest(f - s - y, y - f - s, 0)) AS w, max(s) AS s FROM p0 JOIN s USING (id) WHERE f IS NOT NULL GROUP BY p0.id) SELECT id, round(c, 4) AS coverage, round(1 - c, 4) AS violation_rate, round(2 * s, 4) AS mean_width, round(w, 4) AS winkler_score, n AS n_observations FROM e"
simple("conformal_evaluate", _pairs, lambda d: _conformal_arrays(d).select("id", *[F.round(c, 4).alias(c) for c in ("coverage", "violation_rate", "mean_width", "winkler_score")], "n_observations"), _EVALUATED)
simple("conformal_arrays", _pairs, lambda d: _learned(d), oracles.LEARNED)


def _learned(d: DataFrame) -> DataFrame:
    """What conformal_learn, conformal_apply and conformal_predict_asymmetric give for each series, at 0.1 and 0.2."""
    c = conformal
    z = _arrays(d).withColumn("profile", c.conformal_learn("r", [0.1, 0.2])).withColumn("applied", c.conformal_apply("f", "profile"))
    score = lambda k: F.round(F.col("profile.scores_lower")[k], 4)
    return z.select("id", score(0).alias("score_10"), score(1).alias("score_20"), F.round(c.conformal_predict_asymmetric("r", "f", 0.1)["conformity_score"], 4).alias("asymmetric"), F.size("applied.lower").alias("levels"), F.round(F.col("applied.lower")[1][0], 4).alias("first_lower_20"))


def _per_step(d: DataFrame, horizon: int = 4) -> DataFrame:
    """The last `horizon` pairs are the points and all before them the folds, counted back from the points; nulls, which no
    width counts, fill up the first fold. A series without two whole folds gets one row of nulls."""
    z = _arrays(d).withColumn("n", F.size("f") - horizon)
    fill = F.array_repeat(F.lit(None).cast("double"), F.pmod(-F.col("n"), F.lit(horizon)))
    folds = lambda c: F.concat(fill, F.slice(c, 1, F.greatest("n", F.lit(0))))
    point = F.slice("f", F.greatest("n", F.lit(0)) + 1, horizon)
    c = F.when(F.col("n") >= 2 * horizon, conformal.conformal_predict_per_step(folds("f"), folds("a"), point, 0.1, horizon))
    z = z.select("id", c.alias("c")).select("id", F.posexplode_outer(F.arrays_zip("c.point", "c.half_widths", "c.lower", "c.upper")).alias("step", "z"))
    return z.select("id", "step", *[F.round(f"z.{k}", 4).alias(n) for k, n in (("point", "point"), ("half_widths", "half_width"), ("lower", "lower"), ("upper", "upper"))])


simple("conformal_per_step", _pairs, _per_step, oracles.PER_STEP)
simple("bootstrap_intervals", _pairs, lambda d: conformal.bootstrap_intervals(_arrays(d), "r", "f", 200).select("id", "intervals.*"))
simple("bootstrap_quantiles", _pairs, lambda d: conformal.bootstrap_quantiles(_arrays(d), "r", "f", 200).select("id", "quantiles.*"))


# ------------------------------------------------------------------ the scalar functions through spark.sql


def _in_sql(select: str, source: Callable[[DataFrame], DataFrame]):
    """`select` over the rows of `source`, with the functions of sources.sql."""

    def build(d: DataFrame) -> DataFrame:
        sql.register(d.sparkSession)
        return d.sparkSession.sql(f"SELECT id, {select} FROM {{rows}}", rows=source(d))

    return build


def _metric_arrays(d: DataFrame) -> DataFrame:
    z = d.where("g IS NOT NULL").groupBy("id").agg(*[F.collect_list(F.struct("ds", c)).alias(c) for c in ("y", "f", "g", "lo", "hi")])
    return z.select("id", *[F.array_sort(c)[c].alias(c) for c in ("y", "f", "g", "lo", "hi")])


_CALLS = {"mae": "y, f", "mse": "y, f", "rmse": "y, f", "mape": "y, f", "smape": "y, f", "bias": "y, f", "r2": "y, f", "mase": "y, f, g", "rmae": "y, f, g", "quantile_loss": "y, f, 0.25D", "mqloss": "y, array(f, g), array(0.25D, 0.75D)", "coverage": "y, lo, hi"}
simple("sql_metrics", _pairs, _in_sql(", ".join(f"round(ts_{n}({a}), 5) AS {n}" for n, a in _CALLS.items()), _metric_arrays), ORACLES["array_metrics"])
simple("sql_conformal", _pairs, _in_sql("round(ts_conformal_quantile(r, 0.1D), 4) AS score_10, round(ts_conformal_learn(r, array(0.1D, 0.2D)).scores_lower[1], 4) AS score_20, round(ts_conformal_predict_asymmetric(r, f, 0.1D).conformity_score, 4) AS asymmetric, size(ts_conformal_apply(f, ts_conformal_learn(r, array(0.1D, 0.2D)).scores_lower, ts_conformal_learn(r, array(0.1D, 0.2D)).scores_upper).lower) AS levels, round(ts_conformal_predict(r, f, 0.2D).lower[0], 4) AS first_lower_20", _arrays), oracles.LEARNED)
_BOUNDED = "ts_conformal_intervals(f, ts_conformal_quantile(r, 0.1D))"
_CHECKED_BY = f"ts_conformal_evaluate(a, {_BOUNDED}.lower, {_BOUNDED}.upper, 0.1D)"
simple("sql_conformal_evaluate", _pairs, _in_sql(f"round(ts_conformal_coverage(a, {_BOUNDED}.lower, {_BOUNDED}.upper), 4) AS coverage, round({_CHECKED_BY}.violation_rate, 4) AS violation_rate, round(ts_mean_interval_width({_BOUNDED}.lower, {_BOUNDED}.upper), 4) AS mean_width, round({_CHECKED_BY}.winkler_score, 4) AS winkler_score, {_CHECKED_BY}.n_observations AS n_observations", _arrays), _EVALUATED)


def _grouped(call: str, build: Callable[[DataFrame], DataFrame]):
    """`build` of id and r, the aggregate `call` of sources.aggregates by id."""

    def run(d: DataFrame) -> DataFrame:
        sql.register(d.sparkSession)
        return build(d.sparkSession.sql(f"SELECT id, {call} AS r FROM {{rows}} GROUP BY id", rows=d))

    return run


_NUMBERS = ["mean", "median", "min", "max", "sum", "std_dev", "q1", "q3"]
simple("sql_stats_agg", t.users, _grouped("ts_stats_agg(ds, y)", lambda g: g.select("id", "r.*").select("id", "length", "n_nulls", "n_zeros", "n_positive", "n_unique_values", *_R(_NUMBERS))), _STAT_SQL.replace(_EXPECTED, ""))
simple("sql_data_quality_agg", t.users, _grouped("ts_data_quality_agg(ds, y)", lambda g: g.select("id", "r.*").withColumns({c: F.round(c, 6) for c in _SCORES})), ORACLES["data_quality_agg"])
simple("sql_features_agg", t.daily, _grouped("ts_features_agg(ds, y, array('mean', 'length'))", lambda g: g.select("id", F.round("r.mean", 5).alias("mean"), "r.length")), ORACLES["features_agg"])
simple("sql_forecast_agg", t.daily, _grouped("ts_forecast_agg(ds, y, 'Naive', 3, map())", lambda g: g.select("id", F.inline(F.arrays_zip("r.forecast_step", F.col("r.forecast_timestamp").alias("ds"), F.col("r.point_forecast").alias("yhat"))))), "WITH e AS (SELECT id, max(ds) AS last, arg_max(y, ds) AS y FROM {daily} GROUP BY id), k AS (SELECT unnest([1, 2, 3]) AS forecast_step) SELECT id, forecast_step, CAST(last + forecast_step AS TIMESTAMP) AS ds, y AS yhat FROM e, k")

# ------------------------------------------------------------------ periods, shape, changepoints

def _found(r: DataFrame, least: float | None = None) -> DataFrame:
    """The first period of each row of detect_periods (columns id, periods, n_periods, ...), rounded; null if there is none."""
    first = r.withColumn("p", F.get("periods", F.lit(0)))
    return first.select("id", "n_periods", "method", *[F.round(f"p.{c}", 4).alias(c) for c in ("period", "confidence", "strength", "amplitude")], "p.matches_expected", "p.matched_expected_period", F.round("p.match_deviation", 4).alias("match_deviation"))


_CHECKED = ("fft", "acf", "auto", "autoperiod", "cfd_autoperiod", "lomb_scargle", "aic", "stl", "matrix_profile", "sazed")
for _name in _CHECKED:
    simple(f"detect_periods_{_name}", t.daily, lambda d, m=_name: _found(analysis.detect_periods_by(d, "id", "ds", "y", {"method": m, "expected_periods": [7.0], "min_confidence": 0.0})), oracles.detected(_name))
for _name in ("regression", "multi", "ssa"):
    simple(f"detect_periods_{_name}", t.daily, lambda d, m=_name: analysis.detect_periods_by(d, "id", "ds", "y", {"method": m, "expected_periods": [7.0], "min_confidence": 0.0}))
_TOTAL = "(SELECT 'all' AS id, ds, round(sum(y), 3) AS y FROM {daily} GROUP BY ds)"
simple("detect_periods_table", t.daily, lambda d: _found(analysis.detect_periods(_total(d), "ds", "y", {"method": "acf"}).withColumn("id", F.lit("all"))), oracles.detected("acf", _TOTAL, 0.3, None))
simple("detect_periods_agg", t.daily, lambda d: _found(analysis.detect_periods_agg(d, ["id"], "ds", "y").select("id", "detect_periods.*")), oracles.detected("fft", least=5.0, expected=None))


def _on_arrays(function: str, **options):
    def build(d: DataFrame) -> DataFrame:
        z = d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ds", "y")))["y"].alias("values"))
        return analysis.over_arrays(z, "values", function, **options).drop("values")

    return build


def _fields(function: str, *names: str, **options):
    """id and some fields of a function's struct over arrays, doubles rounded; a name may have :digits."""

    def build(d: DataFrame) -> DataFrame:
        r = _on_arrays(function, **options)(d).select("id", f"{function}.*")
        kinds = dict(r.dtypes)
        split = [(n.split(":")[0], int(n.split(":")[1]) if ":" in n else 4) for n in names or [c for c in r.columns if c != "id"]]
        return r.select("id", *[F.round(n, k).alias(n) if kinds[n] == "double" else F.col(n) for n, k in split])

    return build


def _each(function: str, *names: str, pos: bool = False, **options):
    """id and the elements of some array fields of a function's struct, one row a position."""

    def build(d: DataFrame) -> DataFrame:
        r = _on_arrays(function, **options)(d)
        z = r.select("id", F.posexplode(F.arrays_zip(*[F.col(f"{function}.{n}").alias(n) for n in names])).alias("pos", "z"))
        return z.select("id", *(["pos"] if pos else []), *[F.round(f"z.{n}", 4).alias(n) for n in names])

    return build


for _name, _spec in {
    "estimate_period_fft": ("period", "frequency", "power:2", "confidence", "method"), "estimate_period_acf": (), "autoperiod": (), "cfd_autoperiod": (), "lomb_scargle": (),
    "aic_period": ("period", "aic", "bic", "rss:2", "r_squared", "method"), "sazed_period": ("period", "power:2", "snr", "method"), "matrix_profile_period": (), "stl_period": (),
}.items():
    simple(_name, t.daily, _fields(_name, *_spec), oracles.ARRAYS[_name])
for _name, _options in {
    "estimate_period_regression": {}, "detect_multiple_periods": {}, "ssa_period": {}, "classify_seasonality": {"period": 7}, "detect_seasonality_changes": {"period": 7}, "instantaneous_period": {}, "detect_amplitude_modulation": {"period": 7},
    "decompose_seasonal": {"period": 7}, "mstl_decomposition": {"periods": [7]},
}.items():
    simple(_name, t.daily, _on_arrays(_name, **_options))
simple("detect_seasonality", t.daily, lambda d: _on_arrays("detect_seasonality")(d).select("id", F.posexplode("detect_seasonality").alias("rank", "period")).withColumn("rank", F.col("rank") + 1), oracles.SEASONALITY)
simple("analyze_seasonality", t.daily, _fields("analyze_seasonality", "primary_period", "seasonal_strength", "trend_strength"), oracles.ANALYZED)
simple("seasonal_strength", t.daily, lambda d: _on_arrays("seasonal_strength", period=7)(d).select("id", F.round("seasonal_strength", 4).alias("strength")), oracles.STRENGTH)
simple("seasonal_strength_windowed", t.daily, lambda d: _on_arrays("seasonal_strength_windowed", period=7)(d).select("id", F.posexplode("seasonal_strength_windowed").alias("pos", "strength")).withColumn("strength", F.round("strength", 4)), oracles.WINDOWED)
simple("seasonal_strength_spectral", t.daily, lambda d: _on_arrays("seasonal_strength", period=7, method="spectral")(d).select("id", F.round("seasonal_strength", 4).alias("strength")), oracles.SPECTRAL)
simple("seasonal_strength_wavelet", t.daily, _on_arrays("seasonal_strength", period=7, method="wavelet"))


def _classes(r: DataFrame) -> DataFrame:
    return r.select("id", "timing_classification", "has_stable_timing", F.round("timing_variability", 4).alias("timing_variability"), F.round("seasonal_strength", 4).alias("seasonal_strength"), "is_seasonal", F.size("weak_seasons").alias("n_weak"), F.round(F.aggregate("cycle_strengths", F.lit(0.0), lambda s, x: s + x), 4).alias("cycle_strengths_sum"))


simple("classify_seasonality_by", t.daily, lambda d: _classes(analysis.classify_seasonality_by(d, "id", "ds", "y", 7)), oracles.CLASSES)
simple("classify_seasonality_agg", t.daily, lambda d: _classes(analysis.classify_seasonality_agg(d, ["id"], "ds", "y", 7).select("id", "classify_seasonality.*")), oracles.CLASSES)
simple("detect_peaks", t.daily, lambda d: _on_arrays("detect_peaks")(d).select("id", "detect_peaks.n_peaks", F.round("detect_peaks.mean_period", 4).alias("mean_period"), F.inline("detect_peaks.peaks")).select("id", "index", "value", F.round("prominence", 4).alias("prominence"), "n_peaks", "mean_period"), oracles.PEAKS)
simple("detect_peaks_by", t.daily, lambda d: analysis.detect_peaks_by(d, "id", "ds", "y").select("id", "n_peaks"), "WITH r AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM {daily} WINDOW w AS (PARTITION BY id ORDER BY ds)) SELECT id, count(*) FILTER (y > a AND y >= b) AS n_peaks FROM r GROUP BY id")
_TIMING = ("n_peaks", "mean_timing", "std_timing", "range_timing", "variability_score", "timing_trend", "is_stable")
simple("analyze_peak_timing", t.daily, _each("analyze_peak_timing", "peak_times", "peak_values", "normalized_timing", period=7), oracles.PEAK_TIMES)
simple("analyze_peak_timing_by", t.daily, lambda d: analysis.analyze_peak_timing_by(d, "id", "ds", "y", 7).select("id", *[F.round(c, 4).alias(c) if c[0] in "msrvt" else F.col(c) for c in _TIMING]), oracles.TIMING)
simple("detrend", t.daily, _each("detrend", "trend", "detrended", pos=True, method="loess"), oracles.LOESS)
simple("detrend_by", t.daily, lambda d: analysis.detrend_by(d, "id", "ds", "y", "linear").select("id", F.round(F.col("coefficients")[1], 5).alias("slope"), F.round("rss", 2).alias("rss")), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS i FROM {daily}) SELECT id, round(regr_slope(y, i), 5) AS slope, round(regr_syy(y, i) * (1 - regr_r2(y, i)), 2) AS rss FROM r GROUP BY id")
simple("mstl_decomposition_by", t.daily, lambda d: analysis.mstl_decomposition_by(d, "id", "ds", "y").select("id", F.posexplode(F.arrays_zip("trend", "remainder")).alias("pos", "z")).select("id", "pos", F.round("z.trend", 4).alias("trend"), F.round("z.remainder", 4).alias("remainder")), oracles.TREND)
simple("detect_changepoints_by", t.daily, lambda d: analysis.detect_changepoints_by(d, "id", "ds", "y", {"include_probabilities": True}).withColumn("changepoint_probability", F.round("changepoint_probability", 4)), oracles.CHANGES)
simple("detect_changepoints_table", t.daily, lambda d: analysis.detect_changepoints(_total(d), "ds", "y"), oracles.changepoints(_TOTAL, "SELECT ds, y, signal > 0.5 AND t > 0 AS is_changepoint, CAST(0 AS DOUBLE) AS changepoint_probability FROM r JOIN sg ON sg.id = r.id AND sg.t = r.i"))
simple("detect_changepoints_agg", t.daily, lambda d: analysis.detect_changepoints_agg(d, ["id"], "ds", "y", {"include_probabilities": True}).select("id", F.inline("changepoints")).withColumn("changepoint_probability", F.round("changepoint_probability", 4)), oracles.CHANGES.replace("SELECT r.id, ds, y, signal", 'SELECT r.id, ds AS "timestamp", y AS value, signal'))
simple("sql_detect_periods_agg", t.daily, _grouped("ts_detect_periods_agg(ds, y)", lambda g: _found(g.select("id", "r.*"))), ORACLES["detect_periods_agg"])
simple("sql_classify_seasonality_agg", t.daily, _grouped("ts_classify_seasonality_agg(ds, y, 7)", lambda g: _classes(g.select("id", "r.*"))), ORACLES["classify_seasonality_agg"])
simple("sql_detect_changepoints_agg", t.daily, _grouped("ts_detect_changepoints_agg(ds, y, map('include_probabilities', 'true'))", lambda g: g.select("id", F.inline("r")).withColumns({"timestamp": F.col("timestamp").cast("date"), "changepoint_probability": F.round("changepoint_probability", 4)})), ORACLES["detect_changepoints_agg"])
simple("detect_changepoints_pelt", t.daily, lambda d: _on_arrays("detect_changepoints_pelt")(d).select("id", "detect_changepoints_pelt.n_changepoints", F.array_join(F.transform("detect_changepoints_pelt.changepoints", lambda x: x.cast("string")), ",").alias("changepoints"), F.round("detect_changepoints_pelt.cost", 2).alias("cost")), oracles.PELT)




def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue by market segment with gaps filled: mean absolute error of two models over the last six months."""
    filled = prep.fill_gaps(t.monthly(spark, sf_dir), "id", "ds", "y", "1mo")
    folds = crossval.cv_folds(filled, "id", "ds", "y", 1, 6)
    models = [forecast.cv_forecast_by(folds, "id", "ds", "y", m, p) for m, p in (("Naive", None), ("SeasonalNaive", {"seasonal_period": 12}))]
    both = models[0].unionByName(models[1])
    return metrics.mae_by(both.select("id", "model_name", "ds", "y", "yhat"), "ds", "y", "yhat").withColumn("mae", F.round("mae", 2))


query("flagship", "WITH a AS {monthly}, g AS (SELECT id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds FROM a GROUP BY id), m AS (SELECT g.id, g.ds, coalesce(y, 0) AS y FROM g LEFT JOIN a ON a.id = g.id AND a.ds = g.ds), r AS (SELECT id, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY id) AS n, lag(y, 12) OVER w AS season FROM m WINDOW w AS (PARTITION BY id ORDER BY ds)), l AS (SELECT id, arg_max(y, i) AS last FROM r WHERE i <= n - 6 GROUP BY id), t AS (SELECT r.*, last FROM r JOIN l USING (id) WHERE i > n - 6) SELECT id, 'Naive' AS model_name, round(avg(abs(y - last)), 2) AS mae FROM t GROUP BY id UNION ALL SELECT id, 'SeasonalNaive', round(avg(abs(y - season)), 2) FROM t GROUP BY id")(flagship)
