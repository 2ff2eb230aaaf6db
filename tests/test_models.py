import datetime as dt

import numpy as np
import pytest

from seriesmill.functions import describe, models, periods, shape, smoothing
from seriesmill.operators import analysis, conformal, crossval, forecast, stats
from seriesmill.sources import sql

T84 = np.arange(84)
WEEKLY = 100 + 0.2 * T84 + 20 * np.sin(2 * np.pi * T84 / 7)


def series(spark, data):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(g, day + dt.timedelta(days=i), None if v is None else float(v)) for g, vs in data.items() for i, v in enumerate(vs)], "id string, ds date, y double")


@pytest.mark.parametrize("name", models.MODELS)
@pytest.mark.parametrize("constant", [0.0, 50.0, 1e6, 0.001, -5.0])
def test_constant_stays_constant(name, constant):
    p, label = models.point_forecast(np.full(30, constant), 5, models.Options(model=name))
    want = constant * 0.95 if name == "CrostonSBA" else constant
    assert len(p) == 5 and label.startswith(name) and np.allclose(p, want, atol=max(1e-6, abs(constant) * 0.02))


@pytest.mark.parametrize("name", [m for m in models.MODELS if m not in models.NOT_SEASONAL | {"SMA", "SeasonalWindowAverage"}])
def test_weekly_pattern_is_followed(name):
    p, _ = models.point_forecast(WEEKLY, 14, models.Options(model=name, seasonal_period=7, detect=False))
    t = np.arange(84, 98)
    assert np.abs(p - (100 + 0.2 * t + 20 * np.sin(2 * np.pi * t / 7))).mean() < 8


def test_models_differ():
    rng = np.random.default_rng(0)
    v = WEEKLY + rng.normal(0, 3, 84)
    got = {n: tuple(np.round(models.point_forecast(v, 7, models.Options(model=n))[0], 6)) for n in models.MODELS if not n.startswith("Auto")}
    same = [n for n in got if list(got.values()).count(got[n]) > 1 and not n.startswith(("Croston", "ADIDA", "IMAPA", "TSB", "ETS", "HoltWinters", "Theta", "DynamicTheta"))]  # demand models agree without zeros; a dynamic line ends where the fixed one lies
    assert same == []


def test_visible_models():
    v = np.arange(1.0, 11)
    f = lambda n, **o: models.point_forecast(v, 3, models.Options(model=n, detect=False, **o))[0]
    assert f("SMA", window=3) == pytest.approx([9, 9, 9])
    assert f("RandomWalkDrift") == pytest.approx([11, 12, 13])
    assert f("Naive") == pytest.approx([10] * 3)
    assert f("SeasonalNaive", seasonal_period=4) == pytest.approx([7, 8, 9])


def test_ets_notation():
    assert smoothing.parse_spec("AAdA").name == "AAdA"
    for bad in ("", "XXX", "AAAA", "ANdN", "AA"):
        with pytest.raises(ValueError):
            smoothing.parse_spec(bad)
    assert not smoothing.parse_spec("MAA").stable and smoothing.parse_spec("MAM").stable


def test_names():
    assert models.model_name("auto_ets") == "AutoETS" and models.model_name("snaive") == "SeasonalNaive"
    with pytest.raises(models.InputError):
        models.model_name("nope")


def test_forecast_by_dates_bounds_and_isolation(spark):
    df = series(spark, {"A": WEEKLY, "B": [1.0, 2.0], "C": [None] * 5, "D": [1, None, 3, 4, 5]})
    out = forecast.forecast_by(df, "id", "ds", "y", "Naive", 3, "1d").orderBy("id", "forecast_step").collect()
    assert [(r.id, r.forecast_step) for r in out] == [(g, k) for g in "AD" for k in (1, 2, 3)]
    assert out[0].ds == dt.date(2024, 3, 25) and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
    sd = np.std([1, 2, 3, 4, 5])
    assert out[5].yhat_upper == pytest.approx(5 + 1.645 * sd * np.sqrt(3))


def test_calendar_dates_clamp(spark):
    df = spark.createDataFrame([("A", dt.date(2024, m, 29 if m == 2 else 31 if m in (1, 3) else 30), float(m)) for m in (1, 2, 3)], "id string, ds date, y double")
    out = [r.ds for r in forecast.forecast_by(df, "id", "ds", "y", "Naive", 3, "1mo").orderBy("ds").collect()]
    assert out == [dt.date(2024, 4, 30), dt.date(2024, 5, 31), dt.date(2024, 6, 30)]


@pytest.mark.parametrize("method,params", [("nope", {}), ("Naive", {"bad": 1}), ("ETS", {"model": "MAA"}), ("Naive", {"confidence_level": 2}), ("AutoETS", {"model_pool": "x"})])
def test_wrong_requests_raise(spark, method, params):
    with pytest.raises(models.InputError):
        forecast.forecast_by(series(spark, {"A": WEEKLY}), "id", "ds", "y", method, 3, "1d", params)


def test_partitions_do_not_matter(spark):
    df = series(spark, {"s%d" % k: WEEKLY[:60] + k for k in range(20)})
    run = lambda d: sorted(map(tuple, forecast.forecast_by(d, "id", "ds", "y", "Theta", 3).collect()))
    assert run(df.repartition(7)) == run(df.coalesce(1))


def test_regressors(spark):
    t = np.arange(40)
    x = (t % 5).astype(float)
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("A", day + dt.timedelta(days=int(i)), float(10 + 3 * x[i]), float(x[i])) for i in t], "id string, ds date, y double, x double")
    fut = spark.createDataFrame([("A", day + dt.timedelta(days=40 + i), float(i)) for i in range(4)], "id string, fd date, fx double")
    for method in ("ARIMA", "Theta", "MFLES"):
        out = forecast.forecast_exog_by(df, "id", "ds", "y", ["x"], fut, "fd", ["fx"], "1d", method, 4).orderBy("forecast_step").collect()
        assert [r.yhat for r in out] == pytest.approx([10, 13, 16, 19], abs=0.5) and out[0].model_name.endswith("X")


def test_inspect_and_explain(spark):
    df = series(spark, {"A": WEEKLY})
    for m in ("AutoETS", "AutoARIMA", "AutoTheta", "AutoTBATS", "MFLES", "MSTL", "Laplace"):
        r = forecast.forecast_inspect_by(df, "id", "ds", "y", m, {"seasonal_period": 7}).first()
        assert r.inspection.model_family and r.inspection.raw_json
    for m in ("ETS", "MSTL", "Theta"):
        r = forecast.forecast_explain_by(df, "id", "ds", "y", m, 5, {"seasonal_period": 7}).first()
        assert np.allclose(np.array(r.level) + r.trend + r.seasonal + r.residual, r.point)
    with pytest.raises(models.InputError):
        forecast.forecast_inspect_by(df, "id", "ds", "y", "Naive")


def test_folds_equal_an_explicit_split(spark):
    df = series(spark, {"A": 100 + 2 * T84[:60] + 3 * (T84[:60] % 7), "B": 150 + 2 * T84[:60]})
    folds = crossval.cv_folds(df, "id", "ds", "y", 2, 7)
    cut = crossval.cv_split(df, "id", "ds", "y", [dt.date(2024, 2, 15), dt.date(2024, 2, 22)], 7)
    one, two = (sorted(map(tuple, forecast.cv_forecast_by(f, "id", "ds", "y", "Theta").collect())) for f in (folds, cut))
    assert one == two and len(one) == 28
    with pytest.raises(models.InputError):
        forecast.cv_forecast_by(df, "id", "ds", "y", "Naive")
    with pytest.raises(ValueError):
        crossval.cv_folds(df, "id", "ds", "y", 2, 7, {"nope": 1})


def test_group_before_the_cutoff_is_left_out(spark):
    df = series(spark, {"A": range(10)})
    assert crossval.cv_split(df, "id", "ds", "y", [dt.date(2023, 1, 1)], 3).count() == 0


def test_backtest(spark):
    out = forecast.backtest_auto_by(series(spark, {"A": WEEKLY, "B": WEEKLY + 5}), "id", "ds", "y", 7, 3, "SeasonalNaive", {"seasonal_period": 7}, "mae")
    rows = out.collect()
    assert len(rows) == 42 and all(r.fold_metric_score == pytest.approx(1.4) for r in rows)


def test_statistics_and_features(spark):
    df = series(spark, {"A": [1, 2, 3, 4, 5], "B": [0, 0, 1, None, 1, 0]})
    s = {r.id: r for r in stats.stats_by(df, "id", "ds", "y").collect()}
    assert s["A"].skewness == pytest.approx(0) and s["A"].expected_length == 5 and s["A"].n_gaps == 0
    assert (s["B"].n_zeros_start, s["B"].n_zeros_end, s["B"].n_nulls, s["B"].plateau_size, s["B"].plateau_size_nonzero) == (2, 1, 1, 2, 2)
    assert len(s["A"].__fields__) == 37
    f = describe.features(np.arange(1.0, 11))
    assert len(f) == 117 and f["mean"] == 5.5 and f["linear_trend_slope"] == pytest.approx(1)
    v = np.random.default_rng(0).normal(size=60)
    n, m, r = 60, 2, 0.2 * v.std()
    near = lambda k, size: sum(max(abs(v[i : i + k] - v[j : j + k])) <= r for i in range(size) for j in range(i + 1, size))
    a, b = near(m, n - m) / ((n - m) * (n - m - 1) / 2), near(m + 1, n - m - 1) / ((n - m - 1) * (n - m - 2) / 2)
    assert describe.features(v)["sample_entropy"] == pytest.approx(-np.log(b / a))
    phi = lambda k: np.mean([np.log(sum(max(abs(v[i : i + k] - v[j : j + k])) <= r for j in range(n - k + 1)) / (n - k + 1)) for i in range(n - k + 1)])
    assert describe.features(v)["approximate_entropy"] == pytest.approx(phi(2) - phi(3))
    with pytest.warns(UserWarning):
        assert stats.features_by(df, "id", "ds", "y", ["mean", "nope"]).columns == ["id", "mean"]


def test_features_config(tmp_path):
    (tmp_path / "c.json").write_text('{"mean": {}, "autocorrelation_lag1": {"lag": 1}}')
    (tmp_path / "c.csv").write_text('feature,params_json\nmean,\nlength,"{""a"": 1}"\n')
    assert stats.features_config_from_json(str(tmp_path / "c.json"))["feature_names"] == ["mean", "autocorrelation_lag1"]
    assert stats.features_config_from_csv(str(tmp_path / "c.csv"))["overrides"] == [{"feature": "length", "params_json": '{"a": 1}'}]


@pytest.mark.parametrize("p,tolerance", [(4, 1), (7, 1), (12, 2)])
def test_periods_of_a_pure_wave(p, tolerance):
    v = 10 + 5 * np.sin(2 * np.pi * np.arange(120) / p)
    for method in ("fft", "acf", "autoperiod", "cfd_autoperiod", "lomb_scargle", "aic", "ssa", "stl", "matrix_profile", "sazed", "regression", "multi", "auto"):
        if method == "matrix_profile" and p == 4:
            continue  # within the exclusion zone
        got = periods.detect(v, method, min_confidence=0.0, expected=[float(p)], tolerance=0.3)
        assert abs(got["primary_period"] - p) <= tolerance, method
        assert got["periods"][0]["matches_expected"]
    assert abs(periods.lomb_scargle(v)["period"] * periods.lomb_scargle(v)["frequency"] - 1) < 1e-9


def test_shape():
    v = WEEKLY
    d = shape.mstl_decomposition(v, [7])
    assert np.allclose(np.array(d["trend"]) + d["seasonal"][0] + d["remainder"], v)
    assert shape.strength(v, 7) > 0.9 and shape.strength(np.random.default_rng(0).normal(size=200), 7) < 0.3
    assert shape.detect_peaks(v)["mean_period"] == pytest.approx(7)
    assert shape.peak_timing(v, 7)["is_stable"]
    assert shape.classify(v, 7)["is_seasonal"] and not shape.classify(np.arange(60.0) * 0 + np.random.default_rng(1).normal(size=60), 7)["is_seasonal"]
    c = shape.decompose_seasonal(v, 7)
    assert np.allclose(np.array(c["trend"]) + c["seasonal"] + c["remainder"], v)
    m = shape.decompose_seasonal(v, 7, "multiplicative")
    assert np.allclose(np.array(m["trend"]) * m["seasonal"] * m["remainder"], v)
    onset = np.r_[np.random.default_rng(3).normal(0, 1, 60), 20 * np.sin(2 * np.pi * np.arange(60) / 7)]
    assert [x["change_type"] for x in shape.seasonality_changes(onset, 7, 0.6)["change_points"]][-1] == "onset"
    for x in ("linear", "polynomial", "diff", "diff2", "loess", "auto", "unknown"):
        assert len(shape.detrend(v, x)["detrended"]) >= 82


def test_changepoints(spark):
    rng = np.random.default_rng(1)
    w = np.r_[10 + rng.normal(0, 0.3, 25), 50 + rng.normal(0, 0.3, 25)]
    assert 25 in shape.bocpd(w)["changepoint_indices"] and shape.pelt(w)["changepoints"] == [25]
    out = analysis.detect_changepoints_by(series(spark, {"A": w, "B": [1, 2]}), "id", "ds", "y", {"include_probabilities": True})
    assert out.where("id = 'A' and is_changepoint").count() >= 1 and out.where("id = 'B' and is_changepoint is null").count() == 2


def test_conformal(spark):
    c = conformal
    df = spark.createDataFrame([([1.0, -2.0, 3.0, -4.0, 5.0], [10.0, 20.0], [9.0, 25.0])], "r array<double>, f array<double>, a array<double>")
    q = df.select(c.conformal_quantile("r", 0.1), c.conformal_quantile("r", 0.5), c.conformal_quantile("r", 1.0)).first()
    assert q[0] == pytest.approx(5) and q[1] == pytest.approx(3.4) and q[2] is None
    p = df.select(c.conformal_predict("r", "f", 0.5).alias("p")).first().p
    assert p.lower == pytest.approx([6.6, 16.6]) and p.method == "split_conformal"
    e = df.select(c.conformal_evaluate("a", "f", "a", 0.1).alias("e")).first().e
    assert e.coverage == 0.5 and e.n_observations == 2
    prof = df.select(c.conformal_apply("f", c.conformal_learn("r", [0.1, 0.5], "symmetric", "jackknife_plus")).alias("x")).first().x
    assert prof.lower[1] == pytest.approx([6.6, 16.6])
    with pytest.raises(ValueError):
        c.conformal_learn("r", [0.1], "asymmetric", "jackknife_plus")
    b = c.bootstrap_intervals(df, "r", "f", 500).first().intervals
    assert b.lower[0] < 10 < b.upper[0] and b == c.bootstrap_intervals(df, "r", "f", 500).first().intervals


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    for v in (rng.normal(size=4000), rng.integers(0, 5, 4000).astype(float), np.r_[np.zeros(3000), rng.random(1000)]):
        df = spark.createDataFrame([(float(x),) for x in v], "x double").repartition(3)
        for k in (0, 1, 1999, 3000, 3999):
            assert conformal.order_statistic(df, "x", k, small=50) == np.sort(v)[k]


def test_sql(spark):
    names = sql.register(spark)
    assert len(names) > 30
    r = spark.sql("select ts_mae(array(10D, 20D, 30D), array(12D, 18D, 33D)) m, ts_forecast_values(array(1D, 2D, 3D, 4D), 'RandomWalkDrift', 2).yhat f, ts_detect_peaks(array(1D, 3D, 1D, 4D, 1D)).n_peaks p, ts_seasonal_strength(array(1D, 2D), 7) s").first()
    assert r.m == pytest.approx(7 / 3) and r.f == pytest.approx([5, 6]) and r.p == 2 and r.s is None
    series(spark, {"A": [1, 2, 3]}).createOrReplaceTempView("sales")
    assert sql.call(spark, "ts_fill_nulls_const_by", "sales", "id", "ds", "y", 0).count() == 3
    with pytest.raises(ValueError):
        sql.call(spark, "nope", "sales")


def test_aggregates_in_group_by(spark):
    import random

    from seriesmill.operators import analysis, forecast

    sql.register(spark)
    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(g, day + dt.timedelta(days=i), None if rng.random() < 0.05 else round(rng.uniform(0, 9) + 5 * (i % 7 == 0) + 30 * (i > 40), 2)) for g in "ab" for i in range(70)]
    rows += [("c", day, 1.0), ("c", day, 0.5), ("c", None, 7.0), ("n", None, 1.0), ("z", day, None)]
    df = spark.createDataFrame(rows, "id string, ds timestamp, y double").repartition(3)
    df.createOrReplaceTempView("agg_sales")
    ask = lambda call: {r.id: r.x for r in spark.sql(f"select id, {call} as x from agg_sales group by id").collect()}
    same = lambda got, want: all(str(got[r[0]]) == str(r[1]) for r in want.collect())
    assert same(ask("ts_stats_agg(ds, y)"), stats.stats_agg(df, ["id"], "ds", "y"))
    assert same(ask("ts_data_quality_agg(ds, y)"), stats.data_quality_agg(df, ["id"], "ds", "y"))
    assert same(ask("ts_features_agg(ds, y)"), stats.features_agg(df, ["id"], "ds", "y"))
    some = ask("ts_features(ds, y, array('mean', 'length'), null)")
    assert some["a"].length == 70 - sum(r[2] is None for r in rows if r[0] == "a") and some["a"].median is None
    assert same(ask("ts_detect_periods_agg(ds, y, 'acf')"), analysis.detect_periods_agg(df, ["id"], "ds", "y", "acf"))
    assert same(ask("ts_classify_seasonality_agg(ds, y, 7)"), analysis.classify_seasonality_agg(df, ["id"], "ds", "y", 7))
    assert same(ask("ts_detect_changepoints_agg(ds, y, map('hazard_lambda', '100'))"), analysis.detect_changepoints_agg(df, ["id"], "ds", "y", {"hazard_lambda": 100}))
    got = ask("ts_forecast_agg(ds, y, 'SES', 3, map())")
    want = {r.id: r.forecast for r in forecast.forecast_agg(df, ["id"], "ds", "y", "SES", 3).collect()}
    for k in "ab":
        assert got[k].point_forecast == want[k].point_forecast and got[k].lower_90 == want[k].lower_90 and got[k].insample_fitted == want[k].insample_fitted
        assert got[k].forecast_timestamp == want[k].forecast_timestamp == [day + dt.timedelta(days=70 + i) for i in range(3)]
    assert got["n"] is None and ask("ts_stats_agg(ds, y)")["n"] is None
    assert spark.sql("select ts_stats_agg(cast(ds as date), y).length as n from agg_sales").first().n == 143
    with pytest.raises(Exception, match="horizon"):
        ask("ts_forecast_agg(ds, y, 'SES', 0, map())")


def test_conformal_per_step_uses_all_pairs(spark, tmp_path):
    import math
    import random

    import __spark_entry__

    rng, day = random.Random(4), dt.datetime(2024, 1, 1)
    series = {f"s{n}": [round(rng.uniform(0, 9), 3) for _ in range(n)] for n in (3, 10, 13, 14, 30, 103)}
    rows = [(k, day + dt.timedelta(days=i), y) for k, v in series.items() for i, y in enumerate(v)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {k: [] for k in series}
    for r in __spark_entry__.queries()["conformal_per_step"](spark, str(tmp_path)).orderBy("step").collect():
        got[r.id].append(r)
    assert all(got.values())
    for k, v in series.items():
        pairs = list(zip(v, v[1:]))  # forecast, actual
        if len(pairs) < 12:
            assert [tuple(r)[1:] for r in got[k]] == [(None,) * 5]
            continue
        early = pairs[:-4]
        half = []
        for step in range(4):
            r = sorted(abs(y - f) for i, (f, y) in enumerate(early) if (len(early) - i) % 4 == (4 - step) % 4)
            at = min(1.0, math.ceil(round((len(r) + 1) * 0.9, 9)) / len(r)) * (len(r) - 1)
            lo = int(at)
            half.append(r[lo] + (r[min(lo + 1, len(r) - 1)] - r[lo]) * (at - lo))
        point = [f for f, _ in pairs[-4:]]
        assert [(r.step, r.point) for r in got[k]] == list(enumerate(point))
        for name, want in (("half_width", half), ("lower", np.array(point) - half), ("upper", np.array(point) + half)):
            assert np.allclose([r[name] for r in got[k]], want, atol=1e-4)


def test_stats_by_keeps_series_of_nulls(spark, tmp_path):
    import __spark_entry__

    day = dt.datetime(2024, 1, 1)
    rows = [(5 * k, 1, day + dt.timedelta(days=k), 2.0) for k in range(3)] + [(5 * k + 2, 2, day + dt.timedelta(days=k), 2.0) for k in range(3)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.id: r for r in __spark_entry__.queries()["stats_by"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2] and got[2].mean == 2.0
    assert (got[1].length, got[1].n_nulls, got[1].n_zeros, got[1].n_unique_values, got[1].expected_length) == (3, 3, 0, 0, 3) and np.isnan(got[1].mean)
