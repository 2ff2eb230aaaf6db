import datetime as dt

import numpy as np
import pytest

import __spark_entry__ as entry
from seriesmill.functions import describe, models, smoothing
from seriesmill.operators import forecast, prep, stats
from seriesmill.plans import frequency as fq
from seriesmill.plans import series as plan

SF = "/root/testdata/sf0.001"


def some_series():
    rng = np.random.default_rng(4)
    out = [np.round(rng.normal(size=n) * 50, 1) * (rng.random(n) < 0.6) for n in (0, 1, 2, 3, 5, 9, 12, 12, 12, 40, 40, 83) for _ in range(3)]
    return [*out, np.full(12, 5.0), np.zeros(40), np.r_[np.nan, 1.0, 2.0, np.nan], np.full(5, np.nan), np.r_[1.0, np.inf, np.arange(10.0)]]


@pytest.mark.parametrize("name", ["demand_features", "demand_stats", "demand_Theta", "demand_AutoETS", "demand_TSB"])
def test_demand_is_dealt_out_once(spark, name):
    """The lines go through one exchange, and the months without demand are never rows of the table."""
    got = entry.queries()[name](spark, SF)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "Window" not in text


@pytest.mark.parametrize("kind,freq,dates", [("date", "1mo", ["2024-01-01", "2024-01-20", "2024-04-01", "2024-04-01", "2025-01-01"]), ("date", "1d", ["2024-01-01", "2024-01-02", "2024-01-06"]), ("date", "1w", ["2024-01-01", "2024-01-20"]), ("timestamp", "1h", ["2024-01-01 00:00:00", "2024-01-01 03:30:00"]), ("timestamp", "1q", ["2024-01-01 00:00:00", "2024-11-02 03:30:00"]), ("int", "2", ["1", "4", "9", "10"])])
def test_filled_arrays_equal_filled_rows(spark, kind, freq, dates):
    rows = [(g, d, None if (i + k) % 3 == 0 else float(i)) for k, g in enumerate("AB") for i, d in enumerate(dates[: len(dates) - k])]
    df = spark.createDataFrame([*rows, ("A", None, 1.0)], "g string, d string, y double").selectExpr("g", f"cast(d as {kind}) as d", "y")
    filled = prep.fill_nulls_const(prep.fill_gaps(df, "g", "d", "y", freq), "g", "d", "y", 7.0)
    want = {r.g: (r._d, r._v) for r in plan.collect(filled, "g", "d", "filled_value").collect()}
    for dealt in (False, True):
        got = {r.g: (r._d, r._v) for r in plan.collect(df, "g", "d", "y", fill=(fq.parse(freq), 7.0), dealt=dealt).collect()}
        assert got == want and len(got) == 2


def same(a, b):
    return a is b if a is None or b is None else a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True)


def test_features_of_many_series_are_those_of_each():
    many = some_series()
    present, got, missing = describe.features_many(many)
    assert list(got) == describe.feature_names()
    for i, v in enumerate(many):
        each = describe.features(v)
        assert present[i] == (each is not None) == bool(np.isfinite(v[~np.isnan(v)]).all() and (~np.isnan(v)).any())
        for k, x in (each or {}).items():
            assert same(x, None if missing[k][i] else got[k][i]), (k, i)
    v = np.array([300.0, 20, -20, 0, 5e-1, 3, 7e22])  # leading digits 3 2 2 3 7
    share = np.array([0, 2, 2, 0, 0, 0, 1, 0, 0]) / 5
    assert describe.features(v)["benford_correlation"] == pytest.approx(np.corrcoef(describe.BENFORD, share)[0, 1])


def test_statistics_of_many_series_are_those_of_each():
    many = some_series()
    nulls = [(np.arange(len(v)) % 4 == 2) * 1.0 for v in many]
    many = [np.where(n > 0, np.nan, v) for v, n in zip(many, nulls)]
    present, got, missing = describe.statistics_many(many, nulls)
    for i, (v, n) in enumerate(zip(many, nulls)):
        assert present[i] or np.isinf(v).any()
        if np.isfinite(v[~np.isnan(v)]).all():
            each = describe.statistics(v, n)
            assert all(same(x, got[k][i]) and not missing[k][i] for k, x in each.items())
            x = v[~np.isnan(v)]
            assert (each["length"], each["n_nulls"], each["n_nan"]) == (len(v), n.sum(), np.isnan(v).sum() - n.sum())
            if len(x) > 1:
                assert same(each["std_dev"], x.std(ddof=1)) and same(each["median"], np.median(x)) and each["n_unique_values"] == len(np.unique(x.view(np.int64)))


def test_filled_statistics_equal_those_of_filled_rows(spark):
    rows = [(g, dt.date(2024, 1 + m, 1 + (m % 3)), float(m)) for g in "AB" for m in (0, 1, 4, 5, 9, 11) if g == "A" or m > 1]
    df = spark.createDataFrame(rows, "g string, d date, y double")
    for freq in ("1mo", "1d", "1w"):
        filled = prep.fill_nulls_const(prep.fill_gaps(df, "g", "d", "y", freq), "g", "d", "y", 0.0)
        want = stats.stats_by(filled, "g", "d", "filled_value", freq).orderBy("g").collect()
        got = stats.stats_by(df, "g", "d", "y", freq, 0.0).orderBy("g").collect()
        assert [str(r) for r in got] == [str(r) for r in want]


def waves():
    rng = np.random.default_rng(6)
    return [10 + 4 * np.sin(np.arange(60) * 2 * np.pi / p) + rng.normal(size=60) * 0.2 for p in (4, 5, 7, 11, 12) for _ in range(2)] + [rng.normal(size=60), np.r_[np.inf, np.ones(59)], np.ones(60)]


def test_theta_takes_all_periods_of_a_length_at_once(monkeypatch):
    many, calls, whole = waves(), [], smoothing.theta_many
    o = forecast.options("Theta", None)
    periods = [models.season_of(v, o) for v in many]
    assert models.seasons_of(many, o) == periods and len(set(periods)) > 5
    each = [None if np.isinf(v).any() else models.point_forecast(v, 6, o)[0] for v in many]
    monkeypatch.setattr(smoothing, "theta_many", lambda x, *a: calls.append(len(x)) or whole(x, *a))
    got = models.point_forecasts(many, [6] * len(many), o)
    assert max(calls) >= len([p for p in periods if p > 1]) and len([c for c in calls if c > 1]) <= 2
    for a, b in zip(each, got):
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b[0], rtol=1e-9))


@pytest.mark.parametrize("spec", ["ANN", "AAN", "AAdN", "AAA", "MNM", "MMN", "MMM"])
def test_starts_and_searches_of_many_series_are_those_of_each(spec):
    spec, m = smoothing.parse_spec(spec), 12
    many = [np.abs(v) + 1 for v in waves() if np.isfinite(v).all()]
    level, trend, season = smoothing.start(np.array(many), spec, m)
    fits = smoothing.fit_many(many, spec, m, details=False)
    for i, v in enumerate(many):
        one = smoothing.start(v[None], spec, m)
        assert np.allclose([level[i], trend[i], *season[:, i]], [one[0][0], one[1][0], *one[2][:, 0]], rtol=1e-12)
        if spec.season == "N" and spec.trend == "A":
            slope, cut = np.polyfit(np.arange(10), v[:10], 1)
            assert np.allclose([level[i], trend[i]], [cut - slope, slope])
        # with details the plain recursion runs, without them that in place
        f = smoothing.fit(v, spec, m)
        assert np.allclose(f.forecast(8), fits[i].forecast(8), rtol=1e-9) and np.isclose(f.aicc, fits[i].aicc)


def test_best_smoothing_of_many_series_is_that_of_each():
    many = [v for v in waves() if np.isfinite(v).all()] + [np.zeros(60), np.arange(60.0)]
    for v, f in zip(many, smoothing.auto_many(many, 12)):
        one = min((smoothing.fit(v, s, 12, count=40, rounds=3) for s in smoothing.pool("reduced", True, True) if smoothing.possible(v, s, 12)), key=lambda f: f.aicc)
        assert f.spec == one.spec and np.allclose(f.forecast(6), one.forecast(6), rtol=1e-9, atol=1e-9)
