import datetime as dt
import math

import pytest

from seriesmill.operators import keys, metrics, prep
from seriesmill.plans import frequency as fq


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def days(*values, group="A"):
    return [(group, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in values]


def frame(spark, data, kind="date"):
    return spark.createDataFrame(data, f"g string, d {kind}, v double")


@pytest.mark.parametrize("text,want", [("1d", (1, "day")), ("30 min", (30, "minute")), ("2 weeks", (2, "week")), ("3mo", (3, "month")), ("1q", (1, "quarter")), ("1y", (1, "year")), ("5", (5, None)), (None, (1, "day"))])
def test_frequency(text, want):
    f = fq.parse(text)
    assert (f.count, f.unit) == want


@pytest.mark.parametrize("bad", ["", "d", "-1d", "1x", "0", "1.5h"])
def test_bad_frequency(bad):
    with pytest.raises(ValueError):
        fq.parse(bad)


def test_fill_gaps_keeps_date_type(spark):
    out = prep.fill_gaps(frame(spark, days((0, 10.0), (1, 20.0), (3, 40.0))), "g", "d", "v", "1d")
    assert out.schema["d"].dataType.simpleString() == "date"
    assert rows(out, "d")[2] == ("A", dt.date(2024, 1, 3), None) and out.count() == 4


def test_fill_gaps_hours_and_off_grid(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([("B", t(0), 1.0), ("B", t(1), 2.0), ("B", t(3, 30), 4.0), ("C", t(0), 1.0)], "g string, d timestamp_ntz, v double")
    out = prep.fill_gaps(df, "g", "d", "v", "1h")
    assert out.schema["d"].dataType.simpleString() == "timestamp_ntz"
    assert [r[1] for r in rows(out.where("v is null"), "d")] == [t(2), t(3)]


@pytest.mark.parametrize("gap", [1, 2, prep.PIECE, prep.PIECE + 1, prep.PIECE + 2, 3 * prep.PIECE + 7])
def test_fill_gaps_of_any_length(spark, gap):
    df = spark.createDataFrame([("A", 5, 1.0), ("A", 5 + gap, 2.0), ("B", 3, None), ("B", 4, 4.0)], "g string, d long, v double")
    out = [(r.g, r.d, r.v) for r in prep.fill_gaps(df, "g", "d", "v", "1").collect()]
    want = [("A", d, {5: 1.0, 5 + gap: 2.0}.get(d)) for d in range(5, 6 + gap)] + [("B", 3, None), ("B", 4, 4.0)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_fill_gaps_integers_and_quarters(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 7, 2.0)], "g string, d int, v double")
    assert [r[1] for r in rows(prep.fill_gaps(df, "g", "d", "v", "2"), "d")] == [1, 3, 5, 7]
    q = frame(spark, [("A", dt.date(2023, 2, 10), 1.0), ("A", dt.date(2023, 12, 1), 2.0)])
    assert [r[1] for r in rows(prep.fill_gaps(q, "g", "d", "v", "1q").where("v is null"), "d")] == [dt.date(2023, 4, 1), dt.date(2023, 7, 1)]


def test_fill_forward(spark):
    out = prep.fill_forward(frame(spark, days((0, 1.0), (1, 2.0))), "g", "d", "v", dt.date(2024, 1, 4), "1d")
    assert [r[2] for r in rows(out, "d")] == [1.0, 2.0, None, None]
    assert prep.fill_forward(frame(spark, days((5, 1.0))), "g", "d", "v", dt.date(2024, 1, 4), "1d").count() == 1


def test_bad_date_type(spark):
    with pytest.raises(TypeError):
        prep.fill_gaps(spark.createDataFrame([("A", "x", 1.0)], "g string, d string, v double"), "g", "d", "v", "1d")


def test_drops(spark):
    df = frame(spark, days((0, 0.0), (1, 5.0), (2, 0.0)) + days((0, None), (1, None), group="N") + days((0, 3.0), (1, 3.0), group="C") + days((0, 0.0), (1, 0.0), group="Z"))
    groups = lambda d: {r.g for r in d.collect()}
    assert groups(prep.drop_constant(df, "g", "v")) == {"A", "N"}
    assert groups(prep.drop_short(df, "g", 3)) == {"A"}
    assert groups(prep.drop_gappy(df, "g", "v", 0.5)) == {"A", "C", "Z"}
    assert groups(prep.drop_zeros(df, "g", "v")) == {"A", "C"}
    assert prep.drop_leading_zeros(df, "g", "d", "v").where("g = 'A'").count() == 2
    assert prep.drop_trailing_zeros(df, "g", "d", "v").where("g = 'A'").count() == 2
    assert groups(prep.drop_edge_zeros(df, "g", "d", "v")) == {"A", "C"}


def test_imputation_and_diff(spark):
    df = frame(spark, days((0, None), (1, 4.0), (2, None), (3, 8.0)))
    filled = lambda d: [r[-1] for r in rows(d, "d")]
    assert filled(prep.fill_nulls_const(df, "g", "d", "v", 0)) == [0, 4, 0, 8]
    assert filled(prep.fill_nulls_forward(df, "g", "d", "v")) == [None, 4, 4, 8]
    assert filled(prep.fill_nulls_backward(df, "g", "d", "v")) == [4, 4, 8, 8]
    assert filled(prep.fill_nulls_mean(df, "g", "d", "v")) == [6, 4, 6, 8]
    assert filled(prep.diff(df, "g", "d", "v", 2)) == [None, None, None, 4]
    with pytest.raises(ValueError):
        prep.diff(df, "g", "d", "v", 0)


def test_unknown_values(spark):
    df = frame(spark, days((0, 1.0), (1, 2.0), (2, 3.0)))
    marked = prep.mark_unknown(df, "g", "d", "2024-01-02").orderBy("d").collect()
    assert [r.is_unknown for r in marked] == [False, False, True] and marked[0].last_known_date == dt.date(2024, 1, 2)
    get = lambda *a: [r.value_col for r in prep.fill_unknown(df, "g", "d", "v", "2024-01-02", *a).orderBy("date_col").collect()]
    assert get() == [1, 2, 2] and get("null") == [1, 2, None] and get("default", 7) == [1, 2, 7]
    with pytest.raises(ValueError):
        get("other")


def test_timestamps(spark):
    df = frame(spark, days((0, 1.0), (1, 1.0)) + days((0, 1.0), group="B"))
    want = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    r = {x.group_col: x for x in prep.validate_timestamps(df, "g", "d", want).collect()}
    assert r["A"].is_valid and r["A"].missing_timestamps is None and r["B"].missing_timestamps == [want[1]]
    s = prep.validate_timestamps_summary(df, "g", "d", want).first()
    assert (s.all_valid, s.n_groups, s.n_valid_groups, s.invalid_groups) == (False, 2, 1, ["B"])


def ids(spark):
    return spark.createDataFrame([("EU", "S1", "A", dt.date(2024, 1, 1), 1), ("EU", "S1", "B", dt.date(2024, 1, 1), 2), ("EU", "S2", "A", dt.date(2024, 1, 1), 3), ("US", "S3", None, dt.date(2024, 1, 1), None)], "r string, s string, i string, d date, q int")


def test_keys(spark):
    df = ids(spark)
    assert {r.unique_id for r in keys.combine_keys(df, "d", "q", ["r", "s", "i"]).collect()} == {"EU|S1|A", "EU|S1|B", "EU|S2|A", "US|S3|NULL"}
    h = {r.unique_id: r.q for r in keys.aggregate_hierarchy(df, "d", "q", ["r", "s", "i"]).collect()}
    assert len(h) == 10 and h["AGGREGATED|AGGREGATED|AGGREGATED"] == 6 and h["EU|S1|AGGREGATED"] == 3 and h["US|S3|NULL"] == 0
    back = keys.split_keys(keys.combine_keys(df, "d", "q", ["r", "s"], "-"), "unique_id", "d", "q", "-").first()
    assert (back.id_part_1, back.id_part_2, back.id_part_3) == ("EU", "S1", "")


def test_separator(spark):
    df = ids(spark)
    good, bad = keys.validate_separator(df, ["r", "s", "i"]).first(), keys.validate_separator(df, ["r", "s", "i"], "S").first()
    assert good.is_valid and good.n_conflicts == 0 and good.conflicting_values == []
    assert not bad.is_valid and bad.conflicting_values == ["S1", "S2", "S3", "US"] and "'-'" in bad.message


def test_metrics(spark):
    df = spark.createDataFrame([("A", i, float(v), float(f), float(v)) for i, (v, f) in enumerate([(10, 12), (20, 18), (30, 33)])] + [("A", 9, None, 1.0, 1.0), ("A", 10, math.nan, 1.0, 1.0)], "id string, ds int, y double, f double, b double").drop("b")
    one = lambda d: d.first()[-1]
    assert one(metrics.mae_by(df, "ds", "y", "f")) == pytest.approx(7 / 3)
    assert one(metrics.rmse_by(df, "ds", "y", "f")) == pytest.approx(math.sqrt(17 / 3))
    assert one(metrics.bias_by(df, "ds", "y", "f")) == pytest.approx(1.0)
    z = spark.createDataFrame([([10.0, 20.0, 30.0, None], [12.0, 18.0, 33.0, 1.0], [1.0])], "a array<double>, f array<double>, s array<double>")
    got = z.select(metrics.array_mae("a", "f"), metrics.array_r2("a", "f"), metrics.array_mae("a", "s"), metrics.array_coverage("a", "f", "f")).first()
    assert got[0] == pytest.approx(7 / 3) and got[1] == pytest.approx(1 - 17 / 200) and got[2] is None and got[3] == 0
