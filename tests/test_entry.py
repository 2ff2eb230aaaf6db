import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "%.3f" % (v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_streaming(spark, tmp_path):
    from seriesmill.streaming import online

    rows = [("a", f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", float(i)) for i in range(12)]
    spark.createDataFrame(rows, "id string, t string, v double").selectExpr("id", "cast(t as timestamp) as t", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = online.windowed(stream, "id", "t", "v").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.y for r in spark.table("w").collect()) == [6.0, 22.0, 38.0]
    q = online.flag_changes(stream, "id", "t", "v").writeStream.format("memory").queryName("f").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("f").count() == 12


def test_forecast_one_writes_large_totals_as_its_sql(spark, tmp_path):
    values = (3.25, 0.0, 12345678.901, 20000000.0, -7654321000.25)
    rows = ", ".join(f"(timestamp'2024-01-0{i + 1} 05:00:00', 'view', {v}D)" for i, v in enumerate(values))
    for n in range(3, len(values) + 1):
        at = tmp_path / str(n)
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(ts, event_type, value)").orderBy("ts").limit(n).write.parquet(f"{at}/events.parquet")
        c = duckdb.connect()
        c.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
        got = entry.queries()["forecast_one"](spark, str(at))
        assert [tuple(r) for r in got.collect()] == c.execute(entry.oracle_sql()["forecast_one"]).fetchall()
