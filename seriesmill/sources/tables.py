"""Readers of the tables that the queries use, and series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import series


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_name(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A table or view by its name, or the DataFrame itself."""
    return source if isinstance(source, DataFrame) else spark.table(source)


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A file or folder as parquet, csv or json, by its suffix if no kind is given. Any URI that Spark knows will do."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True)).option("inferSchema", options.get("inferSchema", True))
    return reader.format({"pq": "parquet", "jsonl": "json", "ndjson": "json"}.get(kind, kind)).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ds, y: value of the events of each type by day."""
    e = parquet(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("id"), F.to_date("ts").alias("ds")).agg(F.round(F.sum("value"), 4).alias("y"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ds, y: value of each user's events by day, with gaps; a fifth of the values are null and a fifth zero."""
    e = parquet(spark, sf_dir, "events")
    k = F.min("event_id") % 5
    return e.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("ds")).agg(F.when(k == 0, None).when(k == 1, 0.0).otherwise(F.round(F.sum("value"), 4)).alias("y"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ds, y: order value of each market segment by month."""
    o, c = parquet(spark, sf_dir, "orders"), parquet(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_mktsegment").alias("id"), F.trunc("o_orderdate", "MM").alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ds, y: quantity of each part by month, from the line items; months without any are missing. A part has few
    lines a month, so its lines are dealt out by part at once, and nothing that groups by part deals them out again."""
    li = parquet(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.trunc("l_shipdate", "MM").alias("ds"), "l_quantity")
    return series.spread(li, ["id"]).groupBy("id", "ds").agg(F.sum("l_quantity").alias("y"))


#: The same in DuckDB.
DAILY = "SELECT event_type AS id, CAST(ts AS DATE) AS ds, round(sum(value), 4) AS y FROM events GROUP BY 1, 2"
USERS = "SELECT user_id AS id, CAST(ts AS DATE) AS ds, CASE WHEN min(event_id) % 5 = 0 THEN NULL WHEN min(event_id) % 5 = 1 THEN 0.0 ELSE round(sum(value), 4) END AS y FROM events GROUP BY 1, 2"
MONTHLY = "SELECT c_mktsegment AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
DEMAND = "SELECT l_partkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2"
