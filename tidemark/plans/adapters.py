"""The driver's tables read as entity time series, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("entity"), "ts", "event_type", "value")


READINGS = "SELECT event_id, user_id AS entity, ts, event_type, value FROM events"


def hourly(spark, sf) -> DataFrame:
    """One row per entity and hour: mean value and count."""
    return readings(spark, sf).groupBy("entity", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


HOURLY = "SELECT user_id AS entity, date_trunc('hour', ts) AS ts, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2"


def daily(spark, sf) -> DataFrame:
    """One row per entity and day with rows: count, mean, sum, maximum and the mean of clicks."""
    return readings(spark, sf).groupBy("entity", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_v"), F.sum("value").alias("sum_v"), F.max("value").alias("max_v"),
    )


DAILY = "SELECT user_id AS entity, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mean_v, sum(value) AS sum_v, max(value) AS max_v FROM events GROUP BY 1, 2"


def points(spark, sf) -> DataFrame:
    """Operating points: supplier by ship day; power is quantity, flow is price in thousands, spread the tax in percent."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("power"), (F.col("l_extendedprice") / 1000).alias("flow"),
        (F.col("l_tax") * 100).alias("spread"), F.col("l_discount").alias("t"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber",
    )


POINTS = "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, l_quantity AS power, l_extendedprice / 1000 AS flow, l_tax * 100 AS spread, l_discount AS t, l_returnflag AS flag, l_linestatus AS status, l_orderkey, l_linenumber FROM lineitem"


def panel(spark, sf) -> DataFrame:
    """Entity x day panel of points: energy, volume and mean conditions."""
    return points(spark, sf).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("power").alias("energy"), F.sum("flow").alias("volume"), F.avg("spread").alias("spread"), F.avg("t").alias("t"), F.avg("power").alias("power"))


PANEL = f"SELECT entity, day, count(*) AS n, sum(power) AS energy, sum(flow) AS volume, avg(spread) AS spread, avg(t) AS t, avg(power) AS power FROM ({POINTS}) GROUP BY 1, 2"


def visits(spark, sf) -> DataFrame:
    """Interventions: an entity's orders on the first of a month (customers folded onto suppliers' keys)."""
    s = table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 1)
    return s.select((F.col("o_custkey") % 100 + 1).alias("entity"), F.to_date("o_orderdate").alias("day")).distinct()


VISITS = "SELECT DISTINCT o_custkey % 100 + 1 AS entity, CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) = 1"


def r6(*columns: str):
    """Columns rounded to 6 digits under their own names."""
    return [F.round(c, 6).alias(c) for c in columns]


#: Channels of ten entities by hour: supply, return and spread in degrees, flow, power and outdoor temperature, all from the readings.
HOURS = "SELECT entity, ts, n, v, 60.0 + n AS vl, 30.0 + v * 0.2 AS rt, 30.0 + n - v * 0.2 AS dt, 60.0 + v * 5 AS flow, (60.0 + v * 5) * (30.0 + n - v * 0.2) * 0.00116 AS power, CAST((CAST(ts AS DATE) - DATE '2024-01-01') % 23 - 4 AS DOUBLE) AS t_out FROM (SELECT user_id % 10 AS entity, date_trunc('hour', ts) AS ts, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2)"


def hours(spark, sf) -> DataFrame:
    h = readings(spark, sf).groupBy((F.col("entity") % 10).alias("entity"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    h = h.withColumns({"vl": 60.0 + F.col("n"), "rt": 30.0 + F.col("v") * 0.2, "dt": 30.0 + F.col("n") - F.col("v") * 0.2, "flow": 60.0 + F.col("v") * 5})
    return h.withColumn("power", F.col("flow") * F.col("dt") * 0.00116).withColumn("t_out", (F.datediff("ts", F.lit("2024-01-01").cast("date")) % 23 - 4).cast("double"))
