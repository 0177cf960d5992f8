"""Queries for seasons, splits, picks, compact encodings and injected faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.functions import text as T
from tidemark.operators import seasons as N
from tidemark.plans.adapters import DAILY, PANEL, POINTS, VISITS, daily, panel, points, r6, readings, table, visits
from tidemark.plans.q_stats import WINTER
from tidemark.plans.registry import query


@query("latest_season", f"WITH {WINTER}, s AS (SELECT winter AS season, count(*) AS entities FROM k WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 3) SELECT season, entities FROM s ORDER BY CAST(string_split(season, '/')[2] AS INTEGER) DESC LIMIT 1")
def latest_season(spark, sf):
    return N.latest_season(points(spark, sf), "entity", X.winter_label("day"), 5, 3)


@query("coldest_february", f"WITH d AS (SELECT day, avg(t) AS t FROM ({POINTS}) GROUP BY 1), s AS (SELECT DISTINCT day - CAST(k AS INTEGER) AS start FROM d, range(0, 14) r(k)), w AS (SELECT CAST(start AS DATE) AS start, avg(t) AS mean, count(*) AS n FROM s JOIN d ON d.day BETWEEN s.start AND s.start + 13 WHERE month(start) = 2 AND month(start + 13) = 2 GROUP BY 1 HAVING count(*) >= 11.2) SELECT CAST(year(start) AS INTEGER) AS year, round(min(mean), 6) AS mean FROM w GROUP BY 1")
def coldest_february(spark, sf):
    return N.coldest_window(points(spark, sf), "day", "t", 14).select("year", *r6("mean"))


@query("nearest_values", f"WITH c AS ({VISITS}), d AS (SELECT c.entity, c.day AS case_day, energy, p.day - c.day AS o, row_number() OVER (PARTITION BY c.entity, c.day, sign(p.day - c.day) ORDER BY abs(p.day - c.day)) AS r FROM c JOIN ({PANEL}) p ON p.entity = c.entity AND p.day <> c.day AND abs(p.day - c.day) <= 365), g AS (SELECT entity, case_day, CASE WHEN count(*) FILTER (o < 0) >= 5 THEN quantile_cont(energy, 0.5) FILTER (o < 0) END AS b, CASE WHEN count(*) FILTER (o > 0) >= 5 THEN quantile_cont(energy, 0.5) FILTER (o > 0) END AS a FROM d WHERE r <= 30 GROUP BY 1, 2) SELECT c.entity, c.day AS case_day, round(b, 6) AS before, round(a, 6) AS after FROM c LEFT JOIN g ON g.entity = c.entity AND g.case_day = c.day")
def nearest_values(spark, sf):
    return N.nearest_values(panel(spark, sf), visits(spark, sf), "entity", "day", "energy", 30).select("entity", "case_day", *r6("before", "after"))


@query("main_channel", "WITH d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_type, sum(value) AS total FROM events GROUP BY 1, 2, 3), r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS p FROM d) SELECT entity, day, event_type, round(total, 6) AS total FROM r WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, day ORDER BY p) = 1")
def main_channel(spark, sf):
    d = readings(spark, sf).groupBy("entity", F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("total"))
    return N.main_channel(d, ["entity", "day"], "event_type", ["purchase", "click", "view"]).select("entity", "day", "event_type", *r6("total"))


@query("watched_string", f"WITH d AS ({DAILY}), k AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), e AS (SELECT DISTINCT entity FROM d WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') SELECT e.entity, string_agg(CASE WHEN d.entity IS NULL THEN '0' ELSE '1' END, '' ORDER BY k.day) AS code FROM e CROSS JOIN k LEFT JOIN d ON d.entity = e.entity AND d.day = k.day GROUP BY 1")
def watched_string(spark, sf):
    return N.watched_string(daily(spark, sf), "entity", "day", "2024-01-01", 30)


@query("split_weeks", f"SELECT CASE WHEN day > DATE '2000-01-01' THEN 'test' WHEN CAST('0x' || substr(md5(CAST(CAST(floor((day - DATE '1970-01-05') / 7.0) AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 THEN 'validation' ELSE 'training' END AS part, count(*) AS n FROM ({PANEL}) GROUP BY 1")
def split_weeks(spark, sf):
    return N.split_weeks(panel(spark, sf), "entity", "day", "2000-01-01").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_by_quantile", f"WITH p AS ({POINTS}), q AS (SELECT entity, quantile_cont(power, 0.95) AS a, quantile_cont(flow, 0.95) AS b FROM p GROUP BY 1) SELECT l_orderkey, l_linenumber, round(power / a, 9) AS power, round(flow / b, 9) AS flow FROM p JOIN q USING (entity)")
def normalize_by_quantile(spark, sf):
    return N.normalize_by_quantile(points(spark, sf), "entity", ["power", "flow"]).select("l_orderkey", "l_linenumber", F.round("power", 9).alias("power"), F.round("flow", 9).alias("flow"))


@query("inject_fault", f"WITH p AS (SELECT entity, day, energy, sum(energy) OVER (PARTITION BY entity ORDER BY day) AS counter, day - DATE '1998-06-01' AS n FROM ({PANEL})), a AS (SELECT *, CASE WHEN n BETWEEN 0 AND 29 THEN 6.0 * (n + 1) / 30.0 ELSE 0 END AS add_ FROM p) SELECT entity, day, round(energy + add_, 6) AS energy, round(counter + sum(add_) OVER (PARTITION BY entity ORDER BY day), 6) AS counter, n BETWEEN 0 AND 29 AS faulty FROM a")
def inject_fault(spark, sf):
    p = panel(spark, sf).withColumn("counter", F.sum("energy").over(Window.partitionBy("entity").orderBy("day")))
    return N.inject_fault(p, "entity", "day", "energy", "counter", F.lit("1998-06-01").cast("date"), "ramp", 6.0, 30).select("entity", "day", *r6("energy", "counter"), "faulty")


@query("temperature_coverage", f"SELECT flag, count(*) AS n, round(quantile_cont(spread, 0.1), 6) AS q10, round(quantile_cont(spread, 0.5), 6) AS q50, round(quantile_cont(spread, 0.9), 6) AS q90, count(*) FILTER (abs(spread - 4) <= 2) AS near FROM ({POINTS}) GROUP BY 1")
def temperature_coverage(spark, sf):
    return N.coverage(points(spark, sf), "flag", "spread", 4.0).select("flag", "n", *r6("q10", "q50", "q90"), "near")


@query("share_at_cap", "WITH l AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, arg_max(value, ts) AS v FROM events GROUP BY 1, 2) SELECT entity, round(avg(CASE WHEN v >= 60 THEN 1.0 ELSE 0 END), 6) AS share FROM l GROUP BY 1")
def share_at_cap(spark, sf):
    return N.share_at_cap(readings(spark, sf), "entity", "ts", "value", 60.0).select("entity", *r6("share"))


@query("readable_numbers", "SELECT event_id, replace(CAST(CAST(round(CAST(value AS DECIMAL(18, 6)), 1) AS DECIMAL(18, 1)) AS VARCHAR), '.', ',') AS shown FROM events")
def readable_numbers(spark, sf):
    """One digit behind the comma; ties, as decimals, are rounded away from 0."""
    return table(spark, sf, "events").select("event_id", T.decimal_comma("value").alias("shown"))


@query("alarms_per_year", f"WITH p AS ({PANEL}), a AS (SELECT entity, count(*) AS alarms FROM p WHERE energy > 80 GROUP BY 1), o AS (SELECT entity, max(day) - min(day) + 1 AS span FROM p GROUP BY 1) SELECT entity, coalesce(alarms, 0) AS alarms, round(coalesce(alarms, 0) * 365.25 / span, 6) AS per_year FROM o LEFT JOIN a USING (entity)")
def alarms_per_year(spark, sf):
    p = panel(spark, sf)
    a = p.where("energy > 80").groupBy("entity").agg(F.count(F.lit(1)).alias("alarms"))
    o = p.groupBy("entity").agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("span"))
    n = F.coalesce("alarms", F.lit(0))
    return o.join(a, "entity", "left").select("entity", n.alias("alarms"), F.round(n * 365.25 / F.col("span"), 6).alias("per_year"))
