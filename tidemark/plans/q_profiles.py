"""Queries for load steps, cooling, gap filling, adaptive windows, pairs of windows and status weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import profiles as P
from tidemark.operators import shape as S
from tidemark.plans.adapters import HOURLY, PANEL, POINTS, VISITS, hourly, panel, points, r6, readings, table, visits
from tidemark.plans.registry import query

NET = "h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS ts, avg(value) AS load, count(*) AS flow FROM events GROUP BY 1, 2)"


def _net(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("load"), F.count(F.lit(1)).alias("flow"))


AHEAD = ", ".join(f"CASE WHEN epoch(lead(ts, {i}) OVER w) - epoch(ts) = {i} * 3600 THEN lead(load, {i}) OVER w - lag(load) OVER w END AS a{i}" for i in range(1, 4))


@query("load_steps", f"WITH {NET}, s AS (SELECT entity, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) = 3600 THEN load - lag(load) OVER w END AS step, {AHEAD} FROM h WINDOW w AS (PARTITION BY entity ORDER BY ts)), g AS (SELECT *, greatest(abs(a1), abs(a2), abs(a3)) AS size, a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL AS complete FROM s WHERE step > 20) SELECT entity, ts, round(step, 6) AS step, CAST(CASE WHEN complete AND size >= 0.2 THEN CASE WHEN abs(a1) >= 0.63 * size THEN 1 WHEN abs(a2) >= 0.63 * size THEN 2 ELSE 3 END END AS INTEGER) AS response_h FROM g")
def load_steps(spark, sf):
    return P.load_steps(_net(spark, sf), "entity", "ts", "load", "load", 20.0, 3).select("entity", "ts", *r6("step"), "response_h")


@query("cooling_rate", f"WITH {NET}, f AS (SELECT entity, CASE WHEN epoch(lead(ts) OVER w) - epoch(ts) = 3600 AND flow <= 2 AND lead(flow) OVER w <= 2 AND load > 30 THEN load - lead(load) OVER w END AS fall FROM h WINDOW w AS (PARTITION BY entity ORDER BY ts)) SELECT entity, count(fall) AS n, round(CASE WHEN count(fall) >= 5 THEN quantile_cont(fall, 0.5) END, 6) AS rate FROM f GROUP BY 1")
def cooling_rate(spark, sf):
    return P.cooling(_net(spark, sf), "entity", "ts", "flow", "load", 2, 30.0, 5).select("entity", "n", *r6("rate"))


BAL = f"""WITH h AS ({HOURLY}), e AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1), s AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e), c AS (SELECT entity, ts, value AS rate, sum(value) OVER (PARTITION BY entity ORDER BY ts) + 2 * row_number() OVER (PARTITION BY entity ORDER BY ts) AS counter FROM h), g AS (SELECT s.entity, s.ts, rate, counter, row_number() OVER (PARTITION BY s.entity ORDER BY s.ts) AS i FROM s LEFT JOIN c USING (entity, ts)),
m AS (SELECT entity, avg(rate) AS m, max(rate) AS top FROM g GROUP BY 1), q AS (SELECT entity, hour(ts) AS h, avg(rate) AS hm FROM g GROUP BY 1, 2),
w AS (SELECT g.*, coalesce(hm, m) AS model, top, last_value(CASE WHEN rate IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(rate IGNORE NULLS) OVER p AS pv, last_value(counter IGNORE NULLS) OVER p AS pc, first_value(CASE WHEN rate IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(rate IGNORE NULLS) OVER n AS nv, first_value(counter IGNORE NULLS) OVER n AS nc FROM g JOIN m USING (entity) LEFT JOIN q ON q.entity = g.entity AND q.h = hour(g.ts) WINDOW p AS (PARTITION BY g.entity ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY g.entity ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, ni - pi - 1 AS gap, nc - pc - nv AS used, sum(CASE WHEN rate IS NULL THEN model END) OVER (PARTITION BY entity, pi) AS span FROM w),
y AS (SELECT *, CASE WHEN rate IS NOT NULL THEN 'measured' WHEN gap <= 3 THEN 'interpolated' WHEN used >= 0 AND used <= 2 * top * gap AND span > 0 THEN 'balanced' ELSE 'modelled' END AS source FROM x)
SELECT entity, ts, source, round(CASE source WHEN 'measured' THEN rate WHEN 'interpolated' THEN pv + (nv - pv) * (i - pi) / (ni - pi) WHEN 'balanced' THEN model * used / span ELSE model END, 5) AS rate FROM y"""


@query("balanced_gap_fill", BAL)
def balanced_gap_fill(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("ts")
    c = hourly(spark, sf).select("entity", "ts", F.col("value").alias("rate"), (F.sum("value").over(w) + 2 * F.row_number().over(w)).alias("counter"))
    return P.balanced_fill(S.grid(c, "entity", "ts"), "entity", "ts", "rate", "counter").select("entity", "ts", "source", F.round("rate", 5).alias("rate"))


@query("adaptive_windows", f"""WITH p AS ({POINTS}), e AS (SELECT entity, min(day) AS a, max(day) AS b FROM p GROUP BY 1), g AS (SELECT entity, a, CAST(unnest(generate_series(a, b, INTERVAL 28 DAY)) AS DATE) AS d FROM e), w AS (SELECT unnest(generate_series(14, 60)) AS width),
c AS (SELECT g.entity, g.d, w.width, count(p.power) AS n, regr_slope(p.flow, p.power) AS slope FROM g CROSS JOIN w LEFT JOIN p ON p.entity = g.entity AND p.day <= g.d AND p.day > g.d - CAST(w.width AS INTEGER) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, d ORDER BY CASE WHEN n >= 20 THEN 0 ELSE 1 END, CASE WHEN n >= 20 THEN width ELSE -width END) AS rn FROM c)
SELECT entity, d AS window_end, CAST(width AS INTEGER) AS width, n, round(CASE WHEN n >= 20 THEN slope END, 5) AS slope FROM r WHERE rn = 1""")
def adaptive_windows(spark, sf):
    out = P.adaptive_windows(points(spark, sf), "entity", "day", "power", "flow", step=28, least=20)
    return out.select("entity", "window_end", "width", "n", F.round("slope", 5).alias("slope"))


PAIRS = f"v AS ({VISITS}), s AS (SELECT v.entity, v.day AS visit, avg(energy) FILTER (p.day BETWEEN v.day + 1 AND v.day + 90) AS a, avg(energy) FILTER (p.day BETWEEN v.day - 364 AND v.day - 275) AS b FROM v LEFT JOIN ({PANEL}) p ON p.entity = v.entity GROUP BY 1, 2)"


def _pairs(spark, sf):
    return P.calendar_pairs(panel(spark, sf), visits(spark, sf), "entity", "day", {"energy": F.avg("energy")})


@query("same_calendar_pairs", f"WITH {PAIRS} SELECT entity, visit, round(b, 6) AS energy_before, round(a, 6) AS energy_after, round(a - b, 6) AS energy_change FROM s")
def same_calendar_pairs(spark, sf):
    return _pairs(spark, sf).select("entity", "visit", *r6("energy_before", "energy_after", "energy_change"))


@query("transition_table", f"WITH {PAIRS} SELECT count(*) FILTER (b <= 28 AND a <= 28) AS good_good, count(*) FILTER (b <= 28 AND a > 28) AS good_bad, count(*) FILTER (b > 28 AND a <= 28) AS bad_good, count(*) FILTER (b > 28 AND a > 28) AS bad_bad FROM s")
def transition_table(spark, sf):
    return P.transitions(_pairs(spark, sf), F.col("energy_before") > 28, F.col("energy_after") > 28)


@query("ternary_shares", f"WITH p AS ({POINTS}), q AS (SELECT entity, quantile_cont(power, 0.95) AS a, quantile_cont(flow, 0.95) AS b, quantile_cont(spread, 0.95) AS c FROM p GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, least(greatest(power / a, 0), 1) AS a, least(greatest(flow / b, 0), 1) AS b, least(greatest(spread / c, 0), 1) AS c FROM p JOIN q USING (entity)) SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 6) AS share_power, round(b / (a + b + c), 6) AS share_flow, round(c / (a + b + c), 6) AS share_spread FROM x")
def ternary_shares(spark, sf):
    return P.ternary(points(spark, sf), "entity", ("power", "flow", "spread")).select("l_orderkey", "l_linenumber", *r6("share_power", "share_flow", "share_spread"))


@query("week_status", f"WITH k AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem), INTERVAL 7 DAY)) AS DATE) AS week), o AS (SELECT DISTINCT entity, day FROM ({PANEL})), h AS (SELECT entity, day, CASE WHEN volume > 60 THEN 1 ELSE -1 END AS direction FROM ({PANEL}) WHERE energy > 60), e AS (SELECT DISTINCT entity FROM o) SELECT e.entity, k.week, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.entity = e.entity AND direction = 1 AND h.day BETWEEN k.week - 27 AND k.week) THEN 'worse' WHEN EXISTS (SELECT 1 FROM h WHERE h.entity = e.entity AND h.day BETWEEN k.week - 27 AND k.week) THEN 'better' WHEN EXISTS (SELECT 1 FROM o WHERE o.entity = e.entity AND o.day BETWEEN k.week - 27 AND k.week) THEN 'watched' ELSE 'no_data' END AS status FROM e, k")
def week_status(spark, sf):
    p = panel(spark, sf)
    weeks = p.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 7 days"))).alias("week"))
    a = p.where("energy > 60").select("entity", "day", F.when(F.col("volume") > 60, 1).otherwise(-1).alias("direction"))
    return P.week_status(a, p, "entity", "day", "direction", weeks)


@query("complete_days", "WITH h AS (SELECT event_type AS entity, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2, 3), d AS (SELECT entity, day, round(sum(v), 6) AS total, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) = 24) SELECT entity, day, total, coalesce(day - lag(day, 2) OVER (PARTITION BY entity ORDER BY day) = 2, false) AS has_history FROM d")
def complete_days(spark, sf):
    d = P.complete_days(_net(spark, sf), "entity", "ts", "load", 2)
    return d.select("entity", "day", F.round(F.aggregate("hours", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "has_history")


@query("nearest_vertex", "WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 100) * 10.0 AS x, (s_suppkey * 53 % 100) * 10.0 AS y FROM supplier), g AS (SELECT p_partkey AS vertex, (p_partkey * 71 % 97) * 10.3 AS x, (p_partkey * 29 % 89) * 11.2 AS y FROM part), m AS (SELECT p.k, g.vertex, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS d FROM p CROSS JOIN g), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d, 6), vertex) AS rn FROM m) SELECT p.k, round(d, 6) AS distance FROM p LEFT JOIN b ON b.k = p.k AND rn = 1")
def nearest_vertex(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37 % 100) * 10.0).alias("x"), ((F.col("s_suppkey") * 53 % 100) * 10.0).alias("y"))
    g = table(spark, sf, "part").select(F.col("p_partkey").alias("vertex"), ((F.col("p_partkey") * 71 % 97) * 10.3).alias("x"), ((F.col("p_partkey") * 29 % 89) * 11.2).alias("y"))
    return P.nearest_point(p, g, "k", "x", "y", 10.0).select("k", *r6("distance"))


@query("cell_join", "SELECT floor(s_acctbal / 100) * 100 + 50 AS cell, count(*) AS n FROM supplier GROUP BY 1")
def cell_join(spark, sf):
    return table(spark, sf, "supplier").groupBy((F.floor(F.col("s_acctbal") / 100) * 100 + F.lit(50)).cast("double").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
