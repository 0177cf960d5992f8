"""Queries for gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gaps as G
from tidemark.operators import shape as S
from tidemark.plans.adapters import HOURS, hours, r6
from tidemark.plans.registry import query

HOLES = f"h AS (SELECT entity, ts, CASE WHEN hour(ts) % 7 <> 4 THEN flow END AS flow, CASE WHEN hour(ts) % 6 <> 3 THEN power END AS power, CASE WHEN hour(ts) % 3 <> 0 THEN dt END AS dt, CASE WHEN hour(ts) % 5 <> 2 THEN vl END AS vl, CASE WHEN hour(ts) % 4 <> 1 THEN rt END AS rt FROM ({HOURS}))"
FACTOR = "k AS (SELECT entity, CASE WHEN count(r) >= 50 THEN quantile_cont(r, 0.5) ELSE 0.001163 END AS k FROM (SELECT entity, CASE WHEN flow > 50 AND dt > 3 AND power > 0 THEN power / (flow * dt) END AS r FROM h) GROUP BY 1)"


def _holes(spark, sf):
    h = F.hour("ts")
    lack = {"flow": (7, 4), "power": (6, 3), "dt": (3, 0), "vl": (5, 2), "rt": (4, 1)}
    return hours(spark, sf).select("entity", "ts", *[F.when(h % m != r, F.col(c)).alias(c) for c, (m, r) in lack.items()])


@query("identity_factor", f"WITH {HOLES}, {FACTOR} SELECT entity, round(k, 9) AS factor FROM k")
def identity_factor(spark, sf):
    return G.identity_factor(_holes(spark, sf), "entity", "flow", "dt", "power").select("entity", F.round("factor", 9).alias("factor"))


@query("identity_fill", f"""WITH {HOLES}, {FACTOR}, a AS (SELECT h.* REPLACE (coalesce(dt, vl - rt) AS dt), k FROM h JOIN k USING (entity)), b AS (SELECT * REPLACE (coalesce(rt, vl - dt) AS rt) FROM a), c AS (SELECT * REPLACE (coalesce(vl, rt + dt) AS vl) FROM b), d AS (SELECT * REPLACE (coalesce(power, k * flow * dt) AS power) FROM c)
SELECT entity, ts, round(coalesce(flow, CASE WHEN dt > 0.5 THEN power / (k * dt) END), 5) AS flow, round(power + 0.00000013, 6) AS power, round(dt, 6) AS dt, round(vl, 6) AS vl, round(rt, 6) AS rt FROM d""")
def identity_fill(spark, sf):
    return G.identity_fill(_holes(spark, sf), "entity", "flow", "power", "dt", "vl", "rt").select("entity", "ts", F.round("flow", 5).alias("flow"), F.round(F.col("power") + 0.00000013, 6).alias("power"), *r6("dt", "vl", "rt"))


def _profile_sql(source: str, value: str, least: int) -> str:
    return f"""q AS (SELECT *, hour(ts) AS h, CASE WHEN t_out IS NULL THEN -1 ELSE CAST(t_out >= 0 AS INTEGER) + CAST(t_out >= 5 AS INTEGER) + CAST(t_out >= 10 AS INTEGER) + CAST(t_out >= 15 AS INTEGER) END AS c FROM {source}),
p1 AS (SELECT entity, h, c, avg({value}) AS p1 FROM q WHERE c >= 0 GROUP BY 1, 2, 3 HAVING count({value}) >= {least}), p2 AS (SELECT entity, h, avg({value}) AS p2 FROM q GROUP BY 1, 2 HAVING count({value}) >= {least}), p3 AS (SELECT entity, avg({value}) AS p3 FROM q GROUP BY 1),
p AS (SELECT q.*, coalesce(p1, p2, p3, (SELECT quantile_cont(p3, 0.5) FROM p3)) AS profile FROM q LEFT JOIN p1 USING (entity, h, c) LEFT JOIN p2 USING (entity, h) LEFT JOIN p3 USING (entity))"""


GAPPY = f"g AS (SELECT entity, ts, CASE WHEN day(ts) % 9 <> 0 THEN t_out END AS t_out, CASE WHEN entity <> 3 AND hour(ts) % 7 <> 4 THEN flow END AS flow FROM ({HOURS}))"


@query("hour_profile", f"WITH {GAPPY}, {_profile_sql('g', 'flow', 5)} SELECT entity, ts, round(profile, 6) AS profile FROM p")
def hour_profile(spark, sf):
    g = hours(spark, sf).select("entity", "ts", F.when(F.dayofmonth("ts") % 9 != 0, F.col("t_out")).alias("t_out"), F.when((F.col("entity") != 3) & (F.hour("ts") % 7 != 4), F.col("flow")).alias("flow"))
    return G.hour_profile(g, "entity", "ts", "t_out", "flow").select("entity", "ts", *r6("profile"))


GRIDDED = f"""b AS ({HOURS}), e AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM b GROUP BY 1), s AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e),
c AS (SELECT entity, ts, flow, sum(flow) OVER (PARTITION BY entity ORDER BY ts) * 1.1 - CASE WHEN day(ts) > 20 AND entity = 2 THEN 500000 ELSE 0 END AS total FROM b),
g AS (SELECT s.entity, s.ts, c.flow, CASE WHEN hour(s.ts) % 5 = 0 AND s.entity <> 4 THEN c.total END AS counter FROM s LEFT JOIN c USING (entity, ts))"""


def _gridded(spark, sf):
    from pyspark.sql import Window

    b = hours(spark, sf).select("entity", "ts", "flow")
    total = F.sum("flow").over(Window.partitionBy("entity").orderBy("ts")) * 1.1 - F.when((F.dayofmonth("ts") > 20) & (F.col("entity") == 2), 500000).otherwise(0)
    c = b.withColumn("total", total)
    return S.grid(c, "entity", "ts").select("entity", "ts", "flow", F.when((F.hour("ts") % 5 == 0) & (F.col("entity") != 4), F.col("total")).alias("counter"))


@query("counter_fill", f"""WITH {GRIDDED}, t AS (SELECT entity, quantile_cont(flow, 0.999) AS top FROM g GROUP BY 1), w AS (SELECT g.*, top, row_number() OVER o AS i, CASE WHEN row_number() OVER o = 1 THEN 0.0 ELSE greatest(coalesce((flow + lag(flow) OVER o) / 2, 0.0), 0.0) END AS w FROM g JOIN t USING (entity) WINDOW o AS (PARTITION BY entity ORDER BY ts)),
x AS (SELECT *, sum(w) OVER (PARTITION BY entity ORDER BY ts) AS s FROM w),
y AS (SELECT *, last_value(CASE WHEN counter IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(CASE WHEN counter IS NOT NULL THEN s END IGNORE NULLS) OVER p AS ps, last_value(counter IGNORE NULLS) OVER p AS pc, first_value(CASE WHEN counter IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(CASE WHEN counter IS NOT NULL THEN s END IGNORE NULLS) OVER f AS ns, first_value(counter IGNORE NULLS) OVER f AS nc FROM x
WINDOW p AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, ts, counter IS NULL AS filled, round(0.00000013 + CASE WHEN counter IS NOT NULL THEN counter WHEN pi IS NULL AND ni IS NULL THEN s WHEN pi IS NULL THEN nc - ns + s WHEN ni IS NULL THEN pc + s - ps WHEN nc - pc >= 0 AND nc - pc <= 2 * top * (ni - pi) THEN CASE WHEN ns - ps > 1e-6 THEN pc + (nc - pc) * (s - ps) / (ns - ps) ELSE pc + (nc - pc) * (i - pi) / (ni - pi) END ELSE pc + s - ps END, 6) AS counter FROM y""")
def counter_fill(spark, sf):
    return G.counter_fill(_gridded(spark, sf), "entity", "ts", "counter", "flow").select("entity", "ts", "filled", F.round(F.col("counter") + 0.00000013, 6).alias("counter"))


@query("rate_ratio", f"""WITH b AS ({HOURS}), c AS (SELECT entity, ts, flow, sum(flow) OVER (PARTITION BY entity ORDER BY ts) * (1 + entity * 0.2) AS counter FROM b), l AS (SELECT entity, counter - lag(counter) OVER o AS d, (flow + lag(flow) OVER o) / 2 AS t, epoch(ts) - epoch(lag(ts) OVER o) = 3600 AND counter >= lag(counter) OVER o AS ok FROM c WINDOW o AS (PARTITION BY entity ORDER BY ts)),
s AS (SELECT entity, count(*) FILTER (ok) AS pairs, sum(t) FILTER (ok) AS t, sum(d) FILTER (ok) AS d FROM l GROUP BY 1) SELECT entity, pairs, round(CASE WHEN pairs >= 3 AND d > 0 THEN least(greatest(t / d, 0.5), 2.0) ELSE 1.0 END, 6) AS ratio FROM s""")
def rate_ratio(spark, sf):
    from pyspark.sql import Window

    c = hours(spark, sf).withColumn("counter", F.sum("flow").over(Window.partitionBy("entity").orderBy("ts")) * (1 + F.col("entity") * 0.2))
    return G.rate_ratio(c, "entity", "ts", "flow", "counter", 3).select("entity", "pairs", *r6("ratio"))


@query("holdout_validation", f"""WITH b AS ({HOURS}), a AS (SELECT entity, ts, t_out, CASE WHEN hour(ts) % 6 = 1 THEN flow END AS truth, CASE WHEN hour(ts) % 6 <> 1 THEN flow END AS lft, epoch(ts) / 3600.0 AS x FROM b), {_profile_sql('a', 'lft', 5)},
n AS (SELECT *, last_value(CASE WHEN lft IS NOT NULL THEN x END IGNORE NULLS) OVER o AS px, last_value(lft IGNORE NULLS) OVER o AS py, first_value(CASE WHEN lft IS NOT NULL THEN x END IGNORE NULLS) OVER f AS nx, first_value(lft IGNORE NULLS) OVER f AS ny FROM p WINDOW o AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
m AS (SELECT 'linear' AS method, truth, py + (ny - py) * (x - px) / (nx - px) AS got FROM n WHERE truth IS NOT NULL UNION ALL SELECT 'profile', truth, profile FROM n WHERE truth IS NOT NULL)
SELECT method, count(*) AS n, round(avg(abs(got - truth)), 6) AS mae, round(abs(sum(got) - sum(truth)) / sum(truth), 6) AS relative_sum FROM m WHERE got IS NOT NULL GROUP BY 1""")
def holdout_validation(spark, sf):
    return G.holdout(hours(spark, sf), "entity", "ts", "t_out", "flow", F.hour("ts") % 6 == 1).select("method", "n", *r6("mae", "relative_sum"))
