"""Queries for sources and time-series shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.operators import shape as S
from tidemark.plans.adapters import DAILY, HOURLY, PANEL, POINTS, READINGS, daily, hourly, panel, points, r6, readings
from tidemark.plans.registry import query


@query("dedup_priority", f"""WITH r AS ({READINGS}), g AS (SELECT 0 AS gen, entity, date_trunc('hour', ts) AS ts, value, event_id FROM r WHERE event_id % 3 <> 0 UNION ALL SELECT 1, entity, date_trunc('hour', ts), value, event_id FROM r WHERE event_id % 2 = 0)
SELECT entity, ts, round(value, 6) AS value, event_id FROM g QUALIFY row_number() OVER (PARTITION BY entity, ts ORDER BY gen DESC, event_id DESC) = 1""")
def dedup_priority(spark, sf):
    r = readings(spark, sf).select("entity", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    old, new = r.where("event_id % 3 <> 0"), r.where("event_id % 2 = 0")
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    return S.keep_first(both, ["entity", "ts"], F.desc("gen"), F.desc("event_id")).select("entity", "ts", *r6("value"), "event_id")


@query("merge_generations", f"""WITH r AS (SELECT entity, ts, avg(value) AS value FROM ({READINGS}) GROUP BY 1, 2), g AS (SELECT 0 AS gen, * FROM r WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT 1, entity, ts, value + 1000 FROM r WHERE ts >= TIMESTAMP '2024-01-10')
SELECT entity, ts, round(value, 6) AS value FROM g QUALIFY row_number() OVER (PARTITION BY entity, ts ORDER BY gen DESC) = 1""")
def merge_generations(spark, sf):
    r = readings(spark, sf).groupBy("entity", "ts").agg(F.avg("value").alias("value"))
    old = r.where("ts < timestamp_ntz'2024-01-20'")
    new = r.where("ts >= timestamp_ntz'2024-01-10'").withColumn("value", F.col("value") + 1000)
    return S.merge_generations([old, new], ["entity", "ts"]).select("entity", "ts", *r6("value"))


@query("plausibility_mask", "SELECT event_id, CASE WHEN value BETWEEN 5 AND 120 THEN value END AS value FROM events")
def plausibility_mask(spark, sf):
    return S.mask_outside(readings(spark, sf), {"value": (5.0, 120.0)}).select("event_id", "value")


@query("derive_spread", f"SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN spread END, power - flow), 6) AS spread FROM ({POINTS})")
def derive_spread(spark, sf):
    p = points(spark, sf).withColumn("spread", F.when(F.col("l_linenumber") % 2 == 0, F.col("spread")))
    return S.derive_spread(p, "spread", "power", "flow").select("l_orderkey", "l_linenumber", *r6("spread"))


@query("scale_factor", f"""WITH p AS (SELECT entity, power * 1000 AS flow, (flow + 2) * 100 AS spread, power * 1000 * (flow + 2) * 100 / 859.845 / 100 * (1 + t) AS power FROM ({POINTS})), c AS (SELECT *, unnest([1, 10, 100, 1000]) AS factor FROM p),
e AS (SELECT entity, factor, CASE WHEN flow / factor > 50 AND power / factor > 0.2 AND spread / factor > 1 THEN abs(flow / factor * (spread / factor) / 859.845 - power / factor) / (power / factor) END AS e FROM c)
SELECT entity, factor, round(quantile_cont(e, 0.5), 6) AS error, count(e) AS n FROM e GROUP BY 1, 2 HAVING quantile_cont(e, 0.5) <= 0.1 AND count(e) >= 20""")
def scale_factor(spark, sf):
    p = points(spark, sf)
    f, s = F.col("power") * 1000, (F.col("flow") + 2) * 100
    p = p.select("entity", f.alias("flow"), s.alias("spread"), (f * s / 859.845 / 100 * (1 + F.col("t"))).alias("power"))
    return S.scale_factor(p, "entity", "flow", "spread", "power", least=20).select("entity", "factor", *r6("error"), "n")


@query("inventory", f"SELECT entity, count(*) AS n_rows, min(ts) AS ts_min, max(ts) AS ts_max, count(DISTINCT event_type) AS n_files FROM ({READINGS}) GROUP BY 1")
def inventory(spark, sf):
    return readings(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.countDistinct("event_type").alias("n_files"))


@query("overlap_reconciliation", f"""WITH d AS ({DAILY}), a AS (SELECT * FROM d WHERE day < DATE '2024-01-20'), b AS (SELECT entity, day, mean_v + 0.05 * (entity % 3) AS mean_v, sum_v * 1.01 AS sum_v FROM d WHERE day >= DATE '2024-01-10'),
j AS (SELECT 'mean_v' AS channel, a.mean_v AS x, b.mean_v AS y FROM a JOIN b USING (entity, day) UNION ALL SELECT 'sum_v', a.sum_v, b.sum_v FROM a JOIN b USING (entity, day))
SELECT channel, count(*) AS n, round(avg(CASE WHEN abs(x - y) <= 0.051 THEN 1.0 ELSE 0 END), 6) AS share_equal, round(max(abs(x - y)), 6) AS max_diff, round(corr(x, y), 6) AS corr FROM j GROUP BY 1""")
def overlap_reconciliation(spark, sf):
    d = daily(spark, sf)
    a = d.where("day < date'2024-01-20'")
    b = d.where("day >= date'2024-01-10'").withColumns({"mean_v": F.col("mean_v") + 0.05 * (F.col("entity") % 3), "sum_v": F.col("sum_v") * 1.01})
    return S.overlap(a, b, ["entity", "day"], ["mean_v", "sum_v"]).select("channel", "n", *r6("share_equal", "max_diff", "corr"))


@query("long_series", f"WITH e AS (SELECT entity, max(CAST(ts AS DATE)) AS last_day FROM ({READINGS}) GROUP BY 1), m AS (SELECT quantile_cont(date_diff('day', DATE '2024-01-01', last_day), 0.5) AS med FROM e) SELECT entity, last_day, date_diff('day', DATE '2024-01-01', last_day) > med AS long_series FROM e, m")
def long_series(spark, sf):
    e = readings(spark, sf).groupBy("entity").agg(F.max(F.to_date("ts")).alias("last_day"))
    e = e.withColumn("d", F.datediff("last_day", F.lit("2024-01-01").cast("date")))
    return e.crossJoin(F.broadcast(e.agg(F.percentile("d", F.lit(0.5)).alias("med")))).select("entity", "last_day", (F.col("d") > F.col("med")).alias("long_series"))


GRID = f"""h AS ({HOURLY}), e AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1), s AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e), g AS (SELECT s.entity, s.ts, h.value, h.n FROM s LEFT JOIN h USING (entity, ts))"""


@query("hourly_grid", f"WITH {GRID} SELECT entity, ts, round(value, 6) AS value FROM g")
def hourly_grid(spark, sf):
    return S.grid(hourly(spark, sf), "entity", "ts").select("entity", "ts", *r6("value"))


@query("interpolate_short_gaps", f"""WITH {GRID}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM g),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(value IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni, first_value(value IGNORE NULLS) OVER q AS nv FROM i
WINDOW p AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN ni - pi - 1 <= 6 THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS value, value IS NULL AND coalesce(ni - pi - 1 <= 6, false) AS interpolated FROM w""")
def interpolate_short_gaps(spark, sf):
    return S.interpolate_short(S.grid(hourly(spark, sf), "entity", "ts"), "entity", "ts", "value", 6).select("entity", "ts", *r6("value"), "interpolated")


@query("raster_segments", f"""WITH d AS ({DAILY}), e AS (SELECT entity, min(day) AS a, max(day) AS b FROM d GROUP BY 1), s AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
g AS (SELECT s.entity, s.day, CASE WHEN coalesce(n, 0) >= 4 THEN 'dense' WHEN coalesce(n, 0) > 0 THEN 'sparse' ELSE 'gap' END AS state FROM s LEFT JOIN d USING (entity, day)),
c AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY entity ORDER BY day) THEN 0 ELSE 1 END AS new FROM g), r AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY day) AS seg FROM c)
SELECT entity, state, min(day) AS seg_start, max(day) AS seg_end, count(*) AS n FROM r GROUP BY entity, seg, state""")
def raster_segments(spark, sf):
    g = S.grid(daily(spark, sf), "entity", "day", "interval 1 day")
    n = F.coalesce("n", F.lit(0))
    return S.segments(g, "entity", "day", F.when(n >= 4, "dense").when(n > 0, "sparse").otherwise("gap"))


@query("runs_of_flags", f"""WITH d AS ({DAILY}), h AS (SELECT * FROM d WHERE mean_v > 50), c AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY entity ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM h), r AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY day) AS seg FROM c)
SELECT entity, min(day) AS run_start, max(day) AS run_end, count(*) AS n FROM r GROUP BY entity, seg""")
def runs_of_flags(spark, sf):
    return S.runs(daily(spark, sf), "entity", "day", F.col("mean_v") > 50, 24.0)


COUNTER = f"h AS (SELECT entity, ts, value, CASE WHEN n % 2 = 0 OR hour(ts) < 2 THEN sum(value) OVER (PARTITION BY entity ORDER BY ts) END AS counter FROM ({HOURLY}))"


def _counter(spark, sf):
    from pyspark.sql import Window

    run = F.sum("value").over(Window.partitionBy("entity").orderBy("ts"))
    return hourly(spark, sf).select("entity", "ts", "value", F.when((F.col("n") % 2 == 0) | (F.hour("ts") < 2), run).alias("counter"))


@query("integrate_counter", f"""WITH {COUNTER}, l AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 3600000000.0 AS hours, count(counter) OVER (PARTITION BY entity ORDER BY ts) AS seg FROM h WINDOW w AS (PARTITION BY entity ORDER BY ts)),
a AS (SELECT *, first_value(counter) OVER (PARTITION BY entity, seg ORDER BY ts) AS anchor, sum(CASE WHEN counter IS NULL AND hours > 0 AND hours <= 2 THEN greatest(value, 0) * hours ELSE 0 END) OVER (PARTITION BY entity, seg ORDER BY ts) AS s FROM l)
SELECT entity, ts, round(coalesce(counter, anchor + s), 6) AS counter, counter IS NULL AND anchor IS NOT NULL AS filled FROM a""")
def integrate_counter(spark, sf):
    return S.integrate_counter(_counter(spark, sf), "entity", "ts", "counter", "value").select("entity", "ts", *r6("counter"), "filled")


@query("valid_step_diff", f"""WITH h AS ({HOURLY}), l AS (SELECT entity, ts, value - lag(value) OVER w AS d, date_diff('microsecond', lag(ts) OVER w, ts) / 3600000000.0 AS hours FROM h WINDOW w AS (PARTITION BY entity ORDER BY ts))
SELECT entity, ts, round(CASE WHEN hours > 0 AND hours <= 12 AND d >= 0 AND d <= 60 THEN d END, 6) AS step FROM l""")
def valid_step_diff(spark, sf):
    return S.valid_step(hourly(spark, sf), "entity", "ts", "value", 12.0, 60.0).select("entity", "ts", *r6("step"))


ASOF = f"""{COUNTER}, e AS (SELECT entity, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) + 1 AS b FROM h WHERE counter IS NOT NULL GROUP BY 1), m AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS TIMESTAMP) AS ts FROM e),
j AS (SELECT m.entity, m.ts, h.counter, h.ts AS matched_ts, row_number() OVER (PARTITION BY m.entity, m.ts ORDER BY abs(epoch(h.ts) - epoch(m.ts)), h.ts) AS rn FROM m LEFT JOIN h ON h.entity = m.entity AND h.counter IS NOT NULL AND abs(epoch(h.ts) - epoch(m.ts)) <= 6 * 3600), n AS (SELECT * FROM j WHERE rn = 1)"""


@query("counter_midnight_asof", f"WITH {ASOF} SELECT entity, ts, round(counter, 6) AS counter, matched_ts FROM n")
def counter_midnight_asof(spark, sf):
    c = _counter(spark, sf).where("counter is not null")
    ends = c.groupBy("entity").agg(F.min(F.to_date("ts")).alias("a"), F.date_add(F.max(F.to_date("ts")), 1).alias("b"))
    mid = ends.select("entity", F.explode(F.sequence(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"), F.expr("interval 1 day"))).alias("ts"))
    return S.asof_nearest(mid, c, "entity", "ts", "counter", 6.0).select("entity", "ts", *r6("counter"), "matched_ts")


@query("midnight_difference", f"""WITH {ASOF}, d AS (SELECT entity, ts, (lead(counter) OVER w - counter) AS d, (epoch(lead(matched_ts) OVER w) - epoch(matched_ts)) / 3600.0 AS span FROM n WINDOW w AS (PARTITION BY entity ORDER BY ts))
SELECT entity, CAST(ts AS DATE) AS day, round(CASE WHEN span > 0 THEN d * 24.0 / span END, 6) AS delta FROM d""")
def midnight_difference(spark, sf):
    return S.midnight_difference(_counter(spark, sf).where("counter is not null"), "entity", "ts", "counter", 6.0).select("entity", "day", *r6("delta"))


def _windows_sql(days: int, step: int) -> str:
    return f"""WITH r AS ({READINGS}), f AS (SELECT entity, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM r GROUP BY 1), k AS (SELECT entity, a, unnest(range(0, CAST(floor((b - a) / {step}.0) AS BIGINT) + 1)) AS k FROM f)
SELECT k.entity, CAST(a + CAST(k.k * {step} AS INTEGER) AS DATE) AS window_start, count(r.value) AS n, round(avg(r.value), 6) AS mean_v, count(r.value) < 5 AS low_coverage FROM k LEFT JOIN r ON r.entity = k.entity AND CAST(r.ts AS DATE) >= a + CAST(k.k * {step} AS INTEGER) AND CAST(r.ts AS DATE) < a + CAST(k.k * {step} + {days} AS INTEGER) GROUP BY 1, 2"""


@query("tumbling_windows", _windows_sql(7, 7))
def tumbling_windows(spark, sf):
    return S.windows(readings(spark, sf), "entity", "ts", 7, 7, [F.avg("value").alias("mean_v")], 5).select("entity", "window_start", "n", *r6("mean_v"), "low_coverage")


@query("sliding_windows", _windows_sql(7, 3))
def sliding_windows(spark, sf):
    return S.windows(readings(spark, sf), "entity", "ts", 7, 3, [F.avg("value").alias("mean_v")], 5).select("entity", "window_start", "n", *r6("mean_v"), "low_coverage")


@query("sessions", f"""WITH c AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY entity ORDER BY ts), ts) < 12 * 3600000000 THEN 0 ELSE 1 END AS new FROM ({READINGS})), s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM c)
SELECT entity, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY entity, s""")
def sessions(spark, sf):
    return S.sessions(readings(spark, sf), "entity", "ts", 12.0, [F.sum("value").alias("total")]).select("entity", "session_start", "session_end", "n", *r6("total"))


@query("carpet_matrix", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"round(avg(value) FILTER (hour(ts) = {h}), 6) AS h{h:02d}" for h in range(24)) + " FROM events GROUP BY 1")
def carpet_matrix(spark, sf):
    return readings(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(*[F.round(F.avg(F.when(F.hour("ts") == h, F.col("value"))), 6).alias(f"h{h:02d}") for h in range(24)])


@query("duration_curve", f"SELECT entity, day, l_orderkey, l_linenumber, power, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY entity), 6) AS share FROM ({POINTS}) WINDOW w AS (PARTITION BY entity ORDER BY power DESC, day, l_orderkey, l_linenumber, flow)")
def duration_curve(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy(F.desc("power"), "day", "l_orderkey", "l_linenumber", "flow")
    return points(spark, sf).select("entity", "day", "l_orderkey", "l_linenumber", "power", F.round(100.0 * F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy("entity")), 6).alias("share"))


@query("season_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'core_winter' WHEN month(l_shipdate) IN (3, 4) THEN 'spring' WHEN month(l_shipdate) BETWEEN 5 AND 8 THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN month(l_shipdate) = 12 THEN printf('%02d/%02d', year(l_shipdate) % 100, (year(l_shipdate) + 1) % 100) WHEN month(l_shipdate) IN (1, 2) THEN printf('%02d/%02d', (year(l_shipdate) - 1) % 100, year(l_shipdate) % 100) ELSE '' END AS winter FROM lineitem")
def season_labels(spark, sf):
    from tidemark.plans.adapters import table

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.season("l_shipdate").alias("season"), X.winter_label("l_shipdate").alias("winter"))


@query("degree_hours", f"SELECT entity, day, round(sum(greatest(15 - value, 0)), 6) AS degree_hours FROM (SELECT entity, CAST(ts AS DATE) AS day, value FROM ({HOURLY})) GROUP BY 1, 2")
def degree_hours(spark, sf):
    return hourly(spark, sf).groupBy("entity", F.to_date("ts").alias("day")).agg(F.round(F.sum(X.degree_hours("value")), 6).alias("degree_hours"))


@query("panel_by_day", f"SELECT entity, day, n, round(energy, 6) AS energy, round(volume, 6) AS volume, round(spread, 6) AS spread FROM ({PANEL})")
def panel_by_day(spark, sf):
    return panel(spark, sf).select("entity", "day", "n", *r6("energy", "volume", "spread"))
