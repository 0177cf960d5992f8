"""Queries for the assessment of entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.operators import assess as A
from tidemark.plans.adapters import DAILY, HOURS, PANEL, POINTS, VISITS, daily, hours, panel, points, r6, table, visits
from tidemark.plans.registry import query


def r4(*columns):
    return [F.round(c, 4).alias(c) for c in columns]


# ---------------------------------------------------------------- reference periods and curve monitors

REF = f"""p AS (SELECT * REPLACE (round(spread, 6) AS spread) FROM ({PANEL})), v AS ({VISITS}), s0 AS (SELECT entity, min(day) AS ref_start FROM p GROUP BY 1), l AS (SELECT v.entity, min(v.day) - 14 AS e FROM v JOIN s0 ON s0.entity = v.entity AND v.day > ref_start GROUP BY 1),
rf AS (SELECT s0.entity, ref_start, CASE WHEN coalesce(e < ref_start + 365, false) THEN e ELSE ref_start + 365 END AS ref_end, CASE WHEN coalesce(e < ref_start + 365, false) THEN 'visit' ELSE 'year' END AS end_reason FROM s0 LEFT JOIN l USING (entity)),
r AS (SELECT rf.entity, ref_start, ref_end, end_reason, count(*) FILTER (day < ref_end) AS ref_days, coalesce(max(spread) FILTER (day < ref_end) - min(spread) FILTER (day < ref_end), 0) AS ref_span, count(*) FILTER (day >= ref_end) AS watched_days FROM rf JOIN p USING (entity) GROUP BY 1, 2, 3, 4),
ref AS (SELECT *, CASE WHEN ref_days < 5 THEN 'too_few_days' WHEN ref_span < 4 THEN 'small_span' WHEN watched_days = 0 THEN 'nothing_after' ELSE 'ok' END AS status FROM r)"""


def _days(spark, sf):
    """The panel with conditions that are equal where they should be: sums in another order differ in the last bits."""
    return panel(spark, sf).withColumn("spread", F.round("spread", 6))


def _ref(spark, sf):
    return A.reference(_days(spark, sf), visits(spark, sf), "entity", "day", "spread", least_days=5, least_span=4.0)


@query("reference_period", f"WITH {REF} SELECT entity, ref_start, ref_end, end_reason, ref_days, round(ref_span, 6) AS ref_span, watched_days, status FROM ref")
def reference_period(spark, sf):
    return _ref(spark, sf).select("entity", "ref_start", "ref_end", "end_reason", "ref_days", *r6("ref_span"), "watched_days", "status")


MODELS = f"""{REF}, q AS (SELECT p.entity, p.day, p.spread AS t, p.energy AS y FROM p JOIN ref USING (entity) WHERE status = 'ok' AND day < ref_end), ts AS (SELECT a.entity, quantile_cont((b.y - a.y) / (b.t - a.t), 0.5) AS slope FROM q a JOIN q b ON a.entity = b.entity AND b.t > a.t GROUP BY 1), ln AS (SELECT entity, slope, quantile_cont(y, 0.5) - any_value(slope) * quantile_cont(t, 0.5) AS intercept FROM q JOIN ts USING (entity) GROUP BY 1, 2),
rs AS (SELECT q.*, slope, intercept, y - intercept - slope * t AS r, lag(y - intercept - slope * t) OVER (PARTITION BY entity ORDER BY day) AS l FROM q JOIN ln USING (entity)), mo AS (SELECT entity, slope, intercept, greatest(1.4826 * mad(r), 1e-6) AS s, CASE WHEN count(*) >= 3 AND corr(r, l) IS NOT NULL AND NOT isnan(corr(r, l)) THEN corr(r, l) ELSE 0.0 END AS phi FROM rs GROUP BY 1, 2, 3),
md AS (SELECT *, sqrt((1 + least(greatest(phi, 0), 0.8)) / (1 - least(greatest(phi, 0), 0.8))) AS factor FROM mo)"""


def _models(spark, sf):
    return A.curve_models(_days(spark, sf), _ref(spark, sf), "entity", "day", "spread", "energy")


@query("curve_models", f"WITH {MODELS} SELECT entity, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(s + 0.0000013, 5) AS s, round(phi, 4) AS phi, round(factor, 4) AS factor, round(s * factor, 4) AS s_eff FROM md")
def curve_models(spark, sf):
    return _models(spark, sf).select("entity", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round(F.col("s") + 0.0000013, 5).alias("s"), *r4("phi", "factor", "s_eff"))


DEV = f"{MODELS}, dv AS (SELECT p.entity, p.day, p.energy, intercept + slope * p.spread AS expected, (p.energy - intercept - slope * p.spread) / (s * factor) AS z FROM p JOIN ref USING (entity) JOIN md USING (entity) WHERE p.day >= ref_end)"


@query("curve_deviation", f"WITH {DEV} SELECT entity, day, round(expected, 4) AS expected, round(energy - expected, 4) AS residual, round(z, 3) AS z FROM dv")
def curve_deviation(spark, sf):
    d = A.curve_deviation(_days(spark, sf), _ref(spark, sf), _models(spark, sf), "entity", "day", "spread", "energy")
    return d.select("entity", "day", *r4("expected", "residual"), F.round("z", 3).alias("z"))


@query("curve_alarms", None)
def curve_alarms(spark, sf):
    """The whole monitor: reference period, curve, widened spread, CUSUM (held against plain Python in the tests)."""
    from tidemark.operators.monitor import cusum

    d = A.curve_deviation(_days(spark, sf), _ref(spark, sf), _models(spark, sf), "entity", "day", "spread", "energy")
    return cusum(d, "entity", "day", "z")


@query("curve_skill", f"WITH {DEV}, nx AS (SELECT v.entity, min(v.day) AS nv FROM v JOIN ref ON ref.entity = v.entity AND v.day >= ref_end GROUP BY 1), nm AS (SELECT p.entity, quantile_cont(p.energy, 0.5) AS med FROM p JOIN ref USING (entity) WHERE p.day < ref_end GROUP BY 1), c AS (SELECT dv.*, med, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM dv LEFT JOIN nx USING (entity) JOIN nm USING (entity) WHERE nv IS NULL OR day < nv - 7), g AS (SELECT entity, count(*) AS days, avg(abs(energy - expected)) AS error_model, avg(abs(energy - med)) AS error_naive FROM c WHERE i <= 120 GROUP BY 1 HAVING count(*) >= 5) SELECT entity, days, round(error_model, 4) AS error_model, round(error_naive, 4) AS error_naive, round(CASE WHEN error_naive > 0 THEN 1 - error_model / error_naive END, 4) AS skill FROM g")
def curve_skill(spark, sf):
    p, r, v = _days(spark, sf), _ref(spark, sf), visits(spark, sf)
    return A.curve_skill(p, r, _models(spark, sf), v, "entity", "day", "spread", "energy", least=5).select("entity", "days", *r4("error_model", "error_naive", "skill"))


SEASON = "CASE WHEN month(day) IN (12, 1, 2) THEN 'core_winter' WHEN month(day) IN (3, 4) THEN 'spring' WHEN month(day) BETWEEN 5 AND 8 THEN 'summer' ELSE 'autumn' END"


@query("season_factor", f"WITH d AS (SELECT {SEASON} AS season, abs(energy - 25) / (1 + volume) AS x FROM ({PANEL})) SELECT season, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN quantile_cont(x, 0.5) / (SELECT quantile_cont(x, 0.5) FROM d) ELSE 1.0 END, 6) AS factor FROM d GROUP BY 1")
def season_factor(spark, sf):
    d = panel(spark, sf).withColumn("off", F.col("energy") - 25).withColumn("scale", 1 + F.col("volume"))
    return A.season_factor(d, X.season("day"), "off", "scale", 30).select("season", "n", *r6("factor"))


@query("residual_by_day", f"WITH h AS (SELECT entity, CAST(ts AS DATE) AS day, v - 40 AS r FROM ({HOURS})), e AS (SELECT entity, min(day) AS a, max(day) AS b FROM h GROUP BY 1), k AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e) SELECT k.entity, k.day, count(r) AS n, round(CASE WHEN count(r) >= 3 THEN quantile_cont(r, 0.5) END, 6) AS residual FROM k LEFT JOIN h USING (entity, day) GROUP BY 1, 2")
def residual_by_day(spark, sf):
    return A.residual_by_day(hours(spark, sf).withColumn("r", F.col("v") - 40), "entity", "ts", "r").select("entity", "day", "n", *r6("residual"))


# ---------------------------------------------------------------- dynamics and windows

@query("daily_dynamics", f"""WITH h AS (SELECT *, epoch(ts) / 3600.0 - epoch(lag(ts) OVER w) / 3600.0 AS gap, rt - lag(rt) OVER w AS dr FROM ({HOURS}) WINDOW w AS (PARTITION BY entity ORDER BY ts)), a AS (SELECT *, CASE WHEN gap > 0 AND gap <= 6 THEN dr / gap END AS d1 FROM h), b AS (SELECT *, CASE WHEN gap > 0 AND gap <= 6 THEN (d1 - lag(d1) OVER (PARTITION BY entity ORDER BY ts)) / gap END AS d2 FROM a),
g AS (SELECT entity, CAST(ts AS DATE) AS day, count(d1) AS n_steps, count(*) FILTER (power > 9) AS n_load, avg(abs(d1)) AS d1_mean, quantile_cont(abs(d1), 0.95) AS d1_p95, avg(abs(d2)) AS d2_mean, max(rt) - min(rt) AS span, avg(CASE WHEN power > 9 AND d1 IS NOT NULL THEN CAST(abs(d1) < 2 AS INTEGER) END) AS slow, count(d1) FILTER (power > 9) AS nl, count(*) AS np, CASE WHEN isnan(corr(rt, vl)) THEN NULL ELSE corr(rt, vl) END AS c FROM b GROUP BY 1, 2)
SELECT entity, day, n_steps, n_load, round(CASE WHEN n_steps >= 3 THEN d1_mean END, 5) AS d1_mean, round(CASE WHEN n_steps >= 3 THEN d1_p95 END, 5) AS d1_p95, round(CASE WHEN n_steps >= 3 THEN d2_mean END, 5) AS d2_mean, round(CASE WHEN n_steps >= 3 THEN span END, 5) AS span, round(CASE WHEN n_steps >= 3 AND nl >= 3 THEN slow END, 5) AS slow_share FROM g""")
def daily_dynamics(spark, sf):
    d = A.dynamics(hours(spark, sf), "entity", "ts", "rt", "vl", "power", 9.0, 2.0, 6.0, 3)
    return d.select("entity", "day", "n_steps", "n_load", *[F.round(c, 5).alias(c) for c in ("d1_mean", "d1_p95", "d2_mean", "span", "slow_share")])


@query("daily_coupling", f"WITH g AS (SELECT entity, CAST(ts AS DATE) AS day, count(*) AS n, corr(rt, flow * (1 + hour(ts) % 3)) AS c FROM ({HOURS}) GROUP BY 1, 2), s AS (SELECT entity, CAST(ts AS DATE) AS day, count(*) FILTER (gap > 0 AND gap <= 6) AS steps FROM (SELECT entity, ts, epoch(ts) / 3600.0 - epoch(lag(ts) OVER (PARTITION BY entity ORDER BY ts)) / 3600.0 AS gap FROM ({HOURS})) GROUP BY 1, 2) SELECT entity, day, round(CASE WHEN steps >= 3 AND n >= 3 AND NOT isnan(c) THEN c END, 5) AS coupling FROM g JOIN s USING (entity, day)")
def daily_coupling(spark, sf):
    h = hours(spark, sf).withColumn("other", F.col("flow") * (1 + F.hour("ts") % 3))
    return A.dynamics(h, "entity", "ts", "rt", "other", "power", 9.0, 2.0, 6.0, 3).select("entity", "day", F.round("coupling", 5).alias("coupling"))


CHAN = f"ch AS (SELECT *, sum(power) OVER w AS energy, sum(flow) OVER w / 1000 AS volume, greatest(15 - t_out, 0) AS dh FROM ({HOURS}) WINDOW w AS (PARTITION BY entity ORDER BY ts))"
BOUNDS = "bo AS (SELECT entity, c AS case_day, side, CAST(c + CASE side WHEN 'before' THEN -7 ELSE 1 END AS TIMESTAMP) AS a, CAST(c + CASE side WHEN 'before' THEN 0 ELSE 8 END AS TIMESTAMP) - INTERVAL 1 HOUR AS b FROM (SELECT DISTINCT entity FROM ch), (VALUES (DATE '2024-01-10'), (DATE '2024-01-22')) x(c), (VALUES ('before'), ('after')) y(side))"
WINDOWED = f"""{CHAN}, {BOUNDS}, wj AS (SELECT bo.entity, case_day, side, date_diff('hour', a, b) + 1 AS cal, count(ch.ts) AS n_hours, count(DISTINCT CAST(ch.ts AS DATE)) AS days, quantile_cont(rt, 0.5) AS rt_median, avg(rt) FILTER (power > 9) AS rt_loaded, avg(dt) FILTER (power > 9) AS dt_loaded, quantile_cont(flow, 0.5) AS flow_median, avg(CASE WHEN ch.ts IS NOT NULL THEN CAST(coalesce(power > 9, false) AS INTEGER) END) AS load_share, max(power) AS peak,
arg_max(energy, ch.ts) - arg_min(energy, ch.ts) AS e, arg_max(volume, ch.ts) - arg_min(volume, ch.ts) AS v, sum(dh) AS dh FROM bo LEFT JOIN ch ON ch.entity = bo.entity AND ch.ts BETWEEN a AND b GROUP BY 1, 2, 3, 4),
wm AS (SELECT *, CASE WHEN n_hours >= 2 THEN e END AS energy, CASE WHEN n_hours >= 2 THEN v END AS volume FROM wj)"""


def _windows(spark, sf):
    w = Window.partitionBy("entity").orderBy("ts")
    h = hours(spark, sf)
    ch = h.withColumns({"energy": F.sum("power").over(w), "volume": F.sum("flow").over(w) / 1000, "dh": F.greatest(15 - F.col("t_out"), F.lit(0.0))})
    case = F.explode(F.array(F.lit("2024-01-10").cast("date"), F.lit("2024-01-22").cast("date")))
    b = h.select("entity").distinct().withColumn("case_day", case).withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after"))))
    first, last = F.when(F.col("side") == "before", -7).otherwise(1), F.when(F.col("side") == "before", 0).otherwise(8)
    b = b.withColumn("start", F.date_add("case_day", first).cast("timestamp_ntz")).withColumn("end", F.timestamp_add("HOUR", F.lit(-1), F.date_add("case_day", last).cast("timestamp_ntz")))
    return A.window_metrics(ch, b, "entity", "ts", ["case_day", "side"], 9.0)


@query("window_metrics", f"WITH {WINDOWED} SELECT entity, case_day, side, n_hours, round(n_hours / CAST(cal AS DOUBLE), 6) AS coverage, round(days / greatest(1.0, cal / 24.0), 6) AS day_coverage, round(rt_median, 5) AS rt_median, round(rt_loaded, 5) AS rt_loaded, round(dt_loaded, 5) AS dt_loaded, round(flow_median, 4) AS flow_median, round(load_share, 6) AS load_share, round(peak, 5) AS peak, round(energy, 4) AS energy, round(volume, 5) AS volume, round(energy * (8760.0 / cal) / greatest(peak, 0.1), 3) AS full_hours, round(CASE WHEN dh > 0 THEN energy / dh END, 5) AS energy_per_dh FROM wm")
def window_metrics(spark, sf):
    return _windows(spark, sf).select("entity", "case_day", "side", "n_hours", *r6("coverage", "day_coverage"), *[F.round(c, 5).alias(c) for c in ("rt_median", "rt_loaded", "dt_loaded")], *r4("flow_median"), *r6("load_share"), F.round("peak", 5).alias("peak"), *r4("energy"), F.round("volume", 5).alias("volume"), F.round("full_hours", 3).alias("full_hours"), F.round("energy_per_dh", 5).alias("energy_per_dh"))


SWAPS = "sw AS (SELECT DISTINCT user_id % 10 AS entity, CAST(ts AS DATE) AS day FROM events WHERE event_id % 97 = 5)"


@query("window_pairs", f"""WITH {WINDOWED}, {SWAPS}, pr AS (SELECT coalesce(x.entity, y.entity) AS entity, coalesce(x.case_day, y.case_day) AS case_day, x.rt_median AS rb, y.rt_median AS ra, x.energy AS eb, y.energy AS ea FROM (SELECT * FROM wm WHERE side = 'before') x FULL JOIN (SELECT * FROM wm WHERE side = 'after') y ON x.entity = y.entity AND x.case_day = y.case_day)
SELECT entity, case_day, round(rb, 5) AS rt_median_before, round(ra, 5) AS rt_median_after, round(ra - rb, 5) AS d_rt_median, round(ea - eb, 4) AS d_energy, CASE WHEN rb > 40 THEN 'bad' WHEN rb IS NOT NULL THEN 'good' END AS state_before, CASE WHEN ra > 40 THEN 'bad' WHEN ra IS NOT NULL THEN 'good' END AS state_after, EXISTS (SELECT 1 FROM sw WHERE sw.entity = pr.entity AND sw.day BETWEEN case_day - 7 AND case_day + 7) AS meter_change, EXISTS (SELECT 1 FROM sw WHERE sw.entity = pr.entity AND sw.day <> case_day AND (sw.day BETWEEN case_day - 7 AND case_day - 1 OR sw.day BETWEEN case_day + 1 AND case_day + 7)) AS other_visit FROM pr""")
def window_pairs(spark, sf):
    p = A.pair_rows(_windows(spark, sf), "entity", "case_day", "side", ["rt_median", "energy"], "rt_median", 40.0)
    sw = table(spark, sf, "events").where("event_id % 97 = 5").select((F.col("user_id") % 10).alias("entity"), F.to_date("ts").alias("day")).distinct()
    at = lambda n: F.date_add("case_day", n)
    p = A.flag_inside(p, sw, "entity", "case_day", "day", [(at(-7), at(7))], "meter_change")
    p = A.flag_inside(p, sw, "entity", "case_day", "day", [(at(-7), at(-1)), (at(1), at(7))], "other_visit", True)
    return p.select("entity", "case_day", *[F.round(c, 5).alias(c) for c in ("rt_median_before", "rt_median_after", "d_rt_median")], *r4("d_energy"), "state_before", "state_after", "meter_change", "other_visit")


@query("event_axis", f"SELECT p.entity, v.day AS event, CAST(p.day - v.day AS INTEGER) AS days_from, round(energy, 6) AS energy FROM ({PANEL}) p JOIN ({VISITS}) v ON v.entity = p.entity AND abs(p.day - v.day) <= 300")
def event_axis(spark, sf):
    return A.event_axis(panel(spark, sf), visits(spark, sf), "entity", "day").select("entity", "event", "days_from", *r6("energy"))


LIMIT = "li AS (SELECT DISTINCT user_id % 10 AS entity, TIMESTAMP '2024-01-28' + to_hours(CAST(24 * (user_id % 10 % 3) AS BIGINT)) AS lim FROM events)"


@query("model_metrics", f"""WITH h AS (SELECT *, hour(ts) AS h, ts < TIMESTAMP '2024-01-16' AS w, ts >= TIMESTAMP '2024-01-16' AS s FROM ({HOURS}) WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'), {LIMIT}, d AS (SELECT h.*, w AND power > 0.5 AND flow > 1 AND dt > 1 AS ld, s AND h <= 5 AS ni FROM h JOIN li USING (entity) WHERE ts < lim),
g AS (SELECT entity, count(*) FILTER (w) AS hours_winter, count(*) FILTER (s) AS hours_summer, quantile_cont(flow, 0.5) FILTER (ni) AS nf, avg(CAST(flow >= 5 AS INTEGER)) FILTER (ni) AS ft, CASE WHEN count(*) FILTER (ni AND flow >= 5) >= 3 THEN quantile_cont(dt, 0.5) FILTER (ni AND flow >= 5) END AS ns, avg(dt) FILTER (ld) AS wl, quantile_cont(rt, 0.9) FILTER (w) AS p90, stddev_samp(flow) FILTER (ld) / avg(flow) FILTER (ld) AS cv, quantile_cont(flow, 0.5) FILTER (w AND h <= 5) AS n5, quantile_cont(flow, 0.5) FILTER (w AND h BETWEEN 8 AND 20) AS d5, quantile_cont(power, 0.99) FILTER (w) AS pk, avg(power) FILTER (s) / avg(power) AS ss,
CASE WHEN count(*) FILTER (ld) >= 10 THEN covar_pop(ln(CASE WHEN ld THEN power END), ln(CASE WHEN ld THEN flow END)) / var_pop(ln(CASE WHEN ld THEN power END)) END AS fs, CASE WHEN count(*) FILTER (ld) >= 10 THEN sqrt(var_pop(ln(CASE WHEN ld THEN flow END)) + var_pop(ln(CASE WHEN ld THEN dt END))) END AS pw, CASE WHEN count(*) FILTER (ld) >= 10 THEN sum(rt * power) FILTER (ld) / sum(power) FILTER (ld) END AS rw FROM d GROUP BY 1),
dd AS (SELECT entity, CAST(ts AS DATE) AS day, avg(rt) AS r, avg(t_out) AS t FROM d WHERE w GROUP BY 1, 2 HAVING avg(t_out) <= 15), z AS (SELECT entity, CASE WHEN count(*) >= 5 THEN regr_intercept(r, t) END AS r0 FROM dd GROUP BY 1)
SELECT entity, hours_winter, hours_summer, round(nf, 4) AS summer_night_flow, round(ft, 6) AS summer_flow_through, round(ns, 5) AS summer_night_spread, round(wl, 5) AS winter_loaded_spread, round(p90, 5) AS winter_return_p90, round(cv, 5) AS winter_flow_cv, round(pk, 5) AS winter_peak, round(ss, 5) AS summer_load_share, round(fs, 5) AS flow_share, round(pw, 5) AS point_width, round(rw, 5) AS return_weighted, round(r0, 5) AS winter_return_at_0, round(CASE WHEN d5 > 0 THEN n5 / d5 END, 5) AS winter_night_day_flow FROM g LEFT JOIN z USING (entity)""")
def model_metrics(spark, sf):
    h = hours(spark, sf).where("ts >= timestamp_ntz'2024-01-01' and ts < timestamp_ntz'2024-02-01'")
    lim = h.select("entity").distinct().withColumn("limit", F.timestamp_add("HOUR", (24 * (F.col("entity") % 3)).cast("int"), F.lit("2024-01-28").cast("timestamp_ntz")))
    m = A.model_metrics(h, "entity", "ts", ("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-02-01"), lim, least_load=10, least_days=5, least_flowing=3)
    r5 = [F.round(c, 5).alias(c) for c in ("summer_night_spread", "winter_loaded_spread", "winter_return_p90", "winter_flow_cv", "winter_peak", "summer_load_share", "flow_share", "point_width", "return_weighted", "winter_return_at_0", "winter_night_day_flow")]
    return m.select("entity", "hours_winter", "hours_summer", *r4("summer_night_flow"), *r6("summer_flow_through"), *r5)


@query("saturation", f"""WITH h AS ({HOURS}), q AS (SELECT entity, quantile_cont(flow, 0.99) FILTER (flow > 1) AS f, quantile_cont(power, 0.99) FILTER (flow > 1 AND power > 0) AS p FROM h GROUP BY 1), g AS (SELECT entity, CASE WHEN count(*) FILTER (flow > 1) >= 20 THEN avg(CAST(flow >= 0.95 * f AS INTEGER)) FILTER (flow > 1) END AS plateau, CASE WHEN count(*) FILTER (flow > 1 AND power > 0 AND power < 0.2 * p) >= 5 THEN quantile_cont(rt, 0.5) FILTER (flow > 1 AND power > 0 AND power < 0.2 * p) END AS low FROM h JOIN q USING (entity) GROUP BY 1),
d AS (SELECT entity, CAST(ts AS DATE) AS day, quantile_cont(flow, 0.95) AS y, avg(t_out) AS t FROM h GROUP BY 1, 2), l AS (SELECT entity, count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM d WHERE t BETWEEN 3 AND 12 GROUP BY 1), c AS (SELECT entity, any_value(n) AS n, count(*) AS c, quantile_cont(y, 0.5) AS m, quantile_cont(a + b * t, 0.5) AS e FROM d JOIN l USING (entity) WHERE t <= 1 GROUP BY 1)
SELECT entity, round(CASE WHEN n >= 5 AND c >= 3 AND e > 0 THEN m / e END, 5) AS saturation, round(plateau, 6) AS plateau, round(low, 5) AS low_load_return FROM g LEFT JOIN c USING (entity)""")
def saturation(spark, sf):
    return A.saturation(hours(spark, sf), "entity", "ts", 5, 3, 20, 5).select("entity", F.round("saturation", 5).alias("saturation"), *r6("plateau"), F.round("low_load_return", 5).alias("low_load_return"))


@query("cooling_before_after", f"WITH f AS (SELECT entity, ts, CASE WHEN epoch(lead(ts) OVER w) - epoch(ts) = 3600 AND flow <= 300 AND lead(flow) OVER w <= 300 AND rt > 30 THEN rt - lead(rt) OVER w END AS fall FROM ({HOURS}) WINDOW w AS (PARTITION BY entity ORDER BY ts)), g AS (SELECT entity, CASE WHEN count(fall) FILTER (ts < TIMESTAMP '2024-01-16') >= 3 THEN quantile_cont(fall, 0.5) FILTER (ts < TIMESTAMP '2024-01-16') END AS b, CASE WHEN count(fall) FILTER (ts >= TIMESTAMP '2024-01-16') >= 3 THEN quantile_cont(fall, 0.5) FILTER (ts >= TIMESTAMP '2024-01-16') END AS a FROM f GROUP BY 1) SELECT entity, round(b, 6) AS rate_before, round(a, 6) AS rate_after, round(a - b, 6) AS d_rate FROM g")
def cooling_before_after(spark, sf):
    from tidemark.operators.profiles import cooling_sides

    return cooling_sides(hours(spark, sf), "entity", "ts", "flow", "rt", 300, 30.0, 3, F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select("entity", *r6("rate_before", "rate_after", "d_rate"))


@query("mean_embedding", "WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, round(sum(m * i) FILTER (n >= 30), 6) AS weighted FROM m GROUP BY 1")
def mean_embedding(spark, sf):
    m = A.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding", 30)
    total = F.aggregate(F.transform("mean", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("label", "n", F.round(total, 6).alias("weighted"))


# ---------------------------------------------------------------- scores, patterns, rankings

@query("station_profile", f"SELECT entity, count(*) FILTER (n >= 1) AS days, round(quantile_cont(energy, 0.5) FILTER (n >= 1), 6) AS energy, round(quantile_cont(volume, 0.5) FILTER (n >= 1), 6) AS volume, round(avg(CAST(energy > 40 AS INTEGER)) FILTER (n >= 1), 6) AS high_share, round(quantile_cont(energy, 0.5) FILTER (n >= 1 AND {SEASON} = 'core_winter'), 6) AS winter_energy FROM ({PANEL}) GROUP BY 1")
def station_profile(spark, sf):
    ok = F.col("n") >= 1
    med = lambda c, cond=ok: F.percentile(F.when(cond, F.col(c)), F.lit(0.5))
    return panel(spark, sf).groupBy("entity").agg(F.count(F.when(ok, 1)).alias("days"), F.round(med("energy"), 6).alias("energy"), F.round(med("volume"), 6).alias("volume"), F.round(F.avg(F.when(ok, (F.col("energy") > 40).cast("double"))), 6).alias("high_share"), F.round(med("energy", ok & (X.season("day") == "core_winter")), 6).alias("winter_energy"))


@query("station_score", f"WITH d AS ({DAILY}), h AS (SELECT entity, day FROM d WHERE mean_v > 50), c AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY entity ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM h), s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY day) AS seg FROM c), r AS (SELECT entity, max(n) AS longest FROM (SELECT entity, seg, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1), g AS (SELECT entity, count(mean_v) AS days, avg(mean_v) AS a, quantile_cont(mean_v, 0.5) AS m, avg(CAST(mean_v > 50 AS INTEGER)) AS f FROM d GROUP BY 1) SELECT entity, days, round(CASE WHEN days >= 5 THEN a END, 6) AS mean, round(CASE WHEN days >= 5 THEN m END, 6) AS median, round(CASE WHEN days >= 5 THEN f END, 6) AS flagged_share, coalesce(longest, 0) AS longest_run FROM g LEFT JOIN r USING (entity)")
def station_score(spark, sf):
    d = daily(spark, sf).withColumn("flag", F.col("mean_v") > 50)
    return A.entity_score(d, "entity", "day", "mean_v", "flag", 5).select("entity", "days", *r6("mean", "median", "flagged_share"), "longest_run")


FEAT = f"f AS (SELECT entity, avg(power) AS level, stddev_samp(flow) AS unrest, avg(spread) AS spread, count(*) AS n FROM ({POINTS}) GROUP BY 1)"


def _features(spark, sf):
    return points(spark, sf).groupBy("entity").agg(F.avg("power").alias("level"), F.stddev_samp("flow").alias("unrest"), F.avg("spread").alias("spread"), F.count(F.lit(1)).alias("n"))


@query("first_match_pattern", f"WITH {FEAT}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.2) AS l{c}, quantile_cont({c}, 0.8) AS h{c}" for c in ("level", "unrest", "spread")) + " FROM f) SELECT entity, CASE WHEN level >= hlevel AND level > llevel AND spread <= lspread AND spread < hspread THEN 'short circuit' WHEN unrest >= hunrest AND unrest > lunrest THEN 'unsteady' WHEN level <= llevel AND level < hlevel THEN 'idle' ELSE 'none' END AS pattern FROM f, q")
def first_match_pattern(spark, sf):
    return A.first_match(_features(spark, sf), "entity", [("short circuit", {"level": "high", "spread": "low"}), ("unsteady", {"unrest": "high"}), ("idle", {"level": "low"})])


@query("composite_score", f"WITH p AS ({PANEL}), q AS (SELECT day, median(energy) AS me, mad(energy) AS de, median(volume) AS mv, mad(volume) AS dv FROM p GROUP BY 1), z AS (SELECT entity, day, CASE WHEN de > 0 THEN (energy - me) / (1.4826 * de) END AS a, CASE WHEN dv > 0 THEN (volume - mv) / (1.4826 * dv) END AS b FROM p JOIN q USING (day)) SELECT entity, day, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 0.7 * coalesce(a, 0) - 0.3 * coalesce(b, 0) END, 4) AS score FROM z")
def composite_score(spark, sf):
    return A.composite_score(panel(spark, sf), ["day"], {"energy": 0.7, "volume": -0.3}).select("entity", "day", *r4("score"))


@query("linear_shap", f"WITH {FEAT}, u AS (SELECT entity, 'level' AS feature, level AS x, 0.8 AS w FROM f UNION ALL SELECT entity, 'unrest', unrest, -0.4 FROM f UNION ALL SELECT entity, 'spread', CASE WHEN entity % 4 <> 1 THEN spread END, 1.5 FROM f) SELECT entity, feature, round(coalesce(w * (x - avg(x) OVER (PARTITION BY feature)) / nullif(stddev_pop(x) OVER (PARTITION BY feature), 0), 0), 5) AS contribution FROM u")
def linear_shap(spark, sf):
    f = _features(spark, sf).withColumn("spread", F.when(F.col("entity") % 4 != 1, F.col("spread")))
    return A.linear_shap(f, "entity", {"level": 0.8, "unrest": -0.4, "spread": 1.5}).select("entity", "feature", F.round("contribution", 5).alias("contribution"))


@query("symptoms", f"WITH w AS (SELECT entity, CAST(floor((day - DATE '1970-01-01') / 180.0) AS BIGINT) AS win, quantile_cont(energy, 0.5) AS energy, quantile_cont(spread, 0.5) AS spread FROM ({PANEL}) GROUP BY 1, 2), m AS (SELECT entity, win, 'energy' AS symptom, energy AS x FROM w UNION ALL SELECT entity, win, 'spread', spread FROM w), l AS (SELECT win, symptom, count(x) AS n, quantile_cont(x, 0.8) AS h, quantile_cont(x, 1 - 0.8) AS lo FROM m GROUP BY 1, 2) SELECT entity, win AS \"window\", symptom, CASE WHEN n >= 5 THEN CASE symptom WHEN 'spread' THEN x < lo ELSE x > h END END AS present FROM m JOIN l USING (win, symptom)")
def symptoms(spark, sf):
    return A.symptoms(panel(spark, sf), "entity", "day", {"energy": "high", "spread": "low"}, 180)


@query("ranked_coverage", f"WITH {FEAT}, r AS (SELECT *, row_number() OVER (ORDER BY level DESC NULLS LAST, entity) AS i FROM f) SELECT CAST(s AS INTEGER) AS step, count(*) FILTER (entity % 3 = 0) AS hits, round(count(*) FILTER (entity % 3 = 0) / CAST((SELECT count(*) FILTER (entity % 3 = 0) FROM f) AS DOUBLE), 6) AS share FROM (VALUES (2), (5), (8)) t(s) JOIN r ON i <= s GROUP BY 1")
def ranked_coverage(spark, sf):
    f = _features(spark, sf).withColumn("hit", F.col("entity") % 3 == 0)
    return A.coverage_of_ranking(f, "level", "entity", "hit", [2, 5, 8]).select("step", "hits", *r6("share"))


@query("alarm_budget_pick", f"WITH p AS ({PANEL}), h AS (SELECT unnest([40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0]) AS h), l AS (SELECT CAST(h AS DOUBLE) AS h, count(*) FILTER (energy > h) AS alarms FROM p, h GROUP BY 1) SELECT h, alarms FROM l ORDER BY abs(alarms - 0.02 * (SELECT count(*) FROM p)), h DESC LIMIT 1")
def alarm_budget_pick(spark, sf):
    """The threshold whose alarm load is nearest two in a hundred days."""
    p = panel(spark, sf)
    hs = [40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0]
    loads = p.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("energy") > h, 1)).alias(f"a{i}") for i, h in enumerate(hs)])
    l = loads.select("n", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"a{i}").alias("alarms")) for i, h in enumerate(hs)])).alias("x")).select("x.h", "x.alarms", (F.col("x.alarms") - 0.02 * F.col("n")).alias("over"))
    return A.nearest_budget(l, "h", "over", 0.0).select("h", "alarms")


@query("precision_at_k", "WITH d AS (SELECT quality, n_chars, doc_id FROM documents JOIN labels USING (doc_id)), t AS (SELECT * FROM d ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT count(*) AS k, count(*) FILTER (quality = 1) AS hits, round(count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE), 6) AS precision FROM t")
def precision_at_k(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return A.precision_at(d, "quality", "n_chars", "doc_id", 50).select("k", "hits", *r6("precision"))


@query("longest_blocks", f"WITH h AS (SELECT entity, day FROM ({DAILY}) WHERE mean_v > 40), c AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY entity ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM h), s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY day) AS seg FROM c), r AS (SELECT entity, min(day) AS run_start, max(day) AS run_end, count(*) AS n FROM s GROUP BY entity, seg) SELECT * FROM r ORDER BY n DESC, entity, run_start LIMIT 20")
def longest_blocks(spark, sf):
    from tidemark.operators.shape import runs

    return runs(daily(spark, sf), "entity", "day", F.col("mean_v") > 40, 24.0).orderBy(F.desc("n"), "entity", "run_start").limit(20)


# ---------------------------------------------------------------- effects and agreement

@query("expectation_by_entity", f"WITH p AS (SELECT * EXCLUDE (n) FROM ({PANEL})), g AS (SELECT entity, count(*) AS n, avg(energy) AS my, avg(spread) AS ma, avg(t) AS mb, var_pop(spread) AS aa, var_pop(t) AS bb, covar_pop(spread, t) AS ab, covar_pop(spread, energy) AS ay, covar_pop(t, energy) AS bd FROM p GROUP BY 1), s AS (SELECT *, aa * bb - ab * ab AS det FROM g) SELECT entity, day, n, CASE WHEN n < 20 THEN 'too_few_rows' WHEN NOT det > 1e-9 * aa * bb + 1e-12 THEN 'no_variation' ELSE 'ok' END AS reason, round(CASE WHEN n >= 20 AND det > 1e-9 * aa * bb + 1e-12 THEN my + (ay * bb - bd * ab) / det * (spread - ma) + (bd * aa - ay * ab) / det * (t - mb) END, 5) AS expected FROM p JOIN s USING (entity)")
def expectation_by_entity(spark, sf):
    return A.expectation_by_entity(panel(spark, sf).drop("n"), "entity", ["spread", "t"], "energy", 20).select("entity", "day", "n", "reason", F.round("expected", 5).alias("expected"))


@query("interaction_model", f"WITH p AS (SELECT power AS x, flow AS y, day < DATE '1998-06-01' AS b FROM ({POINTS})), g AS (SELECT b, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_sxx(y, x) AS xx, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy FROM p GROUP BY 1), j AS (SELECT u.n + w.n AS n, u.s AS s0, w.s AS s1, u.i + 8.8 * u.s AS e0, w.i + 8.8 * w.s AS e1, sqrt((u.yy - u.s * u.xy + w.yy - w.s * w.xy) / (u.n + w.n - 4) * (1 / u.xx + 1 / w.xx)) AS se FROM g u, g w WHERE u.b AND NOT w.b) SELECT n, round(s0, 6) AS slope_before, round(s1, 6) AS slope_after, round(s1 - s0, 6) AS slope_difference, round(se, 6) AS se, round((s1 - s0) / se, 4) AS t, round(e0, 5) AS expected_before, round(e1, 5) AS expected_after, round(e1 - e0, 5) AS delta, round(100 * (e1 - e0) / e0, 4) AS delta_percent FROM j")
def interaction_model(spark, sf):
    p = points(spark, sf).withColumn("g", F.when(F.col("day") < F.lit("1998-06-01").cast("date"), "before").otherwise("after"))
    d = A.interaction(p, "g", "power", "flow", "before", "after", 8.8)
    return d.select("n", *r6("slope_before", "slope_after", "slope_difference", "se"), *r4("t"), *[F.round(c, 5).alias(c) for c in ("expected_before", "expected_after", "delta")], *r4("delta_percent"))


@query("group_effect", f"WITH p AS (SELECT entity, energy, CASE WHEN day < DATE '1998-01-01' THEN 'before' WHEN entity % 5 <> 0 THEN 'after' END AS side FROM ({PANEL})), g AS (SELECT entity, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after, quantile_cont(energy, 0.5) FILTER (side = 'before') AS b, quantile_cont(energy, 0.5) FILTER (side = 'after') AS a FROM p GROUP BY 1) SELECT entity, n_before, n_after, round(CASE WHEN n_before >= 30 AND n_after >= 30 THEN b END, 6) AS median_before, round(CASE WHEN n_before >= 30 AND n_after >= 30 THEN a END, 6) AS median_after, round(CASE WHEN n_before >= 30 AND n_after >= 30 THEN a - b END, 6) AS effect FROM g")
def group_effect(spark, sf):
    p = panel(spark, sf).withColumn("side", F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "before").when(F.col("entity") % 5 != 0, "after"))
    return A.group_effect(p, "entity", "energy", "side").select("entity", "n_before", "n_after", *r6("median_before", "median_after", "effect"))


@query("cramers_v", "WITH c AS (SELECT lang AS a, source AS b, count(*) AS o FROM documents GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), s AS (SELECT sum(CAST(o AS DOUBLE) * o / (r * k)) AS s, sum(o) AS n, count(DISTINCT c.a) AS x, count(DISTINCT c.b) AS y FROM c JOIN r USING (a) JOIN k USING (b)) SELECT CAST(n AS BIGINT) AS n, x AS rows, y AS columns, round(sqrt(greatest(s - 1, 0) / (least(x, y) - 1)), 6) AS v FROM s")
def cramers_v(spark, sf):
    return A.cramers_v(table(spark, sf, "documents"), "lang", "source").select("n", "rows", "columns", *r6("v"))


@query("adjusted_rand", "WITH c AS (SELECT lang AS a, source AS b, CAST(count(*) AS DOUBLE) AS o FROM documents GROUP BY 1, 2), x AS (SELECT sum(r * (r - 1) / 2) AS s FROM (SELECT sum(o) AS r FROM c GROUP BY a)), y AS (SELECT sum(r * (r - 1) / 2) AS s FROM (SELECT sum(o) AS r FROM c GROUP BY b)), t AS (SELECT sum(o * (o - 1) / 2) AS s, sum(o) AS n FROM c) SELECT CAST(t.n AS BIGINT) AS n, round((t.s - x.s * y.s / (t.n * (t.n - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t, x, y")
def adjusted_rand(spark, sf):
    return A.adjusted_rand(table(spark, sf, "documents"), "lang", "source").select("n", *r6("ari"))


RANKED = "WITH p AS (SELECT flag, power, flow, spread FROM ({p})), r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY power) + (count(*) OVER (PARTITION BY flag, power) - 1) / 2.0 AS a, rank() OVER (PARTITION BY flag ORDER BY flow) + (count(*) OVER (PARTITION BY flag, flow) - 1) / 2.0 AS b, rank() OVER (PARTITION BY flag ORDER BY spread) + (count(*) OVER (PARTITION BY flag, spread) - 1) / 2.0 AS c FROM p)"


@query("correlation_matrix", RANKED.format(p=POINTS) + " SELECT flag, 'power' AS a, 'flow' AS b, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT flag, 'power', 'spread', round(corr(a, c), 6), count(*) FROM r GROUP BY 1 UNION ALL SELECT flag, 'flow', 'spread', round(corr(b, c), 6), count(*) FROM r GROUP BY 1")
def correlation_matrix(spark, sf):
    return A.correlation_matrix(points(spark, sf), ["power", "flow", "spread"], ["flag"]).select("flag", "a", "b", *r6("rho"), "n")


@query("winter_pair", f"""WITH d AS (SELECT v.entity, v.day AS visit, power, flow, CASE WHEN p.day - v.day BETWEEN -180 AND -15 THEN 'b' WHEN p.day - v.day BETWEEN 15 AND 180 THEN 'a' END AS side FROM ({VISITS}) v JOIN ({POINTS}) p ON p.entity = v.entity AND abs(p.day - v.day) <= 180 AND power > 0 AND flow > 0), s AS (SELECT * FROM d WHERE side IS NOT NULL),
q AS (SELECT entity, visit, quantile_cont(power, 0.05) FILTER (side = 'b') AS bl, quantile_cont(power, 0.95) FILTER (side = 'b') AS bh, quantile_cont(power, 0.05) FILTER (side = 'a') AS al, quantile_cont(power, 0.95) FILTER (side = 'a') AS ah FROM s GROUP BY 1, 2), r AS (SELECT s.* FROM s JOIN q USING (entity, visit) WHERE power BETWEEN greatest(bl, al) AND least(bh, ah)),
f AS (SELECT entity, visit, CASE WHEN count(*) >= 10 AND var_pop(ln(power)) > 1e-12 THEN covar_pop(ln(power), ln(flow)) / var_pop(ln(power)) END AS sl, avg(ln(power)) AS mx, avg(ln(flow)) AS my FROM r WHERE side = 'b' GROUP BY 1, 2), e AS (SELECT r.entity, r.visit, side, ln(flow) - (my - sl * mx) - sl * ln(power) AS x FROM r JOIN f USING (entity, visit)),
g AS (SELECT entity, visit, count(*) FILTER (side = 'b') AS n_before, count(*) FILTER (side = 'a') AS n_after, quantile_cont(x, 0.5) FILTER (side = 'a') AS a, quantile_cont(x, 0.5) FILTER (side = 'b') AS b FROM e GROUP BY 1, 2)
SELECT entity, visit, n_before, n_after, round(CASE WHEN n_before >= 10 AND n_after >= 10 THEN a END, 5) AS cross_residual, round(CASE WHEN n_before >= 10 AND n_after >= 10 THEN b END, 5) AS residual_before FROM g""")
def winter_pair(spark, sf):
    return A.winter_pair(points(spark, sf), visits(spark, sf), "entity", "day", "power", "flow").select("entity", "visit", "n_before", "n_after", F.round("cross_residual", 5).alias("cross_residual"), F.round("residual_before", 5).alias("residual_before"))


@query("hit_threshold_sweep", f"""WITH p AS ({PANEL}), v AS ({VISITS}), hs AS (SELECT unnest([60.0, 80.0]) AS h), h AS (SELECT hs.h, entity, day FROM p JOIN hs ON energy > hs.h), o AS (SELECT DISTINCT entity, day FROM p),
c AS (SELECT entity AS case_key, day AS case_day, CAST(h AS DOUBLE) AS h FROM v, hs), w AS (SELECT DISTINCT case_day, o.entity FROM (SELECT DISTINCT day AS case_day FROM v) x JOIN o ON o.day BETWEEN case_day - 7 AND case_day + 60 GROUP BY case_day, o.entity HAVING count(DISTINCT o.day) >= 3), k AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.entity = w.entity AND v.day BETWEEN case_day - 7 AND case_day + 60)),
t AS (SELECT c.*, EXISTS (SELECT 1 FROM h WHERE h.h = c.h AND h.entity = case_key AND h.day BETWEEN case_day - 7 AND case_day + 60) AS hit, (SELECT count(*) FROM k WHERE k.case_day = c.case_day) AS controls, (SELECT count(DISTINCT k.entity) FROM k JOIN h ON h.h = c.h AND h.entity = k.entity AND h.day BETWEEN k.case_day - 7 AND k.case_day + 60 WHERE k.case_day = c.case_day) AS ch FROM c)
SELECT t.h, any_value(a.alarms) AS alarms, count(*) AS cases, count(*) FILTER (hit) AS hits, round(sum(ch / CAST(controls AS DOUBLE)), 5) AS expected FROM t JOIN (SELECT h, count(*) AS alarms FROM h GROUP BY 1) a ON a.h = t.h WHERE controls >= 1 GROUP BY 1""")
def hit_threshold_sweep(spark, sf):
    """The hit test and the alarm load at each threshold."""
    from tidemark.operators import events as E

    p, v, out = panel(spark, sf), visits(spark, sf), None
    for h in (60.0, 80.0):
        a = p.where(F.col("energy") > h).select("entity", "day")
        b = E.hit_balance(E.hit_test(v, a, p.select("entity", "day"), least_days=3)).crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("alarms")))).select(F.lit(h).alias("h"), "alarms", "cases", "hits", F.round("expected", 5).alias("expected"))
        out = b if out is None else out.unionByName(b)
    return out
