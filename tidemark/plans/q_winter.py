"""Queries for the comparison of winters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.operators import winter as W
from tidemark.plans.adapters import HOURS, PANEL, POINTS, VISITS, hours, panel, points, r6, table, visits
from tidemark.plans.registry import query

LABEL = "CASE WHEN month(day) = 12 THEN printf('%02d/%02d', year(day) % 100, (year(day) + 1) % 100) WHEN month(day) IN (1, 2) THEN printf('%02d/%02d', (year(day) - 1) % 100, year(day) % 100) ELSE '' END"
END = "(2000 + CAST(string_split(winter, '/')[2] AS INTEGER))"
CONTRACT = "k AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 6 <> 5 THEN s_acctbal / 100 END AS contract FROM supplier)"
METRICS = {"spread_ref": -1, "slope": -1, "residual_sd": 1, "hot_share": 1, "flow_per_kw": 1}
LEAST = 12


def _contract(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_suppkey") % 6 != 5, F.col("s_acctbal") / 100).alias("contract"))


@query("operating_hours", f"SELECT entity, count(*) AS n FROM ({POINTS}) WHERE power > 0 AND flow > 0 AND spread > 0 GROUP BY 1")
def operating_hours(spark, sf):
    return W.operating(points(spark, sf), "power", "flow", "spread").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


FREE = f"p AS (SELECT * FROM ({POINTS}) x WHERE power > 0 AND flow > 0 AND spread > 0 AND NOT EXISTS (SELECT 1 FROM ({VISITS}) v WHERE v.entity = x.entity AND x.day BETWEEN v.day - 7 AND v.day + 7))"


def _free(spark, sf):
    return W.outside_visits(W.operating(points(spark, sf), "power", "flow", "spread"), visits(spark, sf), "entity", "day")


@query("visit_buffer", f"WITH {FREE} SELECT entity, day, count(*) AS n FROM p GROUP BY 1, 2")
def visit_buffer(spark, sf):
    return _free(spark, sf).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))


WM = f"""{FREE}, {CONTRACT}, d AS (SELECT *, {LABEL} AS winter, ln(power) AS lx, ln(flow) AS ly FROM p), f AS (SELECT entity, winter, count(*) AS n, CASE WHEN count(*) >= {LEAST} AND var_pop(lx) > 1e-12 THEN covar_pop(lx, ly) / var_pop(lx) END AS slope, avg(lx) AS mx, avg(ly) AS my, var_pop(ly) AS vy, covar_pop(lx, ly) AS c, quantile_cont(power, 0.5) AS p_ref, quantile_cont(flow, 0.5) AS flow_median, avg(CASE WHEN t > 0.05 THEN 1.0 ELSE 0.0 END) AS hot_share FROM d WHERE winter <> '' GROUP BY 1, 2),
m AS (SELECT entity, winter, n, CASE WHEN n < {LEAST} THEN 'too_few_rows' WHEN slope IS NULL THEN 'no_fit' ELSE 'ok' END AS status, p_ref, slope, CASE WHEN vy > 1e-12 THEN 1 - greatest(vy - slope * c, 0) / vy END AS r2, sqrt(greatest(vy - slope * c, 0)) AS residual_sd, p_ref * 1000.0 / (1.163 * exp(my - slope * mx + slope * ln(p_ref))) AS spread_ref, flow_median, hot_share, CASE WHEN contract > 0 THEN flow_median / contract END AS flow_per_kw, contract FROM f LEFT JOIN k USING (entity))"""
OK = ", ".join(f"CASE WHEN status = 'ok' THEN {c} END AS {c}" for c in ("p_ref", "slope", "r2", "residual_sd", "spread_ref", "flow_median", "hot_share", "flow_per_kw"))


def _metrics(spark, sf):
    return W.winter_metrics(_free(spark, sf), "entity", "day", "power", "flow", "spread", "t", _contract(spark, sf), LEAST, 0.05)


@query("winter_metrics_status", f"WITH {WM}, o AS (SELECT entity, winter, n, status, {OK} FROM m) SELECT entity, winter, n, status, round(p_ref, 6) AS p_ref, round(slope, 5) AS slope, round(r2, 5) AS r2, round(residual_sd, 5) AS residual_sd, round(spread_ref, 4) AS spread_ref, round(flow_median, 6) AS flow_median, round(hot_share, 5) AS hot_share, round(flow_per_kw, 5) AS flow_per_kw FROM o")
def winter_metrics_status(spark, sf):
    r5 = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
    return _metrics(spark, sf).select("entity", "winter", "n", "status", *r6("p_ref"), *r5("slope", "r2", "residual_sd"), F.round("spread_ref", 4).alias("spread_ref"), *r6("flow_median"), *r5("hot_share", "flow_per_kw"))


CLASS = "CASE WHEN contract IS NULL THEN 'unknown' WHEN contract <= 45 THEN 'small' ELSE 'large' END"


def _zsql(tag: str, by: str) -> str:
    """Members' median, MAD and deviation of every metric by a grouping."""
    a = ", ".join(f"quantile_cont({c}, 0.5) FILTER (member) AS {tag}med_{c}, mad({c}) FILTER (member) AS {tag}mad_{c}, stddev_samp({c}) FILTER (member) AS {tag}sd_{c}" for c in METRICS)
    return f"{tag}s AS (SELECT {by}, count(*) FILTER (member) AS {tag}members, {a} FROM t GROUP BY ALL)"


def _pick(c: str, sign: int) -> str:
    z = lambda g: f"{sign} * ({c} - {g}med_{c}) / CASE WHEN {g}mad_{c} > 0 THEN 1.4826 * {g}mad_{c} WHEN {g}sd_{c} > 0 THEN {g}sd_{c} END"
    return f"CASE basis WHEN 'network' THEN {z('n')} WHEN 'class' THEN {z('g')} END AS z_{c}"


NETWORK = f"{WM}, t AS (SELECT entity, winter, status, entity % 7 <> 0 AS member, {CLASS} AS class, {OK} FROM m WHERE status = 'ok'), {_zsql('n', 'winter')}, {_zsql('g', 'winter, class')}, u AS (SELECT *, CASE WHEN nmembers < 5 THEN 'too_small' WHEN class <> 'unknown' AND gmembers >= 4 THEN 'class' ELSE 'network' END AS basis FROM t JOIN ns USING (winter) JOIN gs USING (winter, class)), z AS (SELECT entity, winter, member, basis, {', '.join(_pick(c, s) for c, s in METRICS.items())} FROM u)"


def _network(spark, sf):
    m = _metrics(spark, sf).where("status = 'ok'").join(_contract(spark, sf), "entity")
    m = m.withColumn("class", F.when(F.col("contract").isNull(), "unknown").when(F.col("contract") <= 45, "small").otherwise("large"))
    return W.against_network(m, "winter", METRICS, F.col("entity") % 7 != 0, "class", 5, 4)


@query("winter_network", f"WITH {NETWORK} SELECT entity, winter, member, basis, " + ", ".join(f"round(z_{c}, 4) AS z_{c}" for c in METRICS) + " FROM z")
def winter_network(spark, sf):
    return _network(spark, sf).select("entity", "winter", "member", "basis", *[F.round(f"z_{c}", 4).alias(f"z_{c}") for c in METRICS])


KNOWN = " + ".join(f"CAST(z_{c} IS NOT NULL AS INTEGER)" for c in METRICS)
MARKS = f"""{NETWORK}, s AS (SELECT *, ({' + '.join(f'coalesce(z_{c}, 0)' for c in METRICS)}) / nullif({KNOWN}, 0) AS score, {KNOWN} AS metrics_known FROM z), e AS (SELECT winter, {', '.join(f'quantile_cont(z_{c}, 0.7) FILTER (member) AS e_{c}' for c in METRICS)} FROM s GROUP BY 1),
b AS (SELECT s.*, {', '.join(f'coalesce(z_{c} >= e_{c} AND z_{c} > 0, false) AS bad_{c}' for c in METRICS)} FROM s JOIN e USING (winter)), r AS (SELECT *, {' + '.join(f'CAST(bad_{c} AS INTEGER)' for c in METRICS)} AS bad, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY winter ORDER BY score DESC NULLS LAST) END AS rank FROM b), mk AS (SELECT *, bad >= 2 AS flagged FROM r)"""


def _marks(spark, sf):
    return W.marks(_network(spark, sf), "winter", list(METRICS), 0.3)


@query("winter_marks", f"WITH {MARKS} SELECT entity, winter, metrics_known, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank, bad, flagged FROM mk")
def winter_marks(spark, sf):
    return _marks(spark, sf).select("entity", "winter", "metrics_known", F.round("score", 4).alias("score"), "rank", "bad", "flagged")


@query("winter_overview", f"WITH {MARKS} SELECT entity, count(DISTINCT winter) AS winters, count(*) FILTER (flagged) AS flagged_winters, round(quantile_cont(score, 0.5), 4) AS score_median, round(quantile_cont(rank, 0.5), 4) AS rank_median, coalesce(string_agg(winter, ',' ORDER BY {END}) FILTER (flagged), '') AS which, count(*) FILTER (flagged) >= 2 AS chronic FROM mk WHERE score IS NOT NULL GROUP BY 1")
def winter_overview(spark, sf):
    return W.overview(_marks(spark, sf), "entity", "winter").select("entity", "winters", "flagged_winters", F.round("score_median", 4).alias("score_median"), F.round("rank_median", 4).alias("rank_median"), "which", "chronic")


@query("fault_pattern", f"WITH {MARKS} SELECT entity, winter, CASE WHEN bad_slope AND bad_spread_ref THEN 'valve' WHEN bad_spread_ref AND (bad_hot_share OR bad_flow_per_kw) THEN 'flow' WHEN bad_residual_sd THEN 'unsteady' WHEN bad_slope THEN 'control' WHEN bad_hot_share THEN 'return' WHEN bad_flow_per_kw THEN 'flow_per_kw' ELSE '' END AS pattern FROM mk")
def fault_pattern(spark, sf):
    bad = F.array_compact(F.array(*[F.when(F.col(f"bad_{c}"), F.lit(c)) for c in METRICS]))
    return _marks(spark, sf).select("entity", "winter", W.pattern(bad).alias("pattern"))


ALARMS = f"al AS (SELECT entity, day, CASE WHEN entity % 2 = 0 THEN 'kwh_per_m3' ELSE 'log_volume' END AS channel, CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END AS direction FROM ({PANEL}) WHERE energy > 60)"
RATED = "ra AS (SELECT *, CASE WHEN (channel = 'kwh_per_m3' AND direction = -1) OR (channel = 'log_volume' AND direction = 1) THEN 'worse' ELSE 'better' END AS rating FROM al)"


def _rated(spark, sf):
    a = panel(spark, sf).where("energy > 60").select("entity", "day", F.when(F.col("entity") % 2 == 0, "kwh_per_m3").otherwise("log_volume").alias("channel"), F.when(F.col("n") % 2 == 1, 1).otherwise(-1).alias("direction"))
    return a.withColumn("rating", W.direction_rating("channel", "direction"))


@query("direction_rating", f"WITH {ALARMS}, {RATED} SELECT entity, day, channel, CAST(direction AS INTEGER) AS direction, rating FROM ra")
def direction_rating(spark, sf):
    return _rated(spark, sf)


@query("winter_priority", f"WITH {MARKS}, {ALARMS}, {RATED}, n AS (SELECT mk.entity, mk.winter, count(*) AS alarms, count(*) FILTER (rating = 'worse') AS worse FROM mk JOIN ra ON ra.entity = mk.entity AND ra.day BETWEEN make_date({END} - 1, 10, 1) AND make_date({END}, 4, 30) GROUP BY 1, 2) SELECT entity, winter, flagged, coalesce(alarms, 0) AS alarms, coalesce(worse, 0) AS worse, CASE WHEN flagged AND coalesce(worse, 0) > 0 THEN 'high' WHEN flagged OR coalesce(worse, 0) > 0 THEN 'medium' ELSE 'low' END AS level FROM mk LEFT JOIN n USING (entity, winter)")
def winter_priority(spark, sf):
    return W.priority(_marks(spark, sf), _rated(spark, sf), "entity", "day", "winter").select("entity", "winter", "flagged", "alarms", "worse", "level")


FOUND = f"fi AS (SELECT entity, day, day(day) % 2 = 1 AND entity % 3 = 0 AS valve, entity % 4 = 1 AS control FROM ({VISITS}))"


@query("finding_after_winter", f"WITH {MARKS}, {FOUND}, j AS (SELECT mk.entity, mk.winter, fi.day, valve, control, row_number() OVER (PARTITION BY mk.entity, mk.winter ORDER BY fi.day) AS rn FROM mk JOIN fi ON fi.entity = mk.entity AND fi.day > make_date({END}, 4, 30) AND fi.day <= make_date({END}, 4, 30) + 400) SELECT entity, winter, day AS visit, valve, control FROM j WHERE rn = 1")
def finding_after_winter(spark, sf):
    f = visits(spark, sf).withColumn("valve", (F.dayofmonth("day") % 2 == 1) & (F.col("entity") % 3 == 0)).withColumn("control", F.col("entity") % 4 == 1)
    return W.finding_after(_marks(spark, sf).select("entity", "winter"), f, "entity", "day", "winter", ["valve", "control"])


@query("winter_energy", f"WITH d AS (SELECT *, {LABEL} AS winter FROM ({POINTS})) SELECT entity, winter, count(*) AS n, round(CASE WHEN count(*) >= {LEAST} THEN avg(power) * 24 * (make_date({END}, 3, 1) - make_date({END} - 1, 12, 1)) END, 4) AS energy FROM d WHERE winter <> '' GROUP BY 1, 2")
def winter_energy(spark, sf):
    return W.winter_energy(points(spark, sf), "entity", "day", "power", LEAST).select("entity", "winter", "n", F.round("energy", 4).alias("energy"))


@query("degree_hours_by_winter", f"WITH d AS (SELECT CASE WHEN n < 3 THEN t_out END AS t_out, {LABEL} AS winter FROM (SELECT *, CAST(ts AS DATE) AS day FROM ({HOURS}))) SELECT winter, round(sum(greatest(15 - t_out, 0)), 4) AS degree_hours, count(t_out) AS hours FROM d WHERE winter <> '' GROUP BY 1")
def degree_hours_by_winter(spark, sf):
    h = hours(spark, sf).withColumn("day", F.to_date("ts")).withColumn("t_out", F.when(F.col("n") < 3, F.col("t_out")))
    return W.degree_hours_by_winter(h, "day", "t_out").select("winter", F.round("degree_hours", 4).alias("degree_hours"), "hours")


NORM = f"""d AS (SELECT entity, day, round(spread, 6) AS x, energy AS y, {LABEL} AS winter FROM ({PANEL})), s AS (SELECT entity, winter, count(*) AS n, max(x) - min(x) AS span FROM d WHERE winter <> '' GROUP BY 1, 2), g AS (SELECT d.* FROM d JOIN s USING (entity, winter) WHERE n >= 10 AND span >= 3),
ts AS (SELECT a.entity, a.winter, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM g a JOIN g b ON a.entity = b.entity AND a.winter = b.winter AND b.x > a.x GROUP BY 1, 2), md AS (SELECT entity, winter, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM g GROUP BY 1, 2),
m AS (SELECT s.*, slope, my - slope * mx + slope * 5 AS norm, entity % 7 <> 0 AS member FROM s LEFT JOIN ts USING (entity, winter) LEFT JOIN md USING (entity, winter)), w AS (SELECT winter, count(norm) FILTER (member) AS stations, quantile_cont(norm, 0.5) FILTER (member) AS median, mad(norm) FILTER (member) AS mad, stddev_samp(norm) FILTER (member) AS sd FROM m GROUP BY 1)"""


@query("norm_value", f"WITH {NORM} SELECT entity, winter, n, round(span, 6) AS span, round(slope, 5) AS slope, round(norm, 5) AS norm, stations, round(CASE WHEN stations >= 3 THEN median END, 5) AS median, round(CASE WHEN stations >= 3 THEN (median - norm) / 1.15 END, 5) AS distance, round(CASE WHEN stations >= 3 THEN (median - norm) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd END END, 4) AS z, CAST(CASE WHEN stations >= 3 AND member AND norm IS NOT NULL THEN rank() OVER (PARTITION BY winter, stations >= 3 AND member AND norm IS NOT NULL ORDER BY median - norm DESC) END AS INTEGER) AS rank FROM m JOIN w USING (winter)")
def norm_value(spark, sf):
    d = W.norm_value(panel(spark, sf).withColumn("spread", F.round("spread", 6)), "entity", "day", "spread", "energy", 5.0, 10, 3.0, F.col("entity") % 7 != 0, 3)
    r5 = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
    return d.select("entity", "winter", "n", *r6("span"), *r5("slope", "norm"), "stations", *r5("median", "distance"), F.round("z", 4).alias("z"), "rank")


def _window_sql(first: int, last: int) -> str:
    return f"""WITH v AS ({VISITS}), y AS (SELECT *, CAST(CASE WHEN month(day) IN (1, 2) THEN year(day) - 2 WHEN month(day) = 12 THEN year(day) - 1 ELSE year(day) - 1 END AS INTEGER) AS wb, CAST(CASE WHEN month(day) = 12 THEN year(day) + 1 ELSE year(day) END AS INTEGER) AS wa, month(day) IN (12, 1, 2) AS cut FROM v),
b AS (SELECT *, CAST(make_date(wb, {first}, 1) AS TIMESTAMP) AS b0, CAST(last_day(make_date(wb + 1, {last}, 1)) AS TIMESTAMP) + INTERVAL 23 HOUR AS b1, CAST(make_date(wa, {first}, 1) AS TIMESTAMP) AS a0, CAST(last_day(make_date(wa + 1, {last}, 1)) AS TIMESTAMP) + INTERVAL 23 HOUR AS a1, CAST(day AS TIMESTAMP) AS d FROM y),
h AS (SELECT *, date_diff('hour', a0, a1) AS whole, greatest(0, date_diff('hour', a0, d) + 24) AS head, greatest(0, date_diff('hour', d, b1) + 1) AS tail0 FROM b), t AS (SELECT *, CASE WHEN whole - head - tail0 < 0 THEN greatest(0, whole - head) ELSE tail0 END AS tail, greatest(0, whole - head - tail0) AS rest FROM h)
SELECT entity, day, wb AS winter_before, wa AS winter_after, cut, b0 + to_hours(head) AS before_start, b1 - to_hours(tail) AS before_end, a0 + to_hours(head) AS after_start, a1 - to_hours(tail) AS after_end, round(rest / CAST(whole AS DOUBLE), 6) AS window_share FROM t"""


@query("winter_windows", _window_sql(12, 2))
def winter_windows(spark, sf):
    d = W.winter_windows(visits(spark, sf), "day")
    return d.select("entity", "day", "winter_before", "winter_after", "cut", "before_start", "before_end", "after_start", "after_end", *r6("window_share"))


@query("winter_windows_extended", _window_sql(9, 4))
def winter_windows_extended(spark, sf):
    d = W.winter_windows(visits(spark, sf), "day", True)
    return d.select("entity", "day", "winter_before", "winter_after", "cut", "before_start", "before_end", "after_start", "after_end", *r6("window_share"))


@query("season_bounds", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(make_date(year(o_orderdate), 12, 1) AS TIMESTAMP) AS core_start, CAST(last_day(make_date(year(o_orderdate) + 1, 2, 1)) AS TIMESTAMP) + INTERVAL 23 HOUR AS core_end, CAST(make_date(year(o_orderdate), 9, 1) AS TIMESTAMP) AS extended_start, CAST(make_date(year(o_orderdate) + 1, 4, 30) AS TIMESTAMP) + INTERVAL 23 HOUR AS extended_end, make_date(year(o_orderdate), 10, 1) AS season_start, make_date(year(o_orderdate) + 1, 4, 30) AS season_end FROM orders")
def season_bounds(spark, sf):
    y = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    (c0, c1), (e0, e1) = W.season_bounds(F.col("year")), W.season_bounds(F.col("year"), True)
    s0, s1 = W.heating_season(X.winter_label(F.make_date(F.col("year"), F.lit(12), F.lit(1))))
    return y.select("year", c0.alias("core_start"), c1.alias("core_end"), e0.alias("extended_start"), e1.alias("extended_end"), F.add_months(s0, F.when(F.year(s0) - F.col("year") >= 100, -1200).otherwise(0)).alias("season_start"), F.add_months(s1, F.when(F.year(s1) - F.col("year") >= 100, -1200).otherwise(0)).alias("season_end"))


@query("savings_potential", f"WITH f AS (SELECT entity, avg(power) AS x, sum(flow) AS w, CASE WHEN entity % 3 = 0 THEN 'optimum' ELSE 'other' END AS g, entity % 5 = 0 AS special FROM ({POINTS}) GROUP BY 1), t AS (SELECT quantile_cont(x, 0.5) FILTER (g = 'optimum') AS target FROM f) SELECT round(sum(greatest(x - target, 0) * w), 3) AS with_special, round(sum(greatest(x - target, 0) * w) FILTER (NOT special), 3) AS without_special, round(any_value(target), 6) AS target FROM f, t")
def savings_potential(spark, sf):
    f = points(spark, sf).groupBy("entity").agg(F.avg("power").alias("x"), F.sum("flow").alias("w")).withColumn("g", F.when(F.col("entity") % 3 == 0, "optimum").otherwise("other")).withColumn("special", F.col("entity") % 5 == 0)
    return W.savings(f, "entity", "x", "w", "g", "optimum", "special").select(F.round("with_special", 3).alias("with_special"), F.round("without_special", 3).alias("without_special"), *r6("target"))


@query("efficiency", f"SELECT entity, round(sum(greatest(15 - t_out, 0)), 5) AS degree_hours, round(CASE WHEN sum(greatest(15 - t_out, 0)) >= 500 THEN sum(power) / sum(greatest(15 - t_out, 0)) END, 6) AS energy_per_dh, round(CASE WHEN sum(greatest(15 - t_out, 0)) >= 500 THEN sum(flow) / sum(greatest(15 - t_out, 0)) END, 6) AS volume_per_dh FROM ({HOURS}) GROUP BY 1")
def efficiency(spark, sf):
    h = hours(spark, sf).withColumn("dh", F.greatest(15 - F.col("t_out"), F.lit(0.0)))
    return W.efficiency(h, "entity", "power", "flow", "dh").select("entity", F.round("degree_hours", 5).alias("degree_hours"), *r6("energy_per_dh", "volume_per_dh"))
