"""Queries for monitoring and event tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import monitor as M
from tidemark.operators import stats as S
from tidemark.plans.adapters import DAILY, HOURLY, PANEL, VISITS, daily, hourly, panel, r6, visits
from tidemark.plans.registry import query

Z = f"d AS ({DAILY}), m AS (SELECT entity, median(mean_v) AS med, mad(mean_v) AS mad, stddev_samp(mean_v) AS sd FROM d GROUP BY 1), z AS (SELECT entity, day, (mean_v - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd END AS z FROM d JOIN m USING (entity))"


def _z(spark, sf):
    return S.robust_z(daily(spark, sf), "mean_v", ["entity"])


def _cusum(source: str, hs: str, cap: str) -> str:
    """The two-sided account as a recursive query over numbered days."""
    return f"""n AS (SELECT entity, h, day, z, {cap} AS cap, row_number() OVER (PARTITION BY entity, h ORDER BY day) AS i FROM {source}, (SELECT unnest({hs}) AS h) WHERE z IS NOT NULL),
c AS (SELECT entity, h, CAST(0 AS BIGINT) AS i, day, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, day AS fu, day AS fd, false AS ru, false AS rd, true AS au, true AS ad FROM n WHERE i = 1
UNION ALL SELECT entity, h, i, day, u, d, fu, fd, au AND u > h, ad AND d > h, u = 0 OR (au AND NOT u > h), d = 0 OR (ad AND NOT d > h)
FROM (SELECT c.entity, c.h, n.i, n.day, c.au, c.ad, CAST(least(greatest(c.up + n.z - 0.5, 0), n.cap) AS DOUBLE) AS u, CAST(least(greatest(c.down - n.z - 0.5, 0), n.cap) AS DOUBLE) AS d, CASE WHEN c.up = 0 THEN n.day ELSE c.fu END AS fu, CASE WHEN c.down = 0 THEN n.day ELSE c.fd END AS fd FROM c JOIN n ON n.entity = c.entity AND n.h = c.h AND n.i = c.i + 1))"""


ALARMS = _cusum("z", "[5.0]", "10.0")
ALARM_ROWS = "a AS (SELECT entity, day, 1 AS direction, fu AS start FROM c WHERE ru UNION ALL SELECT entity, day, -1, fd FROM c WHERE rd)"


CUSUM_SQL = f"WITH RECURSIVE {Z}, {ALARMS}, {ALARM_ROWS} SELECT * FROM a"


@query("cusum_two_sided", CUSUM_SQL)
def cusum_two_sided(spark, sf):
    return M.cusum(_z(spark, sf), "entity", "day", "z")


@query("cusum_threshold_sweep", f"WITH RECURSIVE {Z}, {_cusum('z', '[2.0, 3.0, 6.0]', 'greatest(10.0, 2 * h)')}, a AS (SELECT entity, h, day, 1 AS direction FROM c WHERE ru UNION ALL SELECT entity, h, day, -1 FROM c WHERE rd) SELECT CAST(h AS DOUBLE) AS h, direction, count(*) AS alarms, count(DISTINCT entity) AS entities FROM a GROUP BY 1, 2")
def cusum_threshold_sweep(spark, sf):
    a = M.cusum_sweep(_z(spark, sf), "entity", "day", "z", [2.0, 3.0, 6.0])
    return a.groupBy("h", "direction").agg(F.count(F.lit(1)).alias("alarms"), F.countDistinct("entity").alias("entities"))


@query("running_account", f"WITH {Z}, s AS (SELECT entity, day, sum(z - 0.5) OVER (PARTITION BY entity ORDER BY day) AS s FROM z WHERE z IS NOT NULL) SELECT entity, day, round(s - least(min(s) OVER (PARTITION BY entity ORDER BY day), 0), 5) AS up FROM s")
def running_account(spark, sf):
    return M.running_account(_z(spark, sf), "entity", "day", "z").select("entity", "day", F.round("up", 5).alias("up"))


WARN = f"{Z}, w AS (SELECT entity, day, z, coalesce(z > 0.3, false) AND coalesce(lag(z) OVER (PARTITION BY entity ORDER BY day) > 0.3, false) AS warning FROM z)"


@query("two_day_warning", f"WITH {WARN} SELECT entity, day, warning FROM w")
def two_day_warning(spark, sf):
    return M.warnings(_z(spark, sf), "entity", "day", "z", 0.3).select("entity", "day", "warning")


@query("quiet_alarm", f"WITH {WARN}, l AS (SELECT *, last_value(CASE WHEN warning THEN day END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM w) SELECT entity, day, warning, warning AND (l IS NULL OR day - l > 7) AS alarm FROM l")
def quiet_alarm(spark, sf):
    w = M.warnings(_z(spark, sf), "entity", "day", "z", 0.3)
    return M.quiet_alarms(w, "entity", "day", "warning").select("entity", "day", "warning", "alarm")


@query("persistence_14d", f"WITH {Z} SELECT entity, day, CAST(sum(CASE WHEN z > 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS flagged_days, sum(CASE WHEN z > 0.5 THEN 1 ELSE 0 END) OVER w >= 5 AS persistent FROM z WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)")
def persistence_14d(spark, sf):
    return M.persistent(_z(spark, sf), "entity", "day", F.col("z") > 0.5, 14, 5).select("entity", "day", "flagged_days", "persistent")


@query("rolling_corr_14d", f"SELECT entity, day, round(CASE WHEN count(*) OVER w >= 10 THEN corr(mean_v, sum_v) OVER w END, 5) AS corr FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)")
def rolling_corr_14d(spark, sf):
    return M.rolling_corr(daily(spark, sf), "entity", "day", "mean_v", "sum_v").select("entity", "day", F.round("corr", 5).alias("corr"))


@query("centred_median_trend", f"SELECT entity, day, round(CASE WHEN count(mean_v) OVER w >= 7 THEN median(mean_v) OVER w END, 6) AS trend FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)")
def centred_median_trend(spark, sf):
    return M.centred_median(daily(spark, sf), "entity", "day", "mean_v", 7, 6, 7).select("entity", "day", *r6("trend"))


@query("autocorr_lag1", f"WITH l AS (SELECT entity, mean_v, lag(mean_v) OVER (PARTITION BY entity ORDER BY day) AS l FROM ({DAILY})) SELECT entity, round(corr(mean_v, l), 6) AS phi FROM l GROUP BY 1")
def autocorr_lag1(spark, sf):
    return M.autocorrelation(daily(spark, sf), "entity", "day", "mean_v").select("entity", *r6("phi"))


@query("autocorr_adjacent", f"WITH l AS (SELECT entity, mean_v, CASE WHEN day - lag(day) OVER w = 1 THEN lag(mean_v) OVER w END AS l FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY day)) SELECT entity, round(corr(mean_v, l), 6) AS phi FROM l GROUP BY 1")
def autocorr_adjacent(spark, sf):
    return M.autocorrelation(daily(spark, sf), "entity", "day", "mean_v", adjacent=True).select("entity", *r6("phi"))


@query("jump_score", f"SELECT entity, day, round(CASE WHEN count(*) OVER a = 5 AND count(*) OVER b = 5 THEN median(mean_v) OVER a - median(mean_v) OVER b END, 6) AS jump FROM ({DAILY}) WINDOW a AS (PARTITION BY entity ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def jump_score(spark, sf):
    return M.jump_score(daily(spark, sf), "entity", "day", "mean_v").select("entity", "day", *r6("jump"))


JUMPS = f"j AS (SELECT entity, day, CASE WHEN count(*) OVER a = 5 AND count(*) OVER b = 5 THEN median(mean_v) OVER a - median(mean_v) OVER b END AS jump FROM ({DAILY}) WINDOW a AS (PARTITION BY entity ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"


@query("strongest_apart", f"""WITH RECURSIVE {JUMPS}, h AS (SELECT entity, day, jump, row_number() OVER (PARTITION BY entity ORDER BY abs(jump) DESC, day DESC, jump DESC) AS i FROM j WHERE abs(jump) >= 5),
r AS (SELECT entity, CAST(0 AS BIGINT) AS i, CAST([] AS DATE[]) AS days FROM h WHERE i = 1 UNION ALL SELECT r.entity, h.i, CASE WHEN len(list_filter(r.days, lambda d: abs(d - h.day) < 10)) > 0 THEN r.days ELSE list_append(r.days, h.day) END FROM r JOIN h ON h.entity = r.entity AND h.i = r.i + 1),
l AS (SELECT entity, unnest(days) AS day FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY i DESC) = 1) SELECT entity, day, round(jump, 6) AS jump FROM l JOIN h USING (entity, day)""")
def strongest_apart(spark, sf):
    return M.strongest_apart(M.jump_score(daily(spark, sf), "entity", "day", "mean_v"), "entity", "day", "jump", 5.0, 10).select("entity", "day", F.round("score", 6).alias("jump"))


@query("weekly_mean_expectation", f"SELECT entity, day, round(avg(mean_v) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS expected FROM ({DAILY})")
def weekly_mean_expectation(spark, sf):
    return M.weekly_expectation(daily(spark, sf), "entity", "day", "mean_v").select("entity", "day", *r6("expected"))


@query("hourly_expectation", f"SELECT entity, ts, round(avg(value) OVER (PARTITION BY entity, hour(ts) ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS expected FROM ({HOURLY})")
def hourly_expectation(spark, sf):
    h = hourly(spark, sf).withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})
    return M.weekly_expectation(h, "entity", "day", "value", "hour").select("entity", "ts", *r6("expected"))


CALIB = "cal AS (SELECT entity, median(mean_v) AS center, count(mean_v) AS cn, mad(mean_v) AS mad FROM d {where} GROUP BY 1)"


@query("calibration", f"WITH d AS ({DAILY}), {CALIB.format(where='')} SELECT entity, round(CASE WHEN cn >= 10 THEN center END, 6) AS center, round(CASE WHEN cn >= 10 THEN greatest(1.4826 * mad, 0.5) END, 5) AS scale FROM cal")
def calibration(spark, sf):
    return M.calibrate(daily(spark, sf), ["entity"], "mean_v").select("entity", *r6("center"), F.round("scale", 5).alias("scale"))


CHAIN = f"""d AS ({DAILY}), {CALIB.format(where="WHERE day <= DATE '2024-01-15'")}, r AS (SELECT entity, day, mean_v - center AS r, lag(mean_v - center) OVER (PARTITION BY entity ORDER BY day) AS l FROM d JOIN cal USING (entity) WHERE day <= DATE '2024-01-15' AND cn >= 5), p AS (SELECT entity, least(greatest(coalesce(CASE WHEN isnan(corr(r, l)) THEN NULL ELSE corr(r, l) END, 0), 0), 0.8) AS phi FROM r GROUP BY 1),
zz AS (SELECT entity, day, (mean_v - center) / (greatest(1.4826 * mad, 1e-6) * sqrt((1 + phi) / (1 - phi))) AS z FROM d JOIN cal USING (entity) JOIN p USING (entity) WHERE day > DATE '2024-01-15' AND cn >= 5)"""


@query("monitor_chain", f"WITH RECURSIVE {CHAIN}, {_cusum('zz', '[3.0]', '10.0')}, {ALARM_ROWS} SELECT * FROM a")
def monitor_chain(spark, sf):
    """The flagship: readings to days, references with autocorrelation, standardized deviations, two-sided CUSUM alarms."""
    return M.monitor(daily(spark, sf), "entity", "day", "mean_v", "2024-01-15", least=5, h=3.0)


# ---------------------------------------------------------------- events

HOT = f"h AS (SELECT entity, day FROM ({PANEL}) WHERE energy > 80), v AS ({VISITS}), o AS (SELECT DISTINCT entity, day FROM ({PANEL}))"


def _alarms(spark, sf):
    return panel(spark, sf).where("energy > 80").select("entity", "day")


HIT = f"""WITH {HOT}, c AS (SELECT entity AS case_key, day AS case_day FROM v), own AS (SELECT case_key, case_day, count(*) > 0 AS hit FROM c JOIN h ON h.entity = case_key AND h.day BETWEEN case_day - 7 AND case_day + 60 GROUP BY 1, 2),
w AS (SELECT case_key, case_day, o.entity, EXISTS (SELECT 1 FROM h WHERE h.entity = o.entity AND h.day BETWEEN case_day - 7 AND case_day + 60) AS a FROM c JOIN o ON o.entity <> case_key AND o.day BETWEEN case_day - 7 AND case_day + 60 WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.entity = o.entity AND v.day BETWEEN case_day - 7 AND case_day + 60) GROUP BY 1, 2, 3 HAVING count(DISTINCT o.day) >= 3),
r AS (SELECT case_key, case_day, count(*) AS controls, count(*) FILTER (a) AS control_hits FROM w GROUP BY 1, 2), t AS (SELECT case_key, case_day, coalesce(hit, false) AS hit, coalesce(controls, 0) AS controls, coalesce(control_hits, 0) AS control_hits, CAST(control_hits AS DOUBLE) / controls AS control_rate FROM c LEFT JOIN own USING (case_key, case_day) LEFT JOIN r USING (case_key, case_day))"""


def _tested(spark, sf):
    return E.hit_test(visits(spark, sf), _alarms(spark, sf), panel(spark, sf).select("entity", "day"), least_days=3)


@query("hit_test_vs_control", HIT + " SELECT case_key, case_day, hit, controls, control_hits, round(control_rate, 6) AS control_rate FROM t")
def hit_test_vs_control(spark, sf):
    return _tested(spark, sf).select("case_key", "case_day", "hit", "controls", "control_hits", *r6("control_rate"))


@query("hit_balance", HIT + " SELECT count(*) AS cases, count(*) FILTER (hit) AS hits, round(sum(control_rate), 6) AS expected, round(count(*) FILTER (hit) / sum(control_rate), 6) AS leverage FROM t WHERE controls >= 1")
def hit_balance(spark, sf):
    return E.hit_balance(_tested(spark, sf)).select("cases", "hits", *r6("expected", "leverage"))


@query("diff_in_diff", f"""WITH p AS ({PANEL}), v AS (SELECT * FROM ({VISITS}) WHERE entity % 2 = 0), s AS (SELECT v.entity AS case_key, v.day AS case_day, p.entity, avg(energy) FILTER (p.day BETWEEN v.day - 60 AND v.day - 1) AS b, avg(energy) FILTER (p.day BETWEEN v.day + 1 AND v.day + 60) AS a, count(*) FILTER (p.day BETWEEN v.day - 60 AND v.day - 1) AS nb, count(*) FILTER (p.day BETWEEN v.day + 1 AND v.day + 60) AS na FROM v JOIN p ON p.day BETWEEN v.day - 60 AND v.day + 60 GROUP BY 1, 2, 3 HAVING nb >= 3 AND na >= 3),
c AS (SELECT case_key, case_day, median(a - b) AS control_change, count(*) AS controls FROM s WHERE entity NOT IN (SELECT entity FROM v) GROUP BY 1, 2)
SELECT s.case_key, s.case_day, round(a - b, 6) AS change, round(control_change, 6) AS control_change, coalesce(controls, 0) AS controls, round(CASE WHEN controls >= 3 THEN a - b - control_change END, 6) AS effect FROM s LEFT JOIN c USING (case_key, case_day) WHERE s.entity = s.case_key""")
def diff_in_diff(spark, sf):
    d = E.diff_in_diff(panel(spark, sf), visits(spark, sf).where("entity % 2 = 0"), "energy", days=60, least_controls=3)
    return d.select("case_key", "case_day", *r6("change", "control_change"), "controls", *r6("effect"))


@query("alarm_visit_nearest", f"WITH {HOT}, j AS (SELECT h.entity, h.day, v.day AS nearest_day, row_number() OVER (PARTITION BY h.entity, h.day ORDER BY abs(v.day - h.day), v.day) AS rn FROM h LEFT JOIN v ON v.entity = h.entity) SELECT entity, day, nearest_day, CAST(nearest_day - day AS INTEGER) AS days_off FROM j WHERE rn = 1")
def alarm_visit_nearest(spark, sf):
    return E.nearest_event(_alarms(spark, sf), visits(spark, sf))


@query("simultaneous_events", f"WITH {HOT} SELECT a.day, count(DISTINCT b.entity) AS entities, count(DISTINCT b.entity) >= 3 AS network_event FROM (SELECT DISTINCT day FROM h) a JOIN h b ON b.day BETWEEN a.day - 7 AND a.day + 7 GROUP BY 1")
def simultaneous_events(spark, sf):
    return E.simultaneous(_alarms(spark, sf))


@query("before_after_buffered", f"WITH f AS (SELECT entity, min(day) AS d FROM ({VISITS}) GROUP BY 1) SELECT p.entity, p.day, CASE WHEN p.day - d < -14 THEN 'before' WHEN p.day - d > 14 THEN 'after' WHEN d IS NOT NULL THEN 'buffer' END AS side FROM ({PANEL}) p LEFT JOIN f USING (entity)")
def before_after_buffered(spark, sf):
    return E.buffered_side(panel(spark, sf), visits(spark, sf)).select("entity", "day", "side")


@query("random_baseline_rate", f"WITH {HOT}, d AS (SELECT entity, count(DISTINCT day) AS days FROM o GROUP BY 1), k AS (SELECT entity, count(*) AS alarms FROM h GROUP BY 1) SELECT entity, coalesce(alarms, 0) AS alarms, days, round(1 - pow(1 - least(1.0, 15.0 / days), coalesce(alarms, 0)), 6) AS chance FROM d LEFT JOIN k USING (entity)")
def random_baseline_rate(spark, sf):
    return E.random_rate(panel(spark, sf), _alarms(spark, sf)).select("entity", "alarms", "days", *r6("chance"))


@query("first_alarm_after", f"WITH {HOT} SELECT v.entity, v.day, min(h.day) AS first_alarm, CAST(min(h.day) - v.day AS INTEGER) AS delay FROM v LEFT JOIN h ON h.entity = v.entity AND h.day BETWEEN v.day AND v.day + 60 GROUP BY 1, 2")
def first_alarm_after(spark, sf):
    return E.first_after(visits(spark, sf), _alarms(spark, sf))


@query("alarms_on_days", f"WITH {HOT} SELECT h.entity, h.day FROM h SEMI JOIN (SELECT entity, day FROM ({PANEL}) WHERE volume > 100) x ON x.entity = h.entity AND x.day = h.day")
def alarms_on_days(spark, sf):
    """Alarms on days on which the entity had much volume."""
    return _alarms(spark, sf).join(panel(spark, sf).where("volume > 100").select("entity", "day"), ["entity", "day"], "left_semi")


@query("common_days", f"WITH {HOT} SELECT entity, day FROM h INTERSECT SELECT entity, day FROM ({PANEL}) WHERE n >= 2")
def common_days(spark, sf):
    """Entity days that are both in the alarms and among the days with several rows."""
    return _alarms(spark, sf).intersect(panel(spark, sf).where("n >= 2").select("entity", "day"))
