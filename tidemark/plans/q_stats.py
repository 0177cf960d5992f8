"""Queries for daily values, panels, peers, curves and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.operators import daily as D
from tidemark.operators import stats as S
from tidemark.plans.adapters import DAILY, PANEL, POINTS, READINGS, daily, panel, points, r6, readings, table
from tidemark.plans.registry import query


@query("day_values", f"SELECT entity, day, n, round(mean_v, 6) AS mean_v, round(sum_v, 6) AS sum_v, round(CASE WHEN sum_v > 0 THEN ln(sum_v) END, 6) AS log_sum, max_v FROM ({DAILY})")
def day_values(spark, sf):
    return daily(spark, sf).select("entity", "day", "n", *r6("mean_v", "sum_v"), F.round(F.when(F.col("sum_v") > 0, F.ln("sum_v")), 6).alias("log_sum"), "max_v")


@query("day_performance", f"SELECT entity, day, round(CASE WHEN volume >= 25 THEN energy / volume END, 6) AS performance, volume < 25 AS small_volume, coalesce(energy / volume NOT BETWEEN 0.2 AND 1.2, false) AS out_of_band, n >= 1 AND volume >= 25 AND energy / volume BETWEEN 0.2 AND 1.2 AS valid FROM ({PANEL})")
def day_performance(spark, sf):
    return D.performance(panel(spark, sf), "energy", "volume", least_volume=25, band=(0.2, 1.2), least_rows=1).select("entity", "day", *r6("performance"), "small_volume", "out_of_band", "valid")


REASONS = f"""WITH p AS (SELECT *, lag(day) OVER w AS before, lag(energy) OVER w AS e0 FROM ({PANEL}) WINDOW w AS (PARTITION BY entity ORDER BY day)), f AS (SELECT entity, day, n < 2 AS few_rows, energy <= 10 AS standstill, spread IS NULL OR spread <= 1 AS no_spread, coalesce(day - before = 1 AND e0 <= 10, false) AS after_standstill, volume > 150 AS jump FROM p),
g AS (SELECT entity, day, concat_ws(', ', CASE WHEN few_rows THEN 'few_rows' END, CASE WHEN standstill THEN 'standstill' END, CASE WHEN no_spread THEN 'no_spread' END, CASE WHEN after_standstill THEN 'after_standstill' END, CASE WHEN jump THEN 'jump' END) AS reasons, NOT (standstill OR no_spread OR after_standstill OR jump) AS usable FROM f)"""


def _reasons(spark, sf):
    w = Window.partitionBy("entity").orderBy("day")
    p = panel(spark, sf)
    after = F.coalesce((F.datediff("day", F.lag("day").over(w)) == 1) & (F.lag("energy").over(w) <= 10), F.lit(False))
    flags = {"few_rows": F.col("n") < 2, "standstill": F.col("energy") <= 10, "no_spread": F.col("spread").isNull() | (F.col("spread") <= 1), "after_standstill": after, "jump": F.col("volume") > 150}
    return D.flag(p, flags, ignored=("few_rows",))


@query("reasons_and_usable", REASONS + " SELECT entity, day, reasons, usable FROM g")
def reasons_and_usable(spark, sf):
    return _reasons(spark, sf).select("entity", "day", "reasons", "usable")


@query("reason_balance", REASONS + ", u AS (SELECT unnest(string_split(reasons, ', ')) AS reason, usable FROM g WHERE reasons <> '') SELECT reason, count(*) AS days, count(*) FILTER (usable) AS still_usable FROM u GROUP BY 1")
def reason_balance(spark, sf):
    return D.balance(_reasons(spark, sf))


@query("day_panel", f"WITH p AS ({PANEL}), t AS (SELECT day, avg(t) AS t_net, count(*) AS rows FROM p GROUP BY 1) SELECT p.entity, p.day, round(energy, 6) AS energy, round(CASE WHEN rows >= 2 THEN t_net END, 9) AS t_net, p.n >= 2 AS enough FROM p LEFT JOIN t USING (day)")
def day_panel(spark, sf):
    p = panel(spark, sf)
    return D.with_daily_context(p, p.groupBy("day").agg(F.avg("t").alias("t_net"), F.count(F.lit(1)).alias("rows")), "day", "t_net", "rows", 2).select("entity", "day", *r6("energy"), F.round("t_net", 9).alias("t_net"), (F.col("n") >= 2).alias("enough"))


@query("state_shares", f"SELECT entity, day, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (event_type = '{t}') / count(*), 6) AS share_{t}" for t in ("click", "view", "purchase")) + f" FROM (SELECT *, CAST(ts AS DATE) AS day FROM ({READINGS})) GROUP BY 1, 2")
def state_shares(spark, sf):
    return D.state_shares(readings(spark, sf).withColumn("day", F.to_date("ts")), ["entity", "day"], "event_type", ["click", "view", "purchase"]).select("entity", "day", "n", *r6("share_click", "share_view", "share_purchase"))


@query("station_features", f"""SELECT entity, count(*) AS n, round(avg(CASE WHEN month(day) IN (12, 1, 2, 3) THEN flow END), 6) AS winter_mean, round(quantile_cont(flow, 0.95), 9) AS p95, round(avg(CASE WHEN power > 40 THEN 1.0 ELSE 0 END), 6) AS loaded_share, round(stddev_samp(flow), 6) AS sd, round(sum(flow) * 8760 / greatest(max(day) - min(day), 1) / 24, 6) AS per_year, round(quantile_cont(flow, 0.5) / greatest(max(flow), 0.1), 6) AS level FROM ({POINTS}) GROUP BY 1""")
def station_features(spark, sf):
    return D.features(points(spark, sf), "entity", "day", "flow", "power").select("entity", "n", *r6("winter_mean", "loaded_share", "sd", "per_year", "level"), F.round("p95", 9).alias("p95"))


@query("monthly_p95_slope", f"WITH m AS (SELECT entity, year(day) * 12 + month(day) AS m, quantile_cont(flow, 0.95) AS p FROM ({POINTS}) GROUP BY 1, 2) SELECT entity, count(*) AS months, round(CASE WHEN count(*) >= 6 THEN regr_slope(p, m) END, 6) AS slope FROM m GROUP BY 1")
def monthly_p95_slope(spark, sf):
    return D.monthly_trend(points(spark, sf), "entity", "day", "flow", 0.95, 6).select("entity", "months", *r6("slope"))


@query("weighted_efficiency_month", f"WITH m AS (SELECT date_trunc('month', day) AS month, sum(spread * flow) / sum(flow) AS efficiency, count(DISTINCT entity) AS stations FROM ({POINTS}) GROUP BY 1) SELECT CAST(month AS DATE) AS month, round(efficiency, 6) AS efficiency, stations, stations >= 0.6 * max(stations) OVER () AS comparable FROM m")
def weighted_efficiency_month(spark, sf):
    m = points(spark, sf).groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).agg(S.weighted_mean("spread", "flow").alias("efficiency"), F.countDistinct("entity").alias("stations"))
    top = m.agg(F.max("stations").alias("top"))
    return m.crossJoin(F.broadcast(top)).select("month", *r6("efficiency"), "stations", (F.col("stations") >= 0.6 * F.col("top")).alias("comparable"))


@query("bubbles", f"SELECT flag, floor(spread / 2) * 2 + 1.0 AS x_mid, count(*) AS n, round(sum(flow * power) / sum(power), 6) AS y FROM ({POINTS}) GROUP BY 1, 2")
def bubbles(spark, sf):
    return points(spark, sf).groupBy("flag", (F.floor(F.col("spread") / 2) * 2 + F.lit(1.0)).cast("double").alias("x_mid")).agg(F.count(F.lit(1)).alias("n"), F.round(S.weighted_mean("flow", "power"), 6).alias("y"))


@query("robust_z_global", f"WITH v AS (SELECT entity, avg(value) AS v FROM ({READINGS}) GROUP BY 1), m AS (SELECT median(v) AS med, mad(v) AS mad FROM v) SELECT entity, round((v - med) / (1.4826 * mad), 6) AS z FROM v, m")
def robust_z_global(spark, sf):
    v = readings(spark, sf).groupBy("entity").agg(F.avg("value").alias("v"))
    return S.robust_z(v, "v", []).select("entity", *r6("z"))


@query("robust_z_by_day", f"WITH d AS ({DAILY}), m AS (SELECT day, median(mean_v) AS med, mad(mean_v) AS mad, count(*) AS c, stddev_samp(mean_v) AS sd FROM d GROUP BY 1) SELECT entity, day, round(CASE WHEN c >= 5 THEN -(mean_v - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd END END, 6) AS z FROM d JOIN m USING (day)")
def robust_z_by_day(spark, sf):
    return S.robust_z(daily(spark, sf), "mean_v", ["day"], sign=-1, least=5).select("entity", "day", *r6("z"))


@query("robust_z_reference", f"WITH d AS ({DAILY}), m AS (SELECT day, median(mean_v) FILTER (entity % 5 <> 0) AS med, mad(mean_v) FILTER (entity % 5 <> 0) AS mad, count(mean_v) FILTER (entity % 5 <> 0) AS c, stddev_samp(mean_v) FILTER (entity % 5 <> 0) AS sd FROM d GROUP BY 1) SELECT entity, day, round(CASE WHEN c >= 5 THEN (mean_v - med) / CASE WHEN mad > 0 THEN 1.4826 * mad END END, 6) AS z FROM d JOIN m USING (day)")
def robust_z_reference(spark, sf):
    return S.robust_z(daily(spark, sf), "mean_v", ["day"], member=F.col("entity") % 5 != 0, least=5, fallback_std=False).select("entity", "day", *r6("z"))


@query("quantile_bands", f"SELECT day, count(*) AS n, " + ", ".join(f"round(CASE WHEN count(*) >= 5 THEN quantile_cont(mean_v, {q}) END, 9) AS {n}" for n, q in (("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9), ("best", 0.125))) + f" FROM ({DAILY}) GROUP BY 1")
def quantile_bands(spark, sf):
    return D.bands(daily(spark, sf), ["day"], "mean_v", {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "best": 0.125}, 5).select("day", "n", *[F.round(c, 9).alias(c) for c in ("q10", "q25", "q50", "q75", "q90", "best")])


WINTER = f"w AS (SELECT *, CASE WHEN month(day) = 12 THEN printf('%02d/%02d', year(day) % 100, (year(day) + 1) % 100) WHEN month(day) IN (1, 2) THEN printf('%02d/%02d', (year(day) - 1) % 100, year(day) % 100) ELSE '' END AS winter FROM ({POINTS})), k AS (SELECT entity, winter, count(*) AS n, avg(flow) AS level, avg(spread) AS spread FROM w WHERE winter <> '' GROUP BY 1, 2)"


def _winter(spark, sf):
    w = points(spark, sf).withColumn("winter", X.winter_label("day")).where("winter <> ''")
    return w.groupBy("entity", "winter").agg(F.count(F.lit(1)).alias("n"), F.avg("flow").alias("level"), F.avg("spread").alias("spread"))


@query("winter_metrics", f"WITH {WINTER} SELECT entity, winter, n, round(CASE WHEN n >= 5 THEN level END, 6) AS level, CASE WHEN n >= 5 THEN '' ELSE 'few_points' END AS reason FROM k")
def winter_metrics(spark, sf):
    return _winter(spark, sf).select("entity", "winter", "n", F.round(F.when(F.col("n") >= 5, F.col("level")), 6).alias("level"), F.when(F.col("n") >= 5, "").otherwise("few_points").alias("reason"))


@query("decile_flags", f"WITH {WINTER}, q AS (SELECT winter, median(level) AS ml, mad(level) AS dl, median(spread) AS ms, mad(spread) AS ds FROM k GROUP BY 1), z AS (SELECT entity, winter, (level - ml) / (1.4826 * dl) AS z1, -(spread - ms) / (1.4826 * ds) AS z2 FROM k JOIN q USING (winter) WHERE dl > 0 AND ds > 0), t AS (SELECT winter, quantile_cont(z1, 0.9) AS t1, quantile_cont(z2, 0.9) AS t2 FROM z GROUP BY 1) SELECT entity, winter, round(z1, 6) AS z1, round(z2, 6) AS z2, CAST(z1 >= t1 AND z1 > 0 AS INTEGER) + CAST(z2 >= t2 AND z2 > 0 AS INTEGER) AS hits, z1 >= t1 AND z1 > 0 AND z2 >= t2 AND z2 > 0 AS flagged, rank() OVER (PARTITION BY winter ORDER BY z1 + z2 DESC) AS worst FROM z JOIN t USING (winter)")
def decile_flags(spark, sf):
    k = S.robust_z(S.robust_z(_winter(spark, sf), "level", ["winter"], fallback_std=False, out="z1"), "spread", ["winter"], sign=-1, fallback_std=False, out="z2").where("z1 is not null and z2 is not null")
    return D.decile_flags(k, ["winter"], ["z1", "z2"], 0.9, 2).withColumn("worst", F.rank().over(Window.partitionBy("winter").orderBy(F.desc(F.col("z1") + F.col("z2"))))).select("entity", "winter", *r6("z1", "z2"), "hits", "flagged", "worst")


@query("chronic", f"WITH {WINTER}, q AS (SELECT winter, quantile_cont(level, 0.8) AS t FROM k GROUP BY 1), f AS (SELECT entity, winter, level >= t AS hit FROM k JOIN q USING (winter)) SELECT entity, count(*) AS winters, count(*) FILTER (hit) AS hits, coalesce(string_agg(winter, ', ' ORDER BY winter) FILTER (hit), '') AS which, count(*) FILTER (hit) >= 2 AS chronic FROM f GROUP BY 1")
def chronic(spark, sf):
    k = _winter(spark, sf)
    f = k.join(k.groupBy("winter").agg(F.percentile("level", F.lit(0.8)).alias("t")), "winter").withColumn("hit", F.col("level") >= F.col("t"))
    return D.chronic(f, "entity", "winter", "hit", 2)


@query("latest_winter", f"WITH {WINTER} SELECT entity, winter, n FROM k QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CAST(string_split(winter, '/')[2] AS INTEGER) DESC) = 1")
def latest_winter(spark, sf):
    k = _winter(spark, sf)
    return k.groupBy("entity").agg(F.max_by(F.struct("winter", "n"), X.winter_end_year("winter")).alias("s")).select("entity", "s.winter", "s.n")


@query("best_quartile_gap", f"WITH {WINTER}, q AS (SELECT winter, quantile_cont(level, 0.125) AS best FROM k GROUP BY 1) SELECT entity, winter, round(greatest(level - best, 0), 6) AS gap FROM k JOIN q USING (winter)")
def best_quartile_gap(spark, sf):
    k = _winter(spark, sf)
    return k.join(k.groupBy("winter").agg(F.percentile("level", F.lit(0.125)).alias("best")), "winter").select("entity", "winter", F.round(F.greatest(F.col("level") - F.col("best"), F.lit(0.0)), 6).alias("gap"))


@query("knn_peers", f"WITH {WINTER}, p AS (SELECT a.winter, a.entity, b.entity AS peer, row_number() OVER (PARTITION BY a.winter, a.entity ORDER BY abs(ln(a.level) - ln(b.level)), b.entity) AS rank FROM k a JOIN k b ON a.winter = b.winter AND a.entity <> b.entity) SELECT * FROM p WHERE rank <= 5")
def knn_peers(spark, sf):
    return S.nearest_peers(_winter(spark, sf).withColumn("x", F.ln("level")), "entity", "x", ["winter"], 5)


@query("loglog_fit", f"SELECT entity, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN regr_slope(ln(flow), ln(power)) END, 6) AS slope, round(CASE WHEN count(*) >= 30 THEN regr_intercept(ln(flow), ln(power)) END, 6) AS intercept, round(CASE WHEN count(*) >= 30 THEN regr_r2(ln(flow), ln(power)) END, 6) AS r2 FROM ({POINTS}) GROUP BY 1")
def loglog_fit(spark, sf):
    return S.loglog_fit(points(spark, sf), ["entity"], "power", "flow").select("entity", "n", *r6("slope", "intercept"), F.round(F.when(F.col("slope").isNotNull(), F.col("r2")), 6).alias("r2"))


@query("modulation_split", f"WITH m AS (SELECT entity, ln(power) AS p, ln(flow) AS f, ln(spread) AS s FROM ({POINTS}) WHERE power > 0 AND flow > 0 AND spread > 0) SELECT entity, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN covar_pop(f, p) / var_pop(p) END, 6) AS share_flow, round(CASE WHEN count(*) >= 30 THEN covar_pop(s, p) / var_pop(p) END, 6) AS share_spread FROM m GROUP BY 1")
def modulation_split(spark, sf):
    return S.modulation(points(spark, sf), ["entity"], "power", "flow", "spread").select("entity", "n", *r6("share_flow", "share_spread"))


@query("theil_sen", f"WITH d AS (SELECT entity, day - DATE '2024-01-01' AS x, mean_v AS y FROM ({DAILY})), p AS (SELECT a.entity, (b.y - a.y) / (b.x - a.x) AS s FROM d a JOIN d b ON a.entity = b.entity AND a.x < b.x), s AS (SELECT entity, median(s) AS slope FROM p GROUP BY 1), m AS (SELECT entity, median(x) AS mx, median(y) AS my FROM d GROUP BY 1) SELECT entity, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM s JOIN m USING (entity)")
def theil_sen(spark, sf):
    d = daily(spark, sf).withColumn("x", F.datediff("day", F.lit("2024-01-01").cast("date")))
    return S.theil_sen(d, ["entity"], "x", "mean_v").select("entity", *r6("slope", "intercept"))


CURVE = f"c AS (SELECT flag, (floor(spread / 2) + 0.5) * 2 AS x_mid, median(flow) AS y_mid, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2 HAVING count(*) >= 8)"


@query("class_curve", f"WITH {CURVE} SELECT flag, x_mid, round(y_mid, 9) AS y_mid, n FROM c")
def class_curve(spark, sf):
    return S.class_curve(points(spark, sf), ["flag"], "spread", "flow").select("flag", "x_mid", F.round("y_mid", 9).alias("y_mid"), "n")


@query("curve_expectation", f"WITH {CURVE}, p AS (SELECT flag, l_orderkey, l_linenumber, spread, flow FROM ({POINTS})), s AS (SELECT *, lead(x_mid) OVER (PARTITION BY flag ORDER BY x_mid) AS x2, lead(y_mid) OVER (PARTITION BY flag ORDER BY x_mid) AS y2, first_value(x_mid) OVER (PARTITION BY flag ORDER BY x_mid) AS x0 FROM c) SELECT l_orderkey, l_linenumber, round(flow, 6) AS flow, round(CASE WHEN p.spread < x0 OR x2 IS NULL THEN y_mid ELSE y_mid + (y2 - y_mid) * (p.spread - x_mid) / (x2 - x_mid) END, 9) AS expected FROM p JOIN s ON p.flag = s.flag AND ((p.spread >= x_mid AND (x2 IS NULL OR p.spread < x2)) OR (p.spread < x0 AND x_mid = x0))")
def curve_expectation(spark, sf):
    p = points(spark, sf)
    return S.curve_value(p, S.class_curve(p, ["flag"], "spread", "flow"), ["flag"], "spread").select("l_orderkey", "l_linenumber", *r6("flow"), F.round("expected", 9).alias("expected"))


@query("weather_decomposition", f"SELECT entity, count(*) AS n, round(CASE WHEN count(*) >= 30 AND var_pop(15 - t * 100) > 0 THEN regr_intercept(energy, 15 - t * 100) END, 6) AS base, round(CASE WHEN count(*) >= 30 AND var_pop(15 - t * 100) > 0 THEN regr_slope(energy, 15 - t * 100) END, 6) AS slope FROM ({PANEL}) GROUP BY 1")
def weather_decomposition(spark, sf):
    return D.weather_fit(panel(spark, sf).withColumn("hdd", 15 - F.col("t") * 100), ["entity"], "hdd", "energy", 30).select("entity", "n", *r6("base", "slope"))


@query("pooled_residual", f"WITH p AS ({PANEL}), f AS (SELECT regr_slope(energy, spread) AS b, regr_intercept(energy, spread) AS a FROM p) SELECT entity, day, round(energy - a - b * spread, 5) AS residual FROM p, f")
def pooled_residual(spark, sf):
    p = panel(spark, sf)
    return S.residual(p, S.ols(p, ["spread"], "energy"), "energy").select("entity", "day", F.round("residual", 5).alias("residual"))


@query("ols_by_flag", f"SELECT flag, count(*) AS n, round(regr_slope(flow, power), 6) AS slope, round(regr_intercept(flow, power), 6) AS intercept, round(sqrt((regr_syy(flow, power) - regr_slope(flow, power) * regr_sxy(flow, power)) / (count(*) - 2) / regr_sxx(flow, power)), 6) AS se FROM ({POINTS}) GROUP BY 1")
def ols_by_flag(spark, sf):
    return D.line_by_group(points(spark, sf), ["flag"], "power", "flow").select("flag", "n", *r6("slope", "intercept", "se"))


@query("auc_by_source", "WITH d AS (SELECT source, quality, n_chars FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0 AS r FROM d) SELECT source, round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / nullif(CAST(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0) AS DOUBLE), 0), 6) AS auc, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg FROM r GROUP BY 1")
def auc_by_source(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return S.auc(d, "quality", "n_chars", ["source"]).select("source", *r6("auc"), "n_pos", "n_neg")


@query("spearman_by_entity", f"WITH r AS (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY n) + (count(*) OVER (PARTITION BY entity, n) - 1) / 2.0 AS a, rank() OVER (PARTITION BY entity ORDER BY mean_v) + (count(*) OVER (PARTITION BY entity, mean_v) - 1) / 2.0 AS b FROM ({DAILY})) SELECT entity, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1")
def spearman_by_entity(spark, sf):
    return S.spearman(daily(spark, sf), "n", "mean_v", ["entity"]).select("entity", *r6("rho"), "n")


@query("holm", f"WITH p AS (SELECT entity, (entity * 37 % 101 + 1) / 2000.0 AS p FROM (SELECT DISTINCT entity FROM ({READINGS}))), s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1)) AS s FROM p) SELECT entity, round(p, 6) AS p, round(max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s")
def holm(spark, sf):
    p = readings(spark, sf).select("entity").distinct().withColumn("p", (F.col("entity") * 37 % 101 + 1) / 2000.0)
    return S.holm(p, "p").select("entity", *r6("p", "p_holm"))


@query("normal_score", f"WITH v AS (SELECT entity, avg(value) AS v FROM ({READINGS}) GROUP BY 1) SELECT entity, round((rank() OVER (ORDER BY v) - 0.5) / count(*) OVER (), 6) AS p FROM v")
def normal_score(spark, sf):
    v = readings(spark, sf).groupBy("entity").agg(F.avg("value").alias("v"))
    n = v.agg(F.count(F.lit(1)).alias("c"))
    return v.crossJoin(F.broadcast(n)).select("entity", F.round((F.rank().over(Window.orderBy("v")) - 0.5) / F.col("c"), 6).alias("p"))


@query("jaccard_topk", f"WITH v AS (SELECT entity, avg(value) AS a, count(*) AS b FROM ({READINGS}) GROUP BY 1), x AS (SELECT entity FROM v ORDER BY a DESC, entity LIMIT 8), y AS (SELECT entity FROM v ORDER BY b DESC, entity LIMIT 8) SELECT (SELECT count(*) FROM x JOIN y USING (entity)) AS both_sets, round((SELECT count(*) FROM x JOIN y USING (entity)) / CAST((SELECT count(*) FROM (SELECT entity FROM x UNION SELECT entity FROM y)) AS DOUBLE), 6) AS jaccard")
def jaccard_topk(spark, sf):
    v = readings(spark, sf).groupBy("entity").agg(F.avg("value").alias("a"), F.count(F.lit(1)).alias("b"))
    x = v.orderBy(F.desc("a"), "entity").limit(8).select("entity", F.lit(1).alias("x"))
    y = v.orderBy(F.desc("b"), "entity").limit(8).select("entity", F.lit(1).alias("y"))
    return x.join(y, "entity", "full").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("both_sets"), F.count(F.lit(1)).alias("c")).select("both_sets", F.round(F.col("both_sets") / F.col("c"), 6).alias("jaccard"))
