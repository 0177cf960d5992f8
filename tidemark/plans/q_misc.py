"""Queries for graphs, texts, rules, scores, models and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.functions import text as T
from tidemark.operators import graph as G
from tidemark.operators import models as L
from tidemark.operators import rules as R
from tidemark.operators import stats as S
from tidemark.plans.adapters import DAILY, PANEL, POINTS, daily, panel, points, r6, table
from tidemark.plans.q_monitor import CUSUM_SQL
from tidemark.plans.registry import query

EDGES = "e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 30 AS b FROM nation WHERE n_nationkey % 3 <> 1)"


def _edges(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 3 <> 1")
    return n.select(F.col("n_nationkey").cast("int").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 30).cast("int").alias("b"))


def _nodes(spark, sf):
    e = _edges(spark, sf)
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("node")).union(e.select("b")).distinct()


NODES = "n AS (SELECT n_nationkey AS node FROM nation UNION SELECT b FROM e), u AS (SELECT a AS u, b AS v FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"


@query("implicit_nodes", f"WITH {EDGES} SELECT DISTINCT CAST(b AS INTEGER) AS node FROM e WHERE b NOT IN (SELECT n_nationkey FROM nation)")
def implicit_nodes(spark, sf):
    return G.implicit_nodes(table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("node")), _edges(spark, sf), "node", "a", "b")


@query("components", f"WITH RECURSIVE {EDGES}, {NODES}, r AS (SELECT node, node AS x FROM n UNION SELECT r.node, u.v FROM r JOIN u ON u.u = r.x) SELECT CAST(node AS INTEGER) AS node, CAST(min(x) AS INTEGER) AS component FROM r GROUP BY 1")
def components(spark, sf):
    return G.components(_nodes(spark, sf), _edges(spark, sf), "node", "a", "b")


@query("k_hop_neighbours", f"WITH RECURSIVE {EDGES}, {NODES}, r AS (SELECT u, v, 1 AS hops FROM u UNION SELECT r.u, u.v, hops + 1 FROM r JOIN u ON u.u = r.v WHERE hops < 3) SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(min(hops) AS INTEGER) AS hops FROM r WHERE u <> v GROUP BY 1, 2")
def k_hop_neighbours(spark, sf):
    return G.hops(_edges(spark, sf), "a", "b", 3)


POS = "p AS (SELECT s_suppkey AS k, 49.45 + (s_suppkey * 37 % 100) * 0.001 AS lat, 11.0 + (s_suppkey * 53 % 100) * 0.001 AS lon, s_acctbal > 5000 AS flag FROM supplier)"
NEAR = f"{POS}, d AS (SELECT a.k AS a, b.k AS b, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m FROM p a JOIN p b ON a.k < b.k), q AS (SELECT * FROM d WHERE m <= 2000)"


def _pos(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (49.45 + (F.col("s_suppkey") * 37 % 100) * 0.001).alias("lat"), (11.0 + (F.col("s_suppkey") * 53 % 100) * 0.001).alias("lon"), (F.col("s_acctbal") > 5000).alias("flag"))


@query("radius_pairs", f"WITH {NEAR} SELECT a, b, round(m, 3) AS metres FROM q")
def radius_pairs(spark, sf):
    return G.radius_pairs(_pos(spark, sf), "k", "lat", "lon", 2000, digits=3)


@query("neighbour_join_count", f"WITH {NEAR}, c AS (SELECT count(*) AS pairs, count(*) FILTER (x.flag AND y.flag) AS both_flagged FROM q JOIN p x ON x.k = q.a JOIN p y ON y.k = q.b), n AS (SELECT count(*) AS n, count(*) FILTER (flag) AS m FROM p) SELECT pairs, both_flagged, round(pairs * CAST(m * (m - 1) AS DOUBLE) / (n * (n - 1)), 6) AS expected FROM c, n")
def neighbour_join_count(spark, sf):
    p = _pos(spark, sf)
    members, links = G.near_places(p, "k", "lat", "lon", 2000)
    return G.joint_flags(links, p, "k", "flag", members).select("pairs", "both_flagged", *r6("expected"))


@query("neighbour_table", f"WITH {NEAR}, b AS (SELECT a, b FROM q UNION SELECT b, a FROM q) SELECT b.a AS k, count(*) AS neighbours, count(*) FILTER (p.flag) AS flagged_neighbours, coalesce(string_agg(CAST(b.b AS VARCHAR), ',' ORDER BY b.b) FILTER (p.flag), '') AS which FROM b JOIN p ON p.k = b.b GROUP BY 1")
def neighbour_table(spark, sf):
    p = _pos(spark, sf)
    members, links = G.near_places(p, "k", "lat", "lon", 2000)
    return G.neighbour_table(links, p, "k", "flag", members)


NORM = r"trim(regexp_replace(replace(replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("text_normalize", f"SELECT doc_id, md5({NORM.format(x='text')}) AS digest FROM documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize("text")).alias("digest"))


@query("coding_counts", f"SELECT lang, count(*) FILTER (regexp_matches({NORM.format(x='text')}, '\\bth')) AS with_th, count(*) FILTER (contains({NORM.format(x='text')}, 'tion')) AS with_tion, count(*) AS n FROM documents GROUP BY 1")
def coding_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.when(T.mentions("text", "th"), 1)).alias("with_th"), F.count(F.when(F.contains(T.normalize("text"), F.lit("tion")), 1)).alias("with_tion"), F.count(F.lit(1)).alias("n"))


@query("keyword_veto", None)
def keyword_veto(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.mentions("text", "tion", veto_after=("the", "of")).alias("hit"), T.mentions("text", "the", veto_before=("of",)).alias("hit_after_veto"))


@query("year_extract", "SELECT event_id, CAST(CASE WHEN 1900 + event_id % 250 BETWEEN 1950 AND 2030 THEN 1900 + event_id % 250 END AS INTEGER) AS year FROM events")
def year_extract(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.first_year(F.concat(F.lit("no 12345, built "), (1900 + F.col("event_id") % 250).cast("string"), F.lit(".")), 1950, 2030).alias("year"))


@query("power_classes", f"SELECT entity, day, l_orderkey, l_linenumber, CASE WHEN power <= 10 THEN 'small' WHEN power <= 30 THEN 'medium' ELSE 'large' END AS class FROM ({POINTS})")
def power_classes(spark, sf):
    return points(spark, sf).select("entity", "day", "l_orderkey", "l_linenumber", X.ladder("power", [(10, "small"), (30, "medium")], "large", "unknown").alias("class"))


FEAT = f"f AS (SELECT entity, avg(power) AS level, stddev_samp(flow) AS unrest, avg(spread) AS spread, count(*) AS n FROM ({POINTS}) GROUP BY 1)"


def _features(spark, sf):
    return points(spark, sf).groupBy("entity").agg(F.avg("power").alias("level"), F.stddev_samp("flow").alias("unrest"), F.avg("spread").alias("spread"), F.count(F.lit(1)).alias("n"))


@query("rule_book", f"WITH {FEAT}, h AS (SELECT entity, level > 25.6 AS a, unrest > 23.5 AS b, spread < 4 AS c FROM f) SELECT entity, CASE WHEN a OR c THEN 'alarm' WHEN b THEN 'warning' ELSE 'ok' END AS level, CASE WHEN a THEN 'high level' WHEN c THEN 'low spread' WHEN b THEN 'unrest' END AS first_rule, concat_ws('; ', CASE WHEN a THEN 'high level' END, CASE WHEN b THEN 'unrest' END, CASE WHEN c THEN 'low spread' END) AS reasons FROM h")
def rule_book(spark, sf):
    rules = [("high level", "alarm", R.condition("level", 25.6, "above")), ("unrest", "warning", R.condition("unrest", 23.5, "above")), ("low spread", "alarm", R.condition("spread", 4.0, "below"))]
    return R.rule_book(_features(spark, sf), rules).select("entity", "level", "first_rule", "reasons")


@query("rule_calibration", f"WITH {FEAT} SELECT 'level' AS feature, 25.0 AS old, round(CASE WHEN count(level) >= 5 THEN quantile_cont(level, 0.85) ELSE 25.0 END, 6) AS threshold, count(level) AS n FROM f UNION ALL SELECT 'spread', 4.0, round(CASE WHEN count(spread) >= 5 THEN quantile_cont(spread, 0.15) ELSE 4.0 END, 6), count(spread) FROM f")
def rule_calibration(spark, sf):
    return R.calibrate_rules(_features(spark, sf), {"level": (25.0, "above"), "spread": (4.0, "below")}, 0.15, 5).select("feature", "old", *r6("threshold"), "n")


ZF = f"{FEAT}, z AS (SELECT entity, (level - avg(level) OVER ()) / stddev_samp(level) OVER () AS level, (unrest - avg(unrest) OVER ()) / stddev_samp(unrest) OVER () AS unrest, (spread - avg(spread) OVER ()) / stddev_samp(spread) OVER () AS spread FROM f)"


def _z(spark, sf):
    return L.standardize(_features(spark, sf), ["level", "unrest", "spread"]).select("entity", "level", "unrest", "spread")


@query("standardize", f"WITH {ZF} SELECT entity, round(level, 6) AS level, round(unrest, 6) AS unrest, round(spread, 6) AS spread FROM z")
def standardize(spark, sf):
    return _z(spark, sf).select("entity", *r6("level", "unrest", "spread"))


@query("evidence_catalogue", f"WITH {ZF}, u AS (SELECT entity, greatest(-3, least(3, level)) AS l, greatest(-3, least(3, unrest)) AS u, greatest(-3, least(3, spread)) AS s FROM z), e AS (SELECT entity, 'short circuit' AS pattern, (l * 1.0 + s * -1.0) / 2.0 AS score FROM u UNION ALL SELECT entity, 'unsteady', (u * 1.0 + l * 0.5) / 1.5 FROM u UNION ALL SELECT entity, 'healthy', (u * -1.0 + s * 1.0 + l * -0.5) / 2.5 FROM u) SELECT entity, pattern, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY entity ORDER BY score DESC, pattern) AS INTEGER) AS rank FROM e")
def evidence_catalogue(spark, sf):
    cat = [("short circuit", "level", 1.0), ("short circuit", "spread", -1.0), ("unsteady", "unrest", 1.0), ("unsteady", "level", 0.5), ("healthy", "unrest", -1.0), ("healthy", "spread", 1.0), ("healthy", "level", -0.5)]
    return R.evidence(_z(spark, sf), "entity", cat).select("entity", "pattern", *r6("score"), "rank")


@query("severity_score", f"WITH {FEAT} SELECT entity, round(100 * (0.6 * least(greatest(level / 40, 0), 1) + CASE WHEN entity % 3 = 0 THEN 0 ELSE 0.4 * least(greatest(unrest / 30, 0), 1) END) / CASE WHEN entity % 3 = 0 THEN 0.6 ELSE 1.0 END, 6) AS severity FROM f")
def severity_score(spark, sf):
    f = _features(spark, sf).withColumn("unrest", F.when(F.col("entity") % 3 != 0, F.col("unrest")))
    return R.severity(f, {"level": (0.6, 40.0), "unrest": (0.4, 30.0)}).select("entity", *r6("severity"))


@query("urgency_rank", f"WITH {FEAT}, c AS (SELECT entity, CASE WHEN level > 25.6 THEN 'high' WHEN unrest > 23.4 THEN 'medium' ELSE 'low' END AS urgency, CASE WHEN entity % 4 <> 0 THEN spread END AS p FROM f) SELECT entity, urgency, CAST(row_number() OVER (ORDER BY CASE urgency WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, p DESC NULLS LAST, entity) AS INTEGER) AS rank FROM c")
def urgency_rank(spark, sf):
    f = _features(spark, sf).withColumn("urgency", F.when(F.col("level") > 25.6, "high").when(F.col("unrest") > 23.4, "medium").otherwise("low")).withColumn("p", F.when(F.col("entity") % 4 != 0, F.col("spread")))
    return R.urgency_rank(f, "urgency", ["high", "medium", "low"], "p", "entity").select("entity", "urgency", "rank")


@query("naive_bayes_posterior", f"WITH {FEAT}, s AS (SELECT entity, CASE WHEN entity % 5 <> 0 THEN level > 25.5 END AS a, spread < 4 AS b FROM f), l AS (SELECT entity, c.cause, ln(c.prior) + coalesce(CASE WHEN a THEN ln(c.pa) WHEN NOT a THEN ln(1 - c.pa) END, 0) + CASE WHEN b THEN ln(c.pb) ELSE ln(1 - c.pb) END AS l FROM s, (VALUES ('valve', 0.2, 0.8, 0.6), ('pump', 0.3, 0.4, 0.7), ('none', 0.5, 0.1, 0.3)) c(cause, prior, pa, pb)), m AS (SELECT entity, cause, exp(l - max(l) OVER (PARTITION BY entity)) AS e FROM l) SELECT entity, cause, round(e / sum(e) OVER (PARTITION BY entity), 6) AS posterior FROM m")
def naive_bayes_posterior(spark, sf):
    f = _features(spark, sf)
    s = f.select("entity", F.lit("a").alias("symptom"), F.when(F.col("entity") % 5 != 0, F.col("level") > 25.5).alias("present")).union(f.select("entity", F.lit("b"), F.col("spread") < 4))
    like = spark.createDataFrame([("a", "valve", 0.8), ("b", "valve", 0.6), ("a", "pump", 0.4), ("b", "pump", 0.7), ("a", "none", 0.1), ("b", "none", 0.3)], "symptom string, cause string, p double")
    prior = spark.createDataFrame([("valve", 0.2), ("pump", 0.3), ("none", 0.5)], "cause string, prior double")
    return R.bayes_posterior(s, "entity", "symptom", "present", like, prior).select("entity", "cause", *r6("posterior"))


@query("two_by_two", "WITH d AS (SELECT n_chars > 2000 AS p, quality = 1 AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM d), k AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c) SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa FROM k")
def two_by_two(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return R.two_by_two(d, F.col("n_chars") > 2000, F.col("quality") == 1).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "kappa"))


@query("crosstab_margins", "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark, sf):
    return R.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("run_delta", f"WITH d AS ({DAILY}), o AS (SELECT entity, CASE WHEN avg(mean_v) > 45 THEN 'high' ELSE 'low' END AS s FROM d WHERE day < DATE '2024-01-10' GROUP BY 1), n AS (SELECT entity, CASE WHEN avg(mean_v) > 45 THEN 'high' ELSE 'low' END AS s FROM d WHERE day >= DATE '2024-01-20' AND entity % 7 <> 0 GROUP BY 1) SELECT coalesce(o.entity, n.entity) AS entity, o.s AS before, n.s AS after, CASE WHEN o.entity IS NULL THEN 'new' WHEN n.entity IS NULL THEN 'gone' WHEN o.s = n.s THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.entity = n.entity")
def run_delta(spark, sf):
    d = daily(spark, sf)
    side = lambda x: x.groupBy("entity").agg(F.when(F.avg("mean_v") > 45, "high").otherwise("low").alias("s"))
    return R.run_delta(side(d.where("day < date'2024-01-10'")), side(d.where("day >= date'2024-01-20' and entity % 7 <> 0")), "entity", "s")


@query("kmeans_assign", "WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.vec_id, c.label AS cluster, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, cluster, round(sqrt(d), 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1")
def kmeans_assign(spark, sf):
    e = table(spark, sf, "embeddings")
    return L.nearest_centroid(e, "vec_id", "embedding", L.centroids(e, "label", "embedding")).select("vec_id", F.col("label").alias("cluster"), *r6("distance"))


@query("profile_series", f"WITH l AS (SELECT *, day - lag(day) OVER w AS gap, energy - lag(energy) OVER w AS step FROM ({PANEL}) WINDOW w AS (PARTITION BY entity ORDER BY day)) SELECT entity, count(*) AS n, CAST(max(gap) AS INTEGER) AS longest_gap, count(*) FILTER (gap > 7) AS gaps, count(*) FILTER (step < 0) AS drops, count(*) FILTER (step = 0) AS constants, round(quantile_cont(energy, 0.05), 4) AS p05, round(quantile_cont(energy, 0.95), 4) AS p95 FROM l GROUP BY 1")
def profile_series(spark, sf):
    return L.profile(panel(spark, sf), "entity", "day", "energy", 7).select("entity", "n", "longest_gap", "gaps", "drops", "constants", F.round("p05", 4).alias("p05"), F.round("p95", 4).alias("p95"))


@query("quality_class", f"SELECT entity, CASE WHEN max(day) < DATE '2001-06-01' THEN 'inactive' WHEN count(*) < 400 THEN 'low_coverage' ELSE 'usable' END AS class FROM ({PANEL}) GROUP BY 1")
def quality_class(spark, sf):
    return panel(spark, sf).groupBy("entity").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("n")).select("entity", F.when(F.col("last") < F.lit("2001-06-01").cast("date"), "inactive").when(F.col("n") < 400, "low_coverage").otherwise("usable").alias("class"))


@query("spectral_share", None)
def spectral_share(spark, sf):
    """Share of spectral power between two periods: a Fourier transform of each entity's days (no SQL form)."""
    return L.spectral_share(daily(spark, sf), "entity", "day", "mean_v", 2.0, 7.0)


@query("autoregression", f"WITH d AS (SELECT entity, mean_v AS y, n AS x, CASE WHEN day - lag(day) OVER w = 1 THEN lag(mean_v) OVER w END AS l FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY day)), g AS (SELECT entity, count(*) AS n, avg(y) AS my, avg(l) AS ml, avg(x) AS mx, var_pop(y) AS yy, var_pop(l) AS ll, var_pop(x) AS xx, covar_pop(l, x) AS lx, covar_pop(l, y) AS ly, covar_pop(x, y) AS xy FROM d WHERE l IS NOT NULL GROUP BY 1), f AS (SELECT *, CASE WHEN n >= 8 AND ll * xx - lx * lx > 1e-9 * ll * xx THEN least(greatest((ly * xx - xy * lx) / (ll * xx - lx * lx), -0.99), 0.99) END AS phi FROM g), b AS (SELECT *, CASE WHEN phi IS NOT NULL THEN (xy - phi * lx) / xx END AS beta FROM f) SELECT e.entity, coalesce(n, 0) AS n, round(phi, 5) AS phi, round(beta, 4) AS beta, round(my - phi * ml - beta * mx, 4) AS intercept, round(sqrt(greatest(yy + phi * phi * ll + beta * beta * xx - 2 * phi * ly - 2 * beta * xy + 2 * phi * beta * lx, 0)), 4) AS sigma FROM (SELECT DISTINCT entity FROM ({DAILY})) e LEFT JOIN b USING (entity)")
def autoregression(spark, sf):
    r4 = lambda *cs: [F.round(c, 4).alias(c) for c in cs]
    return L.autoregression(daily(spark, sf), "entity", "day", "mean_v", "n", least=8).select("entity", "n", F.round("phi", 5).alias("phi"), *r4("beta", "intercept", "sigma"))


@query("isolation_scores", None)
def isolation_scores(spark, sf):
    return L.isolation_scores(_features(spark, sf).dropna(), "entity", ["level", "unrest", "spread"])


@query("bootstrap_auc", None)
def bootstrap_auc(spark, sf):
    from tidemark.operators.resample import bootstrap_auc as run

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("quality", "n_chars")
    return run(d, "quality", "n_chars", 200)


HASH = "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


@query("network_days_permutation", f"""WITH a AS (SELECT DISTINCT entity AS k, day AS d FROM ({DAILY}) WHERE mean_v > 70), e AS (SELECT min(d) AS lo, max(d) - min(d) + 1 AS span FROM a), b AS (SELECT k, d - lo AS o, span FROM a, e), rr AS (SELECT unnest(range(0, 200)) AS r), ks AS (SELECT DISTINCT k, span FROM b), sh AS (SELECT k, r, {HASH.format(x="'1:' || r || ':' || k")} % span AS s FROM ks, rr),
dr AS (SELECT r, b.k, (o + s) % span AS o, span FROM b JOIN sh USING (k)), w AS (SELECT unnest([-1, 0, 1]) AS w), nr AS (SELECT r, x, count(*) AS n FROM (SELECT DISTINCT r, k, o + w AS x FROM dr, w WHERE o + w BETWEEN 0 AND span - 1) GROUP BY 1, 2), t AS (SELECT quantile_cont(t, 0.95) AS threshold FROM (SELECT r, max(n) AS t FROM nr GROUP BY 1)),
se AS (SELECT x, count(*) AS n FROM (SELECT DISTINCT k, o + w AS x FROM b, w WHERE o + w BETWEEN 0 AND span - 1) GROUP BY 1), dd AS (SELECT lo, unnest(range(0, span)) AS x FROM e) SELECT CAST(lo + CAST(dd.x AS INTEGER) AS DATE) AS day, CAST(coalesce(n, 0) AS INTEGER) AS entities, threshold, coalesce(n, 0) > threshold AS network_day FROM dd LEFT JOIN se USING (x), t""")
def network_days_permutation(spark, sf):
    from tidemark.operators.resample import network_days

    a = daily(spark, sf).where("mean_v > 70").select("entity", "day")
    return network_days(a, "entity", "day", within=1, replicates=200)


@query("stream_day_aggregate", "SELECT user_id AS entity, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS sum_v FROM events GROUP BY 1, 2")
def stream_day_aggregate(spark, sf):
    """Daily aggregates by Structured Streaming over the events, all available now; equal to the batch result."""
    from tidemark.streaming import monitor as M

    out = M.run_day_aggregate(spark, sf, "events")
    return out.select("entity", "day", "n", *r6("sum_v"))


@query("stream_cusum", CUSUM_SQL)
def stream_cusum(spark, sf):
    """CUSUM in keyed state over a stream of days; equal to the batch result."""
    from tidemark.streaming import monitor as M

    return M.run_cusum(spark, S.robust_z(daily(spark, sf), "mean_v", ["entity"]).select("entity", "day", "z"))


@query("neighbour_permutation", f"WITH {NEAR}, rr AS (SELECT unnest(range(-1, 99)) AS r), o AS (SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY CASE WHEN r < 0 THEN CAST(NOT flag AS BIGINT) ELSE {HASH.format(x="'1:' || r || ':' || k")} END, k) AS i FROM p, rr), dr AS (SELECT r, k FROM o WHERE i <= (SELECT count(*) FILTER (flag) FROM p)), h AS (SELECT rr.r, count(y.k) AS n FROM rr LEFT JOIN (SELECT x.r, x.k FROM q JOIN dr x ON x.k = q.a JOIN dr z ON z.k = q.b AND z.r = x.r) y ON y.r = rr.r GROUP BY 1), s AS (SELECT n AS seen FROM h WHERE r < 0) SELECT (SELECT count(*) FROM q) AS pairs, any_value(seen) AS both_flagged, round(avg(n), 6) AS expected, round((1 + count(*) FILTER (n >= seen)) / CAST(1 + count(*) AS DOUBLE), 6) AS p_value FROM h, s WHERE r >= 0")
def neighbour_permutation(spark, sf):
    from tidemark.operators.resample import neighbour_permutation as run

    p = _pos(spark, sf)
    members, links = G.near_places(p, "k", "lat", "lon", 2000)
    return run(links, p, "k", "flag", 99, members=members).select("pairs", "both_flagged", *r6("expected", "p_value"))


@query("auc_difference", None)
def auc_difference(spark, sf):
    """Paired bootstrap of the difference of two AUCs; the tests hold it against plain Python."""
    from tidemark.operators.resample import bootstrap_auc_difference as run

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "n_chars", F.length(F.regexp_replace("text", "[^ ]", "")).alias("blanks"))
    return run(d, "quality", "n_chars", "blanks", "doc_id", 100)
