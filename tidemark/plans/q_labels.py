"""Queries for labels, classes, findings, addresses and meters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import labels as L
from tidemark.operators import profiles as P
from tidemark.plans.adapters import HOURS, PANEL, POINTS, VISITS, hours, panel, points, r6, table, visits
from tidemark.plans.registry import query


@query("before_after_fixed", f"SELECT entity, day, CASE WHEN day > DATE '1998-06-01' THEN 'after' ELSE 'before' END AS side FROM ({PANEL})")
def before_after_fixed(spark, sf):
    return panel(spark, sf).select("entity", "day", L.fixed_side("day", F.lit("1998-06-01").cast("date")).alias("side"))


@query("season_group", "SELECT l_orderkey, l_linenumber, CASE WHEN month(l_shipdate) IN (11, 12, 1, 2, 3) THEN 'winter' WHEN month(l_shipdate) BETWEEN 5 AND 9 THEN 'summer' ELSE 'transition' END AS season FROM lineitem")
def season_group(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", L.season_group("l_shipdate").alias("season"))


@query("building_area", f"WITH s AS (SELECT entity, CASE WHEN entity % 9 <> 0 THEN avg(CAST(status = 'F' AS INTEGER)) END AS x FROM ({POINTS}) GROUP BY 1) SELECT entity, CASE WHEN x <= 0.48 THEN 'new' WHEN x >= 0.52 THEN 'old' WHEN x IS NOT NULL THEN 'mixed' END AS area FROM s")
def building_area(spark, sf):
    s = points(spark, sf).groupBy("entity").agg(F.avg((F.col("status") == "F").cast("double")).alias("x")).withColumn("x", F.when(F.col("entity") % 9 != 0, F.col("x")))
    return s.select("entity", L.building_area("x", (0.48, 0.52)).alias("area"))


@query("traffic_light", f"SELECT entity, ts, CASE WHEN t IS NULL THEN 'grey' WHEN t < 45 THEN 'green' WHEN t < 50 THEN 'yellow' WHEN t < 55 THEN 'orange' ELSE 'red' END AS light FROM (SELECT entity, ts, CASE WHEN hour(ts) % 5 <> 0 THEN rt END AS t FROM ({HOURS}))")
def traffic_light(spark, sf):
    return hours(spark, sf).select("entity", "ts", L.traffic_light(F.when(F.hour("ts") % 5 != 0, F.col("rt"))).alias("light"))


@query("unit_conversion", f"SELECT entity, day, round(100 * (exp(spread - 4) - 1), 5) AS percent, round(energy / volume / 1.163, 6) AS kelvin FROM ({PANEL})")
def unit_conversion(spark, sf):
    p = panel(spark, sf)
    return p.select("entity", "day", F.round(L.percent(F.col("spread") - 4), 5).alias("percent"), F.round(L.kelvin(F.col("energy") / F.col("volume")), 6).alias("kelvin"))


@query("ternary_xy", f"WITH p AS ({POINTS}), q AS (SELECT entity, quantile_cont(power, 0.95) AS a, quantile_cont(flow, 0.95) AS b, quantile_cont(spread, 0.95) AS c FROM p GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, least(greatest(power / a, 0), 1) AS a, least(greatest(flow / b, 0), 1) AS b, least(greatest(spread / c, 0), 1) AS c FROM p JOIN q USING (entity)) SELECT l_orderkey, l_linenumber, round((c + a / 2) / (a + b + c), 6) AS x, round(a / (a + b + c) * sqrt(3.0) / 2, 6) AS y FROM x")
def ternary_xy(spark, sf):
    t = P.ternary(points(spark, sf), "entity", ("power", "flow", "spread"))
    x, y = L.ternary_xy("share_flow", "share_spread", "share_power")
    return t.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


FEAT = f"f AS (SELECT entity, avg(power) AS level, stddev_samp(flow) AS unrest, avg(spread) AS spread, sum(flow) AS volume, count(*) AS n FROM ({POINTS}) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY level, entity) AS i FROM f)"


def _features(spark, sf):
    return points(spark, sf).groupBy("entity").agg(F.avg("power").alias("level"), F.stddev_samp("flow").alias("unrest"), F.avg("spread").alias("spread"), F.sum("flow").alias("volume"), F.count(F.lit(1)).alias("n"))


@query("action_class", f"WITH {FEAT}, c AS (SELECT entity, CASE WHEN level > 25.8 THEN 'valve' WHEN unrest > 23.5 THEN 'unsteady' ELSE '' END AS pattern, CASE WHEN entity % 3 <> 0 THEN spread / 8 END AS p, CASE WHEN entity % 4 = 0 THEN 'bad' ELSE 'good' END AS cluster FROM f) SELECT entity, CASE WHEN pattern = 'valve' OR coalesce(p >= 0.502, false) THEN 'replace valve' WHEN pattern <> '' OR cluster = 'bad' THEN 'tune control' ELSE 'none' END AS action FROM c")
def action_class(spark, sf):
    f = _features(spark, sf)
    pattern = F.when(F.col("level") > 25.8, "valve").when(F.col("unrest") > 23.5, "unsteady").otherwise("")
    return f.select("entity", L.action_class(pattern, F.when(F.col("entity") % 3 != 0, F.col("spread") / 8), F.when(F.col("entity") % 4 == 0, "bad").otherwise("good"), 0.502).alias("action"))


@query("special_reasons", f"WITH {FEAT}, c AS (SELECT *, level > 25.5 AS a, unrest > 23.2 AS b, spread < 4 AS c FROM f) SELECT entity, concat_ws('; ', CASE WHEN CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) >= 2 THEN 'outside: ' || concat_ws('+', CASE WHEN a THEN 'high' END, CASE WHEN b THEN 'wild' END, CASE WHEN c THEN 'tight' END) END, CASE WHEN volume > 0.0105 * (SELECT sum(volume) FROM f) THEN 'large share' END) AS reasons FROM c")
def special_reasons(spark, sf):
    f = _features(spark, sf).withColumns({"high": F.col("level") > 25.5, "wild": F.col("unrest") > 23.2, "tight": F.col("spread") < 4})
    return L.special_reasons(f, ["high", "wild", "tight"], "volume", 2, 0.0105).select("entity", "reasons")


@query("knowledge_status", f"WITH {FEAT} SELECT entity, concat_ws('; ', CASE WHEN n >= 600 THEN 'measured' ELSE 'few values' END, CASE WHEN entity IN (SELECT entity FROM ({VISITS})) THEN 'visited' ELSE 'not visited' END, CASE WHEN coalesce(CASE WHEN entity % 2 = 0 THEN level > 25.5 END, false) THEN 'high level' ELSE 'level unknown or normal' END) AS status FROM f")
def knowledge_status(spark, sf):
    f = _features(spark, sf).join(visits(spark, sf).select("entity").distinct().withColumn("seen", F.lit(True)), "entity", "left")
    return f.select("entity", L.knowledge_status([(F.col("n") >= 600, "measured", "few values"), (F.col("seen"), "visited", "not visited"), (F.when(F.col("entity") % 2 == 0, F.col("level") > 25.5), "high level", "level unknown or normal")]).alias("status"))


@query("action_rules", f"WITH {FEAT}, c AS (SELECT entity, entity % 7 = 0 AS sp, level > 25.5 AS a, unrest > 23.2 AS b, spread < 4 AS c, entity % 2 = 0 AS net, spread FROM f) SELECT entity, CASE WHEN sp THEN 'check data' ELSE concat_ws('; ', CASE WHEN a THEN 'valve' END, CASE WHEN b THEN 'control' END, CASE WHEN c THEN 'insulation' END) END AS actions, CASE WHEN sp THEN 'medium' WHEN a AND net THEN 'high' WHEN a OR b THEN 'medium' WHEN c THEN 'low' ELSE 'none' END AS urgency, round(spread, 6) AS p FROM c")
def action_rules(spark, sf):
    rules = [(F.col("level") > 25.5, "valve", "high"), (F.col("unrest") > 23.2, "control", "medium"), (F.col("spread") < 4, "insulation", "low")]
    return L.actions(_features(spark, sf), "entity", F.col("entity") % 7 == 0, rules, F.col("entity") % 2 == 0, "spread").select("entity", "actions", "urgency", *r6("p"))


SET = "s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN ' ' || l_returnflag END AS o1, l_linestatus AS n1, CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS o2, CASE WHEN l_orderkey % 3 = 0 THEN l_linestatus || ' ' WHEN l_orderkey % 3 = 1 THEN '' ELSE 'X' END AS n2 FROM lineitem)"


@query("setpoint_changed", f"WITH {SET} SELECT l_orderkey, l_linenumber, coalesce(trim(o1) <> '' AND trim(n1) <> '' AND trim(o1) <> trim(n1), false) OR coalesce(trim(o2) <> '' AND trim(n2) <> '' AND trim(o2) <> trim(n2), false) AS changed FROM s")
def setpoint_changed(spark, sf):
    l, n, k = table(spark, sf, "lineitem"), F.col("l_linenumber"), F.col("l_orderkey") % 3
    s = l.select("l_orderkey", "l_linenumber", F.when(n != 2, F.concat(F.lit(" "), "l_returnflag")).alias("o1"), F.col("l_linestatus").alias("n1"), F.when(n != 3, F.col("l_linestatus")).alias("o2"), F.when(k == 0, F.concat("l_linestatus", F.lit(" "))).when(k == 1, "").otherwise("X").alias("n2"))
    return s.select("l_orderkey", "l_linenumber", L.setpoint_changed([("o1", "n1"), ("o2", "n2")]).alias("changed"))


CODED = "c AS (SELECT source AS entity, doc_id, text, DATE '2019-01-01' + CAST(doc_id % 900 AS INTEGER) AS day, contains(lower(text), 'tion') AS tion, contains(lower(text), 'ung') AS ung, CASE WHEN doc_id % 5 <> 0 THEN contains(lower(text), 'eau') END AS eau FROM documents)"


def _coded(spark, sf):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return table(spark, sf, "documents").select(F.col("source").alias("entity"), "doc_id", "text", F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("day"), has("tion").alias("tion"), has("ung").alias("ung"), F.when(F.col("doc_id") % 5 != 0, has("eau")).alias("eau"))


@query("labels_by_entity", f"WITH {CODED}, g AS (SELECT entity, bool_or(coalesce(tion, false)) AS tion, bool_or(coalesce(ung, false)) AS ung, bool_or(coalesce(eau, false)) AS eau, CAST(min(year(day)) AS INTEGER) AS first_year FROM c GROUP BY 1) SELECT *, CASE WHEN eau OR ung THEN 'one' WHEN tion THEN 'two' END AS category FROM g")
def labels_by_entity(spark, sf):
    return L.labels_by_entity(_coded(spark, sf), "entity", "day", ["tion", "ung", "eau"], {"one": ["eau", "ung"], "two": ["tion"]})


@query("uncoded", f"WITH {CODED} SELECT entity, count(*) AS n FROM c WHERE text IS NOT NULL AND trim(text) <> '' AND NOT coalesce(tion, false) AND NOT coalesce(ung, false) AND NOT coalesce(eau, false) GROUP BY 1")
def uncoded(spark, sf):
    return L.uncoded(_coded(spark, sf), "text", ["tion", "ung", "eau"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("type_group", "SELECT p_partkey, CASE WHEN k IS NULL OR trim(k) = '' THEN 'unknown' WHEN contains(k, 'direct') THEN 'direct' WHEN contains(k, 'storage') OR contains(k, 'tank') THEN 'storage' WHEN contains(k, 'flow') THEN 'flow' ELSE 'other' END AS type_group FROM (SELECT p_partkey, lower(CASE p_partkey % 6 WHEN 0 THEN 'Direct unit' WHEN 1 THEN 'TANK 300' WHEN 2 THEN 'flow heater' WHEN 3 THEN ' ' WHEN 4 THEN p_name END) AS k FROM part)")
def type_group(spark, sf):
    m = F.col("p_partkey") % 6
    k = F.when(m == 0, "Direct unit").when(m == 1, "TANK 300").when(m == 2, "flow heater").when(m == 3, " ").when(m == 4, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", L.type_group(k).alias("type_group"))


DIRECTORY = "d AS (SELECT 'a' || (c_custkey % 40) AS addr, c_custkey % 57 AS meter, 2018 + c_custkey % 4 AS year FROM customer)"
DATA = "w AS (SELECT s_suppkey AS meter FROM supplier WHERE s_suppkey % 3 <> 0)"


def _directory(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.concat(F.lit("a"), (c % 40).cast("string")).alias("addr"), (c % 57).alias("meter"), (2018 + c % 4).alias("year"))


@query("meter_for_address", f"WITH {DIRECTORY}, {DATA}, l AS (SELECT addr, max(year) AS year FROM d GROUP BY 1), m AS (SELECT DISTINCT d.addr, d.meter, d.meter IN (SELECT meter FROM w) AS has FROM d JOIN l USING (addr, year)) SELECT addr, meter FROM m QUALIFY row_number() OVER (PARTITION BY addr ORDER BY has DESC, meter) = 1")
def meter_for_address(spark, sf):
    w = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("meter"))
    return L.meter_for_address(_directory(spark, sf), "addr", "meter", "year", w)


@query("visits_by_meter", f"WITH {DIRECTORY}, m AS (SELECT addr, min(meter) AS meter FROM d GROUP BY 1), v AS (SELECT 'a' || (o_custkey % 50) AS addr, CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) = 1) SELECT meter, count(DISTINCT day) AS n, string_agg(DISTINCT CAST(day AS VARCHAR), ',' ORDER BY CAST(day AS VARCHAR)) AS dates FROM v JOIN m USING (addr) GROUP BY 1")
def visits_by_meter(spark, sf):
    m = _directory(spark, sf).groupBy("addr").agg(F.min("meter").alias("meter"))
    v = table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 1).select(F.concat(F.lit("a"), (F.col("o_custkey") % 50).cast("string")).alias("addr"), F.to_date("o_orderdate").alias("day"))
    return L.visits_by_meter(v, m, "addr", "meter", "day").select("meter", "n", F.array_join(F.transform("dates", lambda x: x.cast("string")), ",").alias("dates"))


NODES = "n AS (SELECT 'a' || (p_partkey % 44) AS addr, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 57 END AS meter, CASE WHEN p_partkey % 4 <> 0 THEN CAST(10 * (p_partkey % 44 % 3) + p_partkey % 44 + CASE WHEN p_partkey % 44 > 30 THEN p_partkey % 7 ELSE 0 END AS DOUBLE) END AS kw FROM part), d AS (SELECT 'a' || CAST(s_suppkey * 3 % 41 AS VARCHAR) AS addr, s_suppkey % 57 AS meter FROM supplier)"


@query("contract_resolution", f"WITH {NODES}, o AS (SELECT meter, max(kw) AS own FROM n WHERE meter IS NOT NULL AND kw IS NOT NULL GROUP BY 1), a AS (SELECT addr, count(DISTINCT kw) AS vs, max(kw) AS v FROM n WHERE kw IS NOT NULL GROUP BY 1), m AS (SELECT addr, count(DISTINCT meter) AS ms FROM d GROUP BY 1), f AS (SELECT meter, min(addr) AS addr FROM d GROUP BY 1), j AS (SELECT k.meter, own, v, vs, ms FROM (SELECT DISTINCT meter FROM (SELECT c_custkey % 57 AS meter FROM customer)) k LEFT JOIN o USING (meter) LEFT JOIN f USING (meter) LEFT JOIN a USING (addr) LEFT JOIN m USING (addr)), s AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'node' WHEN v IS NULL THEN 'missing' WHEN vs > 1 THEN 'ambiguous' WHEN ms > 1 THEN 'shared' ELSE 'address' END AS source FROM j) SELECT meter, CASE source WHEN 'node' THEN own WHEN 'address' THEN v END AS kw, source FROM s")
def contract_resolution(spark, sf):
    p = F.col("p_partkey")
    addr = lambda x: F.concat(F.lit("a"), x.cast("string"))
    n = table(spark, sf, "part").select(addr(p % 44).alias("addr"), F.when(p % 5 == 0, p % 57).alias("meter"), F.when(p % 4 != 0, (10 * (p % 44 % 3) + p % 44 + F.when(p % 44 > 30, p % 7).otherwise(0)).cast("double")).alias("kw"))
    d = table(spark, sf, "supplier").select(addr(F.col("s_suppkey") * 3 % 41).alias("addr"), (F.col("s_suppkey") % 57).alias("meter"))
    m = table(spark, sf, "customer").select((F.col("c_custkey") % 57).alias("meter"))
    return L.contract_for(m, n, d, "addr", "meter", "kw")


@query("snapped_graph", "WITH p AS (SELECT s_suppkey AS k, i, round((s_suppkey * 7 % 11 + i * (s_suppkey % 3)) * 0.04, 2) AS x, round((s_suppkey * 5 % 7 + i) * 0.04, 2) AS y FROM supplier, range(0, 4) r(i)), g AS (SELECT *, CAST(round(x / 0.05) AS BIGINT) || ':' || CAST(round(y / 0.05) AS BIGINT) AS n FROM p), e AS (SELECT least(a.n, b.n) AS a, greatest(a.n, b.n) AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS l FROM g a JOIN g b ON a.k = b.k AND b.i = a.i + 1) SELECT a, b, round(min(l), 6) AS length FROM e WHERE a <> b GROUP BY 1, 2")
def snapped_graph(spark, sf):
    k = F.col("s_suppkey")
    at = lambda i: F.struct(F.round((k * 7 % 11 + i * (k % 3)) * 0.04, 2).alias("x"), F.round((k * 5 % 7 + i) * 0.04, 2).alias("y"))
    lines = table(spark, sf, "supplier").select(k, F.transform(F.sequence(F.lit(0), F.lit(3)), at).alias("points"))
    return L.snapped_graph(lines, "s_suppkey", "points").select("a", "b", *r6("length"))


NORM = "trim(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("veto_windows", f"WITH s AS (SELECT doc_id, string_split({NORM}, 'tion') AS p FROM documents) SELECT doc_id, len(p) > 1 AND len(list_filter(range(1, len(p)), lambda i: NOT (contains(left(p[i + 1], 12), 'the') OR contains(left(p[i + 1], 12), 'und') OR contains(right(p[i], 12), 'er')))) > 0 AS hit FROM s")
def veto_windows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_with_vetoes("text", "tion", ("the", "und"), ("er",), 12).alias("hit"))


@query("clause_negation", "WITH c AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '[\\t\\r\\f ]+', ' ', 'g'), '[.;!?\\n]') AS c FROM documents) SELECT doc_id, len(list_filter(c, lambda x: contains(x, 'ing') AND NOT regexp_matches(string_split(x, 'ing')[1], '(^|[^a-z])(the|on|und)([^a-z]|$)'))) > 0 AS hit FROM c")
def clause_negation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.affirmed("text", "ing", ("the", "on", "und")).alias("hit"))


SPELLINGS = ("Fliederstr. {n}", "FLIEDERSTRASSE 0{n}", "Fliederstraße  {n}", "fliederstr {n} (Hof)", "Flieder-str. {n}, 1. OG", "Am Pl. {n} a", "Am Platz {n}A", "Müllerweg {n} - {m}")


@query("address_key", "WITH a AS (SELECT s_suppkey AS k, s_suppkey % 8 AS i, CAST(1 + s_suppkey % 30 AS VARCHAR) AS n, CAST(3 + s_suppkey % 30 AS VARCHAR) AS m FROM supplier) SELECT k, CASE i WHEN 4 THEN 'flieder-strasse ' || n WHEN 5 THEN 'am platz ' || n || 'a' WHEN 6 THEN 'am platz ' || n || 'a' WHEN 7 THEN 'muellerweg ' || n || '-' || m ELSE 'fliederstrasse ' || n END AS address FROM a")
def address_key(spark, sf):
    """Eight spellings of some addresses come to the same keys."""
    k = F.col("s_suppkey")
    n, m = (1 + k % 30).cast("string"), (3 + k % 30).cast("string")
    shown = F.element_at(F.array(*[F.replace(F.replace(F.lit(s), F.lit("{n}"), n), F.lit("{m}"), m) for s in SPELLINGS]), (k % 8 + 1).cast("int"))
    return table(spark, sf, "supplier").select(k.alias("k"), T.address_key(shown).alias("address"))


@query("text_scalars", "SELECT event_id, round(CAST(event_id % 24 AS DOUBLE) + (event_id % 60) / 60.0, 6) AS hour, event_id % 5 IN (0, 1) AS yes, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 + 1 AS VARCHAR) || 'b-' || CAST(event_id % 90 + 3 AS VARCHAR) || ',' || CAST(event_id % 90 + 1 AS VARCHAR) || 'b,' || CAST(event_id % 90 + 1 AS VARCHAR) ELSE CAST(event_id % 90 + 1 AS VARCHAR) END AS house, 48.0 + (event_id % 90) / 100.0 AS lat, 11.25 AS lon FROM events")
def text_scalars(spark, sf):
    """Hours, yes or no, house numbers and coordinates out of texts."""
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    clock = F.concat(F.lit("am "), s(e % 24), F.lit(":"), F.lpad(s(e % 60), 2, "0"), F.lit(" Uhr"))
    word = F.element_at(F.array(*[F.lit(w) for w in (" Ja", "X", "nein", "", "0")]), (e % 5 + 1).cast("int"))
    house = F.when(e % 2 == 0, F.concat(s(e % 90 + 1), F.lit("B-"), s(e % 90 + 3))).otherwise(s(e % 90 + 1))
    at = F.format_string("48.%02d", e % 90)
    place = T.coordinates(F.when(e % 3 == 0, F.concat(F.lit("11.25, "), at)).otherwise(F.concat(at, F.lit(" 11.25"))))
    return table(spark, sf, "events").select("event_id", F.round(T.clock_hour(clock), 6).alias("hour"), T.yes(word).alias("yes"), F.array_join(T.house_variants(house), ",").alias("house"), place["lat"].alias("lat"), place["lon"].alias("lon"))
