"""Labels, classes, findings, addresses and meters: small rules over columns, and the joins that bring findings, meters and contracts together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col


def fixed_side(day, cut) -> Column:
    """after strictly behind the cut-off day, else before; NULL without a day."""
    return F.when(col(day) > col(cut), "after").when(col(day).isNotNull(), "before")


def season_group(day) -> Column:
    """winter (November to March), summer (May to September), transition (April, October)."""
    m = F.month(col(day))
    return F.when(m.isin(11, 12, 1, 2, 3), "winter").when(m.isin(5, 6, 7, 8, 9), "summer").when(m.isNotNull(), "transition")


def building_area(old_share, bounds: tuple[float, float] = (1 / 3, 2 / 3)) -> Column:
    """new up to a third of old buildings, old from two thirds on, mixed between; NULL where it is unknown."""
    x = col(old_share)
    return F.when(x <= bounds[0], "new").when(x >= bounds[1], "old").when(x.isNotNull(), "mixed")


def traffic_light(t, bounds: tuple[float, float, float] = (45.0, 50.0, 55.0)) -> Column:
    """green below the first bound, yellow below the second, orange below the third, red from there on, grey if unknown."""
    x = col(t)
    return F.when(x.isNull(), "grey").when(x < bounds[0], "green").when(x < bounds[1], "yellow").when(x < bounds[2], "orange").otherwise("red")


def percent(x) -> Column:
    """A difference of logarithms in percent."""
    return 100 * (F.exp(col(x)) - 1)


def kelvin(x) -> Column:
    """kWh per cubic metre of water as a spread in kelvin (1.163 kWh for each kelvin)."""
    return col(x) / 1.163


def ternary_xy(flow, spread, power) -> tuple[Column, Column]:
    """Place in the triangle whose corners are all flow (0, 0), all spread (1, 0) and all power (1/2, sqrt(3)/2)."""
    return col(spread) + col(power) / 2, col(power) * F.sqrt(F.lit(3.0)) / 2


def action_class(pattern, p_valve, cluster, bound: float = 0.5) -> Column:
    """Which of the three actions: valve where the pattern or the probability says so, control for any other pattern or a bad cluster, else none."""
    known = F.coalesce(col(pattern) != "", F.lit(False))
    valve = F.coalesce(col(pattern) == "valve", F.lit(False)) | F.coalesce(col(p_valve) >= bound, F.lit(False))
    return F.when(valve, "replace valve").when(known | F.coalesce(col(cluster) == "bad", F.lit(False)), "tune control").otherwise("none")


def setpoint_changed(pairs: list[tuple[str, str]]) -> Column:
    """True if any old and new value are both there and differ as trimmed text."""
    one = lambda a, b: F.coalesce((F.trim(F.col(a).cast("string")) != "") & (F.trim(F.col(b).cast("string")) != "") & (F.trim(F.col(a).cast("string")) != F.trim(F.col(b).cast("string"))), F.lit(False))
    return reduce(lambda a, b: a | b, [one(a, b) for a, b in pairs])


def special_reasons(df: DataFrame, outside: list[str], volume: str, least: int = 2, share: float = 0.10) -> DataFrame:
    """df with reasons: at least `least` metrics outside what was learned (named), and more than `share` of the network's volume; '' if neither holds."""
    total = df.agg(F.sum(volume).alias("_t"))
    names = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in outside]))
    d = df.crossJoin(F.broadcast(total)).withColumn("_o", names)
    parts = [F.when(F.size("_o") >= least, F.concat(F.lit("outside: "), F.array_join("_o", "+"))), F.when(F.col(volume) > share * F.col("_t"), "large share")]
    return d.withColumn("reasons", F.concat_ws("; ", *parts)).drop("_t", "_o")


def knowledge_status(parts: list[tuple[Column, str, str]]) -> Column:
    """One sentence of each part's two texts, joined by '; ': what is known of an entity and what is not."""
    return F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), yes).otherwise(no) for c, yes, no in parts])


def actions(df: DataFrame, key: str, special: Column, rules: list[tuple[Column, str, str]], confirmed: Column, p: str) -> DataFrame:
    """key, actions, urgency: the texts of the rules (condition, text, urgency) that hold; a special case gets 'check data' alone; high stands only where the network confirms it, else
    it is medium."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("t"), F.lit(u).alias("u"))) for c, t, u in rules]))
    d = df.withColumn("_h", hits).withColumn("_s", F.coalesce(special, F.lit(False)))
    has = lambda u: F.exists("_h", lambda h: h["u"] == u)
    urgency = F.when(F.col("_s"), "medium").when(has("high") & F.coalesce(confirmed, F.lit(False)), "high").when(has("high") | has("medium"), "medium").when(has("low"), "low").otherwise("none")
    return d.select(key, F.when(F.col("_s"), "check data").otherwise(F.array_join(F.transform("_h", lambda h: h["t"]), "; ")).alias("actions"), urgency.alias("urgency"), F.col(p).alias("p"))


def labels_by_entity(df: DataFrame, key: str, day: str, flags: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """key, each flag OR-ed over its rows, first_year, and category: the first one of which a flag holds."""
    g = df.groupBy(key).agg(*[F.max(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags], F.min(F.year(day)).alias("first_year"))
    out = F.when(F.lit(False), "")
    for name, own in categories.items():
        out = out.when(reduce(lambda a, b: a | b, [F.col(f) for f in own]), name)
    return g.withColumn("category", out)


def uncoded(df: DataFrame, text: str, flags: list[str]) -> DataFrame:
    """Rows with a text that no flag took up."""
    none = reduce(lambda a, b: a & b, [~F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return df.where(F.col(text).isNotNull() & (F.trim(text) != "") & none)


def type_group(kind) -> Column:
    """Groups of station types by what their name holds, the first that fits; other otherwise, unknown without a name."""
    x = F.lower(col(kind))
    return F.when(x.isNull() | (F.trim(x) == ""), "unknown").when(x.contains("direct"), "direct").when(x.contains("storage") | x.contains("tank"), "storage").when(x.contains("flow"), "flow").otherwise("other")


def meter_for_address(directory: DataFrame, key: str, meter: str, year: str, with_data: DataFrame) -> DataFrame:
    """key, meter: of an address's latest year the meter that has data, of several the lowest; the lowest if none has."""
    last = directory.groupBy(key).agg(F.max(year).alias(year))
    d = directory.join(last, [key, year]).select(key, meter).distinct().join(with_data.select(meter).distinct().withColumn("_d", F.lit(0)), meter, "left")
    return d.groupBy(key).agg(F.min(F.struct(F.coalesce("_d", F.lit(1)).alias("d"), F.col(meter).alias("m"))).alias("_b")).select(key, F.col("_b.m").alias(meter))


def visits_by_meter(visits: DataFrame, directory: DataFrame, key: str, meter: str, day: str) -> DataFrame:
    """meter, dates (in order, each once), n: visits through their address; addresses without a meter drop out."""
    j = visits.join(directory.select(key, meter), key, "left").where(F.col(meter).isNotNull() & F.col(day).isNotNull())
    return j.groupBy(meter).agg(F.sort_array(F.collect_set(day)).alias("dates"), F.countDistinct(day).alias("n"))


def contract_for(meters: DataFrame, nodes: DataFrame, directory: DataFrame, key: str, meter: str, value: str) -> DataFrame:
    """meter, value, source: node (the meter's own value), address (through its address, where one meter and one value stand), shared (several meters at it), ambiguous (several
    values), missing."""
    own = nodes.where(F.col(meter).isNotNull() & F.col(value).isNotNull()).groupBy(meter).agg(F.max(value).alias("_own"))
    at = nodes.where(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("_values"), F.max(value).alias("_v"))
    many = directory.groupBy(key).agg(F.countDistinct(meter).alias("_meters"))
    first = directory.groupBy(meter).agg(F.min(key).alias(key))
    d = meters.select(meter).distinct().join(own, meter, "left").join(first, meter, "left").join(at, key, "left").join(many, key, "left")
    source = F.when(F.col("_own").isNotNull(), "node").when(F.col("_v").isNull(), "missing").when(F.col("_values") > 1, "ambiguous").when(F.col("_meters") > 1, "shared").otherwise("address")
    d = d.withColumn("source", source)
    return d.select(meter, F.when(F.col("source") == "node", F.col("_own")).when(F.col("source") == "address", F.col("_v")).alias(value), "source")


def snapped_graph(lines: DataFrame, key: str, points: str, snap: float = 0.05) -> DataFrame:
    """a, b, length: edges between consecutive points of each line (an array of structs x, y), points snapped to a grid; of parallel edges the shortest, no loops. Nodes are 'x:y' in grid steps."""
    at = lambda p: F.concat_ws(":", F.round(p["x"] / snap).cast("bigint").cast("string"), F.round(p["y"] / snap).cast("bigint").cast("string"))
    step = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda p, q: F.struct(at(p).alias("p"), at(q).alias("q"), F.hypot(p["x"] - q["x"], p["y"] - q["y"]).alias("l")))
    e = lines.where(F.size(points) >= 2).select(F.explode(step).alias("e")).select(F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b"), "e.l").where("a <> b")
    return e.groupBy("a", "b").agg(F.min("l").alias("length"))
