"""Gap filling of metered channels: physical identities, profiles by hour and temperature class, counters, rate against counter, hold-out checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, hours_between

#: kW per litre an hour and kelvin (fixed value: heat capacity of water).
NOMINAL = 1.163e-3
#: Lower bounds of the temperature classes in degrees (fixed values).
CLASSES = (0.0, 5.0, 10.0, 15.0)


def identity_factor(df: DataFrame, key: str, flow: str, dt: str, power: str, least: int = 50) -> DataFrame:
    """key, factor: the median of power / (flow * dt) over hours of clear operation; the nominal value below `least` of them."""
    clear = (F.col(flow) > 50) & (F.col(dt) > 3) & (F.col(power) > 0)
    ratio = F.when(clear, F.col(power) / (F.col(flow) * F.col(dt)))
    return df.groupBy(key).agg(F.when(F.count(ratio) >= least, F.percentile(ratio, F.lit(0.5))).otherwise(F.lit(NOMINAL)).alias("factor"))


def identity_fill(df: DataFrame, key: str, flow: str, power: str, dt: str, vl: str, rt: str, least: int = 50) -> DataFrame:
    """df whose missing channels follow from the others, in a fixed order: spread, return, supply, power, flow (only at a spread above 0.5)."""
    d = df.join(identity_factor(df, key, flow, dt, power, least).withColumnRenamed("factor", "_k"), key)
    d = d.withColumn(dt, F.coalesce(dt, F.col(vl) - F.col(rt))).withColumn(rt, F.coalesce(rt, F.col(vl) - F.col(dt))).withColumn(vl, F.coalesce(vl, F.col(rt) + F.col(dt)))
    d = d.withColumn(power, F.coalesce(power, F.col("_k") * F.col(flow) * F.col(dt)))
    return d.withColumn(flow, F.coalesce(flow, F.when(F.col(dt) > 0.5, F.col(power) / (F.col("_k") * F.col(dt))))).drop("_k")


def temperature_class(t: str, bounds=CLASSES) -> Column:
    """How many bounds the temperature reaches; -1 where it is unknown."""
    n = F.lit(0)
    for b in bounds:
        n = n + (F.col(t) >= b).cast("int")
    return F.when(F.col(t).isNull(), -1).otherwise(n)


def hour_profile(df: DataFrame, key: str, ts: str, t: str, value: str, least: int = 5) -> DataFrame:
    """df with profile: the entity's mean of the value by hour and temperature class, else by hour, else over all its rows, else the median of the
    entities' means; the first that stands on at least `least` values (any number for the last two)."""
    d = df.withColumn("_h", F.hour(ts)).withColumn("_c", temperature_class(t))
    mean = lambda by, name: d.groupBy(*by).agg(F.when(F.count(value) >= least, F.avg(value)).alias(name))
    fine, rough = mean([key, "_h", "_c"], "_p1").where("_c >= 0"), mean([key, "_h"], "_p2")
    own = d.groupBy(key).agg(F.avg(value).alias("_p3"))
    net = own.agg(F.percentile("_p3", F.lit(0.5)).alias("_p4"))  # one row
    d = d.join(fine, [key, "_h", "_c"], "left").join(rough, [key, "_h"], "left").join(own, key).crossJoin(F.broadcast(net))
    return d.withColumn("profile", F.coalesce("_p1", "_p2", "_p3", "_p4")).drop("_h", "_c", "_p1", "_p2", "_p3", "_p4")


def around(df: DataFrame, key: str, order: str, what: Column, before: str = "_p", after: str = "_n") -> DataFrame:
    """df with the last known `what` up to each row and the first known from it on. Both are running frames, so the work is linear."""
    up, down = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    start = Window.unboundedPreceding
    return df.withColumn(before, F.last(what, True).over(up.rowsBetween(start, 0))).withColumn(after, F.last(what, True).over(down.rowsBetween(start, 0)))


def counter_fill(df: DataFrame, key: str, ts: str, counter: str, rate: str, jump: float = 2.0) -> DataFrame:
    """On a regular grid: the counter between two readings takes their difference in proportion to the trapezoids of the rate (evenly where they are 0). A
    difference below 0 or above jump times the highest rate (quantile 0.999) is a changed meter: trapezoids are then added to the left reading. Before the first
    and after the last reading trapezoids alone count; without any reading the counter starts at 0."""
    w = Window.partitionBy(key).orderBy(ts)
    top = df.groupBy(key).agg(F.percentile(rate, F.lit(0.999)).alias("_top"))
    step = F.greatest(F.coalesce((F.col(rate) + F.lag(rate).over(w)) / 2, F.lit(0.0)), F.lit(0.0))
    d = df.join(top, key).withColumn("_i", F.row_number().over(w)).withColumn("_w", F.when(F.col("_i") == 1, F.lit(0.0)).otherwise(step))
    d = d.withColumn("_s", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(F.col(counter).isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_s").alias("s"), F.col(counter).alias("c")))
    d = around(d, key, "_i", known)
    diff, span, seg = F.col("_n.c") - F.col("_p.c"), F.col("_n.i") - F.col("_p.i"), F.col("_n.s") - F.col("_p.s")
    fair = (diff >= 0) & (diff <= jump * F.col("_top") * span)
    inside = F.when(fair & (seg > 1e-6), F.col("_p.c") + diff * (F.col("_s") - F.col("_p.s")) / seg).when(fair, F.col("_p.c") + diff * (F.col("_i") - F.col("_p.i")) / span)
    forward = F.col("_p.c") + F.col("_s") - F.col("_p.s")
    out = F.coalesce(F.col(counter), F.when(F.col("_p").isNull() & F.col("_n").isNull(), F.col("_s")), F.when(F.col("_p").isNull(), F.col("_n.c") - F.col("_n.s") + F.col("_s")), inside, forward)
    return d.withColumn("filled", F.col(counter).isNull()).withColumn(counter, out).drop("_top", "_i", "_w", "_s", "_p", "_n")


def rate_ratio(df: DataFrame, key: str, ts: str, rate: str, counter: str, least: int = 500) -> DataFrame:
    """key, pairs, ratio: trapezoids of the rate by differences of the counter over pairs of complete rows one hour apart, held to [0.5, 2]; 1 below
    `least` pairs or without a difference."""
    w = Window.partitionBy(key).orderBy(ts)
    full = F.col(rate).isNotNull() & F.col(counter).isNotNull()
    d = df.withColumn("_d", F.col(counter) - F.lag(counter).over(w)).withColumn("_t", (F.col(rate) + F.lag(rate).over(w)) / 2)
    d = d.withColumn("_ok", F.coalesce(full & F.lag(full).over(w) & (hours_between(ts, F.lag(ts).over(w)) == 1) & (F.col("_d") >= 0), F.lit(False)))
    g = d.groupBy(key).agg(F.count(F.when(F.col("_ok"), 1)).alias("pairs"), F.sum(F.when(F.col("_ok"), F.col("_t"))).alias("_t"), F.sum(F.when(F.col("_ok"), F.col("_d"))).alias("_d"))
    return g.select(key, "pairs", F.when((F.col("pairs") >= least) & (F.col("_d") > 0), clip(F.col("_t") / F.col("_d"), 0.5, 2.0)).otherwise(F.lit(1.0)).alias("ratio"))


def holdout(df: DataFrame, key: str, ts: str, t: str, value: str, hidden: Column, least: int = 5) -> DataFrame:
    """method, n, mae, relative_sum: measured values for which hidden holds are taken out, filled linearly between the rows around them and by the profile of
    the rest, and compared. relative_sum: absolute error of the sum by the sum."""
    d = df.withColumn("_true", F.when(F.coalesce(hidden, F.lit(False)), F.col(value))).withColumn("_left", F.when(~F.coalesce(hidden, F.lit(False)), F.col(value)))
    d = hour_profile(d, key, ts, t, "_left", least).withColumn("_x", F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(3.6e9))
    d = around(d, key, "_x", F.when(F.col("_left").isNotNull(), F.struct(F.col("_x").alias("x"), F.col("_left").alias("y"))))
    line = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * (F.col("_x") - F.col("_p.x")) / (F.col("_n.x") - F.col("_p.x"))
    d = d.where("_true is not null").select("_true", F.explode(F.array(F.struct(F.lit("linear").alias("method"), line.alias("got")), F.struct(F.lit("profile").alias("method"), F.col("profile").alias("got")))).alias("_m")).select("_true", "_m.*")
    d = d.where("got is not null")
    return d.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("got") - F.col("_true"))).alias("mae"), F.try_divide(F.abs(F.sum("got") - F.sum("_true")), F.sum("_true")).alias("relative_sum"))
