"""Load steps, cooling, balanced gap filling, adaptive windows, pairs of windows, ternary shares, status weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between


def load_steps(df: DataFrame, key: str, ts: str, load: str, answer: str, rise: float, hours: int = 6, share: float = 0.63, least: float = 0.2) -> DataFrame:
    """key, ts, step, response_h: steps of load above `rise` from one hour to the next, and after how many hours the answer has gone `share` of
    its largest excursion in the next `hours` complete hours; NULL where it moves less than `least` or an hour is missing."""
    w = Window.partitionBy(key).orderBy(ts)
    d = df.withColumn("_step", F.when(hours_between(ts, F.lag(ts).over(w)) == 1, F.col(load) - F.lag(load).over(w)))
    ahead = F.array(*[F.when(hours_between(F.lead(ts, i).over(w), ts) == i, F.lead(answer, i).over(w) - F.lag(answer).over(w)) for i in range(1, hours + 1)])
    d = d.withColumn("_a", ahead).where(F.col("_step") > rise)
    full = F.forall("_a", lambda x: x.isNotNull())
    size = F.array_max(F.transform("_a", lambda x: F.abs(x)))
    reached = F.array_min(F.transform("_a", lambda x, i: F.when(F.abs(x) >= share * size, i + 1)))
    return d.select(key, ts, F.col("_step").alias("step"), F.when(full & (size >= least), reached).cast("int").alias("response_h"))


def cooling(df: DataFrame, key: str, ts: str, flow: str, t: str, most_flow: float, least_t: float, least: int) -> DataFrame:
    """key, n, rate: median fall of temperature per hour at standstill (both flows at most most_flow, exactly an hour apart); NULL below `least` hours."""
    w = Window.partitionBy(key).orderBy(ts)
    still = (hours_between(F.lead(ts).over(w), ts) == 1) & (F.col(flow) <= most_flow) & (F.lead(flow).over(w) <= most_flow) & (F.col(t) > least_t)
    d = df.withColumn("_fall", F.when(still, F.col(t) - F.lead(t).over(w)))
    return d.groupBy(key).agg(F.count("_fall").alias("n"), F.when(F.count("_fall") >= least, F.percentile("_fall", F.lit(0.5))).alias("rate"))


def cooling_sides(df: DataFrame, key: str, ts: str, flow: str, t: str, most_flow: float, least_t: float, least: int, before: Column) -> DataFrame:
    """key, rate_before, rate_after, d_rate: the cooling rate of the hours for which before holds and of the others."""
    w = Window.partitionBy(key).orderBy(ts)
    still = (hours_between(F.lead(ts).over(w), ts) == 1) & (F.col(flow) <= most_flow) & (F.lead(flow).over(w) <= most_flow) & (F.col(t) > least_t)
    d = df.withColumn("_fall", F.when(still, F.col(t) - F.lead(t).over(w))).withColumn("_b", before)
    rate = lambda c: F.when(F.count(c) >= least, F.percentile(c, F.lit(0.5)))
    g = d.groupBy(key).agg(rate(F.when(F.col("_b"), F.col("_fall"))).alias("rate_before"), rate(F.when(~F.col("_b"), F.col("_fall"))).alias("rate_after"))
    return g.withColumn("d_rate", F.col("rate_after") - F.col("rate_before"))


def balanced_fill(df: DataFrame, key: str, ts: str, rate: str, counter: str, short: int = 3) -> DataFrame:
    """On an hourly grid: rate with its gaps filled, and source (measured, interpolated, balanced, modelled).

    Gaps of at most `short` steps are interpolated. Longer ones take the entity's mean of the hour of day, scaled so that the gap's
    sum is what the counter went up between the readings on both sides (balanced) where both are there and the
    difference is plausible, else unscaled (modelled). Gaps at the ends are modelled."""
    w = Window.partitionBy(key).orderBy(ts)
    past, on = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(rate).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(rate).alias("v"), F.col(counter).alias("c")))
    d = d.withColumn("_p", F.last(at, True).over(past)).withColumn("_n", F.last(at, True).over(on))
    profile = df.groupBy(key, F.hour(ts).alias("_h")).agg(F.avg(rate).alias("_hm"))
    mean = df.groupBy(key).agg(F.avg(rate).alias("_m"), F.max(rate).alias("_top"))
    d = d.withColumn("_h", F.hour(ts)).join(profile, [key, "_h"], "left").join(mean, key, "left").withColumn("_model", F.coalesce("_hm", "_m"))
    gap = F.col("_n.i") - F.col("_p.i")
    d = d.withColumn("_gap", F.when(F.col(rate).isNull(), gap - 1))
    span = F.sum(F.when(F.col(rate).isNull(), F.col("_model"))).over(Window.partitionBy(key, "_p.i"))
    used = F.col("_n.c") - F.col("_p.c") - F.col("_n.v")  # the counter holds the hour that ends with the reading after the gap
    fair = (used >= 0) & (used <= 2 * F.col("_top") * F.col("_gap"))
    d = d.withColumn("_span", span)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / gap
    source = F.when(F.col(rate).isNotNull(), "measured").when(F.col("_gap") <= short, "interpolated").when(fair & (F.col("_span") > 0), "balanced").otherwise("modelled")
    d = d.withColumn("source", source)
    filled = F.when(F.col("source") == "measured", F.col(rate)).when(F.col("source") == "interpolated", line).when(F.col("source") == "balanced", F.col("_model") * used / F.col("_span")).otherwise(F.col("_model"))
    return d.withColumn(rate, filled).drop("_i", "_p", "_n", "_h", "_hm", "_m", "_top", "_model", "_gap", "_span")


def adaptive_windows(df: DataFrame, key: str, day: str, x: str, y: str, step: int = 7, least: int = 30, narrow: int = 14, wide: int = 60) -> DataFrame:
    """key, window_end, width, n, slope: every `step` days the narrowest trailing window of narrow..wide days with at least `least` points, and the slope of
    y on x in it. Running sums by day answer all widths by difference; NULL slope where even the widest has too few."""
    n = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    sums = {"n": n, "sx": n * F.col(x), "sy": n * F.col(y), "sxx": n * F.col(x) * F.col(x), "sxy": n * F.col(x) * F.col(y)}
    daily = df.groupBy(key, day).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in sums.items()])
    ends = daily.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = ends.select(key, "_a", F.explode(F.sequence("_a", "_b")).alias(day))
    w = Window.partitionBy(key).orderBy(day)
    full = grid.join(daily, [key, day], "left").select(key, day, "_a", *[F.sum(F.coalesce(k, F.lit(0.0))).over(w).alias(k) for k in sums])
    run = F.struct(*sums)
    # a window holds the running sums of at most wide + 1 days before its end
    d = full.withColumn("_before", F.collect_list(run).over(w.rowsBetween(-wide, -narrow)))
    d = d.where(F.pmod(F.datediff(day, "_a"), F.lit(step)) == 0)
    start = F.datediff(day, "_a")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in sums])
    # positions from the end of the list: narrow days back comes last; before the series all sums are 0
    widths = F.sequence(F.lit(narrow), F.lit(wide))
    at = lambda m: F.when(start >= m, F.try_element_at("_before", -(m - narrow + 1))).otherwise(zero)
    pick = F.try_element_at(F.filter(widths, lambda m: F.col("n") - at(m)["n"] >= least), F.lit(1))
    d = d.withColumn("_pick", pick).withColumn("width", F.coalesce("_pick", F.lit(wide)))
    low = at(F.col("width"))
    v = {k: F.col(k) - low[k] for k in sums}
    det = v["n"] * v["sxx"] - v["sx"] * v["sx"]
    slope = F.when(F.col("_pick").isNotNull() & (det > 1e-9), (v["n"] * v["sxy"] - v["sx"] * v["sy"]) / det)
    return d.select(key, F.col(day).alias("window_end"), "width", v["n"].cast("bigint").alias("n"), slope.alias("slope"))


def calendar_pairs(df: DataFrame, visits: DataFrame, key: str, day: str, aggs: dict[str, Column], days: int = 90) -> DataFrame:
    """key, visit and each aggregate after the visit (days 1 to `days`), in the same calendar days a year before, and their difference."""
    v = visits.select(key, F.col(day).alias("visit"))
    d = df.join(v, key)  # an entity has a few visits
    off = F.datediff(day, "visit")
    d = d.withColumn("_side", F.when(off.between(1, days), "after").when(off.between(1 - 365, days - 365), "before")).where("_side is not null")
    g = d.groupBy(key, "visit", "_side").agg(*[c.alias(k) for k, c in aggs.items()])
    side = lambda s: g.where(F.col("_side") == s).select(key, "visit", *[F.col(k).alias(f"{k}_{s}") for k in aggs])
    out = v.distinct().join(side("before"), [key, "visit"], "left").join(side("after"), [key, "visit"], "left")
    return out.withColumns({f"{k}_change": F.col(f"{k}_after") - F.col(f"{k}_before") for k in aggs})


def transitions(pairs: DataFrame, before: Column, after: Column) -> DataFrame:
    """good_good, good_bad, bad_good, bad_bad: a row of counts; rows with a NULL side are left out."""
    d = pairs.select(before.alias("b"), after.alias("a")).where("a is not null and b is not null")
    return d.agg(*[F.count(F.when((F.col("b") == x) & (F.col("a") == y), 1)).alias(f"{'bad' if x else 'good'}_{'bad' if y else 'good'}") for x in (False, True) for y in (False, True)])


def ternary(df: DataFrame, key: str, columns: tuple[str, str, str], q: float = 0.95) -> DataFrame:
    """df with share_<column>: each column by its entity's q-quantile, held to [0, 1], as a share of the three; NULL unless all are known and their sum is positive."""
    top = df.groupBy(key).agg(*[F.percentile(c, F.lit(q)).alias(f"_q{i}") for i, c in enumerate(columns)])
    d = df.join(top, key)
    part = [F.when(F.col(f"_q{i}") > 0, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c) / F.col(f"_q{i}"), F.lit(0.0)), F.lit(1.0)))) for i, c in enumerate(columns)]
    total = part[0] + part[1] + part[2]
    return d.withColumns({f"share_{c}": F.when(total > 0, p / total) for c, p in zip(columns, part, strict=True)}).drop("_q0", "_q1", "_q2")


def week_status(alarms: DataFrame, observed: DataFrame, key: str, day: str, direction: str, weeks: DataFrame, window: int = 28) -> DataFrame:
    """key, week, status: worse before better before watched before no_data, from the trailing `window` days of each week's first day."""
    spread = lambda d: d.withColumn("_w", F.explode(F.sequence(F.col(day), F.date_add(day, window - 1))))
    a = spread(alarms).groupBy(key, F.col("_w").alias("week")).agg(F.max((F.col(direction) == 1).cast("int")).alias("_worse"), F.lit(1).alias("_any"))
    o = spread(observed.select(key, day).distinct()).select(key, F.col("_w").alias("week")).distinct().withColumn("_seen", F.lit(1))
    ids = observed.select(key).distinct()
    grid = ids.crossJoin(F.broadcast(weeks.select("week")))  # the calendar: some hundred weeks
    d = grid.join(a, [key, "week"], "left").join(o, [key, "week"], "left")
    return d.select(key, "week", F.when(F.col("_worse") == 1, "worse").when(F.col("_any") == 1, "better").when(F.col("_seen") == 1, "watched").otherwise("no_data").alias("status"))


def complete_days(df: DataFrame, key: str, ts: str, value: str, history: int = 7) -> DataFrame:
    """key, day, hours (24 values in order), has_history: days with all 24 hours, and whether the `history` days before are complete too."""
    d = df.where(F.col(value).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.hour(ts).alias("h"), F.col(value).alias("v")))).alias("_l"), F.countDistinct(F.hour(ts)).alias("_n"))
    d = d.where("_n = 24")
    w = Window.partitionBy(key).orderBy("day")
    return d.select(key, "day", F.transform("_l", lambda x: x["v"]).alias("hours"), F.coalesce(F.datediff("day", F.lag("day", history).over(w)) == history, F.lit(False)).alias("has_history"))


def nearest_point(points: DataFrame, grid: DataFrame, key: str, x: str, y: str, cell: float, name: str = "vertex", most_rounds: int = 40) -> DataFrame:
    """key, vertex, distance: the nearest grid point, of equally near ones the smallest. Points look into their own cell and those around it; what has no grid point within
    a cell's width looks again in cells of twice the width, until all have one (or the grid is empty)."""
    from tidemark.operators.graph import ready

    ready(points.sparkSession)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).alias("_x"), F.col(y).alias("_y")).checkpoint()
    vertices = grid.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(name), F.col(x).alias("_gx"), F.col(y).alias("_gy"))
    found = None
    for _ in range(most_rounds):
        a = left.withColumn("_d", F.explode(around)).select(key, "_x", "_y", (F.floor(F.col("_x") / cell) + F.col("_d.i")).alias("_cx"), (F.floor(F.col("_y") / cell) + F.col("_d.j")).alias("_cy"))
        b = vertices.withColumn("_cx", F.floor(F.col("_gx") / cell)).withColumn("_cy", F.floor(F.col("_gy") / cell))
        m = a.join(b, ["_cx", "_cy"]).withColumn("distance", F.hypot(F.col("_x") - F.col("_gx"), F.col("_y") - F.col("_gy"))).where(F.col("distance") <= cell)
        best = m.groupBy(key).agg(F.min(F.struct("distance", name)).alias("_b")).select(key, F.col(f"_b.{name}").alias(name), F.col("_b.distance").alias("distance")).checkpoint()
        found = best if found is None else found.unionByName(best)
        left = left.join(best, key, "left_anti").checkpoint()
        if left.isEmpty() or (best.isEmpty() and vertices.isEmpty()):
            break
        cell *= 2
    return points.select(key).join(found, key, "left")
