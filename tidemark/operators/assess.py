"""Assessment of entities: reference periods, curve monitors, skill, dynamics, metrics of windows and periods, scores, patterns, ranked lists, effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between
from tidemark.operators import stats as S


# ---------------------------------------------------------------- reference periods and curve monitors

def reference(days: DataFrame, visits: DataFrame, key: str, day: str, t: str, length: int = 365, apart: int = 14, least_days: int = 60, least_span: float = 8.0) -> DataFrame:
    """key, ref_start, ref_end (the day after), end_reason (year or visit), ref_days, ref_span, watched_days and status. The reference begins on the first usable day and lasts
    a year, or until `apart` days before the first later visit. status: too_few_days, small_span, nothing_after or ok."""
    start = days.groupBy(key).agg(F.min(day).alias("ref_start"))
    later = visits.select(key, F.col(day).alias("_v")).join(start, key).where(F.col("_v") > F.col("ref_start")).groupBy(key).agg(F.date_sub(F.min("_v"), apart).alias("_e"))
    ref = start.join(later, key, "left").withColumn("_y", F.date_add("ref_start", length))
    cut = F.coalesce(F.col("_e") < F.col("_y"), F.lit(False))
    ref = ref.withColumn("ref_end", F.when(cut, F.col("_e")).otherwise(F.col("_y"))).withColumn("end_reason", F.when(cut, "visit").otherwise("year"))
    inside, after = F.col(day) < F.col("ref_end"), F.col(day) >= F.col("ref_end")
    d = days.join(ref.select(key, "ref_start", "ref_end", "end_reason"), key)
    g = d.groupBy(key, "ref_start", "ref_end", "end_reason").agg(F.count(F.when(inside, 1)).alias("ref_days"), F.coalesce(F.max(F.when(inside, F.col(t))) - F.min(F.when(inside, F.col(t))), F.lit(0.0)).alias("ref_span"), F.count(F.when(after, 1)).alias("watched_days"))
    return g.withColumn("status", F.when(F.col("ref_days") < least_days, "too_few_days").when(F.col("ref_span") < least_span, "small_span").when(F.col("watched_days") == 0, "nothing_after").otherwise("ok"))


def curve_models(days: DataFrame, ref: DataFrame, key: str, day: str, t: str, y: str, most_phi: float = 0.8) -> DataFrame:
    """key, slope, intercept (Theil-Sen over the reference), s (1.4826 MAD of the residuals, at least 1e-6), phi (correlation of adjacent residuals, 0 below three), factor
    (what autocorrelation widens s by, phi held to 0..most_phi), s_eff: of entities whose reference is ok."""
    ok = ref.where("status = 'ok'").select(key, "ref_end")
    r = days.join(ok, key).where(F.col(day) < F.col("ref_end"))
    line = S.theil_sen(r, [key], t, y)
    rest = r.join(line, key).withColumn("_r", F.col(y) - F.col("intercept") - F.col("slope") * F.col(t))
    rest = rest.withColumn("_l", F.lag("_r").over(Window.partitionBy(key).orderBy(day)))
    med = rest.groupBy(key, "slope", "intercept").agg(F.percentile("_r", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"), F.corr("_r", "_l").alias("_phi"))
    mad = rest.join(med.select(key, "_m"), key).groupBy(key).agg((1.4826 * F.percentile(F.abs(F.col("_r") - F.col("_m")), F.lit(0.5))).alias("_s"))
    phi = F.when((F.col("_n") >= 3) & F.col("_phi").isNotNull() & ~F.isnan("_phi"), F.col("_phi")).otherwise(0.0)
    m = med.join(mad, key).withColumn("s", F.greatest("_s", F.lit(1e-6))).withColumn("phi", phi)
    held = F.least(F.greatest("phi", F.lit(0.0)), F.lit(most_phi))
    m = m.withColumn("factor", F.sqrt((1 + held) / (1 - held)))
    return m.select(key, "slope", "intercept", "s", "phi", "factor", (F.col("s") * F.col("factor")).alias("s_eff"))


def curve_deviation(days: DataFrame, ref: DataFrame, models: DataFrame, key: str, day: str, t: str, y: str) -> DataFrame:
    """key, day, expected, residual and z of every day after the reference."""
    d = days.join(ref.select(key, "ref_end"), key).join(models, key).where(F.col(day) >= F.col("ref_end"))
    d = d.withColumn("expected", F.col("intercept") + F.col("slope") * F.col(t)).withColumn("residual", F.col(y) - F.col("expected"))
    return d.select(key, day, "expected", "residual", (F.col("residual") / F.col("s_eff")).alias("z"))


def curve_skill(days: DataFrame, ref: DataFrame, models: DataFrame, visits: DataFrame, key: str, day: str, t: str, y: str, most: int = 120, before: int = 7, least: int = 20) -> DataFrame:
    """key, days, error_model, error_naive, skill: mean absolute errors of the curve and of the reference's median over the first `most` days after the reference that lie more
    than `before` days before the next visit; entities with fewer than `least` such days are left out."""
    r = ref.select(key, "ref_end")
    nxt = visits.select(key, F.col(day).alias("_v")).join(r, key).where(F.col("_v") >= F.col("ref_end")).groupBy(key).agg(F.min("_v").alias("_v"))
    naive = days.join(r, key).where(F.col(day) < F.col("ref_end")).groupBy(key).agg(F.percentile(y, F.lit(0.5)).alias("_med"))
    d = curve_deviation(days, ref, models, key, day, t, y).join(days.select(key, day, F.col(y).alias("_y")), [key, day]).join(nxt, key, "left").join(naive, key)
    d = d.where(F.col("_v").isNull() | (F.col(day) < F.date_sub("_v", before))).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(day))).where(F.col("_i") <= most)
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("days"), F.avg(F.abs("residual")).alias("error_model"), F.avg(F.abs(F.col("_y") - F.col("_med"))).alias("error_naive")).where(F.col("days") >= least)
    return g.withColumn("skill", F.when(F.col("error_naive") > 0, 1 - F.col("error_model") / F.col("error_naive")))


def season_factor(df: DataFrame, season: Column, deviation: str, scale: str, least: int) -> DataFrame:
    """season, n, factor: the median of |deviation| / scale by the one over all seasons (1 below `least` rows): what a season's spread is worth."""
    d = df.select(season.alias("season"), (F.abs(F.col(deviation)) / F.col(scale)).alias("_x")).where("_x is not null")
    g, whole = S.large_medians(d, "season", "_x")
    g = g.withColumnRenamed("median", "_m").crossJoin(F.broadcast(whole.select(F.col("median").alias("_w"))))
    return g.select("season", "n", F.when((F.col("n") >= least) & (F.col("_w") > 0), F.col("_m") / F.col("_w")).otherwise(1.0).alias("factor"))


def residual_by_day(df: DataFrame, key: str, ts: str, residual: str, least: int = 3) -> DataFrame:
    """key, day, n, residual (median) on the full calendar between an entity's first and last row; NULL below `least` rows."""
    g = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(residual).alias("n"), F.percentile(residual, F.lit(0.5)).alias("_m"))
    ends = df.groupBy(key).agg(F.to_date(F.min(ts)).alias("_a"), F.to_date(F.max(ts)).alias("_b")).select(key, F.explode(F.sequence("_a", "_b")).alias("day"))
    return ends.join(g, [key, "day"], "left").select(key, "day", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.col("_m")).alias("residual"))


# ---------------------------------------------------------------- dynamics and metrics of windows

def dynamics(df: DataFrame, key: str, ts: str, x: str, partner: str, load: str, heavy: float, slow: float = 0.2, most_hours: float = 2.0, least: int = 12) -> DataFrame:
    """key, day, d1_mean, d1_p95, d2_mean (absolute first and second differences per hour), span, slow_share (loaded steps below `slow`), coupling (correlation with
    the partner channel), n_steps and n_load. Values are NULL below `least` steps (coupling: pairs; slow_share: also below three loaded steps)."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = hours_between(ts, F.lag(ts).over(w))
    d = df.withColumn("_d1", F.when((gap > 0) & (gap <= most_hours), (F.col(x) - F.lag(x).over(w)) / gap)).withColumn("_gap", gap)
    d = d.withColumn("_d2", F.when((F.col("_gap") > 0) & (F.col("_gap") <= most_hours), (F.col("_d1") - F.lag("_d1").over(w)) / F.col("_gap")))
    loaded = F.coalesce(F.col(load) > heavy, F.lit(False))
    step = F.when(loaded, F.abs("_d1"))
    both = F.col(x).isNotNull() & F.col(partner).isNotNull()
    g = d.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.count("_d1").alias("n_steps"), F.count(F.when(loaded, 1)).alias("n_load"), F.avg(F.abs("_d1")).alias("d1_mean"), F.percentile(F.abs("_d1"), F.lit(0.95)).alias("d1_p95"), F.avg(F.abs("_d2")).alias("d2_mean"),
        (F.max(x) - F.min(x)).alias("span"), F.avg((step < slow).cast("double")).alias("slow_share"), F.count(step).alias("_nl"), F.count(F.when(both, 1)).alias("_np"), F.corr(x, partner).alias("coupling"),
    )
    enough = F.col("n_steps") >= least
    g = g.withColumn("coupling", F.when((F.col("_np") >= least) & ~F.isnan("coupling"), F.col("coupling"))).withColumn("slow_share", F.when(F.col("_nl") >= 3, F.col("slow_share")))
    return g.select(key, "day", *[F.when(enough, F.col(c)).alias(c) for c in ("d1_mean", "d1_p95", "d2_mean", "span", "slow_share", "coupling")], "n_steps", "n_load")


def window_metrics(df: DataFrame, bounds: DataFrame, key: str, ts: str, group: list[str], heavy: float = 0.5) -> DataFrame:
    """key, group columns and thirteen metrics of the rows between start and end (included) of each row of bounds (key, *group, start, end): n_hours, coverage, day_coverage, rt_median,
    rt_loaded, dt_loaded, flow_median, load_share, peak, summer_flow, energy, volume, full_hours, energy_per_dh. Channels: rt, dt, flow, power, energy and volume (counters), dh.
    Windows without rows are there with n_hours 0."""
    calendar = F.timestamp_diff("HOUR", F.col("start").cast("timestamp"), F.col("end").cast("timestamp")) + 1
    b = bounds.withColumn("_cal", calendar)
    j = df.join(b, key).where((F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end")))  # an entity has a few windows
    on = F.coalesce(F.col("power") > heavy, F.lit(False))
    known = lambda c: F.max_by(c, ts) - F.min_by(c, ts)
    by = [key, *group]
    g = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_hours"), F.countDistinct(F.to_date(ts)).alias("_days"), F.percentile("rt", F.lit(0.5)).alias("rt_median"), F.avg(F.when(on, F.col("rt"))).alias("rt_loaded"),
        F.avg(F.when(on, F.col("dt"))).alias("dt_loaded"), F.percentile("flow", F.lit(0.5)).alias("flow_median"), F.avg(on.cast("double")).alias("load_share"), F.max("power").alias("peak"),
        F.percentile(F.when(F.month(ts).isin(6, 7, 8), F.col("flow")), F.lit(0.5)).alias("summer_flow"), known("energy").alias("_e"), known("volume").alias("_v"), F.sum("dh").alias("degree_hours"),
    )
    out = b.select(*by, "_cal").join(g, by, "left").withColumn("n_hours", F.coalesce("n_hours", F.lit(0)))
    two = F.col("n_hours") >= 2
    out = out.withColumn("energy", F.when(two, F.col("_e"))).withColumn("volume", F.when(two, F.col("_v")))
    return out.select(
        *by, "n_hours", (F.col("n_hours") / F.col("_cal")).alias("coverage"), (F.coalesce("_days", F.lit(0)) / F.greatest(F.lit(1.0), F.col("_cal") / 24.0)).alias("day_coverage"), "rt_median", "rt_loaded", "dt_loaded", "flow_median", "load_share", "peak", "summer_flow", "energy", "volume",
        (F.col("energy") * (8760.0 / F.col("_cal")) / F.greatest("peak", F.lit(0.1))).alias("full_hours"), F.when(F.col("degree_hours") > 0, F.col("energy") / F.col("degree_hours")).alias("energy_per_dh"), F.when(F.col("degree_hours") > 0, F.col("volume") / F.col("degree_hours")).alias("volume_per_dh"),
    )


def pair_rows(metrics: DataFrame, key: str, case: str, side: str, columns: list[str], state: str, bad_above: float) -> DataFrame:
    """key, case, <column>_before, <column>_after, d_<column>, state_before and state_after (bad where `state` is above the bound, NULL where it is unknown)."""
    pick = lambda s: metrics.where(F.col(side) == s).select(key, case, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    out = pick("before").join(pick("after"), [key, case], "full").withColumns({f"d_{c}": F.col(f"{c}_after") - F.col(f"{c}_before") for c in columns})
    return out.withColumns({f"state_{s}": F.when(F.col(f"{state}_{s}") > bad_above, "bad").when(F.col(f"{state}_{s}").isNotNull(), "good") for s in ("before", "after")})


def flag_inside(pairs: DataFrame, events: DataFrame, key: str, case: str, day: str, ranges: list[tuple[Column, Column]], out: str, not_case: bool = False) -> DataFrame:
    """pairs with a flag: an event of the entity lies in one of the ranges (and, if not_case, on another day than the case). Rows are marked, not dropped."""
    e = events.select(key, F.col(day).alias("_e")).distinct()
    hit = reduce(lambda a, b: a | b, [F.col("_e").between(lo, hi) for lo, hi in ranges])
    if not_case:
        hit = hit & (F.col("_e") != F.col(case))
    got = pairs.join(e, key).where(hit).select(key, case).distinct().withColumn(out, F.lit(True))
    return pairs.join(got, [key, case], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def event_axis(df: DataFrame, events: DataFrame, key: str, day: str, reach: int = 300) -> DataFrame:
    """df rows within `reach` days of each event of their entity, with event and days_from."""
    e = events.select(key, F.col(day).alias("event")).distinct()
    return df.join(e, key).withColumn("days_from", F.datediff(day, "event")).where(F.abs("days_from") <= reach)


def model_metrics(h: DataFrame, key: str, ts: str, winter: tuple[str, str], summer: tuple[str, str], limit: DataFrame | None = None, day_column: str = "limit", least_load: int = 100, least_days: int = 30, least_flowing: int = 20) -> DataFrame:
    """One row of characteristics per entity from a winter and a summer (half-open ranges): hours, night flow, flow-through share, night spread, return at 0 degrees (line over daily means up to
    15 degrees), loaded spread, return p90, coefficient of variation of the flow, night by day flow, summer load share, share of the flow in the variance of power, width of operating points,
    load-weighted return. limit: key and a day from which an entity's rows are cut off. Channels: flow, dt, rt, power, t_out."""
    d = h if limit is None else h.join(limit, key).where(F.col(ts) < F.col(day_column))
    t = F.col(ts)
    inside = lambda r: (t >= F.lit(r[0]).cast("timestamp_ntz")) & (t < F.lit(r[1]).cast("timestamp_ntz"))
    d = d.withColumn("_w", inside(winter)).withColumn("_s", inside(summer)).withColumn("_h", F.hour(ts))
    w, s = F.col("_w"), F.col("_s")
    night = s & (F.col("_h") <= 5) & F.col("flow").isNotNull()
    flowing = night & (F.col("flow") >= 5)
    load = w & (F.col("power") > 0.5) & (F.col("flow") > 1) & (F.col("dt") > 1) & F.col("rt").isNotNull()
    med = lambda cond, c: F.percentile(F.when(cond, F.col(c)), F.lit(0.5))
    lp, lf, ld = (F.when(load, F.ln(c)) for c in ("power", "flow", "dt"))
    n_load = F.count(F.when(load, 1))
    heavy = lambda c: F.when(n_load >= least_load, c)
    g = d.groupBy(key).agg(
        F.count(F.when(w, F.col("flow"))).alias("hours_winter"), F.count(F.when(s, F.col("flow"))).alias("hours_summer"), med(night, "flow").alias("summer_night_flow"), F.avg(F.when(night, (F.col("flow") >= 5).cast("double"))).alias("summer_flow_through"),
        F.when(F.count(F.when(flowing, 1)) >= least_flowing, med(flowing, "dt")).alias("summer_night_spread"), F.avg(F.when(load, F.col("dt"))).alias("winter_loaded_spread"), F.percentile(F.when(w, F.col("rt")), F.lit(0.9)).alias("winter_return_p90"),
        (F.stddev_samp(F.when(load, F.col("flow"))) / F.avg(F.when(load, F.col("flow")))).alias("winter_flow_cv"), med(w & (F.col("_h") <= 5), "flow").alias("_night"), med(w & F.col("_h").between(8, 20), "flow").alias("_day"),
        F.percentile(F.when(w, F.col("power")), F.lit(0.99)).alias("winter_peak"), F.try_divide(F.avg(F.when(s, F.col("power"))), F.avg(F.when((t < F.lit(summer[1]).cast("timestamp_ntz")) & (t >= F.add_months(F.lit(summer[1]).cast("date"), -12).cast("timestamp_ntz")), F.col("power")))).alias("summer_load_share"),
        heavy(F.try_divide(F.covar_pop(lp, lf), F.var_pop(lp))).alias("flow_share"), heavy(F.sqrt(F.var_pop(lf) + F.var_pop(ld))).alias("point_width"), heavy(F.sum(F.when(load, F.col("rt") * F.col("power"))) / F.sum(F.when(load, F.col("power")))).alias("return_weighted"),
    )
    days = d.where("_w").groupBy(key, F.to_date(ts).alias("_day")).agg(F.avg("rt").alias("_r"), F.avg("t_out").alias("_t")).where("_r is not null and _t <= 15")
    zero = days.groupBy(key).agg(F.when(F.count(F.lit(1)) >= least_days, F.regr_intercept("_r", "_t")).alias("winter_return_at_0"))
    return g.join(zero, key, "left").withColumn("winter_night_day_flow", F.when(F.col("_day") > 0, F.col("_night") / F.col("_day"))).drop("_night", "_day")


def saturation(h: DataFrame, key: str, ts: str, least_mild: int = 20, least_cold: int = 5, least_hours: int = 500, least_low: int = 100) -> DataFrame:
    """key, saturation (median of the daily flow peaks on days up to 1 degree by what the line of days of 3 to 12 degrees foretells), plateau (share of flowing hours at or above 95 % of the
    99-% value), low_load_return (median return of flowing hours below a fifth of the peak power); NULL where too few days or hours stand behind a value."""
    flowing = F.when(F.col("flow") > 1, F.col("flow"))
    top = h.groupBy(key).agg(F.percentile(flowing, F.lit(0.99)).alias("_f"), F.percentile(F.when((F.col("flow") > 1) & (F.col("power") > 0) & F.col("rt").isNotNull(), F.col("power")), F.lit(0.99)).alias("_p"))
    d = h.join(top, key)
    low = (F.col("flow") > 1) & (F.col("power") > 0) & (F.col("power") < 0.2 * F.col("_p"))
    g = d.groupBy(key).agg(F.when(F.count(flowing) >= least_hours, F.avg(F.when(F.col("flow") > 1, (F.col("flow") >= 0.95 * F.col("_f")).cast("double")))).alias("plateau"), F.when(F.count(F.when(low, F.col("rt"))) >= least_low, F.percentile(F.when(low, F.col("rt")), F.lit(0.5))).alias("low_load_return"))
    days = h.groupBy(key, F.to_date(ts).alias("_d")).agg(F.percentile("flow", F.lit(0.95)).alias("_y"), F.avg("t_out").alias("_t")).where("_y is not null and _t is not null")
    mild = F.col("_t").between(3, 12)
    x, y = F.when(mild, F.col("_t")), F.when(mild, F.col("_y"))
    line = days.groupBy(key).agg(F.count(x).alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    cold = days.where("_t <= 1").join(line, key).groupBy(key, "_n").agg(F.count(F.lit(1)).alias("_c"), F.percentile("_y", F.lit(0.5)).alias("_m"), F.percentile(F.col("_a") + F.col("_b") * F.col("_t"), F.lit(0.5)).alias("_e"))
    sat = cold.select(key, F.when((F.col("_n") >= least_mild) & (F.col("_c") >= least_cold) & (F.col("_e") > 0), F.col("_m") / F.col("_e")).alias("saturation"))
    return g.join(sat, key, "left").select(key, "saturation", "plateau", "low_load_return")


def mean_vector(df: DataFrame, by: list[str], vector: str, least: int) -> DataFrame:
    """by, n and the mean of the vectors, component by component; NULL below `least` rows."""
    each = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("n"))
    g = each.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"))
    return g.select(*by, "n", F.when(F.col("n") >= least, F.col("_v")).alias("mean"))


# ---------------------------------------------------------------- scores, patterns, rankings

def entity_score(df: DataFrame, key: str, day: str, x: str, flag: str, least: int = 10) -> DataFrame:
    """key, days, mean, median, flagged_share (NULL below `least` known values) and longest_run of flagged calendar days."""
    from tidemark.operators.shape import runs

    g = df.groupBy(key).agg(F.count(x).alias("days"), F.avg(x).alias("_a"), F.percentile(x, F.lit(0.5)).alias("_m"), F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")).alias("_s"))
    r = runs(df, key, day, F.coalesce(F.col(flag), F.lit(False)), 24.0).groupBy(key).agg(F.max("n").alias("longest_run"))
    ok = F.col("days") >= least
    return g.join(r, key, "left").select(key, "days", F.when(ok, F.col("_a")).alias("mean"), F.when(ok, F.col("_m")).alias("median"), F.when(ok, F.col("_s")).alias("flagged_share"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def first_match(df: DataFrame, key: str, rules: list[tuple[str, dict[str, str]]], low: float = 0.2, high: float = 0.8, least: int = 5) -> DataFrame:
    """key, pattern: the first rule whose features are all high (at or above the upper quantile) or low as it says; 'none' otherwise. A feature with fewer than `least` values fires nothing, and
    neither does a value that equals both quantiles."""
    names = sorted({f for _, cond in rules for f in cond})
    q = df.agg(*[F.percentile(f, F.lit(low)).alias(f"_l_{f}") for f in names], *[F.percentile(f, F.lit(high)).alias(f"_h_{f}") for f in names], *[F.count(f).alias(f"_n_{f}") for f in names])  # one row
    d = df.crossJoin(F.broadcast(q))

    def fires(f: str, way: str) -> Column:
        lo, hi, x = F.col(f"_l_{f}"), F.col(f"_h_{f}"), F.col(f)
        return F.coalesce((F.col(f"_n_{f}") >= least) & ((x >= hi) & (x > lo) if way == "high" else (x <= lo) & (x < hi)), F.lit(False))

    out = F.when(F.lit(False), "")
    for name, cond in rules:
        out = out.when(reduce(lambda a, b: a & b, [fires(f, w) for f, w in cond.items()]), name)
    return d.select(key, out.otherwise("none").alias("pattern"))


def composite_score(df: DataFrame, by: list[str], weights: dict[str, float], out: str = "score") -> DataFrame:
    """df with the weighted sum of robust distances within groups; a metric without spread in its group adds nothing there, and rows without any known metric are NULL."""
    d = df
    for i, c in enumerate(weights):
        d = S.robust_z(d, c, by, fallback_std=False, out=f"_z{i}")
    known = reduce(lambda a, b: a | b, [F.col(f"_z{i}").isNotNull() for i in range(len(weights))])
    total = reduce(lambda a, b: a + b, [w * F.coalesce(F.col(f"_z{i}"), F.lit(0.0)) for i, w in enumerate(weights.values())])
    return d.withColumn(out, F.when(known, total)).drop(*[f"_z{i}" for i in range(len(weights))])


def linear_shap(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, feature, contribution: weight times the value's distance to the mean of all rows, in units of the population deviation; 0 for a constant feature, and for a missing value (the mean)."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights], *[F.stddev_pop(c).alias(f"_s_{c}") for c in weights])  # one row
    d = df.crossJoin(F.broadcast(s))
    part = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.when(F.col(f"_s_{c}") > 0, w * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")), F.lit(0.0)).alias("contribution")) for c, w in weights.items()]
    return d.select(key, F.explode(F.array(*part)).alias("_p")).select(key, "_p.feature", "_p.contribution")


def symptoms(df: DataFrame, key: str, day: str, features: dict[str, str], window: int, q: float = 0.8, least: int = 5) -> DataFrame:
    """key, window, symptom, present: whether an entity's median in a window of `window` days is beyond the fleet's q-quantile of that window (below the 1 - q one for 'low' features); NULL where fewer
    than `least` entities have a value."""
    w = df.withColumn("window", F.floor(F.unix_date(F.col(day)) / window))
    m = w.groupBy(key, "window").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in features]).unpivot([key, "window"], list(features), "symptom", "value")
    lim = m.groupBy("window", "symptom").agg(F.count("value").alias("_n"), F.percentile("value", F.lit(q)).alias("_h"), F.percentile("value", F.lit(1 - q)).alias("_l"))
    low = F.col("symptom").isin([c for c, way in features.items() if way == "low"])
    hit = F.when(low, F.col("value") < F.col("_l")).otherwise(F.col("value") > F.col("_h"))
    return m.join(lim, ["window", "symptom"]).select(key, "window", "symptom", F.when(F.col("_n") >= least, hit).alias("present"))


def coverage_of_ranking(df: DataFrame, points: str, key: str, hit: str, steps: list[int]) -> DataFrame:
    """step, hits, share: how many of all hits the first `step` rows of the list ranked by points hold. The list is cut at the largest step, so it stays small."""
    most = max(steps)
    top = df.orderBy(F.desc_nulls_last(points), key).limit(most)  # Spark keeps `most` rows of each partition
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(points), key))  # at most `most` rows
    total = df.agg(F.sum(F.coalesce(F.col(hit), F.lit(False)).cast("int")).alias("_t"))
    d = top.withColumn("_i", place).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).where(F.col("_i") <= F.col("step"))
    g = d.groupBy("step").agg(F.sum(F.coalesce(F.col(hit), F.lit(False)).cast("int")).alias("hits"))
    return g.crossJoin(F.broadcast(total)).select("step", "hits", F.try_divide(F.col("hits").cast("double"), F.col("_t")).alias("share"))


def nearest_budget(df: DataFrame, parameter: str, load: str, budget: float) -> DataFrame:
    """The row whose load is nearest the budget; of two equally near the stricter (larger) parameter."""
    return df.orderBy(F.abs(F.col(load) - budget), F.desc(parameter)).limit(1)


def precision_at(df: DataFrame, truth: str, score: str, key: str, k: int) -> DataFrame:
    """k, hits, precision among the k best scores; ties go to the smaller key."""
    top = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    return top.agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col(truth) == 1, 1)).alias("hits")).withColumn("precision", F.try_divide(F.col("hits").cast("double"), F.col("k")))


# ---------------------------------------------------------------- effects and agreement

def expectation_by_entity(df: DataFrame, key: str, x: list[str], y: str, least: int = 60) -> DataFrame:
    """key, n, reason (ok, too_few_rows or no_variation) and expected, residual for each row: a line (one predictor) or plane (two) for each entity, solved from grouped sums."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*x, y]])
    v = lambda c: F.when(full, F.col(c))
    n = F.count(F.when(full, 1))
    a, b = x[0], x[-1]
    g = df.groupBy(key).agg(n.alias("n"), F.avg(v(y)).alias("_my"), F.avg(v(a)).alias("_ma"), F.avg(v(b)).alias("_mb"), F.var_pop(v(a)).alias("_vaa"), F.var_pop(v(b)).alias("_vbb"), F.covar_pop(v(a), v(b)).alias("_vab"), F.covar_pop(v(a), v(y)).alias("_vay"), F.covar_pop(v(b), v(y)).alias("_vby"))
    if len(x) == 1:
        det, ba, bb = F.col("_vaa"), F.col("_vay") / F.col("_vaa"), F.lit(0.0)
    else:
        det = F.col("_vaa") * F.col("_vbb") - F.col("_vab") * F.col("_vab")
        ba, bb = (F.col("_vay") * F.col("_vbb") - F.col("_vby") * F.col("_vab")) / det, (F.col("_vby") * F.col("_vaa") - F.col("_vay") * F.col("_vab")) / det
    ok = F.col("n") >= least
    varies = det > (1e-9 * (F.col("_vaa") if len(x) == 1 else F.col("_vaa") * F.col("_vbb")) + 1e-12)
    g = g.withColumn("reason", F.when(~ok, "too_few_rows").when(~varies, "no_variation").otherwise("ok"))
    g = g.withColumn("_a", F.when(F.col("reason") == "ok", ba)).withColumn("_b", F.when(F.col("reason") == "ok", bb))
    d = df.join(g, key).withColumn("expected", F.col("_my") + F.col("_a") * (F.col(a) - F.col("_ma")) + F.col("_b") * (F.col(b) - F.col("_mb")))
    return d.withColumn("residual", F.col(y) - F.col("expected")).drop("_my", "_ma", "_mb", "_vaa", "_vbb", "_vab", "_vay", "_vby", "_a", "_b")


def interaction(df: DataFrame, group: str, x: str, y: str, before: str, after: str, at: float) -> DataFrame:
    """n, slope_before, slope_after, slope_difference, its standard error and t, expected values at `at`, delta and delta_percent: the model y ~ x * group of two groups, whose interaction is the difference
    of two lines with a common residual variance."""
    side = lambda g, c: F.when(F.col(group) == g, F.col(c))
    agg = []
    for tag, g in (("0", before), ("1", after)):
        agg += [F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(group) == g), 1)).alias(f"n{tag}"), F.regr_slope(side(g, y), side(g, x)).alias(f"b{tag}"), F.regr_intercept(side(g, y), side(g, x)).alias(f"a{tag}"), F.regr_sxx(side(g, y), side(g, x)).alias(f"xx{tag}"), F.regr_syy(side(g, y), side(g, x)).alias(f"yy{tag}"), F.regr_sxy(side(g, y), side(g, x)).alias(f"xy{tag}")]
    r = df.agg(*agg)
    sse = F.col("yy0") - F.col("b0") * F.col("xy0") + F.col("yy1") - F.col("b1") * F.col("xy1")
    se = F.sqrt(sse / (F.col("n0") + F.col("n1") - 4) * (1 / F.col("xx0") + 1 / F.col("xx1")))
    e0, e1 = F.col("a0") + F.col("b0") * at, F.col("a1") + F.col("b1") * at
    r = r.select((F.col("n0") + F.col("n1")).alias("n"), F.col("b0").alias("slope_before"), F.col("b1").alias("slope_after"), (F.col("b1") - F.col("b0")).alias("slope_difference"), se.alias("se"), e0.alias("expected_before"), e1.alias("expected_after"))
    return r.withColumn("t", F.col("slope_difference") / F.col("se")).withColumn("delta", F.col("expected_after") - F.col("expected_before")).withColumn("delta_percent", 100 * F.col("delta") / F.col("expected_before"))


def group_effect(df: DataFrame, group: str, x: str, side: str, least: int = 30) -> DataFrame:
    """group, n_before, n_after, median_before, median_after, effect; the medians and the effect are NULL below `least` rows on either side. Groups without rows on a side stay."""
    b, a = (F.when(F.col(side) == s, F.col(x)) for s in ("before", "after"))
    g = df.groupBy(group).agg(F.count(b).alias("n_before"), F.count(a).alias("n_after"), F.percentile(b, F.lit(0.5)).alias("_b"), F.percentile(a, F.lit(0.5)).alias("_a"))
    ok = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    return g.select(group, "n_before", "n_after", F.when(ok, F.col("_b")).alias("median_before"), F.when(ok, F.col("_a")).alias("median_after"), F.when(ok, F.col("_a") - F.col("_b")).alias("effect"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rows, columns, v: Cramer's V of the contingency table; NULL with a single row or column."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("_o"))
    r, k = c.groupBy(a).agg(F.sum("_o").alias("_r")), c.groupBy(b).agg(F.sum("_o").alias("_k"))
    # sum of o^2 / (r k) over the cells that hold rows; the empty ones add their expectation, so chi2 = n (sum - 1)
    s = c.join(r, a).join(k, b).agg(F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_k"))).alias("_s"), F.sum("_o").alias("n"), F.countDistinct(a).alias("rows"), F.countDistinct(b).alias("columns"))
    small = F.least("rows", "columns") - 1
    return s.select("n", "rows", "columns", F.when(small > 0, F.sqrt(F.greatest(F.col("_s") - 1, F.lit(0.0)) / small)).alias("v"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, ari: agreement of two partitions corrected for chance, from the contingency table."""
    pairs = lambda x: x * (x - 1) / 2
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    r = c.groupBy(a).agg(F.sum("_o").alias("_r")).agg(F.sum(pairs(F.col("_r"))).alias("_sr"))
    k = c.groupBy(b).agg(F.sum("_o").alias("_k")).agg(F.sum(pairs(F.col("_k"))).alias("_sk"))
    s = c.agg(F.sum(pairs(F.col("_o"))).alias("_s"), F.sum("_o").alias("n")).crossJoin(F.broadcast(r)).crossJoin(F.broadcast(k))
    chance = F.col("_sr") * F.col("_sk") / pairs(F.col("n"))
    return s.select(F.col("n").cast("bigint").alias("n"), F.try_divide(F.col("_s") - chance, (F.col("_sr") + F.col("_sk")) / 2 - chance).alias("ari"))


def correlation_matrix(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, a, b, rho, n: Spearman's correlation of every two columns over rows where both are known."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            part = S.spearman(df, a, b, by).select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"), "rho", "n")
            out = part if out is None else out.unionByName(part)
    return out


def winter_pair(points: DataFrame, visits: DataFrame, key: str, day: str, x: str, y: str, reach: int = 180, buffer: int = 14, low: float = 0.05, high: float = 0.95, least: int = 10) -> DataFrame:
    """key, visit, n_before, n_after, cross_residual, residual_before: points before and after a visit that lie in the common range of x (the larger lower and the smaller upper quantile of both sides); median
    distance in ln y of both sides to the log-log line of the side before."""
    v = visits.select(key, F.col(day).alias("visit")).distinct()
    d = points.where((F.col(x) > 0) & (F.col(y) > 0)).join(v, key).withColumn("_o", F.datediff(day, "visit"))
    d = d.withColumn("side", F.when(F.col("_o").between(-reach, -buffer - 1), "before").when(F.col("_o").between(buffer + 1, reach), "after")).where("side is not null")
    q = d.groupBy(key, "visit").agg(*[F.percentile(F.when(F.col("side") == s, F.col(x)), F.lit(p)).alias(f"_{s}_{i}") for s in ("before", "after") for i, p in (("l", low), ("h", high))])
    q = q.select(key, "visit", F.greatest("_before_l", "_after_l").alias("_lo"), F.least("_before_h", "_after_h").alias("_hi")).where("_lo is not null and _hi is not null")
    d = d.join(q, [key, "visit"]).where(F.col(x).between(F.col("_lo"), F.col("_hi")))
    fit = S.loglog_fit(d.where("side = 'before'"), [key, "visit"], x, y, least).select(key, "visit", "slope", "intercept")
    d = d.join(fit, [key, "visit"]).withColumn("_r", F.ln(y) - F.col("intercept") - F.col("slope") * F.ln(x))
    g = d.groupBy(key, "visit").agg(F.count(F.when(F.col("side") == "before", 1)).alias("n_before"), F.count(F.when(F.col("side") == "after", 1)).alias("n_after"), F.percentile(F.when(F.col("side") == "after", F.col("_r")), F.lit(0.5)).alias("_a"), F.percentile(F.when(F.col("side") == "before", F.col("_r")), F.lit(0.5)).alias("_b"))
    ok = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    return g.select(key, "visit", "n_before", "n_after", F.when(ok, F.col("_a")).alias("cross_residual"), F.when(ok, F.col("_b")).alias("residual_before"))
