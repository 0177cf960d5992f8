"""Shaping of entity time series: priority dedup, masks, grids, runs, gap filling, counters, as-of joins, windows, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between

HOUR = "interval 1 hour"


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in order (which must end with a tiebreak to be deterministic)."""
    rn = "_rn"
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) == 1).drop(rn)


def merge_generations(frames: list[DataFrame], keys: list[str], ts: str = "ts") -> DataFrame:
    """Union of overlapping exports; of equal keys the row of the later frame wins (frames in rising priority), and within a frame the row whose
    values come last in order, whatever the partitions."""
    tagged = [f.withColumn("_gen", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "_gen")]
    return keep_first(out, keys, F.col("_gen").desc(), *[F.desc_nulls_last(c) for c in rest]).drop("_gen")


def mask_outside(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their plausible range become NULL; rows are kept."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in limits.items()})


def derive_spread(df: DataFrame, spread: str, high: str, low: str) -> DataFrame:
    """A missing spread is the difference of its two channels."""
    own = F.col(spread) if spread in df.columns else F.lit(None).cast("double")
    return df.withColumn(spread, F.coalesce(own, F.col(high) - F.col(low)))


def scale_factor(df: DataFrame, by: str, flow: str, spread: str, power: str, factors=(1, 10, 100, 1000), constant: float = 859.845, tolerance: float = 0.10, least: int = 50) -> DataFrame:
    """by, factor, error, n: candidates whose power follows from flow and spread after scaling. Exactly one row per `by` is a sound file."""
    tried = df.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    f, s, p = (F.col(c) / F.col("factor") for c in (flow, spread, power))
    tried = tried.withColumn("_e", F.when((f > 50) & (p > 0.2) & (s > 1), F.abs(f * s / constant - p) / p))
    return tried.groupBy(by, "factor").agg(F.percentile("_e", F.lit(0.5)).alias("error"), F.count("_e").alias("n")).where((F.col("error") <= tolerance) & (F.col("n") >= least))


def grid(df: DataFrame, key: str, ts: str, step: str = HOUR) -> DataFrame:
    """Every step from an entity's first to its last row, with the row's columns where there is one."""
    ends = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    slots = ends.select(key, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(ts))
    return slots.join(df, [key, ts], "left")


def runs(df: DataFrame, key: str, ts: str, flag: Column, step_hours: float) -> DataFrame:
    """key, run_start, run_end, n: runs of flagged rows one step apart; a gap in time breaks a run."""
    w = Window.partitionBy(key).orderBy(ts)
    hit = df.where(flag)
    new = F.coalesce((hours_between(ts, F.lag(ts).over(w)) > step_hours).cast("int"), F.lit(1))
    return hit.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_run")


def segments(df: DataFrame, key: str, day: str, state: Column) -> DataFrame:
    """key, state, seg_start, seg_end, n: stretches of days of one state, in order."""
    w = Window.partitionBy(key).orderBy(day)
    s = df.withColumn("state", state)
    s = s.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    return s.withColumn("_seg", F.sum("_new").over(w)).groupBy(key, "_seg", "state").agg(F.min(day).alias("seg_start"), F.max(day).alias("seg_end"), F.count(F.lit(1)).alias("n")).drop("_seg")


def interpolate_short(df: DataFrame, key: str, ts: str, value: str, most: int) -> DataFrame:
    """On a regular grid: NULL runs of at most `most` steps between two values are filled linearly and marked in
    `interpolated`; longer runs and those at the ends stay NULL as a whole."""
    w = Window.partitionBy(key).orderBy(ts)
    # both are running frames: a frame that ends with the partition would be worked out anew for every row
    prior, later = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    d = d.withColumn("_p", F.last(at, True).over(prior)).withColumn("_n", F.last(at, True).over(later))
    gap = F.col("_n.i") - F.col("_p.i")
    fill = F.col(value).isNull() & (gap - 1 <= most)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / gap
    return d.withColumn("interpolated", F.coalesce(fill, F.lit(False))).withColumn(value, F.when(F.col("interpolated"), line).otherwise(F.col(value))).drop("_i", "_p", "_n")


def integrate_counter(df: DataFrame, key: str, ts: str, counter: str, rate: str, most_hours: float = 2.0) -> DataFrame:
    """A missing counter goes on from its last value by rate times hours (steps of 0 to most_hours only, no negative
    rates), restarting at every measured value; `filled` marks such rows."""
    w = Window.partitionBy(key).orderBy(ts)
    hours = hours_between(ts, F.lag(ts).over(w))
    step = F.when((hours > 0) & (hours <= most_hours), F.greatest(F.coalesce(F.col(rate), F.lit(0.0)), F.lit(0.0)) * hours).otherwise(0.0)
    d = df.withColumn("_step", step).withColumn("_seg", F.count(counter).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(key, "_seg").orderBy(ts)
    d = d.withColumn("_anchor", F.first(counter).over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = d.withColumn("_sum", F.sum(F.when(F.col(counter).isNull(), F.col("_step")).otherwise(0.0)).over(s.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("filled", F.col(counter).isNull() & F.col("_anchor").isNotNull())
    return d.withColumn(counter, F.coalesce(F.col(counter), F.col("_anchor") + F.col("_sum"))).drop("_step", "_seg", "_anchor", "_sum")


def valid_step(df: DataFrame, key: str, ts: str, value: str, most_hours: float, largest: float | None = None, out: str = "step") -> DataFrame:
    """Difference to the row before, only over gaps of 0 to most_hours; negative steps and steps above `largest` are NULL."""
    w = Window.partitionBy(key).orderBy(ts)
    hours = hours_between(ts, F.lag(ts).over(w))
    diff = F.col(value) - F.lag(value).over(w)
    ok = (hours > 0) & (hours <= most_hours)
    if largest is not None:
        ok = ok & (diff >= 0) & (diff <= largest)
    return df.withColumn(out, F.when(ok, diff))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, most_hours: float) -> DataFrame:
    """left (key, ts) with the value and time of the right row nearest in time, at most most_hours away (included); of two equally
    near the earlier. One sort by key and time; no range join."""
    l = left.select(key, ts, F.lit(None).cast("timestamp_ntz").alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_ask"))
    r = right.where(F.col(value).isNotNull()).select(key, ts, F.col(ts).cast("timestamp_ntz").alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_ask"))
    w = Window.partitionBy(key).orderBy(ts, "_ask")
    both = l.unionByName(r)
    at = F.when(F.col("_ask") == 0, F.struct("_t", "_v"))
    both = both.withColumn("_p", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("_ask"))
    both = both.withColumn("_n", F.last(at, True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.where("_ask = 1")
    back, on = hours_between(ts, "_p._t"), hours_between("_n._t", ts)
    pick = F.when((back <= most_hours) & ((on > most_hours) | on.isNull() | (back <= on)), F.col("_p")).when(on <= most_hours, F.col("_n"))
    return both.select(key, ts, pick["_v"].alias(value), pick["_t"].alias("matched_ts"))


def midnight_difference(readings: DataFrame, key: str, ts: str, counter: str, most_hours: float = 2.0) -> DataFrame:
    """key, day, delta: counter difference from midnight to midnight, from the nearest readings and scaled to 24 h by their real span."""
    ends = readings.groupBy(key).agg(F.min(F.to_date(ts)).alias("_a"), F.date_add(F.max(F.to_date(ts)), 1).alias("_b"))
    midnights = ends.select(key, F.explode(F.sequence(F.col("_a").cast("timestamp_ntz"), F.col("_b").cast("timestamp_ntz"), F.expr("interval 1 day"))).alias(ts))
    m = asof_nearest(midnights, readings, key, ts, counter, most_hours)
    w = Window.partitionBy(key).orderBy(ts)
    span = hours_between(F.lead("matched_ts").over(w), "matched_ts")
    d = m.withColumn("delta", F.when(span > 0, (F.lead(counter).over(w) - F.col(counter)) * 24.0 / span))
    return d.select(key, F.to_date(ts).alias("day"), "delta")


def windows(df: DataFrame, key: str, ts: str, days: int, step_days: int, aggs: list[Column], covered_hours: float | None = None) -> DataFrame:
    """key, window_start, n and aggs for windows of `days` from an entity's first midnight every `step_days`; windows without rows
    are there with n = 0. Rows are dealt to the windows that hold them by arithmetic, not by a range join."""
    first = df.groupBy(key).agg(F.to_date(F.min(ts)).alias("_a"), F.to_date(F.max(ts)).alias("_b"))
    all_ = first.select(key, "_a", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("_b", "_a") / step_days).cast("int"))).alias("_k"))
    each = -(-days // step_days)
    d = df.join(first.select(key, "_a"), key).withColumn("_last", F.floor(F.datediff(F.to_date(ts), "_a") / step_days).cast("int"))
    d = d.withColumn("_k", F.explode(F.sequence(F.greatest(F.col("_last") - (each - 1), F.lit(0)), F.col("_last"))))
    d = d.where(F.datediff(F.to_date(ts), "_a") < F.col("_k") * step_days + days)
    got = d.groupBy(key, "_k").agg(F.count(F.lit(1)).alias("n"), *aggs)
    out = all_.join(got, [key, "_k"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("window_start", F.expr(f"date_add(_a, _k * {step_days})"))
    if covered_hours is not None:
        out = out.withColumn("low_coverage", F.col("n") < covered_hours)
    return out.drop("_a", "_k")


def sessions(df: DataFrame, key: str, ts: str, gap_hours: float, aggs: list[Column]) -> DataFrame:
    """key, session_start, session_end, n and aggs: rows less than gap_hours apart belong together."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((hours_between(ts, F.lag(ts).over(w)) >= gap_hours).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w)).groupBy(key, "_s").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n"), *aggs).drop("_s")


def overlap(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], tolerance: float = 0.051) -> DataFrame:
    """channel, n, share_equal, max_diff, corr of two exports on the keys they share."""
    left = a.select(*keys, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(keys, channels, "channel", "x")
    right = b.select(*keys, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(keys, channels, "channel", "y")
    d = left.join(right, [*keys, "channel"]).where("x is not null and y is not null").withColumn("_d", F.abs(F.col("x") - F.col("y")))
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_d") <= tolerance).cast("double")).alias("share_equal"), F.max("_d").alias("max_diff"), F.corr("x", "y").alias("corr"))
