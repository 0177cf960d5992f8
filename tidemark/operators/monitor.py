"""Monitoring of standardized deviations: CUSUM accounts, warnings, persistence, jumps, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: str, day: str, z: str) -> DataFrame:
    """key and its known values in order of days, as one array of (day, z). NULLs are left out."""
    return df.where(F.col(z).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), F.col(z).cast("double").alias("z")))).alias("s"))


def cusum_fold(series: Column, k: float, h: Column, cap: Column) -> Column:
    """Alarms of the two-sided account as an array of (day, direction, start).

    up = max(0, up + z - k), down = max(0, down - z - k), both held at cap. An account that passes h raises one alarm and
    is armed again when it has come back to exactly 0; its start is the day on which it left 0.
    """
    day0 = F.lit(None).cast("date")
    none = F.array().cast("array<struct<day:date,direction:int,start:date>>")
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(True).alias("arm_up"), F.lit(True).alias("arm_down"), day0.alias("from_up"), day0.alias("from_down"), none.alias("alarms"))

    def step(a, x):
        up = F.least(F.greatest(a["up"] + x["z"] - k, F.lit(0.0)), cap)
        down = F.least(F.greatest(a["down"] - x["z"] - k, F.lit(0.0)), cap)
        from_up = F.when(a["up"] == 0.0, x["day"]).otherwise(a["from_up"])
        from_down = F.when(a["down"] == 0.0, x["day"]).otherwise(a["from_down"])
        ring_up, ring_down = a["arm_up"] & (up > h), a["arm_down"] & (down > h)
        alarm = lambda d, s: F.struct(x["day"].alias("day"), F.lit(d).alias("direction"), s.alias("start"))
        new = F.concat(a["alarms"], F.when(ring_up, F.array(alarm(1, from_up))).otherwise(none), F.when(ring_down, F.array(alarm(-1, from_down))).otherwise(none))
        return F.struct(up.alias("up"), down.alias("down"), (F.when(up == 0.0, True).otherwise(a["arm_up"] & ~ring_up)).alias("arm_up"), (F.when(down == 0.0, True).otherwise(a["arm_down"] & ~ring_down)).alias("arm_down"), from_up.alias("from_up"), from_down.alias("from_down"), new.alias("alarms"))

    return F.aggregate(series, zero, step, lambda a: a["alarms"])


def cusum(df: DataFrame, key: str, day: str, z: str, k: float = 0.5, h: float = 5.0, cap: float = 10.0) -> DataFrame:
    """key, day, direction (1 up, -1 down), start of every alarm."""
    alarms = ordered(df, key, day, z).select(key, F.explode(cusum_fold(F.col("s"), k, F.lit(h), F.lit(cap))).alias("a"))
    return alarms.select(key, F.col("a.day").alias("day"), F.col("a.direction").alias("direction"), F.col("a.start").alias("start"))


def cusum_sweep(df: DataFrame, key: str, day: str, z: str, thresholds: list[float], k: float = 0.5) -> DataFrame:
    """key, h, day, direction: alarms at each threshold, with the account held at max(10, 2h)."""
    s = ordered(df, key, day, z).withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in thresholds])))
    alarms = s.select(key, "h", F.explode(cusum_fold(F.col("s"), k, F.col("h"), F.greatest(F.lit(10.0), 2 * F.col("h")))).alias("a"))
    return alarms.select(key, "h", F.col("a.day").alias("day"), F.col("a.direction").alias("direction"))


def running_account(df: DataFrame, key: str, day: str, z: str, k: float = 0.5) -> DataFrame:
    """key, day, up: the upper account without cap or alarms, from running minima of sums (no fold)."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col(z).isNotNull()).withColumn("_s", F.sum(F.col(z) - k).over(w))
    return d.withColumn("up", F.col("_s") - F.least(F.min("_s").over(w), F.lit(0.0))).drop("_s")


def warnings(df: DataFrame, key: str, day: str, value: str, threshold: float, days: int = 2) -> DataFrame:
    """df with `warning`: value above threshold on `days` rows in a row."""
    w = Window.partitionBy(key).orderBy(day)
    hit = F.coalesce(F.col(value) > threshold, F.lit(False)).cast("int")
    d = df.withColumn("_hit", hit)
    return d.withColumn("warning", F.sum("_hit").over(w.rowsBetween(-(days - 1), 0)) == days).drop("_hit")


def quiet_alarms(df: DataFrame, key: str, day: str, warning: str, quiet: int = 7) -> DataFrame:
    """df with `alarm`: a warning without another warning in the `quiet` days before."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(warning), F.col(day)), True).over(w)
    return df.withColumn("alarm", F.col(warning) & (last.isNull() | (F.datediff(day, last) > quiet)))


def persistent(df: DataFrame, key: str, day: str, flag: Column, window: int = 14, least: int = 7) -> DataFrame:
    """df with flagged_days (in the trailing calendar days) and persistent."""
    n = F.unix_date(F.col(day))
    w = Window.partitionBy(key).orderBy(n).rangeBetween(-(window - 1), 0)
    d = df.withColumn("flagged_days", F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w))
    return d.withColumn("persistent", F.col("flagged_days") >= least)


def rolling_corr(df: DataFrame, key: str, day: str, x: str, y: str, window: int = 14, least: int = 10) -> DataFrame:
    """df with `corr` of x and y over the last `window` days; NULL below `least` rows and where x or y does not vary."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(day))).rangeBetween(-(window - 1), 0)
    r = F.try_divide(F.regr_sxy(y, x).over(w), F.sqrt(F.regr_sxx(y, x).over(w) * F.regr_syy(y, x).over(w)))  # corr raises where x or y is constant
    return df.withColumn("corr", F.when(F.count(F.lit(1)).over(w) >= least, r))


def centred_median(df: DataFrame, key: str, day: str, x: str, before: int, after: int, least: int) -> DataFrame:
    """df with `trend`: the median of x over rows from `before` to `after` around each row; NULL below `least` values."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-before, after)
    d = df.withColumn("_l", F.array_sort(F.collect_list(x).over(w)))
    n = F.size("_l")
    mid = (F.element_at("_l", ((n + 1) / 2).cast("int")) + F.element_at("_l", (n / 2).cast("int") + 1)) / 2
    return d.withColumn("trend", F.when(n >= least, mid)).drop("_l")


def autocorrelation(df: DataFrame, key: str, day: str, x: str, adjacent: bool = False) -> DataFrame:
    """key, phi: correlation of x with the row before, or with the day before only."""
    w = Window.partitionBy(key).orderBy(day)
    ok = F.datediff(day, F.lag(day).over(w)) == 1 if adjacent else F.lag(day).over(w).isNotNull()
    return df.where(F.col(x).isNotNull()).withColumn("_l", F.when(ok, F.lag(x).over(w))).groupBy(key).agg(F.corr(x, "_l").alias("phi"))


def jump_score(df: DataFrame, key: str, day: str, x: str, k: int = 5) -> DataFrame:
    """df with `jump`: median of the k values from a row on minus median of the k before it; NULL without k on both sides."""
    w = Window.partitionBy(key).orderBy(day)
    med = lambda c: F.element_at(c, (k + 1) // 2) if k % 2 else (F.element_at(c, k // 2) + F.element_at(c, k // 2 + 1)) / 2
    d = df.where(F.col(x).isNotNull()).withColumn("_b", F.array_sort(F.collect_list(x).over(w.rowsBetween(-k, -1)))).withColumn("_a", F.array_sort(F.collect_list(x).over(w.rowsBetween(0, k - 1))))
    return d.withColumn("jump", F.when((F.size("_a") == k) & (F.size("_b") == k), med(F.col("_a")) - med(F.col("_b")))).drop("_a", "_b")


def strongest_apart(df: DataFrame, key: str, day: str, score: str, threshold: float, apart: int) -> DataFrame:
    """key, day, score of local alarms: strongest first, none nearer than `apart` days to a stronger one."""
    hits = df.where(F.abs(F.col(score)) >= threshold).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col(score)).alias("a"), F.col(day).alias("day"), F.col(score).alias("score"))), asc=False).alias("s"))
    none = F.array().cast("array<struct<day:date,score:double>>")
    near = lambda got, x: F.exists(got, lambda g: F.abs(F.datediff(g["day"], x["day"])) < apart)
    pick = F.aggregate("s", none, lambda got, x: F.when(near(got, x), got).otherwise(F.concat(got, F.array(F.struct(x["day"].alias("day"), x["score"].alias("score"))))))
    return hits.select(key, F.explode(pick).alias("p")).select(key, "p.day", "p.score")


def weekly_expectation(df: DataFrame, key: str, day: str, x: str, hour: str | None = None, out: str = "expected") -> DataFrame:
    """df with the mean of x over the 7 days before (same hour, if given)."""
    by = [key, hour] if hour else [key]
    w = Window.partitionBy(*by).orderBy(F.unix_date(F.col(day))).rangeBetween(-7, -1)
    return df.withColumn(out, F.avg(x).over(w))


def calibrate(df: DataFrame, by: list[str], deviation: str, least: int = 10, floor: float = 0.5) -> DataFrame:
    """by, center, scale: median and 1.4826 MAD (not below floor) of deviations; NULL below `least` rows."""
    c = df.groupBy(*by).agg(F.percentile(deviation, F.lit(0.5)).alias("center"), F.count(deviation).alias("n"))
    mad = df.join(c, by).groupBy(*by).agg(F.percentile(F.abs(F.col(deviation) - F.col("center")), F.lit(0.5)).alias("_mad"))
    return c.join(mad, by).select(*by, F.when(F.col("n") >= least, F.col("center")).alias("center"), F.when(F.col("n") >= least, F.greatest(1.4826 * F.col("_mad"), F.lit(floor))).alias("scale"))


def monitor(df: DataFrame, key: str, day: str, value: str, learn_until: str, least: int = 10, k: float = 0.5, h: float = 5.0, cap: float = 10.0) -> DataFrame:
    """The chain: reference by entity up to a day (median, MAD, lag-1 autocorrelation), standardized deviations after it with the
    spread that autocorrelation asks for, and CUSUM alarms. key, day, direction, start."""
    learn = df.where(F.col(day) <= F.lit(learn_until).cast("date"))
    ref = calibrate(learn, [key], value, least, 1e-6)
    rest = learn.join(ref, key).withColumn("_r", F.col(value) - F.col("center"))
    phi = autocorrelation(rest, key, day, "_r").select(key, F.least(F.greatest(F.coalesce("phi", F.lit(0.0)), F.lit(0.0)), F.lit(0.8)).alias("phi"))
    z = df.where(F.col(day) > F.lit(learn_until).cast("date")).join(ref, key).join(phi, key)
    z = z.withColumn("z", (F.col(value) - F.col("center")) / (F.col("scale") * F.sqrt((1 + F.col("phi")) / (1 - F.col("phi")))))
    return cusum(z, key, day, "z", k, h, cap)
