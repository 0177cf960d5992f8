"""Events against alarms: hit tests with controls, before/after comparison, nearest matches, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_month(df: DataFrame, day: str, before: int = 0, after: int = 0, out: str = "_m") -> DataFrame:
    """df with one row for each 32-day bucket that [day - before, day + after] touches, so that range joins are equi-joins on buckets."""
    n = F.unix_date(F.col(day))
    return df.withColumn(out, F.explode(F.sequence(F.floor((n - before) / 32).cast("int"), F.floor((n + after) / 32).cast("int"))))


def hit_test(cases: DataFrame, alarms: DataFrame, observed: DataFrame, key: str = "entity", day: str = "day", before: int = 7, after: int = 60, least_days: int = 1) -> DataFrame:
    """case key and day, hit (the case has an alarm in its window), controls, control_hits and control_rate.

    Controls are the entities that were observed on at least least_days days of the window and have no case of their own in it
    (before and after are not negative, so the case itself is never among them). They depend on the case's day alone, so
    everything is counted once for each distinct day, through 32-day buckets, and joined to the cases last."""
    if before < 0 or after < 0:
        raise ValueError("the window must hold the case's own day")
    c = cases.select(F.col(key).alias("case_key"), F.col(day).alias("case_day")).distinct()
    win = by_month(c.select("case_day").distinct(), "case_day", before, after)

    def seen(t: DataFrame, name: str) -> DataFrame:
        t = by_month(t.select(F.col(key).alias("e"), F.col(day).alias("d")).distinct(), "d")
        return win.join(t, "_m").where(F.datediff("d", "case_day").between(-before, after)).groupBy("case_day", "e").agg(F.count(F.lit(1)).alias(name))

    alarmed, watched, own = seen(alarms, "a"), seen(observed, "o").where(F.col("o") >= least_days), seen(cases, "v")
    ids = ["case_day", "e"]
    rate = watched.join(own, ids, "left_anti").join(alarmed, ids, "left").groupBy("case_day").agg(F.count(F.lit(1)).alias("controls"), F.count("a").alias("control_hits"))
    hits = alarmed.select("case_day", F.col("e").alias("case_key"), F.lit(True).alias("hit"))
    out = c.join(hits, ["case_key", "case_day"], "left").join(rate, "case_day", "left")
    n = F.coalesce("controls", F.lit(0))
    return out.select("case_key", "case_day", F.coalesce("hit", F.lit(False)).alias("hit"), n.alias("controls"), F.coalesce("control_hits", F.lit(0)).alias("control_hits"), F.try_divide(F.col("control_hits").cast("double"), F.col("controls")).alias("control_rate"))


def hit_balance(tested: DataFrame, least_controls: int = 1) -> DataFrame:
    """cases, hits, expected (sum of control rates), leverage: one row."""
    t = tested.where(F.col("controls") >= least_controls)
    return t.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.sum("control_rate").alias("expected")).withColumn("leverage", F.try_divide(F.col("hits").cast("double"), F.col("expected")))


def sides(panel: DataFrame, cases: DataFrame, value: str, key: str = "entity", day: str = "day", days: int = 30, gap: int = 0, least: int = 3) -> DataFrame:
    """case_day, entity, before, after: means of value on the days up to `days` before and after each distinct case day, for every entity of the
    panel that has at least `least` values on both sides."""
    c = by_month(cases.select(F.col(day).alias("case_day")).distinct(), "case_day", days + gap, days + gap)
    p = by_month(panel.where(F.col(value).isNotNull()).select(key, day, value), day)
    d = F.datediff(day, "case_day")
    m = c.join(p, "_m").withColumn("_pre", d.between(-days - gap, -gap - 1)).withColumn("_post", d.between(gap + 1, days + gap)).where("_pre or _post")
    g = m.groupBy("case_day", key).agg(*[F.avg(F.when(F.col(s), F.col(value))).alias(n) for s, n in (("_pre", "before"), ("_post", "after"))], *[F.count(F.when(F.col(s), 1)).alias(f"n{s}") for s in ("_pre", "_post")])
    return g.where((F.col("n_pre") >= least) & (F.col("n_post") >= least)).drop("n_pre", "n_post")


def diff_in_diff(panel: DataFrame, cases: DataFrame, value: str, key: str = "entity", day: str = "day", days: int = 30, gap: int = 0, least: int = 3, least_controls: int = 5) -> DataFrame:
    """case_key, case_day, change, control_change (median of entities that never were a case), controls, effect; effect is NULL with too few controls.
    Both sides depend on the case's day and the entity alone, so they are summed once for each distinct day."""
    s = sides(panel, cases, value, key, day, days, gap, least).withColumn("_d", F.col("after") - F.col("before"))
    c = cases.select(F.col(key).alias("case_key"), F.col(day).alias("case_day")).distinct()
    own = c.join(s.select("case_day", F.col(key).alias("case_key"), F.col("_d").alias("change")), ["case_key", "case_day"])
    ctl = s.join(cases.select(key).distinct(), key, "left_anti").groupBy("case_day").agg(F.percentile("_d", F.lit(0.5)).alias("control_change"), F.count(F.lit(1)).alias("controls"))
    out = own.join(ctl, "case_day", "left").withColumn("controls", F.coalesce("controls", F.lit(0)))
    return out.withColumn("effect", F.when(F.col("controls") >= least_controls, F.col("change") - F.col("control_change")))


def nearest_event(points: DataFrame, events: DataFrame, key: str = "entity", day: str = "day") -> DataFrame:
    """points with nearest_day and days_off (event minus point) of the entity's nearest event; of two equally near the earlier."""
    e = events.select(key, F.col(day).alias("_e")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_e")).alias("_es"))
    d = points.join(e, key, "left")
    off = F.array_min(F.transform("_es", lambda x: F.struct(F.abs(F.datediff(x, F.col(day))).alias("a"), x.alias("x"))))
    return d.withColumn("nearest_day", off["x"]).withColumn("days_off", F.datediff(off["x"], F.col(day))).drop("_es")


def simultaneous(alarms: DataFrame, key: str = "entity", day: str = "day", within: int = 7, least: int = 3) -> DataFrame:
    """day, entities (distinct ones with an alarm at most `within` days away), network_event. Days are spread over their neighbourhood and
    counted, so no join is needed."""
    a = alarms.select(key, day).distinct()
    near = a.withColumn("_d", F.explode(F.sequence(F.date_sub(day, within), F.date_add(day, within)))).groupBy(F.col("_d").alias(day)).agg(F.countDistinct(key).alias("entities"))
    return near.join(a.select(day).distinct(), day).withColumn("network_event", F.col("entities") >= least)


def buffered_side(df: DataFrame, dates: DataFrame, key: str = "entity", day: str = "day", buffer: int = 14) -> DataFrame:
    """df with side: before, after, buffer (within `buffer` days of the entity's first date) or NULL without a date; rows are kept."""
    first = dates.groupBy(key).agg(F.min(day).alias("_d"))
    off = F.datediff(day, "_d")
    return df.join(first, key, "left").withColumn("side", F.when(off < -buffer, "before").when(off > buffer, "after").when(off.isNotNull(), "buffer")).drop("_d")


def random_rate(coverage: DataFrame, alarms: DataFrame, key: str = "entity", width: int = 15) -> DataFrame:
    """key, alarms, days, chance: the chance that a random date has one of k alarms within a window of `width` days: 1 - (1 - width / days)^k."""
    k = alarms.groupBy(key).agg(F.count(F.lit(1)).alias("alarms"))
    d = coverage.groupBy(key).agg(F.countDistinct("day").alias("days"))
    out = d.join(k, key, "left").withColumn("alarms", F.coalesce("alarms", F.lit(0)))
    return out.withColumn("chance", 1 - F.pow(1 - F.least(F.lit(1.0), width / F.col("days")), F.col("alarms")))


def first_after(events: DataFrame, alarms: DataFrame, key: str = "entity", day: str = "day", within: int = 60) -> DataFrame:
    """key, day, first_alarm, delay: the first alarm from each event's day on, at most `within` days later."""
    e = by_month(events.select(key, F.col(day).alias("_e")).distinct(), "_e", 0, within)
    a = by_month(alarms.select(key, F.col(day).alias("_a")).distinct(), "_a")
    m = e.join(a, [key, "_m"]).where(F.datediff("_a", "_e").between(0, within)).groupBy(key, "_e").agg(F.min("_a").alias("first_alarm"))
    return events.select(key, F.col(day).alias("_e")).distinct().join(m, [key, "_e"], "left").select(key, F.col("_e").alias(day), "first_alarm", F.datediff("first_alarm", "_e").alias("delay"))
