"""Seasons, splits, picks, compact encodings and injected faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hash32, winter_end_year


def latest_season(df: DataFrame, key: str, season: Column, least_rows: int, least_entities: int) -> DataFrame:
    """season, entities: the latest winter in which at least least_entities entities have at least least_rows rows; no row if there is none."""
    per = df.withColumn("season", season).where("season <> ''").groupBy("season", key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows)
    s = per.groupBy("season").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= least_entities)
    return s.orderBy(winter_end_year("season").desc()).limit(1)


def coldest_window(daily: DataFrame, day: str, t: str, days: int, month: int = 2, least_share: float = 0.8) -> DataFrame:
    """year, start, mean: in each year the coldest window of `days` calendar days that lies inside a month, of those with enough values; ties to the first."""
    d = daily.groupBy(F.col(day).alias("_d")).agg(F.avg(t).alias("_t"))
    spread = d.withColumn("start", F.explode(F.sequence(F.date_sub("_d", days - 1), F.col("_d"))))
    inside = (F.month("start") == month) & (F.month(F.date_add("start", days - 1)) == month)
    w = spread.where(inside).groupBy("start").agg(F.avg("_t").alias("mean"), F.count("_t").alias("_n")).where(F.col("_n") >= least_share * days)
    return w.groupBy(F.year("start").alias("year")).agg(F.min(F.struct("mean", "start")).alias("_b")).select("year", F.col("_b.start").alias("start"), F.col("_b.mean").alias("mean"))


def nearest_values(panel: DataFrame, cases: DataFrame, key: str, day: str, value: str, most: int, within: int = 365, least: int = 5) -> DataFrame:
    """key, case_day, before, after: medians of the `most` values nearest before and after each case, at most `within` days away; NULL below `least`."""
    c = cases.select(key, F.col(day).alias("case_day")).distinct()
    d = panel.where(F.col(value).isNotNull()).join(c, key).withColumn("_o", F.datediff(day, "case_day")).where((F.col("_o") != 0) & (F.abs("_o") <= within))
    w = Window.partitionBy(key, "case_day", F.signum("_o")).orderBy(F.abs("_o"))
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    med = lambda cond: F.when(F.count(F.when(cond, 1)) >= least, F.percentile(F.when(cond, F.col(value)), F.lit(0.5)))
    g = d.groupBy(key, "case_day").agg(med(F.col("_o") < 0).alias("before"), med(F.col("_o") > 0).alias("after"))
    return c.join(g, [key, "case_day"], "left")


def main_channel(df: DataFrame, keys: list[str], channel: str, order: list[str]) -> DataFrame:
    """One row per key: that of the channel named first in order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(channel))
    d = df.where(place > 0)
    return d.groupBy(*keys).agg(F.min(F.struct(place.alias("p"), F.struct(*[c for c in d.columns if c not in keys]).alias("r"))).alias("_b")).select(*keys, "_b.r.*")


def watched_string(df: DataFrame, key: str, day: str, start: str, days: int) -> DataFrame:
    """key, code: a sign for each day from start on, 1 if the entity has a row on it."""
    n = F.datediff(day, F.lit(start).cast("date"))
    g = df.where(n.between(0, days - 1)).groupBy(key).agg(F.collect_set(n).alias("_s"))
    return g.select(key, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.when(F.array_contains("_s", i), "1").otherwise("0")), "").alias("code"))


def split_weeks(df: DataFrame, key: str, day: str, cut: str, share: int = 5) -> DataFrame:
    """df with part: test after the cut-off day; before it every share-th week by a hash of the week is validation, the rest training."""
    week = F.floor(F.datediff(day, F.lit("1970-01-05").cast("date")) / 7)
    return df.withColumn("part", F.when(F.col(day) > F.lit(cut).cast("date"), "test").when(hash32(week) % share == 0, "validation").otherwise("training"))


def normalize_by_quantile(df: DataFrame, key: str, columns: list[str], q: float = 0.95, least: float = 1e-9) -> DataFrame:
    """Columns by their entity's q-quantile; NULL where that is not above `least`."""
    top = df.groupBy(key).agg(*[F.percentile(c, F.lit(q)).alias(f"_q{i}") for i, c in enumerate(columns)])
    return df.join(top, key).withColumns({c: F.when(F.col(f"_q{i}") > least, F.col(c) / F.col(f"_q{i}")) for i, c in enumerate(columns)}).drop(*[f"_q{i}" for i in range(len(columns))])


def inject_fault(df: DataFrame, key: str, day: str, value: str, counter: str, start: Column, kind: str, size: float, days: int) -> DataFrame:
    """df with a fault in the `days` days from start on: 'shift' adds size, 'ramp' adds it growing from 0, 'factor' multiplies by it. The counter takes
    all that has been added from then on, so it stays the sum of the values."""
    n = F.datediff(day, start)
    on = n.between(0, days - 1)
    change = {"shift": F.lit(float(size)), "ramp": size * (n + 1) / F.lit(float(days)), "factor": F.col(value) * (size - 1)}[kind]
    d = df.withColumn("_add", F.when(on, change).otherwise(0.0))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(counter, F.col(counter) + F.sum("_add").over(w)).withColumn(value, F.col(value) + F.col("_add")).withColumn("faulty", F.coalesce(on, F.lit(False))).drop("_add")


def coverage(df: DataFrame, group: str, x: str, center: float, width: float = 2.0) -> DataFrame:
    """group, n, q10, q50, q90 of x and near: rows within `width` of center."""
    return df.where(F.col(x).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)], F.count(F.when(F.abs(F.col(x) - center) <= width, 1)).alias("near"))


def share_at_cap(df: DataFrame, key: str, day: str, x: str, cap: float) -> DataFrame:
    """key, share of its days whose last value stands at the cap."""
    last = df.groupBy(key, F.to_date(day).alias("_d")).agg(F.max_by(x, day).alias("_x"))
    return last.groupBy(key).agg(F.avg((F.col("_x") >= cap).cast("double")).alias("share"))
