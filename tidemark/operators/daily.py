"""Daily values, panels, exclusion reasons and grouped summaries. Rows are flagged, never filtered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def performance(df: DataFrame, energy: str, volume: str, least_volume: float, band: tuple[float, float], least_rows: int) -> DataFrame:
    """energy by volume with the flags small_volume, out_of_band, few_rows and valid."""
    ratio = F.try_divide(F.col(energy), F.col(volume))
    small = F.coalesce(F.col(volume) < least_volume, F.lit(True))
    out = df.withColumn("small_volume", small).withColumn("performance", F.when(~small, ratio))
    out = out.withColumn("out_of_band", F.coalesce(~ratio.between(*band), F.lit(False))).withColumn("few_rows", F.col("n") < least_rows)
    return out.withColumn("valid", ~F.col("few_rows") & ~F.col("small_volume") & ~F.col("out_of_band"))


def flag(df: DataFrame, flags: dict[str, Column], ignored: tuple[str, ...] = ()) -> DataFrame:
    """reasons (names of the flags that hold, in order, joined by commas) and usable (none holds but the ignored ones)."""
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]
    against = [F.coalesce(c, F.lit(False)) for n, c in flags.items() if n not in ignored]
    return df.withColumn("reasons", F.concat_ws(", ", *named)).withColumn("usable", ~reduce(lambda a, b: a | b, against))


def balance(flagged: DataFrame) -> DataFrame:
    """reason, days, still_usable: how many days each reason names (they overlap)."""
    each = flagged.where("reasons <> ''").select(F.explode(F.split("reasons", ", ")).alias("reason"), "usable")
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("usable"), 1)).alias("still_usable"))


def first_reason(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(F.element_at(F.split("reasons", ", "), 1).alias("reason")).agg(F.count(F.lit(1)).alias("days"))


def with_daily_context(panel: DataFrame, context: DataFrame, day: str, value: str, rows: str, least: int) -> DataFrame:
    """panel with a network-wide daily value, NULL where it stands on fewer than `least` rows."""
    c = context.select(day, F.when(F.col(rows) >= least, F.col(value)).alias(value))
    return panel.join(c, day, "left")


def state_shares(df: DataFrame, by: list[str], state: str, states: list[str]) -> DataFrame:
    """by, n and the share of each state among the rows that have one."""
    return df.where(F.col(state).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col(state) == s).cast("double")).alias(f"share_{s}") for s in states])


def features(df: DataFrame, key: str, day: str, x: str, load: str) -> DataFrame:
    """One row of characteristics per entity."""
    span = F.greatest(F.datediff(F.max(day), F.min(day)), F.lit(1))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.month(day).isin(12, 1, 2, 3), F.col(x))).alias("winter_mean"),
        F.percentile(x, F.lit(0.95)).alias("p95"),
        F.avg(F.when(F.coalesce(F.col(load) > 40, F.lit(False)), 1.0).otherwise(0.0)).alias("loaded_share"),
        F.stddev_samp(x).alias("sd"),
        (F.sum(x) * 8760 / span / 24).alias("per_year"),
        (F.percentile(x, F.lit(0.5)) / F.greatest(F.max(x), F.lit(0.1))).alias("level"),
    )


def monthly_trend(df: DataFrame, key: str, day: str, x: str, q: float, least: int) -> DataFrame:
    """key, months, slope of the monthly q-quantile per calendar month; NULL below `least` months."""
    m = df.groupBy(key, (F.year(day) * 12 + F.month(day)).alias("_m")).agg(F.percentile(x, F.lit(q)).alias("_p"))
    return m.groupBy(key).agg(F.count(F.lit(1)).alias("months"), F.when(F.count(F.lit(1)) >= least, F.regr_slope("_p", "_m")).alias("slope"))


def bands(df: DataFrame, by: list[str], x: str, quantiles: dict[str, float], least: int) -> DataFrame:
    """by, n and quantiles of x; NULL below `least` rows."""
    n = F.count(x)
    return df.groupBy(*by).agg(n.alias("n"), *[F.when(n >= least, F.percentile(x, F.lit(q))).alias(name) for name, q in quantiles.items()])


def decile_flags(df: DataFrame, by: list[str], metrics: list[str], q: float, least: int) -> DataFrame:
    """hits (metrics at or above their group's q-quantile and above 0) and flagged (at least `least` hits)."""
    t = df.groupBy(*by).agg(*[F.percentile(m, F.lit(q)).alias(f"_t{i}") for i, m in enumerate(metrics)])
    hit = [F.coalesce((F.col(m) >= F.col(f"_t{i}")) & (F.col(m) > 0), F.lit(False)).cast("int") for i, m in enumerate(metrics)]
    out = df.join(t, by).withColumn("hits", reduce(lambda a, b: a + b, hit))
    return out.withColumn("flagged", F.col("hits") >= least).drop(*[f"_t{i}" for i in range(len(metrics))])


def chronic(df: DataFrame, key: str, period: str, hit: str, least: int) -> DataFrame:
    """key, periods seen, hits, which periods, chronic."""
    hits = F.count(F.when(F.col(hit), 1))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{period}s"), hits.alias("hits"), F.array_join(F.array_sort(F.collect_list(F.when(F.col(hit), F.col(period)))), ", ").alias("which"), (hits >= least).alias("chronic"))


def weather_fit(df: DataFrame, by: list[str], x: str, y: str, least: int) -> DataFrame:
    """by, n, base (intercept) and slope; NULL below `least` rows or where x does not vary."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    ok = (n >= least) & (F.var_pop(x) > 0)
    return df.groupBy(*by).agg(n.alias("n"), F.when(ok, F.regr_intercept(y, x)).alias("base"), F.when(ok, F.regr_slope(y, x)).alias("slope"))


def line_by_group(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, se of the slope of a line in each group."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    g = df.groupBy(*by).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"), F.regr_sxx(y, x).alias("_xx"))
    rest = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    return g.withColumn("se", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("_xx")))).drop("_yy", "_xy", "_xx")
