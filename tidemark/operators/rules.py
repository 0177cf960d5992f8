"""Rules, evidence and scores: which rule fires first, how well a pattern fits, how urgent a case is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(x: str, threshold: float, direction: str) -> Column:
    """Above or below a threshold; NULL is no hit."""
    c = F.col(x) > threshold if direction == "above" else F.col(x) < threshold
    return F.coalesce(c, F.lit(False))


def rule_book(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """df with level and reasons: rules are (name, level, condition); alarms outrank warnings, names keep their order."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"))) for name, level, c in rules]))
    d = df.withColumn("_h", hits)
    alarm = F.filter("_h", lambda h: h["level"] == "alarm")
    warn = F.filter("_h", lambda h: h["level"] == "warning")
    first = F.when(F.size(alarm) > 0, F.element_at(alarm, 1)["name"]).when(F.size(warn) > 0, F.element_at(warn, 1)["name"])
    level = F.when(F.size(alarm) > 0, "alarm").when(F.size(warn) > 0, "warning").otherwise("ok")
    return d.withColumn("level", level).withColumn("first_rule", first).withColumn("reasons", F.array_join(F.transform("_h", lambda h: h["name"]), "; ")).drop("_h")


def calibrate_rules(df: DataFrame, spec: dict[str, tuple[float, str]], target: float, least: int) -> DataFrame:
    """feature, old, threshold, n: the threshold at which `target` of the rows would be hit; the old one where fewer than `least` rows have the feature."""
    long_ = df.select(*[F.col(f).cast("double").alias(f) for f in spec]).unpivot([], list(spec), "feature", "value")
    q = long_.groupBy("feature").agg(F.count("value").alias("n"), F.percentile("value", F.lit(1 - target)).alias("hi"), F.percentile("value", F.lit(target)).alias("lo"))
    old = F.create_map(*[x for f, (t, _) in spec.items() for x in (F.lit(f), F.lit(float(t)))])
    way = F.create_map(*[x for f, (_, d) in spec.items() for x in (F.lit(f), F.lit(d))])
    new = F.when(way[F.col("feature")] == "above", F.col("hi")).otherwise(F.col("lo"))
    return q.select("feature", old[F.col("feature")].alias("old"), F.when(F.col("n") >= least, new).otherwise(old[F.col("feature")]).alias("threshold"), "n")


def evidence(df: DataFrame, key: str, catalogue: list[tuple[str, str, float]], least: float = 0.5) -> DataFrame:
    """key, pattern, score, rank: weighted mean of the standardized features (clipped to +-3) that a pattern names; weights carry the sign.
    Patterns with less than `least` of their weight available are left out."""
    features = sorted({f for _, f, _ in catalogue})
    z = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "z").where("z is not null")
    spark = df.sparkSession
    cat = spark.createDataFrame(catalogue, "pattern string, feature string, weight double")
    full = cat.groupBy("pattern").agg(F.sum(F.abs("weight")).alias("_all"))
    s = z.join(F.broadcast(cat), "feature").groupBy(key, "pattern").agg(F.sum(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("z"))) * F.col("weight")).alias("_s"), F.sum(F.abs("weight")).alias("_w"))
    s = s.join(F.broadcast(full), "pattern").where(F.col("_w") >= least * F.col("_all")).withColumn("score", F.col("_s") / F.col("_w"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pattern"))).select(key, "pattern", "score", "rank")


def severity(df: DataFrame, parts: dict[str, tuple[float, float]], out: str = "severity") -> DataFrame:
    """0 to 100: each part is value / cap, held to [0, 1], and weighed; missing parts give their weight to the others."""
    num, den = F.lit(0.0), F.lit(0.0)
    for c, (weight, cap) in parts.items():
        known = F.col(c).isNotNull()
        num = num + F.when(known, weight * F.least(F.greatest(F.col(c) / cap, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        den = den + F.when(known, weight).otherwise(0.0)
    return df.withColumn(out, 100 * F.try_divide(num, den))


def urgency_rank(df: DataFrame, level: str, order: list[str], then: str, key: str) -> DataFrame:
    """df with rank: by level in the order given, then by `then` falling with NULLs last, then by key."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(level))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(place, F.col(then).desc_nulls_last(), key)))


def bayes_posterior(df: DataFrame, key: str, symptom: str, present: str, likelihood: DataFrame, prior: DataFrame) -> DataFrame:
    """key, cause, posterior: naive Bayes over symptoms (rows with key, symptom, present; NULL drops out) with P(symptom | cause) and P(cause)."""
    seen = df.where(F.col(present).isNotNull()).join(F.broadcast(likelihood), symptom)
    lp = F.when(F.col(present), F.ln("p")).otherwise(F.ln(1 - F.col("p")))
    s = seen.groupBy(key, "cause").agg(F.sum(lp).alias("_l")).join(F.broadcast(prior), "cause").withColumn("_l", F.col("_l") + F.ln("prior"))
    top = s.groupBy(key).agg(F.max("_l").alias("_m"))
    s = s.join(top, key).withColumn("_e", F.exp(F.col("_l") - F.col("_m")))
    return s.join(s.groupBy(key).agg(F.sum("_e").alias("_t")), key).select(key, "cause", (F.col("_e") / F.col("_t")).alias("posterior"))


def two_by_two(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, kappa: one row. Rows where either is NULL are left out."""
    d = df.select(predicted.alias("p"), truth.alias("t")).where("p is not null and t is not null")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    r = d.agg(n("p and t").alias("tp"), n("p and not t").alias("fp"), n("not p and t").alias("fn"), n("not p and not t").alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    all_ = tp + fp + fn + tn
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), all_ * all_)
    return r.select("tp", "fp", "fn", "tn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(F.try_divide(tp + tn, all_) - chance, 1 - chance).alias("kappa"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n with margins ('all') in both directions."""
    c = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return c.select(F.when(F.col("_a") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "all").otherwise(F.col(b)).alias(b), "n")


def run_delta(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """key, before, after, change (new, gone, same, changed) of two runs."""
    j = old.select(key, F.col(status).alias("before"), F.lit(True).alias("_o")).join(new.select(key, F.col(status).alias("after"), F.lit(True).alias("_n")), key, "full")
    return j.select(key, "before", "after", F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed").alias("change"))
