"""Resampling tests: replicates are rows, worked out by grouped sums over all data; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hash32
from tidemark.operators.graph import pairs_of


def _counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """s, pos, neg: how many rows of either class have a score."""
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return d.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.when(F.col(truth) == 1, 1)).alias("pos"), F.count(F.when(F.col(truth) != 1, 1)).alias("neg"))


def uniform(*parts) -> Column:
    """A number between 0 and 1, both excluded, that depends on the parts alone."""
    return (hash32(*parts) + 0.5) / 4294967296.0


def poisson(df: DataFrame, mean: str, u: Column, out: str, most: int = 12) -> DataFrame:
    """df with out, the Poisson count of a mean at the uniform number u: by the distribution function for means up to 4, beyond by a normal number with a skewness term."""
    d = df.withColumn("_u", u)
    d = d.withColumn("_v", F.col("_u") * F.exp(F.least(F.col(mean), F.lit(4.0)))).withColumn("_z", F.when(F.col(mean) > 4, F.sqrt(-2 * F.ln("_u")) * F.cos(6.283185307179586 * uniform("_u"))))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, k: F.struct((a["t"] * F.col(mean) / k).alias("t"), (a["s"] + a["t"] * F.col(mean) / k).alias("s"), (a["n"] + (F.col("_v") > a["s"]).cast("int")).alias("n"))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["n"])
    large = F.greatest(F.lit(0), F.floor(F.col(mean) + F.sqrt(mean) * F.col("_z") + (F.col("_z") * F.col("_z") - 1) / 6 + 0.5).cast("int"))
    return d.withColumn(out, F.when(F.col(mean) == 0, 0).when(F.col(mean) <= 4, small).otherwise(large)).drop("_u", "_v", "_z")


def _auc(weighted: DataFrame, by: str, buckets: int = 64) -> DataFrame:
    """by, auc from (by, s, pos, neg). Pairs are counted by running sums in two steps, score ranges and within them, so no task sees all scores of a replicate."""
    w = weighted.where("pos > 0 or neg > 0")
    cuts = w.agg(F.percentile_approx("s", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("_c"))  # one row of buckets - 1 numbers
    w = w.crossJoin(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_c", lambda c: c < F.col("s")))).drop("_c")
    size = w.groupBy(by, "_r").agg(F.sum("neg").alias("_n"))
    below = size.select(by, "_r", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    run = F.coalesce(F.sum("neg").over(Window.partitionBy(by, "_r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = w.withColumn("_run", run).join(below, [by, "_r"])
    g = d.groupBy(by).agg(F.sum(F.col("pos") * (F.col("_below") + F.col("_run") + F.col("neg") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    return g.select(by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_u") / (F.col("_p").cast("double") * F.col("_q"))).alias("auc"))


def _replicated(counts: DataFrame, n: int, seed: int) -> DataFrame:
    """Every score's counts drawn anew for each replicate: independent Poisson weights, whatever the partitions."""
    d = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in ("pos", "neg"):
        d = poisson(d.withColumn(f"_{c}", F.col(c).cast("double")), f"_{c}", uniform(F.lit(seed), "replicate", "s", F.lit(c)), c)
    return d.select("replicate", "s", "pos", "neg")


def bootstrap_auc(df: DataFrame, truth: str, score: str, n: int = 1000, seed: int = 1) -> DataFrame:
    """auc_low, auc_median, auc_high, replicates: percentiles 2.5, 50 and 97.5 of the AUC over n resamples (Poisson bootstrap over counts by score and class). Replicates without one
    of the classes are left out."""
    r = _auc(_replicated(_counts(df, truth, score), n, seed), "replicate").where("auc is not null")
    q = lambda p, name: F.percentile("auc", F.lit(p)).alias(name)
    return r.agg(q(0.025, "auc_low"), q(0.5, "auc_median"), q(0.975, "auc_high"), F.count(F.lit(1)).alias("replicates"))


def bootstrap_auc_difference(df: DataFrame, truth: str, a: str, b: str, key: str, n: int = 1000, seed: int = 1) -> DataFrame:
    """difference (of a minus b over all rows with both), low, high, share_above (replicates above 0): rows are resampled as pairs, by one Poisson weight for each row and replicate."""
    d = df.where(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    w = d.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(n - 1)))).withColumn("_one", F.lit(1.0))
    w = poisson(w, "_one", uniform(F.lit(seed), "replicate", key), "_w").withColumn("_w", F.when(F.col("replicate") < 0, 1).otherwise(F.col("_w"))).where("_w > 0")
    one = lambda c: _auc(w.groupBy("replicate", F.col(c).cast("double").alias("s")).agg(F.sum(F.when(F.col(truth) == 1, F.col("_w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) != 1, F.col("_w")).otherwise(0)).alias("neg")), "replicate")
    r = one(a).join(one(b).withColumnRenamed("auc", "_b"), "replicate").withColumn("_d", F.col("auc") - F.col("_b"))
    drawn = F.when(F.col("replicate") >= 0, F.col("_d"))
    return r.agg(F.max(F.when(F.col("replicate") < 0, F.col("_d"))).alias("difference"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"), F.avg((drawn > 0).cast("double")).alias("share_above"))


def permutation_test(df: DataFrame, truth: str, score: str, key: str, n: int = 1000, seed: int = 1) -> DataFrame:
    """observed, p_value: the AUC against labels dealt out anew by chance at the same share, (1 + at least as large) / (1 + replicates)."""
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(F.col(key).alias("_k"), (F.col(truth) == 1).cast("int").alias("_y"), F.col(score).cast("double").alias("s"))
    share = d.agg(F.avg("_y").alias("_p"))
    r = d.crossJoin(F.broadcast(share)).withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    drawn = F.when(F.col("replicate") < 0, F.col("_y") == 1).otherwise(uniform(F.lit(seed), "replicate", "_k") < F.col("_p"))
    w = r.withColumn("_d", drawn).groupBy("replicate", "s").agg(F.count(F.when(F.col("_d"), 1)).alias("pos"), F.count(F.when(~F.col("_d"), 1)).alias("neg"))
    g = _auc(w, "replicate")
    seen = g.where("replicate < 0").select(F.col("auc").alias("observed"))
    c = g.where("replicate >= 0 and auc is not null").crossJoin(F.broadcast(seen))
    return c.agg(F.max("observed").alias("observed"), ((1 + F.count(F.when(F.col("auc") >= F.col("observed"), 1))) / (1 + F.count(F.lit(1)))).alias("p_value"))


def network_days(alarms: DataFrame, key: str, day: str, within: int = 3, replicates: int = 500, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """day, entities, threshold, network_day: days near which (at most `within` days away) more entities alarm than in (1 - alpha) of the maxima that cyclic shifts of each
    entity's own alarms give. A shift is a hash of seed, replicate and entity; everything is counted by (replicate, day). An entity is one row with all its days, so a shift is worked out once and
    nothing is joined; a day near several alarms of an entity is left to the first of them, so nothing is made distinct."""
    a = alarms.select(F.col(key).alias("_k"), F.unix_date(F.col(day)).alias("_d")).distinct()
    ends = a.agg(F.min("_d").alias("_lo"), (F.max("_d") - F.min("_d") + 1).alias("_span"))  # one row
    base = a.where("_d is not null").crossJoin(F.broadcast(ends)).groupBy("_k", "_span").agg(F.array_sort(F.collect_list(F.col("_d") - F.col("_lo"))).alias("_os"))
    before = lambda o, i: F.coalesce(F.get("_os", i - 1), F.element_at("_os", -1) - F.col("_span"))
    base = base.select("_k", "_span", F.transform("_os", lambda o, i: F.struct(o.alias("o"), (o - before(o, i)).alias("gap"))).alias("_os"))

    def near(d: DataFrame, by: list[str]) -> DataFrame:
        """by, _x, entities of (by, _span, _shift, _os)."""
        d = d.select(*by, "_span", "_shift", F.explode("_os").alias("_e")).select(*by, "_span", F.pmod(F.col("_e.o") + F.col("_shift"), F.col("_span")).cast("int").alias("_o"), F.col("_e.gap").alias("_gap"))
        behind = F.when(F.col("_o") >= F.col("_gap"), F.col("_o") - F.col("_gap") + within + 1)  # the first day that the alarm before, if there is one, does not take
        d = d.select(*by, F.greatest(F.lit(0), F.col("_o") - within, behind).alias("_a"), F.least(F.col("_span") - 1, F.col("_o") + within).alias("_b"))
        g = d.where("_a <= _b").groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))  # few rows, whatever the number of entities
        return g.withColumn("_x", F.explode(F.sequence("_a", "_b"))).groupBy(*by, "_x").agg(F.sum("_n").alias("entities"))

    drawn = base.where("_k is not null").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("_shift", F.pmod(hash32(F.lit(seed), "replicate", "_k"), F.col("_span")))
    top = near(drawn, ["replicate"]).groupBy("replicate").agg(F.max("entities").alias("_t"))
    # one number a replicate; lo + (hi - lo) * share, rounded as in the SQL, where percentile weighs both ends
    at = (F.size("_ts") - 1) * F.lit(1 - alpha)
    lo, hi = [F.get("_ts", f(at).cast("int")) for f in (F.floor, F.ceil)]
    limit = top.agg(F.array_sort(F.collect_list(F.col("_t").cast("double"))).alias("_ts")).select((lo + (hi - lo) * (at - F.floor(at))).alias("threshold"))
    seen = near(base.withColumn("_shift", F.lit(0)), [])
    days = ends.select("_lo", F.explode(F.sequence(F.lit(0), (F.col("_span") - 1).cast("int"))).alias("_x")).where("_lo is not null")
    out = days.join(seen, "_x", "left").withColumn("entities", F.coalesce("entities", F.lit(0)).cast("int")).crossJoin(F.broadcast(limit))
    return out.select(F.date_from_unix_date(F.col("_lo") + F.col("_x")).alias("day"), "entities", "threshold", (F.col("entities") > F.col("threshold")).alias("network_day"))


def neighbour_permutation(pairs: DataFrame, flagged: DataFrame, key: str, flag: str, replicates: int = 500, seed: int = 1, members: DataFrame | None = None) -> DataFrame:
    """pairs, both_flagged, expected, p_value: neighbour pairs flagged on both sides against flags dealt out by chance: in every replicate as many nodes as are flagged, those with the smallest hash
    of seed, replicate and node (pairs: a, b). With members (k, place; a key has one place) the pairs are links between places, as in graph.joint_flags, and counted by (replicate, place)."""
    f = flagged.select(F.col(key).alias("_k"), F.coalesce(F.col(flag), F.lit(False)).alias("_f"))
    m = f.agg(F.count(F.when(F.col("_f"), 1)).alias("_m"))
    every = F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))).alias("replicate")
    r = f.crossJoin(F.broadcast(m)).select("*", every)
    order = Window.partitionBy("replicate").orderBy(F.when(F.col("replicate") < 0, (~F.col("_f")).cast("bigint")).otherwise(hash32(F.lit(seed), "replicate", "_k")), "_k")  # one row for each node
    drawn = r.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= F.col("_m")).select("replicate", "_k")
    if members is None:
        p = pairs.select("a", "b").distinct()
        hit = p.join(drawn.withColumnRenamed("_k", "a"), "a").join(drawn.withColumnRenamed("_k", "b"), ["replicate", "b"]).groupBy("replicate").agg(F.count(F.lit(1)).alias("_n"))
        total = p.agg(F.count(F.lit(1)).alias("pairs"))
    else:
        sizes = drawn.join(members, F.col("_k") == F.col("k")).groupBy("replicate", "place").agg(F.count(F.lit(1)).alias("_c"))
        hit = pairs_of(pairs, sizes, "_c", ["replicate"]).groupBy("replicate").agg(F.sum("pairs").alias("_n"))
        total = pairs_of(pairs, members.groupBy("place").agg(F.count(F.lit(1)).alias("_c")), "_c").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    all_ = m.select(every).join(hit, "replicate", "left").select("replicate", F.coalesce("_n", F.lit(0)).alias("_n"))
    seen = all_.where("replicate < 0").select(F.col("_n").alias("both_flagged"))
    c = all_.where("replicate >= 0").crossJoin(F.broadcast(seen)).agg(F.max("both_flagged").alias("both_flagged"), F.avg("_n").alias("expected"), ((1 + F.count(F.when(F.col("_n") >= F.col("both_flagged"), 1))) / (1 + F.count(F.lit(1)))).alias("p_value"))
    return c.crossJoin(F.broadcast(total)).select("pairs", "both_flagged", "expected", "p_value")
