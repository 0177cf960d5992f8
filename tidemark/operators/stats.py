"""Robust comparison with peers, ranks, curves, regressions and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, col


def robust_z(df: DataFrame, x: str, by: list[str], member: Column | None = None, sign: int = 1, least: int = 1, fallback_std: bool = True, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) against the rows of a group for which member holds. Where the MAD is 0 the sample deviation
    stands in (or NULL); fewer than `least` members give NULL. Groups are aggregated and joined back, so a large group is
    not held in one window."""
    m = F.col(x) if member is None else F.when(member, F.col(x))
    med = df.groupBy(*by).agg(F.percentile(m, F.lit(0.5)).alias("_med"), F.count(m).alias("_n"), F.stddev_samp(m).alias("_sd"))
    d = df.join(med, by) if by else df.crossJoin(F.broadcast(med))
    dev = F.abs(F.col(x) - F.col("_med"))
    mad = d.groupBy(*by).agg(F.percentile(dev if member is None else F.when(member, dev), F.lit(0.5)).alias("_mad"))
    d = d.join(mad, by) if by else d.crossJoin(F.broadcast(mad))
    scale = F.when(F.col("_mad") > 0, MAD_SCALE * F.col("_mad"))
    if fallback_std:
        scale = F.coalesce(scale, F.when(F.col("_sd") > 0, F.col("_sd")))
    return d.withColumn(out, F.when(F.col("_n") >= least, sign * (F.col(x) - F.col("_med")) / scale)).drop("_med", "_n", "_sd", "_mad")


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1, ties share their mean; NULL unranked (by must hold a null flag of x, see ranks)."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumn("_ra", average_rank(a, *by)).withColumn("_rb", average_rank(b, *by))
    return d.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def nearest_peers(df: DataFrame, key: str, x: str, by: list[str], k: int) -> DataFrame:
    """key, peer, rank: the k rows of a group nearest in x, ties to the smaller key.

    Only the first k rows of the same x and the k rows on either side of it can be among them, so rows are met through their
    rank and no group is crossed with itself."""
    d = df.where(F.col(x).isNotNull()).select(*by, key, x)
    up, down = Window.partitionBy(*by).orderBy(x, key), Window.partitionBy(*by).orderBy(x, F.desc(key))
    same = Window.partitionBy(*by, x)
    d = d.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    d = d.withColumn("_first", F.min("_u").over(same)).withColumn("_last", F.max("_u").over(same)).withColumn("_low", F.min("_d").over(same))
    spots = F.flatten(F.array(
        F.transform(F.sequence(F.col("_first"), F.least("_last", F.col("_first") + k)), lambda i: F.struct(F.lit("u").alias("s"), i.alias("i"))),
        F.transform(F.sequence(F.col("_last") + 1, F.col("_last") + k), lambda i: F.struct(F.lit("u").alias("s"), i.alias("i"))),
        F.transform(F.sequence(F.col("_low") - k, F.col("_low") - 1), lambda i: F.struct(F.lit("d").alias("s"), i.alias("i"))),
    ))
    near = d.select(*by, key, x, F.explode(spots).alias("_p")).select(*by, key, x, "_p.s", "_p.i")
    other = d.select(*by, F.col(key).alias("peer"), F.col(x).alias("_px"), F.explode(F.array(F.struct(F.lit("u").alias("s"), F.col("_u").alias("i")), F.struct(F.lit("d").alias("s"), F.col("_d").alias("i")))).alias("_p")).select(*by, "peer", "_px", "_p.s", "_p.i")
    pairs = near.join(other, [*by, "s", "i"]).where(F.col("peer") != F.col(key)).withColumn("_d", F.abs(F.col(x) - F.col("_px")))
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy("_d", "peer"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, key, "peer", "rank")


def loglog_fit(df: DataFrame, by: list[str], x: str, y: str, least: int = 30) -> DataFrame:
    """by, n, slope, intercept, r2, residual_sd of ln y on ln x over positive pairs; NULL below `least` rows or without spread in x."""
    ok = (F.col(x) > 0) & (F.col(y) > 0)
    lx, ly = F.when(ok, F.ln(x)), F.when(ok, F.ln(y))
    g = df.groupBy(*by).agg(F.count(lx).alias("n"), F.covar_pop(lx, ly).alias("_c"), F.var_pop(lx).alias("_vx"), F.var_pop(ly).alias("_vy"), F.avg(lx).alias("_mx"), F.avg(ly).alias("_my"))
    fit = (F.col("n") >= least) & (F.col("_vx") > 1e-12)
    g = g.withColumn("slope", F.when(fit, F.col("_c") / F.col("_vx")))
    rest = F.greatest(F.col("_vy") - F.col("slope") * F.col("_c"), F.lit(0.0))
    return g.select(*by, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), F.when(F.col("_vy") > 1e-12, 1 - rest / F.col("_vy")).alias("r2"), F.when(F.col("slope").isNotNull(), F.sqrt(rest)).alias("residual_sd"))


def modulation(df: DataFrame, by: list[str], power: str, flow: str, spread: str, least: int = 30) -> DataFrame:
    """Shares of the variance of ln power that flow and spread carry (cov / var), which sum to 1 where power = flow * spread."""
    ok = (F.col(power) > 0) & (F.col(flow) > 0) & (F.col(spread) > 0)
    p, f, s = (F.when(ok, F.ln(c)) for c in (power, flow, spread))
    g = df.groupBy(*by).agg(F.count(p).alias("n"), F.var_pop(p).alias("_v"), F.covar_pop(f, p).alias("_f"), F.covar_pop(s, p).alias("_s"))
    fit = (F.col("n") >= least) & (F.col("_v") > 1e-12)
    return g.select(*by, "n", F.when(fit, F.col("_f") / F.col("_v")).alias("share_flow"), F.when(fit, F.col("_s") / F.col("_v")).alias("share_spread"))


def theil_sen(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope (median of the slopes of all pairs with x rising), intercept (median y - slope * median x). A group is one entity's season,
    at most some hundred rows: the definition asks for its pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    lists = d.groupBy(*by).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_p"), F.percentile(x, F.lit(0.5)).alias("_mx"), F.percentile(y, F.lit(0.5)).alias("_my"))
    pairs = lists.select(*by, "_mx", "_my", "_p", F.explode("_p").alias("a")).select(*by, "_mx", "_my", F.explode(F.transform(F.filter("_p", lambda b: b["x"] > F.col("a.x")), lambda b: (b["y"] - F.col("a.y")) / (b["x"] - F.col("a.x")))).alias("_s"))
    g = pairs.groupBy(*by).agg(F.percentile("_s", F.lit(0.5)).alias("slope"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"))
    return g.select(*by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def class_curve(df: DataFrame, by: list[str], x: str, y: str, width: float = 2.0, least: int = 8) -> DataFrame:
    """by, x_mid, y_mid, n: medians of y by classes of x that hold at least `least` rows."""
    k = F.floor(F.col(x) / width)
    return df.where(F.col(y).isNotNull()).groupBy(*by, k.alias("_k")).agg(F.percentile(y, F.lit(0.5)).alias("y_mid"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*by, ((F.col("_k") + 0.5) * width).alias("x_mid"), "y_mid", "n")


def curve_value(df: DataFrame, curve: DataFrame, by: list[str], x: str, out: str = "expected") -> DataFrame:
    """Expectation from a class curve: linear between class centres, flat beyond the ends."""
    lists = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("x_mid").alias("x"), F.col("y_mid").alias("y")))).alias("_c"))
    d = df.join(lists, by, "left")
    hi = F.try_element_at(F.filter("_c", lambda p: p["x"] > F.col(x)), F.lit(1))
    lo = F.try_element_at(F.filter("_c", lambda p: p["x"] <= F.col(x)), F.lit(-1))
    line = lo["y"] + (hi["y"] - lo["y"]) * (F.col(x) - lo["x"]) / (hi["x"] - lo["x"])
    return d.withColumn(out, F.coalesce(F.when(lo.isNotNull() & hi.isNotNull(), line), lo["y"], hi["y"])).drop("_c")


def ols(df: DataFrame, x: list[str], y: str, weight: str | None = None, cluster: str | None = None):
    """Weighted least squares with an intercept: names, coefficients, standard errors, t, degrees of freedom, n, r2.

    Sums of products come from one grouped pass; the solve is as large as the number of predictors. With `cluster`, the sandwich
    estimator takes score sums by cluster and the usual small-sample factor."""
    import numpy as np

    names = ["intercept", *x]
    w = F.lit(1.0) if weight is None else F.col(weight)
    d = df.dropna(subset=[*x, y, *([weight] if weight else []), *([cluster] if cluster else [])])
    v = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    t = F.col(y).cast("double")
    sums = [F.sum(w * a * b) for i, a in enumerate(v) for b in v[i:]] + [F.sum(w * a * t) for a in v] + [F.sum(w * t * t), F.sum(w * t), F.sum(w), F.count(F.lit(1))]
    row = list(d.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    k = len(v)
    n = int(row[-1])
    groups = d.select(cluster).distinct().count() if cluster else None
    if n <= k or (groups is not None and groups <= k):
        raise ValueError("too few rows or clusters for the predictors")
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[at]
            at += 1
    xy, yy, sy, sw = np.array(row[at : at + k]), row[at + k], row[at + k + 1], row[at + k + 2]
    inv = np.linalg.inv(xx)
    beta = inv @ xy
    sse = max(0.0, yy - beta @ xy)
    if cluster:
        e = t - sum((F.lit(float(b)) * a for b, a in zip(beta, v, strict=True)), F.lit(0.0))
        score = d.groupBy(cluster).agg(*[F.sum(w * e * a).alias(f"u{i}") for i, a in enumerate(v)])
        meat_row = score.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        cov = inv @ np.array(meat_row).reshape(k, k) @ inv * (groups / (groups - 1) * (n - 1) / (n - k))
        dof = groups - 1
    else:
        cov, dof = inv * sse / (n - k), n - k
    se = np.sqrt(np.diag(cov))
    return {"names": names, "beta": beta.tolist(), "se": se.tolist(), "t": (beta / se).tolist(), "dof": dof, "n": n, "r2": 1 - sse / (yy - sy * sy / sw)}


def residual(df: DataFrame, fit: dict, y: str, out: str = "residual") -> DataFrame:
    """y minus the fitted value of ols()."""
    hat = sum((F.lit(b) * F.col(c) for b, c in zip(fit["beta"][1:], fit["names"][1:], strict=True)), F.lit(fit["beta"][0]))
    return df.withColumn(out, F.col(y) - hat)


def auc(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """by, auc, n_pos, n_neg by rank sums; NULL where a class is missing."""
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).withColumn("_r", average_rank(score, *by))
    pos = F.col(truth) == 1
    g = d.groupBy(*by).agg(F.sum(F.when(pos, F.col("_r"))).alias("_s"), F.count(F.when(pos, 1)).alias("n_pos"), F.count(F.when(~pos, 1)).alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return g.select(*by, F.try_divide(F.col("_s") - p * (p + 1) / 2, (p * n).cast("double")).alias("auc"), "n_pos", "n_neg")


def holm(df: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Holm's step-down correction over all rows with a p-value; as many as there are tests."""
    w = Window.orderBy(p)
    known = df.where(F.col(p).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("_i") + 1))
    known = known.withColumn(out, F.max(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_n")
    return known.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def weighted_mean(x, w) -> Column:
    """Sum of x * w by sum of w, over rows where both are known."""
    both = col(x).isNotNull() & col(w).isNotNull()
    return F.try_divide(F.sum(F.when(both, col(x) * col(w))), F.sum(F.when(both, col(w))))


def large_medians(df: DataFrame, by: str, x: str, accuracy: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(by, n, median) of few groups of any size, and one row (n, median) of all of them; rows without x are left out. The medians are exact: percentile keeps every value of a group in one
    task, here approximate quantiles (whose rank is off by at most 1 / accuracy) only tell which values lie around the middle. Those are counted by value and all others by the side on which they lie."""
    d = df.where(F.col(x).isNotNull()).select(F.col(by).alias("_g"), F.col(x).alias("_x"))
    around = F.percentile_approx("_x", F.array(F.lit(0.495), F.lit(0.505)), F.lit(accuracy))
    near, all_ = d.groupBy(F.col("_g").alias("_h")).agg(around.alias("_s")), d.agg(around.alias("_a"))
    side = lambda r: F.when(F.col("_x") < F.col(r)[0], -1).when(F.col("_x") <= F.col(r)[1], 0).otherwise(1)
    t = d.join(F.broadcast(near), F.col("_g").eqNullSafe(F.col("_h"))).crossJoin(F.broadcast(all_)).select("_g", "_x", side("_s").alias("_i"), side("_a").alias("_j"))
    t = t.groupBy("_g", "_i", "_j", F.when((F.col("_i") == 0) | (F.col("_j") == 0), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))

    def middle(group: Column, side: str) -> DataFrame:
        g = t.groupBy(group.alias("_g"), F.col(side).alias("_i"), F.when(F.col(side) == 0, F.col("_x")).alias("_x")).agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy("_g")
        g = g.withColumn("_c", F.sum("_n").over(w.orderBy("_i", "_x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(w))
        value = F.when(F.col("_i") != 0, F.raise_error(F.lit("the middle lies beyond its approximate quantiles")).cast("double")).otherwise(F.col("_x"))
        at = lambda rank: F.max(F.when((F.col("_c") - F.col("_n") <= rank) & (rank < F.col("_c")), value))
        g = g.groupBy("_g").agg(F.max("_t").alias("n"), at(F.floor((F.col("_t") - 1) / 2)).alias("_l"), at(F.floor(F.col("_t") / 2)).alias("_u"))
        return g.select(F.col("_g").alias(by), "n", F.when(F.col("_l") == F.col("_u"), F.col("_l")).otherwise(F.col("_l") * 0.5 + F.col("_u") * 0.5).alias("median"))

    return middle(F.col("_g"), "_i"), middle(F.lit(0), "_j").select("n", "median")
