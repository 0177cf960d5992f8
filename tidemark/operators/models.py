"""Models and the operators that need numpy per entity: clusters, spectra, autoregression, isolation forest, learned pipelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus mean by sample deviation over all rows; NULL where it is 0."""
    s = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    d = df.crossJoin(F.broadcast(s))  # one row
    d = d.withColumns({c: F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")) for i, c in enumerate(columns)})
    return d.drop(*[f"_{k}{i}" for i in range(len(columns)) for k in "ms"])


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label and the mean of its vectors, component by component."""
    each = df.select(label, F.posexplode(vector).alias("_i", "_x"))
    m = each.groupBy(label, "_i").agg(F.avg("_x").alias("_m"))
    return m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centers: DataFrame) -> DataFrame:
    """key, the label of the nearest centroid (ties to the smaller label) and its distance. Centroids are one small array."""
    label = [c for c in centers.columns if c != "centroid"][0]
    all_ = centers.agg(F.collect_list(F.struct(label, "centroid")).alias("_c"))
    d2 = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    d = df.select(key, vector).crossJoin(F.broadcast(all_))
    best = F.array_min(F.transform("_c", lambda c: F.struct(d2(c["centroid"]).alias("d"), c[label].alias("l"))))
    return d.select(key, best["l"].alias(label), F.sqrt(best["d"]).alias("distance"))


def profile(df: DataFrame, key: str, day: str, x: str, gap_days: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(day)
    d = df.withColumn("_g", F.datediff(day, F.lag(day).over(w))).withColumn("_s", F.col(x) - F.lag(x).over(w))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_g").alias("longest_gap"), F.count(F.when(F.col("_g") > gap_days, 1)).alias("gaps"), F.count(F.when(F.col("_s") < 0, 1)).alias("drops"), F.count(F.when(F.col("_s") == 0, 1)).alias("constants"), F.percentile(x, F.lit(0.05)).alias("p05"), F.percentile(x, F.lit(0.95)).alias("p95"))


def spectral_share(df: DataFrame, key: str, ts: str, x: str, shortest: float, longest: float) -> DataFrame:
    """key, share: power of periods between shortest and longest (in steps) by all power of the mean-centred series; missing steps count as the mean."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(ts)[x].to_numpy(float)
        v = np.nan_to_num(v - np.nanmean(v)) if len(v) else v
        p = np.abs(np.fft.rfft(v)) ** 2
        f = np.fft.rfftfreq(len(v))
        band = (f >= 1 / longest) & (f <= 1 / shortest)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "share": [float(p[band].sum() / p.sum()) if p.sum() > 0 else None]})

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, share double")


def autoregression(df: DataFrame, key: str, day: str, y: str, x: str, least: int = 30) -> DataFrame:
    """key, n, phi, beta, intercept, sigma: y on its value of the day before and on x over pairs of adjacent days, by grouped covariances; phi is held to [-0.99, 0.99] and the rest fitted
    to it. Gaps drop pairs. NULL below `least` pairs or where the two predictors do not vary apart."""
    w = Window.partitionBy(key).orderBy(day)
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("_l", F.when(F.datediff(day, F.lag(day).over(w)) == 1, F.lag(y).over(w)))
    on = F.col("_l").isNotNull()
    v, l, u = F.when(on, F.col(y)), F.col("_l"), F.when(on, F.col(x))
    g = d.groupBy(key).agg(F.count(l).alias("n"), F.avg(v).alias("_my"), F.avg(l).alias("_ml"), F.avg(u).alias("_mx"), F.var_pop(v).alias("_yy"), F.var_pop(l).alias("_ll"), F.var_pop(u).alias("_xx"), F.covar_pop(l, u).alias("_lx"), F.covar_pop(l, v).alias("_ly"), F.covar_pop(u, v).alias("_xy"))
    det = F.col("_ll") * F.col("_xx") - F.col("_lx") * F.col("_lx")
    ok = (F.col("n") >= least) & (det > 1e-9 * F.col("_ll") * F.col("_xx"))
    g = g.withColumn("phi", F.when(ok, F.least(F.greatest((F.col("_ly") * F.col("_xx") - F.col("_xy") * F.col("_lx")) / det, F.lit(-0.99)), F.lit(0.99))))
    g = g.withColumn("beta", F.when(F.col("phi").isNotNull(), (F.col("_xy") - F.col("phi") * F.col("_lx")) / F.col("_xx")))
    p, b = F.col("phi"), F.col("beta")
    rest = F.col("_yy") + p * p * F.col("_ll") + b * b * F.col("_xx") - 2 * p * F.col("_ly") - 2 * b * F.col("_xy") + 2 * p * b * F.col("_lx")
    return g.select(key, "n", "phi", "beta", (F.col("_my") - p * F.col("_ml") - b * F.col("_mx")).alias("intercept"), F.when(p.isNotNull(), F.sqrt(F.greatest(rest, F.lit(0.0)))).alias("sigma"))


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """key, score (0 to 1, higher is odder) by an isolation forest applied to all rows in batches. Each tree grows on a sample of its own, drawn from all rows: those with the smallest hashes of
    (tree, row); trees * sample rows come to the driver."""
    kind = df.schema[key].dataType.simpleString()
    total = df.count()
    # a row is sent for a tree with about four times the chance it needs, so each tree has its sample; rows beyond it are dropped by their hash
    near = min(1.0, 4 * sample / max(1, total))
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), F.pmod(F.xxhash64(F.lit(seed), t, F.col(key), *columns), F.lit(1 << 30)).alias("h"))), lambda d: d["h"] < int(near * (1 << 30)))
    sent = df.select(*columns, F.explode(draws).alias("_d")).select("_d.t", "_d.h", *columns)
    order = Window.partitionBy("t").orderBy("h", *columns)
    rows = sent.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= sample).drop("_i").orderBy("t", "h").toPandas()
    samples = {t: g[columns].to_numpy(float) for t, g in rows.groupby("t")}
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        if depth == 0 or len(x) < 2 or (x.max(0) == x.min(0)).all():
            return len(x)
        c = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
        t = rng.uniform(x[:, c].min(), x[:, c].max())
        return int(c), float(t), grow(x[x[:, c] < t], depth - 1), grow(x[x[:, c] >= t], depth - 1)

    def mean_path(n):
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    size = min(sample, total)
    forest = [grow(samples[t], int(np.ceil(np.log2(max(2, size))))) for t in sorted(samples)]

    def depth(node, x, at, out, d):
        if isinstance(node, int):
            out[at] += d + mean_path(node)
            return
        c, t, a, b = node
        low = x[at, c] < t
        depth(a, x, at[low], out, d + 1)
        depth(b, x, at[~low], out, d + 1)

    def run(batches):
        for pdf in batches:
            x, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for tree in forest:
                depth(tree, x, np.arange(len(x)), total, 0)
            yield pd.DataFrame({key: pdf[key], "score": 2 ** (-total / max(1, trees) / max(mean_path(size), 1e-9))})

    return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, score double")


def clusters(df: DataFrame, columns: list[str], k: int, kind: str = "kmeans", seed: int = 1):
    """Fitted pipeline of imputation, scaling and k-means, a Gaussian mixture or bisecting k-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    make = {"kmeans": KMeans, "mixture": GaussianMixture, "bisecting": BisectingKMeans}[kind]
    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), make(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster")]).fit(df)


def classifier(df: DataFrame, columns: list[str], label: str, kind: str = "logistic", regularization: float = 0.1):
    """Fitted pipeline of imputation, scaling and a classifier with balanced weights: logistic, forest, boosted or tree."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    weighted = df.withColumn("_weight", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    make = {"logistic": lambda **a: LogisticRegression(regParam=regularization, **a), "forest": lambda **a: RandomForestClassifier(seed=1, **a), "boosted": lambda **a: GBTClassifier(seed=1, **a), "tree": lambda **a: DecisionTreeClassifier(maxDepth=4, seed=1, **a)}[kind]
    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), make(featuresCol="scaled", labelCol=label, weightCol="_weight")]).fit(weighted)


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with a fold that rows of one group share, from a hash of the group."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(folds)).cast("int"))
