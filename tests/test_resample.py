"""Resampling against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resample as R


def plain_auc(y, s):
    pos, neg = s[y == 1], s[y != 1]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    a, b = np.round(rng.normal(size=300) + 0.8 * y, 1), np.round(rng.normal(size=300) + 0.3 * y, 1)
    d = spark.createDataFrame([(i, int(t), float(u), float(v)) for i, (t, u, v) in enumerate(zip(y, a, b))], "k int, y int, a double, b double")
    return y, a, b, d.unionByName(spark.createDataFrame([(-1, None, 1.0, 1.0), (-2, 1, None, None)], d.schema))


def test_auc_by_running_sums(scored):
    y, a, _, d = scored
    w = R._counts(d, "y", "a").withColumn("g", F.lit(1))
    for buckets in (2, 8, 64):
        assert R._auc(w, "g", buckets).first()["auc"] == pytest.approx(plain_auc(y, a))


def test_bootstraps_have_the_spread_of_plain_ones(scored):
    y, a, b, d = scored
    rng = np.random.default_rng(0)
    plain, diff = [], []
    for _ in range(400):
        i = rng.integers(0, 300, 300)
        plain.append(plain_auc(y[i], a[i]))
        diff.append(plain[-1] - plain_auc(y[i], b[i]))
    r = R.bootstrap_auc(d, "y", "a", 200).first()
    assert r["replicates"] == 200
    for got, q in ((r["auc_low"], 2.5), (r["auc_median"], 50), (r["auc_high"], 97.5)):
        assert got == pytest.approx(np.percentile(plain, q), abs=0.02)
    r = R.bootstrap_auc_difference(d, "y", "a", "b", "k", 200).first()
    assert r["difference"] == pytest.approx(plain_auc(y, a) - plain_auc(y, b)) and r["share_above"] > 0.9
    assert r["low"] == pytest.approx(np.percentile(diff, 2.5), abs=0.03) and r["high"] == pytest.approx(np.percentile(diff, 97.5), abs=0.03)


def test_permutation_tells_signal_from_chance(scored):
    y, a, _, d = scored
    r = R.permutation_test(d, "y", "a", "k", 99).first()
    assert r["observed"] == pytest.approx(plain_auc(y, a)) and r["p_value"] == pytest.approx(0.01)
    noise = d.withColumn("a", (F.xxhash64("k") % 97).cast("double"))
    assert R.permutation_test(noise, "y", "a", "k", 99).first()["p_value"] > 0.05


def test_network_days_of_nothing(spark):
    none = spark.createDataFrame([], "entity int, day date")
    assert R.network_days(none, "entity", "day", replicates=5).count() == 0
    day = dt.date(2024, 3, 1)
    rows = [(e, day + dt.timedelta(days=40)) for e in range(12)] + [(e, day + dt.timedelta(days=7 * e)) for e in range(12)]
    got = R.network_days(spark.createDataFrame(rows, "entity int, day date"), "entity", "day", 0, 100).where("network_day").collect()
    assert [r["day"] for r in got] == [day + dt.timedelta(days=40)]
