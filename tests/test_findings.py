"""What larger and odder tables have shown: one case each."""

import datetime as dt
import hashlib
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_near import metres
from tidemark.operators import assess as A
from tidemark.operators import graph as G
from tidemark.operators import monitor as M
from tidemark.operators import resample as R
from tidemark.operators import stats as S
from tidemark.operators import winter as W


def test_degree_hours_of_a_winter_without_measurements(spark):
    rows = [(dt.date(2024, 1, 5), None), (dt.date(2024, 2, 5), None), (dt.date(2025, 1, 5), 5.0), (dt.date(2025, 1, 6), None), (dt.date(2025, 1, 7), 20.0), (dt.date(2025, 6, 1), 1.0)]
    got = W.degree_hours_by_winter(spark.createDataFrame(rows, "day date, t double"), "day", "t").collect()
    assert {tuple(r) for r in got} == {("23/24", 0.0, 0), ("24/25", 10.0, 2)}


def test_rolling_correlation_of_constants(spark):
    start = dt.date(2024, 1, 1)
    rows = [(e, start + dt.timedelta(days=i), 0.1 if e == 1 else float(i), 0.3 if e == 2 else float(i % 5)) for e in range(3) for i in range(20)]
    got = M.rolling_corr(spark.createDataFrame(rows, "k int, day date, x double, y double"), "k", "day", "x", "y").orderBy("k", "day").collect()
    assert [r["corr"] is None for r in got] == [k > 0 or i < 9 for k in range(3) for i in range(20)]
    n, xs, ys = 14, range(6, 20), [i % 5 for i in range(6, 20)]
    mx, my = sum(xs) / n, sum(ys) / n
    want = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / (sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)) ** 0.5
    assert got[19]["corr"] == pytest.approx(want)


def test_network_days_join_nothing_by_entity_and_replicate(spark):
    r, start, within, n = random.Random(4), dt.date(2024, 3, 1), 2, 40
    alarms = {(k, x) for k in range(25) for x in range(30) if r.random() < (0.1 if k else 1.0)} | {(99, 17), (25, 0), (25, 29)}
    d = spark.createDataFrame([(k, start + dt.timedelta(days=x)) for k, x in alarms] + [(3, None), (26, None)], "k int, day date")
    out = R.network_days(d, "k", "day", within, n)
    assert not [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "_k#" in x]  # such a side is `replicates` times as large as Spark takes it to be
    near = lambda days: {y for x in days for y in range(x - within, x + within + 1) if 0 <= y < 30}
    days = {k: [x for j, x in alarms if j == k] for k, _ in alarms}
    shift = lambda i, k: int(hashlib.md5(f"1:{i}:{k}".encode()).hexdigest()[:8], 16) % 30
    top = sorted(max(Counter(y for k, v in days.items() for y in near([(x + shift(i, k)) % 30 for x in v])).values()) for i in range(n))
    at = 0.95 * (n - 1)
    limit = top[int(at)] + (at - int(at)) * (top[int(at) + 1] - top[int(at)])
    seen = Counter(y for v in days.values() for y in near(v))
    got = out.orderBy("day").collect()
    assert [(x["day"], x["entities"], x["network_day"]) for x in got] == [(start + dt.timedelta(days=y), seen[y], seen[y] > limit) for y in range(30)]
    assert got[0]["threshold"] == pytest.approx(limit)


def crowd(spark):
    """Keys at few places, their pairs within 150 m and their flags."""
    r = random.Random(7)
    spots = [(49.45 + i * 0.001, 11.0 + j * 0.001) for i in range(3) for j in range(4)] + [(49.45, 11.9)]
    pos = [(k, *spots[min(r.randrange(16), 12) if k else 12], r.random() < 0.4) for k in range(90)]
    d = spark.createDataFrame([*pos, (500, None, 11.0, True)], "k int, lat double, lon double, flag boolean")
    flags = {k: f for k, _, _, f in pos} | {500: True}
    return d, {(a[0], b[0]): metres(a[1:3], b[1:3]) for a in pos for b in pos if a[0] < b[0] and metres(a[1:3], b[1:3]) <= 150}, flags


def test_radius_pairs_of_keys_that_share_places(spark):
    d, want, _ = crowd(spark)
    for block in (1, 4, 256):
        got = G.radius_pairs(d, "k", "lat", "lon", 150, digits=3, block=block)
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]  # pairs are not made distinct
        got = got.collect()
        assert len(got) == len(want) and {(x["a"], x["b"]): x["metres"] for x in got} == pytest.approx(want, abs=0.0006)


def test_flagged_neighbours_are_counted_by_place(spark):
    d, want, flags = crowd(spark)
    members, links = G.near_places(d, "k", "lat", "lon", 150)
    got = G.joint_flags(links, d, "k", "flag", members).first()
    n, m = len(flags), sum(flags.values())
    assert tuple(got)[:2] == (len(want), sum(flags[a] and flags[b] for a, b in want)) and got["expected"] == pytest.approx(len(want) * m * (m - 1) / (n * (n - 1)))
    none = d.limit(0)
    assert tuple(G.joint_flags(links, none, "k", "flag", members.limit(0)).first()) == (0, 0, None)


def test_neighbour_table_by_place(spark):
    d, want, flags = crowd(spark)
    members, links = G.near_places(d, "k", "lat", "lon", 150)
    near = {k: sorted({a + b - k for a, b in want if k in (a, b)}) for k in flags}
    rows = {(k, len(v), sum(flags[x] for x in v), ",".join(str(x) for x in v if flags[x])) for k, v in near.items() if v}
    assert {tuple(x) for x in G.neighbour_table(links, d, "k", "flag", members).collect()} == rows and len(rows) < len(flags)


def test_neighbour_permutation_by_place(spark):
    d, want, _ = crowd(spark)
    members, links = G.near_places(d, "k", "lat", "lon", 150)
    pairs = spark.createDataFrame(list(want), "a int, b int")
    assert R.neighbour_permutation(links, d, "k", "flag", 19, members=members).first() == R.neighbour_permutation(pairs, d, "k", "flag", 19).first()


def test_season_factor_by_exact_medians_without_holding_a_group(spark):
    rng = random.Random(5)
    season = lambda i: None if i % 11 == 0 else "abc"[i % 3]
    rows = [(season(i), rng.choice([rng.lognormvariate(0, 2), float(rng.randrange(4)), -3.5]), 2.0) for i in range(30_001)] + [("d", 7.0, 1.0), ("d", 8.0, 1.0), ("a", None, 1.0)]
    d = spark.createDataFrame(rows, "s string, x double, one double").repartition(7)
    groups = {}
    for s, x, _ in rows:
        if x is not None:
            groups.setdefault(s, []).append(x)
    per, whole = S.large_medians(d, "s", "x")
    want = {k: (len(v), statistics.median(v)) for k, v in groups.items()}
    assert {r["s"]: (r["n"], r["median"]) for r in per.collect()} == want
    assert tuple(whole.first()) == (30_003, statistics.median([x for v in groups.values() for x in v]))
    assert [x.count() for x in S.large_medians(d.limit(0), "s", "x")] == [0, 0]
    got = A.season_factor(d, F.col("s"), "x", "one", 30)
    assert " percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    every = statistics.median([abs(x) / y for _, x, y in rows if x is not None])
    factor = {k: statistics.median([abs(x) / y for s, x, y in rows if s == k and x is not None]) / every if n >= 30 else 1.0 for k, (n, _) in want.items()}
    assert {r["season"]: (r["n"], r["factor"]) for r in got.collect()} == {k: (want[k][0], pytest.approx(v)) for k, v in factor.items()}
