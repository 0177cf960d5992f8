"""Rules that the driver's tables do not reach: NULLs, ties, empty tables, edges of guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.functions import text as T
from tidemark.operators import events as E
from tidemark.operators import graph as G
from tidemark.operators import monitor as M
from tidemark.operators import shape as S
from tidemark.operators import stats as Z

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def series(spark, values, key=1):
    return spark.createDataFrame([(key, day(i), v) for i, v in enumerate(values)], "entity int, day date, z double")


def test_cusum_alarms_once_until_it_has_come_back(spark):
    got = M.cusum(series(spark, [0.0] * 5 + [2.0] * 10), "entity", "day", "z").collect()
    assert [(r["day"], r["direction"], r["start"]) for r in got] == [(day(8), 1, day(5))]
    got = M.cusum(series(spark, [2.0] * 6 + [-2.0] * 12 + [2.0] * 6), "entity", "day", "z").orderBy("day").collect()
    assert [r["direction"] for r in got] == [1, -1, 1]


def test_cusum_skips_null_and_takes_empty(spark):
    assert M.cusum(series(spark, [None, None]), "entity", "day", "z").count() == 0
    assert M.cusum(series(spark, []), "entity", "day", "z").count() == 0


def test_stream_equals_batch(spark):
    from tidemark.streaming.monitor import run_cusum

    z = series(spark, [0.0] * 5 + [2.0] * 10 + [-3.0] * 12).union(series(spark, [1.5] * 20, key=2))
    a = sorted(map(tuple, run_cusum(spark, z).collect()))
    assert a == sorted(map(tuple, M.cusum(z, "entity", "day", "z").collect())) and a


def test_quiet_alarms(spark):
    w = spark.createDataFrame([(1, day(i), i in (4, 5, 9, 19)) for i in range(22)], "entity int, day date, warning boolean")
    got = M.quiet_alarms(w, "entity", "day", "warning").where("alarm").orderBy("day").collect()
    assert [r["day"] for r in got] == [day(4), day(19)]


def test_asof_prefers_the_earlier_of_two_equally_near(spark):
    left = spark.createDataFrame([(1, at(24))], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, at(23), 5.0), (1, at(25), 7.0)], "k int, ts timestamp_ntz, v double")
    assert S.asof_nearest(left, right, "k", "ts", "v", 2.0).first()["v"] == 5.0
    far = spark.createDataFrame([(1, at(21), 5.0)], "k int, ts timestamp_ntz, v double")
    assert S.asof_nearest(left, far, "k", "ts", "v", 2.0).first()["v"] is None


def test_long_gaps_stay_whole(spark):
    v = [1.0, None, None, 4.0, None, None, None, 8.0, None]
    g = spark.createDataFrame([(1, at(i), x) for i, x in enumerate(v)], "k int, ts timestamp_ntz, v double")
    got = [r["v"] for r in S.interpolate_short(g, "k", "ts", "v", 2).orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]


def test_counter_restarts_at_each_reading(spark):
    rows = [(1, at(0), None, 3.0), (1, at(1), 10.0, 3.0), (1, at(2), None, 3.0), (1, at(3), None, -1.0), (1, at(9), None, 3.0), (1, at(10), 50.0, 3.0), (1, at(11), None, 4.0)]
    d = spark.createDataFrame(rows, "k int, ts timestamp_ntz, c double, r double")
    got = [r["c"] for r in S.integrate_counter(d, "k", "ts", "c", "r").orderBy("ts").collect()]
    assert got == [None, 10.0, 13.0, 13.0, 13.0, 50.0, 54.0]


def test_newest_export_wins(spark):
    a = spark.createDataFrame([(1, at(0), 1.0), (1, at(1), 1.0)], "k int, ts timestamp_ntz, v double")
    b = spark.createDataFrame([(1, at(1), 2.0), (1, at(2), 2.0)], "k int, ts timestamp_ntz, v double")
    assert [r["v"] for r in S.merge_generations([a, b], ["k", "ts"]).orderBy("ts").collect()] == [1.0, 2.0, 2.0]


def test_robust_z(spark):
    d = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 5)] + [(2, 7.0)] * 3, "g int, x double")
    got = {(r["g"], r["x"]): r["z"] for r in Z.robust_z(d, "x", ["g"]).collect()}
    assert got[1, 5.0] == pytest.approx(2 / 1.4826) and got[2, 7.0] is None


def test_ols_recovers_a_line_and_widens_by_cluster(spark):
    d = spark.range(200).select((F.col("id") % 10).alias("c"), (F.col("id") / 10).alias("x"), (3 + 2 * (F.col("id") / 10) + ((F.col("id") * 7919) % 13 - 6) / 10).alias("y"))
    plain, robust = Z.ols(d, ["x"], "y"), Z.ols(d, ["x"], "y", cluster="c")
    assert plain["beta"] == pytest.approx([3, 2], abs=0.2) and plain["dof"] == 198 and robust["dof"] == 9
    with pytest.raises(ValueError):
        Z.ols(d.limit(2), ["x"], "y")


def test_nearest_peers_match_brute_force(spark):
    xs = [1.0, 1.5, 1.5, 4.0, 9.0, 9.1, 20.0]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, k int, x double")
    got = {(r["k"], r["rank"]): r["peer"] for r in Z.nearest_peers(d, "k", "x", ["g"], 3).collect()}
    for i, x in enumerate(xs):
        want = sorted((abs(x - y), j) for j, y in enumerate(xs) if j != i)[:3]
        assert [got[i, r + 1] for r in range(3)] == [j for _, j in want]


def test_hit_test_counts_controls_without_own_cases(spark):
    obs = spark.createDataFrame([(e, day(i)) for e in range(1, 9) for i in range(40)], "entity int, day date")
    cases = spark.createDataFrame([(1, day(10)), (8, day(12))], "entity int, day date")
    alarms = spark.createDataFrame([(1, day(11)), (2, day(12)), (8, day(39))], "entity int, day date")
    r = {x["case_key"]: x for x in E.hit_test(cases, alarms, obs, before=2, after=5, least_days=3).collect()}
    assert (r[1]["hit"], r[1]["controls"], r[1]["control_hits"]) == (True, 6, 1) and not r[8]["hit"]


def test_components_and_hops(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefj"], "n string")
    e = spark.createDataFrame([("a", "b"), ("b", "j"), ("j", "c"), ("c", "d"), ("d", "f")], "x string, y string")
    assert {r["n"]: r["component"] for r in G.components(n, e, "n", "x", "y").collect()} == {**dict.fromkeys("abcdfj", "a"), "e": "e"}
    assert {r["v"] for r in G.hops(e, "x", "y", 2).where("u = 'b'").collect()} == {"a", "j", "c"}


def test_text_rules(spark):
    d = spark.createDataFrame([(1, "Stellmotor passt"), (2, "Stellmotor  DEFEKT"), (3, None), (4, "Straße Müll 1987 und 3000")], "i int, t string")
    hit = [r["h"] for r in d.select("i", T.mentions("t", "stellmot", veto_after=("passt",)).alias("h")).orderBy("i").collect()]
    assert hit == [False, True, False, False]
    assert d.where("i = 4").select(T.normalize("t")).first()[0] == "strasse muell 1987 und 3000"
    assert d.where("i = 4").select(T.first_year("t", 1900, 2030)).first()[0] == 1987
    assert spark.range(1).select(T.coordinates(F.lit("11.5 / 48.1")).alias("c")).first()["c"] == (48.1, 11.5)


def test_calendar_labels(spark):
    d = spark.createDataFrame([(dt.date(2023, 11, 30),), (dt.date(2023, 12, 1),), (dt.date(2024, 2, 29),), (dt.date(2099, 12, 31),), (None,)], "d date")
    assert [r[0] for r in d.select(X.winter_label("d")).collect()] == ["", "23/24", "23/24", "99/00", ""]


def test_normal_quantile(spark):
    got = spark.createDataFrame([(0.975,), (0.5,), (0.001,), (0.0,)], "p double").select(X.normal_quantile("p")).collect()
    assert got[0][0] == pytest.approx(1.959963985) and got[1][0] == pytest.approx(0, abs=1e-9) and got[2][0] == pytest.approx(-3.090232306) and got[3][0] is None
