"""Near pairs, nearest points and linear frames against brute force."""

import datetime as dt
import math
import random
import time

from pyspark.sql import functions as F

from tidemark.operators import gaps as G
from tidemark.operators import graph as R
from tidemark.operators import profiles as P
from tidemark.operators import shape as S


def metres(a, b):
    (y1, x1), (y2, x2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def test_radius_pairs_at_half_degrees_and_far_north(spark):
    r = random.Random(1)
    pos = [(49.4999, 8.2), (49.5001, 8.2), (-33.5003, 151.2), (-33.4998, 151.2)]
    pos += [(base + r.uniform(-0.004, 0.004), 10 + r.uniform(-0.004, 0.004) / math.cos(math.radians(base))) for base in (0.0, 0.5, 49.5, 60.5, -70.5, 85.5) for _ in range(40)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pos)], "k int, lat double, lon double")
    got = {(x["a"], x["b"]) for x in R.radius_pairs(d, "k", "lat", "lon", 100).collect()}
    want = {(i, j) for i in range(len(pos)) for j in range(i + 1, len(pos)) if metres(pos[i], pos[j]) <= 100}
    assert got == want and (0, 1) in want and (2, 3) in want and len(want) > 60


def test_nearest_point_however_far(spark):
    r = random.Random(2)
    grid = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)] + [(90, 5.0, 5.0), (91, 5.0, 5.0)]
    pts = [(i, r.uniform(-50, 150), r.uniform(-50, 150)) for i in range(50)] + [(60, 5.0, 5.0), (61, 9000.0, 3.0), (62, None, 1.0)]
    g = spark.createDataFrame(grid, "vertex int, x double, y double")
    d = spark.createDataFrame(pts, "k int, x double, y double")
    got = {x["k"]: x["vertex"] for x in P.nearest_point(d, g, "k", "x", "y", 1.0).collect()}
    assert got == {k: None if x is None else min((math.hypot(x - a, y - b), v) for v, a, b in grid)[1] for k, x, y in pts}
    assert P.nearest_point(d, g.limit(0), "k", "x", "y", 1.0, most_rounds=3).where("vertex is not null").isEmpty()


def test_fills_grow_with_the_rows_and_not_with_their_square(spark):
    def took(n):
        d = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2000-01-01").cast("timestamp_ntz")).alias("ts"), F.when(F.col("id") % 5 < 2, F.col("id").cast("double")).alias("v"))
        began = time.time()
        assert S.interpolate_short(d, "k", "ts", "v", 6).where("v is null").count() <= 3
        return time.time() - began

    took(2000)
    assert took(80_000) < 25  # a frame that is worked out anew for every row takes minutes


def test_counter_goes_on_where_a_meter_was_changed(spark):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    counter = [None, 10.0, None, None, 40.0, None, 2.0, None]
    rate = [10.0, 10.0, 5.0, 15.0, 10.0, None, 10.0, 10.0]
    d = spark.createDataFrame([(1, at(i), c, r) for i, (c, r) in enumerate(zip(counter, rate))], "k int, ts timestamp_ntz, c double, r double")
    got = [x["c"] for x in G.counter_fill(d, "k", "ts", "c", "r").orderBy("ts").collect()]
    # trapezoids: 10, 7.5, 10, 12.5, 0, 0, 10; 30 between the readings of 10 and 40 is spread over 7.5 + 10 + 12.5
    assert got == [0.0, 10.0, 17.5, 27.5, 40.0, 40.0, 2.0, 12.0]
