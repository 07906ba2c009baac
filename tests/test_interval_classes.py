"""Points in intervals of any length, against comparing all of them."""

import random

from lumenark.operators import merge


def test_long_and_short_intervals(spark):
    rng = random.Random(3)
    year = 365 * 86400.0
    intervals = [(k, i, a, a + d) for k in "ab" for i, (a, d) in enumerate(
        [(0.0, 30 * year), (-5 * year, 3.0), (100.0, 0.0), (200.0, -1.0), *[(rng.uniform(-100, 1e6), rng.choice([0.001, 1.0, 60.0, 61.0, 3600.0, 1e6])) for _ in range(80)]])]
    points = [(rng.choice("abc"), n, rng.uniform(-200, 2e6)) for n in range(200)] + [("a", 900, 0.0), ("a", 901, 30 * year), ("b", 902, 100.0), ("a", 903, None)]
    iv, pt = spark.createDataFrame(intervals, "k string, idx int, t0 double, t1 double"), spark.createDataFrame(points, "k string, n int, t double")
    got = sorted((r["n"], r["idx"]) for r in merge.intervals_containing(pt, iv, "k", "t").collect())
    assert got == sorted((n, i) for k, n, t in points for kk, i, a, b in intervals if k == kk and t is not None and a <= t < b)
    assert merge.interval_cells(iv, "t0", "t1", 60.0).groupBy("k", "idx").count().agg({"count": "max"}).first()[0] <= 2


def test_no_intervals(spark):
    iv, pt = spark.createDataFrame([], "k string, idx int, t0 double, t1 double"), spark.createDataFrame([("a", 1.0)], "k string, t double")
    assert merge.intervals_containing(pt, iv, "k", "t").count() == 0
