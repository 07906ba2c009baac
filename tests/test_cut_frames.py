"""Frames beside cuts: sparse series, exact touches and the nearest frame, against brute force."""

import numpy as np

from lumenark.functions import quantiles
from lumenark.operators import sequences as S


def expected(frames, bounds):
    out = set()
    for key in {k for k, _ in frames}:
        ft = sorted({t for k, t in frames if k == key})
        gaps = sorted(b - a for a, b in zip(ft, ft[1:]))
        tol = gaps[len(gaps) // 2] if gaps else 0.05
        for b in {b for k, b in bounds if k == key and b > 0}:
            near = [t for t in ft if abs(t - b) <= tol]
            out |= {(key, t) for t in near or [min(ft, key=lambda t: (abs(t - b), t))]}
    return out


def test_a_sparse_series_forms_no_cells(spark):
    rng = np.random.default_rng(3)
    frames = [("slow", float(t) * 1e12) for t in range(9)] + [("fast", round(float(t), 3)) for t in rng.uniform(0, 900, 300)]
    frames += [("one", 7.0), ("bare", 1.0), ("bare", 2.0), (None, 3.0)]
    bounds = [("slow", 2.5e12), ("slow", 6e12), ("slow", -4.0), ("one", 7.04), ("one", 9000.0), ("none", 5.0), (None, 3.0)]
    bounds += [("fast", round(float(b), 3)) for b in rng.uniform(-50, 40000, 60)] + [("fast", frames[20][1])]
    got = S.across_cuts(spark.createDataFrame(frames, "k string, t double"), spark.createDataFrame(bounds, "k string, b double"), ["k"]).collect()
    want = expected([f for f in frames if f[0]], [b for b in bounds if b[0]])
    assert len(got) == len(want) and {(r["k"], r["t"]) for r in got} == want


def test_small_groups_carry_no_splitters(spark):
    freq = spark.range(6000).selectExpr("id % 1500 AS k", "CAST(id AS DOUBLE) AS x", "1L AS n")
    placed = quantiles.ranges_of(freq, ["k"])
    assert [r["__range"] for r in placed.select("__range").distinct().collect()] == [0] and placed.count() == 6000
