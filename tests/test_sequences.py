"""Blocked sequence operators against brute force, with one hot key and tiny blocks."""

import random

import pytest

from lumenark.operators import sequences as S


def spans(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        k = "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"
        a = round(rng.uniform(0, 300), 1)
        rows.append((k, a, round(a + rng.choice([0.0, 0.5, 2.0, 15.0]), 1)))
    return rows


def merged(rows, gap=0.0):
    out = []
    for a, b in sorted(rows):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def by_key(rows):
    d = {}
    for k, *rest in rows:
        d.setdefault(k, []).append(tuple(rest))
    return d


@pytest.mark.parametrize("block", [None, 7.0, 50.0])
def test_union_and_islands(spark, block):
    rows = spans()
    df = spark.createDataFrame(rows, "k string, t0 double, t1 double")
    got = {r["k"]: round(r["covered"], 6) for r in S.union_seconds(df, ["k"], "t0", "t1", block_seconds=block).collect()}
    want = {k: round(sum(b - a for a, b in merged(v)), 6) for k, v in by_key(rows).items()}
    assert got == want
    isl = by_key([(r["k"], r["t0"], r["t1"]) for r in S.islands(df, ["k"], "t0", "t1", 1.0, block).collect()])
    assert {k: sorted(v) for k, v in isl.items()} == {k: merged(v, 1.0) for k, v in by_key(rows).items()}


def test_union_of_three(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 10.0, 11.0)], "k string, t0 double, t1 double")
    assert S.union_seconds(df, ["k"], "t0", "t1").first()["covered"] == 4.0


def test_gaps_cover_head_and_tail(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0), ("a", 10.0, 12.0)], "k string, t0 double, t1 double")
    dur = spark.createDataFrame([("a", 20.0), ("empty", 5.0)], "k string, duration double")
    got = sorted((r["k"], r["t0"], r["t1"]) for r in S.gaps(df, ["k"], "t0", "t1", dur, block_seconds=4.0).collect())
    assert got == [("a", 0.0, 2.0), ("a", 3.0, 10.0), ("a", 12.0, 20.0), ("empty", 0.0, 5.0)]


@pytest.mark.parametrize("rows_per_block", [None, 3, 1000])
def test_frame_runs(spark, rows_per_block):
    vals = ["x", "x", "", "x", "y", "y", "y", None, "y", "x"]
    df = spark.createDataFrame([("k", i, float(i), v) for i, v in enumerate(vals)], "k string, idx bigint, t double, value string")
    got = sorted((r["lo"], r["hi"], r["value"], r["ordinal"]) for r in S.frame_runs(df, ["k"], block_rows=rows_per_block).collect())
    assert got == [(0, 1, "x", 0), (3, 3, "x", 1), (4, 6, "y", 2), (8, 8, "y", 3), (9, 9, "x", 4)]


def test_as_of_across_blocks(spark):
    marks = [("k", 1.0, 10), ("k", 2.0, 20), ("k", 500.0, 30)]
    pts = [("k", 0.5), ("k", 2.0), ("k", 499.0), ("k", 900.0)]
    m = spark.createDataFrame(marks, "k string, mt double, v int")
    p = spark.createDataFrame(pts, "k string, t double")
    got = sorted((r["t"], r["f"]) for r in S.as_of(p, m, ["k"], "t", "mt", "v", "f", block_seconds=5.0).collect())
    assert got == [(0.5, 10), (2.0, 20), (499.0, 20), (900.0, 30)]


def test_freezes_start_at_the_frame_before(spark):
    d = [9.0, 5.0, 0.0, 0.01, 0.0, 5.0, 0.0, 0.0]
    df = spark.createDataFrame([("k", float(i), v) for i, v in enumerate(d)], "k string, t double, mafd double")
    got = [(r["t0"], r["t1"]) for r in S.freeze_spans(df, ["k"], block_seconds=2.0).collect()]
    assert got == [(1.0, 4.0)]


def test_merge_cuts(spark):
    cuts = spark.createDataFrame([("k", t) for t in (0.1, 1.0, 1.1, 1.2, 1.3, 5.0, 9.9)], "k string, cut double")
    dur = spark.createDataFrame([("k", 10.0), ("none", 3.0)], "k string, duration double")
    got = by_key([(r["k"], r["edge"]) for r in S.merge_cuts(cuts, dur, ["k"], min_shot=0.25).collect()])
    assert sorted(got["k"]) == [(0.0,), (1.0,), (1.3,), (5.0,), (10.0,)]
    assert sorted(got["none"]) == [(0.0,), (3.0,)]
