"""Passages, facts, slivers and claims: brute force and fixed expectations."""

import random

import pytest
from pyspark.sql import functions as F

from lumenark.functions import maths as M
from lumenark.functions import text as T
from lumenark.operators import claims as C
from lumenark.operators import passages as P


def greedy(rows):
    """Plain one-pass merge of [(a, b, id, text)] in order."""
    out, buf, n = [], [], 0
    for a, b, _, t in sorted(rows):
        if len(t) >= 180:
            if buf:
                out.append(buf)
            out.append([(a, b, t)])
            buf, n = [], 0
            continue
        if buf and (a - buf[-1][1] > 14 or n + len(t) > 900):
            out.append(buf)
            buf, n = [], 0
        buf.append((a, b, t))
        n += len(t) + 1
        if n >= 320:
            out.append(buf)
            buf, n = [], 0
    if buf:
        out.append(buf)
    return sorted((x[0][0], max(b for _, b, _ in x), " ".join(t for _, _, t in x)) for x in out)


@pytest.mark.parametrize("shape", ["mixed", "constant", "sparse"])
def test_passages_match_one_pass_over_a_hot_key(spark, shape):
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(600):
        t += {"mixed": rng.choice([1.0, 2.0, 30.0]), "constant": 1.0, "sparse": 9.0}[shape]
        n = 9 if shape == "constant" else rng.choice([5, 20, 60, 150, 200 if shape == "mixed" else 30])
        rows.append((round(t, 3), round(t + 0.9, 3), i, ("w%d " % i + "x" * n)[:max(n, 5)].strip()))
    df = spark.createDataFrame([("hot", "speech", i, a, b, s) for a, b, i, s in rows], "entity_key string, source string, row_id bigint, t0 double, t1 double, text string")
    got = sorted((r["t0"], r["t1"], r["text"]) for r in P.build_passages(df, block_seconds=20.0).collect())
    assert got == greedy(rows)


def test_untimed_text_is_kept_once_and_only_where_not_placed(spark):
    rows = [("k", "s", 1, 0.0, 1.0, "hello"), ("k", "s", 2, None, None, "hello"), ("k", "s", 3, None, None, "caption"), ("k", "s", 4, None, None, "caption")]
    df = spark.createDataFrame(rows, "entity_key string, source string, row_id bigint, t0 double, t1 double, text string")
    got = sorted((r["text"], r["t0"]) for r in P.build_passages(df).collect())
    assert got == [("caption", None), ("hello", 0.0)]


FACT = "entity_key string, source string, text string, t0 double, t1 double, confidence double"


def facts(spark, spans, block=5.0):
    df = spark.createDataFrame([("k", "v", t, a, b, c) for t, a, b, c in spans], FACT)
    return {r["text"]: r for r in P.build_facts(df, block_seconds=block).collect()}


def test_fact_runs(spark):
    r = facts(spark, [("orange", 0.0, 2.0, 0.12), ("orange", 2.0, 4.0, 0.59), ("orange", 30.0, 32.0, None)])["orange"]
    assert (r["t0"], r["t1"], r["span"], r["conf"]) == (0.0, 4.0, 6.0, 0.59)
    r = facts(spark, [("dot", t, None, None) for t in (3.5, 4.0, 4.6, 7.2)])["dot"]
    assert r["span"] == 0.0 and r["t1"] - r["t0"] >= 2.5
    r = facts(spark, [("whole", None, None, 0.4)])["whole"]
    assert (r["t0"], r["span"], r["conf"]) == (None, 0.0, 0.4)


SLIVER = "entity_key string, source string, kind string, text string, t0 double, t1 double, confidence double"


def test_slivers(spark):
    red = [("red", 0.0, 5.9), ("red", 5.95, 6.0), ("red", 6.05, 17.7)]
    flick = [("orange", 5.9, 5.95), ("orange", 6.0, 6.0), ("orange", 6.0, 6.05)]
    df = spark.createDataFrame([("k", "v", "colour", t, a, b, None) for t, a, b in red + flick], SLIVER)
    assert {r["text"] for r in P.refuse_slivers(df, block_seconds=3.0).collect()} == {"red"}
    labels = [("person", 0.0, 10.0), ("bed", 0.0, 10.0), ("dog", 2.0, 2.3), ("phone", 5.0, 5.2)]
    df = spark.createDataFrame([("k", "v", "object", t, a, b, None) for t, a, b in labels], SLIVER)
    assert {r["text"] for r in P.refuse_slivers(df, block_seconds=3.0).collect()} == {"person", "bed", "dog", "phone"}


def written(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, value string, confidence double")
    got = {r["i"]: r["w"] for r in df.select("i", C.written(F.col("kind"), F.col("value"), F.col("confidence")).alias("w")).collect()}
    return [None if got[i] is None else (got[i]["form"], got[i]["text"]) for i in range(len(rows))]


def test_claim_text(spark):
    got = written(spark, ("object", "bicycle", 0.0003), ("tempo", "103 BPM", None), ("language", "hi", 0.9), ("shot_scale", "medium", 0.9),
                  ("hook_words", "3 things", None), ("likes", "12", None), ("brand_new", "one two", None), ("brand_new", "a b c d e", None),
                  ("palette", "{}", None), ("silence", "none", None))
    assert got == [None, None, ("fact", "spoken in Hindi"), ("fact", "medium shot"), ("prose", "3 things"), None,
                   ("fact", "brand new one two"), ("prose", "a b c d e"), None, None]


def test_absence(spark):
    texts = {"N/A": True, "no faces found": True, "none": True, "no salient objects or text detected": True, "no": False, "nothing": False, "no way that's real": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["a"] for r in df.select("t", T.is_absence(F.col("t")).alias("a")).collect()} == texts


def test_labels(spark):
    cells = {"3× cow, person": ["cow", "person"], "The video starts with a cow": None, '[{"label": "Dog", "conf": 0.7}, "bed"]': ["dog", "bed"], "[1, 2]": None}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["l"] for r in df.select("c", F.transform(C.labels(F.col("c")), lambda x: x["label"]).alias("l")).collect()}
    assert got == cells


def test_certainty_and_prominence(spark):
    df = spark.createDataFrame([(None,), (1.0,), (0.0,)], "c double")
    assert [r[0] for r in df.select(M.certainty(F.col("c"))).collect()] == [1.0, 1.0, 0.5]
    assert spark.range(1).select(M.prominence(F.lit(10.0), F.lit(20.0))).first()[0] == pytest.approx(1.3)


def test_opaque_handles_go(spark):
    df = spark.createDataFrame([("BAACAgUAAyEGAAMBCGCQ-wADEmp3oIU2fPqhaznC2nu0, liked posts",)], "t string")
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "liked posts"
