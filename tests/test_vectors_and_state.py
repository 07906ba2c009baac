"""Spread, coarse rank, state machine, sources: fixed expectations and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumenark.operators import ledger as L
from lumenark.operators import vectors as V
from lumenark.operators import profile as P
from lumenark.sources import files as S

HITS = "entity_key string, frame_idx bigint, score double"


def frames(spark, rows, **kw):
    return [(r["entity_key"], r["frame_idx"]) for r in V.spread(spark.createDataFrame(rows, HITS), kw.pop("limit", 24), **kw).collect()]


def test_spread_of_one_run(spark):
    rows = [("a", i, 1.0 - i / 1000) for i in range(200)]
    assert [i for _, i in frames(spark, rows)] == [0, 45, 90, 135, 180]


def test_spread_cap_and_no_cap(spark):
    rows = [("a", i * 100, 1.0 - i / 100) for i in range(20)]
    assert len(frames(spark, rows)) == 6
    assert len(frames(spark, rows, per_entity=0)) == 20


@pytest.mark.parametrize("cap", [6, 0])
def test_spread_is_greedy(spark, cap):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, round(rng.random(), 6)) for i in rng.sample(range(3000), 900)]
    taken, want = {}, []
    for k, i, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        acc = taken.setdefault(k, [])
        if (cap and len(acc) >= cap) or any(abs(i - x) < 45 for x in acc):
            continue
        acc.append(i)
        want.append((k, i))
    assert frames(spark, rows, per_entity=cap, limit=1000) == want


def test_every_entity_is_ranked(spark):
    rows = [("loud", i, 0.99 - i / 1e6) for i in range(3000)] + [(f"quiet{j}", i, 0.90 - 0.02 * j - i / 1e6) for j in range(1, 12) for i in range(30)]
    got = [r["entity_key"] for r in V.segmented_max(spark.createDataFrame(rows, HITS)).collect()]
    assert len(got) == 12 and got[:4] == ["loud", "quiet1", "quiet2", "quiet3"]


def test_self_retrieval(spark):
    rng = random.Random(4)
    rows = [("e", "s", i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    vec = spark.createDataFrame(rows, "entity_key string, space string, frame_idx bigint, v array<double>")
    top = V.similar_to_frame(vec, "e", 17, "s", 1, same_entity=True).first()
    assert top["frame_idx"] == 17 and top["score"] > 0.999


def test_stride():
    for frames_n, dim, mb in ((1000, 8, 16), (10_000_000, 1152, 256), (1_048_577, 4, 16)):
        room, s = max(mb * 1048576 // (dim * 4), 1), 1
        while frames_n // s > room:
            s += 1
        assert V.stride_for(frames_n, dim, mb) == s


def test_item_rule_revives_then_parks():
    item = L.START
    for _ in range(L.MAX_ATTEMPTS):
        item = L.step(L.step(item, "claim", 0.0), "fail", 0.0)
    assert item[:4] == ("failed", 0, 1, L.REVIVE_S)
    item = ("fetching", L.MAX_ATTEMPTS, L.MAX_REVIVALS, 0.0, None)
    assert L.step(item, "fail", 0.0)[3] == L.PARK_S
    assert L.step(("uploaded", 1, 0, 0.0, 1.0), "fail", 2.0)[0] == "uploaded"


def test_stream_equals_replay(spark):
    import __spark_entry__ as entry
    q, sf = entry.queries(), "/root/testdata/sf0.001"
    a = {r["key"]: r["state"] for r in q["item_replay"](spark, sf).collect()}
    b = {r["key"]: r["state"] for r in q["stream_state_machine"](spark, sf).collect()}
    assert a == b


def test_torn_shard_keeps_what_came_before(spark, tmp_path):
    import gzip
    head = '{"_": "evidence-shard"}\n'
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(head + '{"t": "claim", "v": 1}\n{"t": "claim", "v": 2}\n{"t": "cl')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"_": "something else"}\n{"t": "claim", "v": 9}\n')
    got = [r["v"] for r in S.shard_table(S.read_shards(spark, str(tmp_path)), "claim", "v int").collect()]
    assert sorted(got) == [1, 2]


def test_copy_field(spark):
    cells = {r"\N": None, r"a\tb": "a\tb", r"a\\n": r"a\n", r"x\\\n": "x\\\n", "plain": "plain", r"\q": "q"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", S.copy_field(F.col("c")).alias("v")).collect()} == cells


def test_sections_find_the_change():
    import numpy as np
    mat = np.zeros((96, 2))
    mat[:40, 0] = 1.0
    mat[40:, 1] = 1.0
    assert P._split_sections(mat) == [(0, 40), (40, 96)]
    assert P._split_sections(np.ones((96, 2))) == [(0, 96)]
