"""The stored coarse-to-fine index, against scoring every frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.operators import vectors as V
from lumenark.operators.frameindex import FrameIndex

VEC = "entity_key string, space string, frame_idx bigint, v array<float>"


def walks(seed=3, n=1500):
    """Slow walks on the sphere, a third of all frames in one entity, with odd rows among them."""
    rng = np.random.default_rng(seed)
    rows = []
    for key, many in (("hot", n), ("b", n), ("c", n // 2), ("d", 3)):
        x = rng.normal(size=16)
        for i in range(many):
            x = x + rng.normal(size=16) * 0.03
            rows.append((key, "clip", i * 7, (x * rng.uniform(0.5, 2)).astype(np.float32).tolist()))
    rows += [("b", "clip", 3, None), ("b", "clip", 4, [float("nan")] * 16), ("b", "clip", 5, []), ("d", "clip", 900, [0.0] * 16),
             ("e", "other", 1, [1.0] * 16), ("e", "clip", 1, [1.0, 2.0]), rows[10], rows[10]]
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = walks()
    index = FrameIndex(spark, str(tmp_path_factory.mktemp("frames")))
    df = spark.createDataFrame(rows, VEC)
    index.append(df.where("entity_key <> 'c'"), 0, budget_bytes=16 * 4 * 80)
    index.append(df.where("entity_key = 'c'"), 1, budget_bytes=16 * 4 * 30)
    return index, rows


def whole(rows, q, limit, exclude=None):
    out = []
    for k, space, i, v in rows:
        if space != "clip" or v is None or len(v) != len(q) or k == exclude or not np.all(np.isfinite(v)):
            continue
        v = np.asarray(v, dtype=np.float64)
        out.append((k, i, float(v @ q) / ((np.linalg.norm(v) or 1.0) * np.linalg.norm(q))))
    return sorted(out, key=lambda r: (-round(r[2], 9), r[0], r[1]))[:limit]


@pytest.mark.parametrize("which, limit, exclude", [(40, 20, None), (40, 20, "hot"), (2000, 5, None), (3100, 200, None), (None, 7, None), (40, 9999, None)])
def test_search_equals_scoring_every_frame(spark, built, which, limit, exclude):
    index, rows = built
    q = np.asarray(rows[which][3] if which is not None else np.linspace(-1, 1, 16), dtype=np.float64)
    query = spark.createDataFrame([(q.tolist(),)], "q array<double>")
    got = [(r["entity_key"], r["frame_idx"], r["score"]) for r in index.search(query, "clip", limit, exclude).collect()]
    want = whole(rows, q, limit, exclude)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_bounds_hold_and_most_windows_stay_closed(spark, built):
    index, rows = built
    query = spark.createDataFrame([([float(x) for x in rows[40][3]],)], "q array<double>")
    windows = index.bounds(query, "clip")
    best = V.scored(index.frames_of(windows), query).groupBy("batch", "entity_key", "window", "bucket").agg(F.max("score").alias("best"))
    assert windows.join(best, ["batch", "entity_key", "window", "bucket"]).where("best > bound").count() == 0
    assert index.survivors(query, "clip", 10).count() * 4 < windows.count()


def test_budget(spark, built):
    got = {(r["space"], r["dim"]): r for r in built[0].inventory().collect()}
    # Both batches, and a window that is not full for each of the four entities.
    assert got["clip", 16]["windows"] <= 80 + 30 + 4 and got["clip", 16]["frames"] == 1500 + 1500 + 750 + 3 + 1 + 2
    assert V.stride_for(3006, 16, 16) == 1


def test_empty_query_and_unknown_space(spark, built):
    none = spark.createDataFrame([], "q array<double>")
    one = spark.createDataFrame([([1.0] * 16,)], "q array<double>")
    assert built[0].search(none, "clip").count() == 0 and built[0].search(one, "nowhere").count() == 0


def test_a_batch_again_and_an_empty_batch(spark, tmp_path):
    index = FrameIndex(spark, str(tmp_path))
    df = spark.createDataFrame(walks(5, 60), VEC)
    for batch, rows in ((0, df), (0, df), (1, df.limit(0))):
        index.append(rows, batch)
    assert index.inventory().where("space = 'clip' and dim = 16").first()["frames"] == 60 + 60 + 30 + 3 + 1 + 2
