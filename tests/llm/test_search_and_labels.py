"""Permutation index, language network and quality model: exactness where defined, recall and held-out accuracy elsewhere."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.llm import langid, pivots, quality

SF = "/root/testdata/sf0.01"


def brute(ids, x, query, top):
    score = (x * x[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)).tolist() if i != query][:top]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_index_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24))
    x[100:400] = x[100]  # a crowded spot: one vector, three hundred times
    rows = [(i, v.tolist(), "b", 0) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, b string, rank int")
    got = pivots.nearest(vectors, F.col("id") % 20 == 0, top=20, block=500, query_block=16).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1200, 20)) and all(len(f) == 20 for f in found.values())
    hits = sum(len({i for i, _ in f} & {i for i, _ in brute(np.arange(1200), x, q, 20)}) for q, f in found.items())
    assert hits / (20 * len(found)) >= 0.9
    assert [i for i, _ in found[120]] == [i for i in range(100, 121) if i != 120]
    for q, f in found.items():
        assert f == sorted(f, key=lambda p: (-p[1], p[0]))
        assert all(math.isclose(s, float((x[q] * x[i]).sum()), rel_tol=1e-12, abs_tol=1e-12) for i, s in f)


def test_index_leaves_out_what_is_no_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (7, [1.0]), (8, []), (9, [-1.0, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.nearest(vectors, F.lit(True), top=20).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 9, -1.0), (1, 1, 0, 0.5), (1, 2, 9, -0.375), (9, 1, 1, -0.375), (9, 2, 0, -1.0)]
    assert pivots.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_inverted_files_give_the_footrule():
    rng = np.random.default_rng(5)
    perm = np.stack([rng.permutation(12)[:6] for _ in range(40)]).astype(np.int16)
    files = pivots.InvertedFiles(perm, 12)
    rank = np.full((40, 12), 6)
    np.put_along_axis(rank, perm.astype(int), np.arange(6)[None, :], axis=1)
    for q in range(40):
        footrule = np.abs(rank - rank[q]).sum(axis=1)
        assert (footrule == 6 * 7 - 2 * files.nearness(perm[q])).all()


def test_gradients_follow_differences():
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork(["a", "b", "c"], filters=3, dim=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] = rng.normal(size=net.p["out"].shape)
    found, target = rng.integers(1, 256, (5, langid.SIZE)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        net._tables = None
        return -np.log(net._softmax(net.pooled(langid._pairs(found))[0])[np.arange(5), target]).mean()

    net._tables = None
    for name, g in net.gradients(found, target).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, h = net.p[name][at], 1e-5
        net.p[name][at] = kept + h
        up = loss()
        net.p[name][at] = kept - h
        down = loss()
        net.p[name][at] = kept
        assert math.isclose((up - down) / (2 * h), g[at], rel_tol=2e-2, abs_tol=1e-5), name


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_language_edges(spark):
    rows = [(i, w * 40, lang, 0) for i in range(60) for w, lang in (("the and of ", "en"), ("der und die ", "de"))]
    rows += [(1000, None, "en", 0), (1001, "", "de", 0), (1002, "123 !!", "en", 0), (None, "the and of", None, 0), (1003, "the and of " * 50_000, None, 0), (1004, "x", None, 0), (1004, "x", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "en" == got[None]["lang_pred"] and got[None]["held_out"] is True
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["keep"] for r in good) / len(good) > 0.97
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.9


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.85])
    agree = rng.random((20_000, 8)) < right
    vote = np.where(agree, truth[:, None], ~truth[:, None]) * 2
    vote[rng.random(vote.shape) < 0.3] = quality.SILENT
    counts = np.bincount(vote @ 3 ** np.arange(8), minlength=3**8)
    model = quality.LabelModel(counts)
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.03
    assert ((model.posterior(vote) > 0.5) == truth).mean() > 0.97


@pytest.mark.parametrize("n", [0, 6])
def test_quality_edges(spark, n):
    rows = [(1, None, "a"), (2, "", "a"), (3, "!!! ###", "a"), (None, "plain words " * 30, "a"), (4, "x" * 100_000, "a"), (4, "x" * 100_000, "a")][:n]
    got = quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, keep string")).collect()
    assert len(got) == n
    assert all(r["score"] == 0.0 and not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
