"""Nearness is the inner product: long vectors are found whatever their direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.llm import pivots


@pytest.mark.parametrize("sigma", [0.0, 1.0])
def test_recall_with_varying_lengths(spark, sigma):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x *= np.exp(sigma * rng.normal(size=(3000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = pivots.nearest(vectors, F.col("id") % 20 == 0, top=20).collect()
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:20].tolist()))
    print("recall", sigma, hits / (20 * 150))
    assert hits / (20 * 150) >= 0.9


@pytest.mark.parametrize("dimensions", [256, 768])
def test_recall_with_many_dimensions(spark, dimensions):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = pivots.nearest(vectors, F.col("id") % 20 == 0, top=20).collect()
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:20].tolist()))
    print("recall", dimensions, hits / (20 * 150))
    assert hits / (20 * 150) >= 0.9
