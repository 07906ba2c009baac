"""Tables of one short text only: a batch may hold fewer words than a shingle or a run is wide."""

import numpy as np
import pyarrow as pa
import pytest

from lumenark.llm import chosenpath, quality
from lumenark.llm.shingles import shingle_sets

SHORT = ["one", "one two", "one two three", "one two three four"]


@pytest.mark.parametrize("text", SHORT)
def test_lone_text_in_a_batch(text):
    n = len(text.split())
    assert [len(s) for s in shingle_sets(pa.array([None, text, ""]))] == [0, 1, 0]
    assert shingle_sets(pa.array([text]))[0].tolist() == shingle_sets(pa.array([text, "a b c d e f"]))[0].tolist()
    assert quality.measures(pa.array([text]))[0, -1] == n
    alone, beside = quality.measures(pa.array([text]))[0], quality.measures(pa.array([text, "a b c d e f"]))[0]
    assert np.array_equal(alone, beside, equal_nan=True)


@pytest.mark.parametrize("text", SHORT)
def test_lone_text_in_a_table(spark, text):
    docs = spark.createDataFrame([(7, text), (8, None)], "doc_id bigint, text string").coalesce(1)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in chosenpath.classes(docs).collect()) == [(7, 7, 0), (8, 8, 0)]
    rows = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    assert rows[8]["score"] == 0.0 and not rows[8]["keep"] and 0.0 <= rows[7]["score"] <= 1.0
