"""The plan's concepts are written before many places read them; a cell is split once however many rows hold it."""

import re

from pyspark.sql import functions as F

from lumenark.operators import graph
from lumenark.plans import graph_queries


def test_the_plans_concepts_are_not_counted_again(spark):
    _, kept, _ = graph_queries.curriculum(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in kept._jdf.queryExecution().optimizedPlan().toString() and kept.count() == 60


def test_cells_are_split_apart_from_their_entities(spark):
    df = spark.createDataFrame([(1, "red, blue"), (2, "red, blue"), (3, "blue | green"), (3, None)], "k long, c string")
    _, edges = graph.tag_edges(df, "k", "c", "t", F.lit(9))
    assert re.search(r"Aggregate \[c(ell)?#\d+\], \[c(ell)?#\d+", edges._jdf.queryExecution().optimizedPlan().toString())
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("v:1", "t:t.c:red"), ("v:2", "t:t.c:red"), *((f"v:{k}", "t:t.c:blue") for k in (1, 2, 3))}
