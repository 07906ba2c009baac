"""The stored graph against the same reads over whole tables, deltas, and what its plans open."""

import random

import pytest

from lumenark.operators import graph
from lumenark.operators.graphstore import StoredGraph


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(2)
    edges = [(f"v:{rng.randrange(60)}", f"t:{rng.randrange(12)}", "tag", float(rng.randint(1, 4)), f"r{rng.randrange(99)}") for _ in range(300)]
    edges += [("v:0", "t:hub", "tag", 1.0, "r")] + [(f"v:{i}", "t:hub", "tag", 1.0, "r") for i in range(40)] + [("v:900", "t:far", "tag", 1.0, "r"), ("v:5", "v:5", "tag", 1.0, "r")]
    names = sorted({x for e in edges for x in e[:2]})
    nodes = [(n, "video" if n[0] == "v" else "tag", n.upper(), "", None) for n in names]
    store = StoredGraph(spark, str(tmp_path_factory.mktemp("graph")))
    schema, kinds = "src string, dst string, rel string, weight double, ref string", "id string, kind string, label string, sub string, meta map<string,string>"
    for batch, part in enumerate((edges[:100], edges[100:250], edges[250:])):
        here = {x for e in part for x in e[:2]}
        store.append(spark.createDataFrame([n for n in nodes if n[0] in here], kinds), spark.createDataFrame(part, schema), batch)
    store.append(None, spark.createDataFrame(edges[100:250], schema), 1)  # the batch again
    whole = graph.accumulate_edges(spark.createDataFrame(edges, schema))
    degrees = graph.degree(whole).withColumnRenamed("weight", "w")
    full = spark.createDataFrame(nodes, kinds).join(degrees, "id", "left").selectExpr("id", "kind", "label", "sub", "coalesce(w, 0.0) AS weight", "meta")
    return store, full, whole


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()))


def test_tables_add_up(both):
    store, nodes, edges = both
    cols = ("src", "dst", "rel", "weight", "ref")
    assert rows(store.edges(), *cols) == rows(edges, *cols)
    assert rows(store.nodes(), "id", "kind", "label", "weight") == rows(nodes, "id", "kind", "label", "weight")


def test_reads_equal_those_over_tables(both, spark):
    store, nodes, edges = both
    for node in ("t:hub", "v:3", "nobody"):
        got, want = store.neighbors(node, 5), graph.neighbors(nodes, edges, node, 5)
        assert rows(got[0], "id", "rel", "weight", "kind") == rows(want[0], "id", "rel", "weight", "kind")
        assert rows(got[1], "src", "dst") == rows(want[1], "src", "dst") and rows(got[2]) == rows(want[2])
    got, want = store.overview(4, 2), graph.overview(nodes, edges, 4, 2)
    assert rows(got[0], "id") == rows(want[0], "id") and rows(got[1]) == rows(want[1]) and rows(got[2], "src", "dst", "rel") == rows(want[2], "src", "dst", "rel")
    keys = spark.createDataFrame([(i,) for i in range(7)], "entity_key int")
    got, want = store.from_keys(keys, 5, 2), graph.from_keys(nodes, edges, keys, 5, 2)
    assert rows(got[0]) == rows(want[0]) and rows(got[1], "src", "dst") == rows(want[1], "src", "dst")


def test_paths(both, spark):
    store, _, edges = both
    own = {(r["src"], r["dst"]) for r in edges.collect()}
    for a, b in (("v:1", "v:2"), ("v:3", "t:hub"), ("v:7", "v:7"), ("v:1", "v:900"), ("v:1", "nobody")):
        got, want = store.shortest_path(a, b), graph.shortest_path(edges, a, b)
        assert (got is None) == (want is None)
        if got is not None:
            chain = [r["id"] for r in got.orderBy("pos").collect()]
            assert len(chain) == want.count() and chain[0] == a and chain[-1] == b
            assert all((x, y) in own or (y, x) in own for x, y in zip(chain, chain[1:]))


def test_a_node_opens_its_directory(both):
    store, _, _ = both
    plan = store.links("v:3")._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters: [")[1].split("Push")[0] and "EqualTo(anchor,v:3)" in plan
