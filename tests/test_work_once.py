"""Work that was done several times over the input is done once: attribute values, n-grams, state commits."""

import glob

from pyspark.sql import functions as F

from lumenark.operators import graph, graphstore, profile
from lumenark.streaming import pipelines


def test_attribute_rows_are_read_and_cleaned_once(spark, tmp_path):
    rows = [(1, "mood", " 'Calm  Sea' ", "a"), (2, "mood", "calm sea", "b"), (2, "mood", "calm sea", "b"), (None, "mood", "CALM SEA", "b"), (3, "mood", "loud", "a"),
            (1, "mood", "7.5", "a"), (2, "mood", "7.5", "a"), (1, "mood", '["loud"]', "a"), (4, None, "loud", "a"), (4, "mood", None, "a"), (4, "size", "x", "a")]
    spark.createDataFrame(rows, "k long, attr string, v string, chan string").write.parquet(f"{tmp_path}/rows")
    nodes, edges = graph.attribute_edges(spark.read.parquet(f"{tmp_path}/rows"), "k", "attr", "v", "facts", F.lit(9), "chan")
    assert not [f for t in (nodes, edges) for f in t.inputFiles() if str(tmp_path) in f]  # support, nodes and edges read what was written once
    assert [(r["id"], r["meta"]["videos"], r["meta"]["source"]) for r in nodes.collect()] == [("a:facts.mood:calm sea", "3", "meta")]
    assert sorted((r["src"] or "", r["dst"]) for r in edges.collect()) == [("", "a:facts.mood:calm sea"), *((f"v:{k}", "a:facts.mood:calm sea") for k in (1, 2))]


def test_gathered_parts_are_those_of_the_built_graph(spark):
    cards = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two again")], "entity_key long, title string")
    nodes = spark.createDataFrame([("t:x", "tag", "x", "s", None)], "id string, kind string, label string, sub string, meta map<string,string>")
    edges = spark.createDataFrame([("v:1", "t:x", "s", 1.0, "b"), ("v:1", "t:x", "s", 2.0, "a"), ("v:9", "t:x", "s", 1.0, "c")], "src string, dst string, rel string, weight double, ref string")
    n, e = graph.gather(cards, (nodes, edges))
    assert e.count() == 2 and sorted(r["id"] for r in n.collect()) == ["t:x", "v:1", "v:2"]
    built, added = graph.build(cards, (nodes, edges))
    assert [tuple(r) for r in added.collect()] == [("v:1", "t:x", "s", 3.0, "a")]
    assert {r["id"]: r["weight"] for r in built.collect()} == {"t:x": 3.0, "v:1": 3.0, "v:2": 0.0}


def grams(text):
    ws, stop = text.split(), set(profile.GRAM_STOP)
    for n in (1, 2, 3):
        for i in range(len(ws) - n + 1):
            part = ws[i:i + n]
            if not all(w in stop for w in part) and (n > 1 or len(part[0]) >= 3):
                yield " ".join(part)


def test_lift_adds_terms_up_in_one_shuffle(spark):
    texts = [(1, "the red fox and the red hen"), (1, "red fox"), (2, "of the"), (2, "the"), (2, ""), (2, None), (None, "red hen is in"), (2, "a red fox is it")]
    df = spark.createDataFrame(texts, "g int, text string")
    got = sorted((r["g"] or 0, r["term"]) for r in profile.term_rows(df, "g").collect())
    assert got == sorted((g or 0, t) for g, text in texts for t in grams(text or ""))
    rows = profile.lift(profile.term_rows(df, "g"), "g", 1, min_n=1)
    assert "Aggregate [g#" not in rows._jdf.queryExecution().optimizedPlan().toString() and "zip_with" not in rows._jdf.queryExecution().optimizedPlan().toString()
    counted = profile.lift(profile.term_counts(df, "g"), "g", 1, min_n=1)
    assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in counted.collect()]
    assert {r["term"]: (r["n_in"], r["n_out"]) for r in rows.collect()}["red fox"] == (2, 1)


def test_a_commit_of_state_writes_its_changes(spark, tmp_path):
    folder, schema = str(tmp_path), "alias string, entity_key string, kind string, prio int"
    spark.createDataFrame([("tg7", "cust_01", "message", 2), ("tg7", "cust_01", "url", 1)], schema).write.parquet(f"{folder}/in")
    pipelines.learn_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/cp")
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/out").select("alias", "prio", "kind").collect()] == [("tg7", 1, "url")]
    assert glob.glob(f"{folder}/cp/state/**/*.changelog", recursive=True)
    assert spark.conf.get(f"{pipelines.STORE}.rocksdb.trackTotalNumberOfRows", None) is None  # the session's own settings are back


def test_stored_links_are_dealt_from_edges_added_up_before(spark, tmp_path, monkeypatch):
    dealt, write = {}, graphstore.StoredGraph._write
    monkeypatch.setattr(graphstore.StoredGraph, "_write", lambda self, df, table, *a: (dealt.setdefault(table, df), write(self, df, table, *a)))
    edges = spark.createDataFrame([("v:1", "t:x", "s", 1.0, "b"), ("v:1", "t:x", "s", 2.0, "a"), ("v:2", "v:2", "s", 1.0, "c")], "src string, dst string, rel string, weight double, ref string")
    store = graphstore.StoredGraph(spark, f"{tmp_path}/graph")
    store.append(None, edges, 0)
    assert "Aggregate" not in dealt["links"]._jdf.queryExecution().optimizedPlan().toString()  # ranges are drawn by reading the rows twice
    assert [tuple(r) for r in store.edges().collect()] == [("v:1", "t:x", "s", 3.0, "a")]
