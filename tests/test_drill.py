"""Cells, metadata blocks and listings on small tables with odd rows."""

from pyspark.sql import functions as F

from lumenark.operators import drill as D


def test_a_cell(spark):
    tables = {"a": spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("", 4), (None, 5)], "video_key string, n int"),
              "b": spark.createDataFrame([("x",), ("x",), ("x",)], "VideoKey string"), "c": spark.createDataFrame([("x",), ("z",)], "`video-key` string"),
              "d": spark.createDataFrame([("x",)], "other string"), "t": spark.createDataFrame([("x", "second"), ("x", "first")], "k string, name string")}
    got = {r["value"]: r for r in D.cell_provenance(tables, "a", "video_key", ("t", "k")).collect()}
    assert set(got) == {"x", "y"}
    assert got["x"]["same_value"] == 2 and got["x"]["row"] is None and got["x"]["refers_to"] == '{"k":"x","name":"first"}'
    assert [tuple(e) for e in got["x"]["elsewhere"]] == [("b", "VideoKey", 3), ("c", "video-key", 1)]
    assert got["y"]["row"] == '{"video_key":"y","n":3}' and got["y"]["refers_to"] is None and got["y"]["elsewhere"] == []
    alone = D.cell_provenance({"a": tables["a"]}, "a", "video_key").collect()
    assert len(alone) == 2 and all(r["elsewhere"] == [] for r in alone)


def test_metadata_blocks(spark):
    cases = [('{"capture": {"a": 1}}', '{"a":1}', False), ('{"capture": [1], "identity": {"stub": true}}', "{}", True), ('{"capture": {"a": 1}', "{}", False), (None, "{}", False),
             ("", "{}", False), ("[]", "{}", False), ('{"identity": {"stub": 0.0}}', "{}", False), ('{"identity": {"stub": "yes"}}', "{}", True),
             ('{"identity": null}', "{}", False), ('{"identity": {"stub": []}}', "{}", False), ('{"identity": {"stub": ""}}', "{}", False), ('{"identity": {"stub": 2}}', "{}", True)]
    df = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(cases)], "i int, meta string")
    got = df.select("i", D.capture_block(F.col("meta")).alias("b"), D.is_stub(F.col("meta")).alias("s")).orderBy("i").collect()
    assert [(r["b"], r["s"]) for r in got] == [(b, s) for _, b, s in cases]


def test_bundles_newest_first(spark):
    b = spark.createDataFrame([(1, 5, '{"claim": 2}'), (2, None, None), (3, 9, "{"), (4, 5, "{}")], "seq int, manifest_id int, counts string")
    assert [(r["seq"], r["counts"]) for r in D.bundle_listing(b).collect()] == [(3, {}), (4, {}), (1, {"claim": 2}), (2, {})]


def test_clips_and_cards(spark):
    parts = spark.createDataFrame([("a", "clip"), ("a", "clip"), ("b", "video"), (None, "clip")], "entity_key string, kind string")
    ents = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "entity_key string")
    assert {r["entity_key"]: r["has_clips"] for r in D.with_clips(ents, parts).collect()} == {"a": True, "b": False, "c": False, None: False}
    card = D.card_view(spark.createDataFrame([("a", "", None)], "entity_key string, title string, duration double")).first()
    assert (card["title"], card["duration"], card["poster"], card["has_speech"]) == ("a", 0.0, "", False)
