"""Faults found in round 3: halves, minus zero, texts computed once."""

import pathlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenark.operators import identity, maps, signals
from lumenark.sources import exports, texts


def test_a_half_reads_as_python_and_the_oracle_round_it(spark, tmp_path):
    rows = [(i, "click", v) for i, v in enumerate((5.5, 6.5, 7.49, 8.5, 9.5))]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in entry.queries()["claim_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.execute(entry.oracle_sql()["claim_text"]).fetchall())


@pytest.mark.parametrize("zero", [0.0, -0.0])
def test_minus_zero_reads_as_zero(spark, zero):
    one = lambda row, schema: spark.createDataFrame([row], schema)
    out = signals.loudness(one(("a", zero, zero, 5.0), "entity_key string, lufs double, true_peak double, lra double"), one(("a", 1.0, zero), "entity_key string, t double, m double"),
                           one(("a", 0.0, 1.0), "entity_key string, t0 double, t1 double"), one(("a", 4.0), "entity_key string, duration double"),
                           one(("a", 0, 0.0, 4.0), "entity_key string, idx long, t0 double, t1 double"))
    got = {r["kind"]: (r["value"], str(r["num"])) for r in out.collect()}
    assert got["lufs"] == ("0.0 LUFS integrated", "0.0") and got["true_peak"] == ("0.0 dBTP — clipping", "0.0")
    assert got["loudness_peak"] == ("0.0 LUFS momentary", "0.0") and got["shot_level"] == ("0.0 LUFS", "0.0")


def test_a_caption_is_built_and_searched_for_its_link_once(spark):
    n = F.col("id")
    cap = texts.build_caption(F.concat(F.lit("http://instagram.com/Reels/AB_cde-"), n), n.cast("string"), F.array(F.lit("b"), F.lit("a")), F.lit("me"), n, n, n, F.repeat(F.lit("word "), 400))
    out = texts.parse_captions(spark.range(3).select(cap.alias("text")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Category: ") == 1 and len(re.findall(r"regexp_extract\(text#\d+, [^,]*instagram", plan)) == 1
    row = out.orderBy("views").first()
    assert (row["key"], row["url"], row["kind"], row["collections"], row["uploader"]) == ("AB_cde-0", "https://www.instagram.com/reel/AB_cde-0/", "reel", ["a", "b"], "me")
    assert texts.parse_captions(spark.createDataFrame([(None,), ("no link",)], "text string")).count() == 0


def test_witnesses_are_brought_together_once(spark):
    rows = [("x", "key_one_11", 2, "b"), ("x", "key_one_11", 1, "z"), ("x", "key_one_11", 1, "c"), ("x", "key_two_22", 1, "a"), ("x", "key_two_22", 1, "a"), ("x", "key_six_66", 3, None), ("key_two_22", "key_one_11", 0, "a"), (" ", "key_one_11", 0, "a"), ("y", "nobody_999", 0, "a"), (None, "key_one_11", 0, "a")]
    cand = spark.createDataFrame(rows, "alias string, entity_key string, prio int, kind string")
    keys = spark.createDataFrame([("key_one_11",), ("key_two_22",), ("key_six_66",)], "entity_key string")
    aliases, lost = identity.learn(cand, keys)
    assert [tuple(r) for r in aliases.select("alias", "entity_key", "kind", "prio").collect()] == [("x", "key_one_11", "c", 1)]
    assert {tuple(r) for r in lost.select("alias", "kept", "refused", "kind").collect()} == {("x", "key_one_11", "key_two_22", "a"), ("x", "key_one_11", "key_six_66", None)}
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1


def test_sessions_are_staged_as_files_of_a_bounded_size_in_one_batch(spark, tmp_path, monkeypatch):
    from lumenark.plans import ledger_queries

    monkeypatch.setattr(ledger_queries, "FILE_ROWS", 4)
    rows = [(i, i % 3, f"2024-01-0{1 + i % 4} 0{i % 7}:00:00") for i in range(18)]
    spark.createDataFrame(rows, "event_id long, user_id long, at string").selectExpr("event_id", "user_id", "'c' AS event_type", "0.0D AS value", "'' AS props", "CAST(at AS timestamp_ntz) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stage, run = ledger_queries._stage, ledger_queries.St.run_available
    monkeypatch.setattr(ledger_queries, "_stage", lambda *a: seen.append(stage(*a)) or seen[-1])
    monkeypatch.setattr(ledger_queries.St, "run_available", lambda *a, **k: seen.append(run(*a, **k)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {tuple(r) for r in entry.queries()["stream_sessions"](spark, str(tmp_path)).collect()}
    assert len(list(pathlib.Path(seen[0], "in").glob("*.parquet"))) == 5 and len(seen[1]) == 1 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.execute(entry.oracle_sql()["stream_sessions"]).fetchall())


def test_files_of_an_export_are_read_one_at_a_time(spark):
    page = "<a href='https://instagram.com/reel/Abcdefghijk'>x</a>" + "y" * 20_000
    files = spark.range(1_000, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".html")).alias("path"), F.encode(F.lit(page), "UTF-8").alias("content"))
    empty = spark.createDataFrame([("g.html", None), (None, b"")], "path string, content binary")
    out = exports.unpack(files.unionByName(empty))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1_002 and exports.read_exports(files).links.count() == 1_000



def test_a_strip_meets_a_chunk_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    block, chunk = rng.normal(size=(8_192, 8)), pd.DataFrame({"v": list(rng.normal(size=(512, 8))), "x": rng.normal(size=512), "y": rng.normal(size=512)})
    near = maps.NearestFitted(block, 12)
    tracemalloc.start()
    near.meet(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20  # all pairs of the block with the chunk took over 400 MB
    m = np.vstack(chunk["v"])
    sim = (block / (np.linalg.norm(block, axis=1, keepdims=True) + 1e-9)) @ (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)).T
    best = np.argsort(-sim, axis=1, kind="stable")[:, :12]
    assert np.allclose(near.sim, np.take_along_axis(sim, best, 1)) and np.array_equal(near.xy, chunk[["x", "y"]].to_numpy()[best])
