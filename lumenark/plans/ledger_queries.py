"""Ledger and streaming queries.  Orders are capture items, events their journal."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..session import shared_dir
from ..streaming import pipelines as St
from .registry import query
from .tables import EVENTS_TIMED_SQL, events_timed, load


def items(spark, sf):
    o = load(spark, sf, "orders")
    s = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("key"), F.when(s == "F", "uploaded").when(s == "O", "queued").otherwise("failed").alias("state"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"),
                    F.lit(0).alias("revivals"), (F.col("o_custkey") * 10.0).alias("next_try"), F.col("o_totalprice").alias("done_at"), F.col("o_custkey").cast("double").alias("last_try"),
                    F.col("o_orderkey").alias("position"), F.concat(F.lit("u"), F.col("o_orderkey")).alias("url"), F.col("o_orderkey").alias("msg_id"), F.lit("mp4").alias("ext"),
                    F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("assets_msg_id"), (F.col("o_custkey") % 4).alias("assets_clips"), F.lit(0.0).alias("added_at"),
                    F.when(F.col("o_custkey") % 3 == 0, "old").otherwise("new").alias("channel"))


def membership(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("collection"))


@query("claim_order", """
SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'F' AND o_custkey * 10 <= 5000 AND o_orderpriority NOT LIKE '5%'""")
def claim_order(spark, sf):
    return L.claim_order(items(spark, sf), membership(spark, sf), 5000.0, ["5-LOW"]).select("key")


@query("ledger_states", "SELECT CASE o_orderstatus WHEN 'F' THEN 'uploaded' WHEN 'O' THEN 'queued' ELSE 'failed' END AS state, count(*) AS n FROM orders GROUP BY 1")
def ledger_states(spark, sf):
    return L.state_counts(items(spark, sf))


@query("ledger_requeue", "SELECT CASE o_orderstatus WHEN 'F' THEN 'uploaded' ELSE 'queued' END AS state, CAST(sum(CASE o_orderstatus WHEN 'P' THEN 0 ELSE o_orderkey % 6 END) AS BIGINT) AS attempts FROM orders GROUP BY 1")
def ledger_requeue(spark, sf):
    return L.requeue(items(spark, sf)).groupBy("state").agg(F.sum("attempts").alias("attempts"))


@query("ledger_rebind", "SELECT CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'uploaded' WHEN o_orderstatus IN ('F', 'O') THEN 'queued' ELSE 'failed' END AS state, count(*) AS n, count(CASE WHEN o_custkey % 3 <> 0 THEN 1 END) AS kept FROM orders GROUP BY 1")
def ledger_rebind(spark, sf):
    return L.rebind(items(spark, sf), "new").groupBy("state").agg(F.count("*").alias("n"), F.count("msg_id").alias("kept"))


@query("collection_progress", "SELECT o_orderpriority AS collection, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def collection_progress(spark, sf):
    return L.collection_progress(items(spark, sf), membership(spark, sf))


@query("asset_queue", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 2 = 1 OR o_custkey = 0) AND o_orderkey > 0")
def asset_queue(spark, sf):
    return L.asset_queue(items(spark, sf)).select("key")


@query("asset_counts", "SELECT count(*) AS videos, count(*) FILTER (o_custkey % 2 = 0 AND o_custkey > 0) AS with_assets, CAST(sum(o_custkey % 4) AS BIGINT) AS clips FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 0")
def asset_counts(spark, sf):
    return L.asset_counts(items(spark, sf))


@query("ledger_add_many", """
SELECT count(*) FILTER (o_orderkey IS NULL) AS added, count(*) FILTER (o_orderstatus <> 'F') AS known, count(*) FILTER (o_orderstatus = 'F') AS captured, (SELECT count(*) FROM part WHERE p_size > 45) AS bad
FROM (SELECT DISTINCT p_partkey * 9 AS k FROM part WHERE p_size <= 45) LEFT JOIN orders ON o_orderkey = k""")
def ledger_add_many(spark, sf):
    p = load(spark, sf, "part")
    inc = p.select(F.when(F.col("p_size") <= 45, F.col("p_partkey") * 9).alias("key"), F.col("p_type").alias("collection"), F.col("p_partkey").alias("position"))
    return L.add_many(items(spark, sf), membership(spark, sf), inc)[2]


@query("ledger_adopt", """
WITH f AS (SELECT l_orderkey AS k, max(l_partkey) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT count(*) FILTER (o_orderstatus <> 'F' OR o_orderkey IS NULL) AS adopted, count(*) FILTER (o_orderstatus = 'F' AND m <> o_orderkey) AS corrected FROM f LEFT JOIN orders ON o_orderkey = k""")
def ledger_adopt(spark, sf):
    f = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("msg_id"))
    return L.adopt(items(spark, sf), f)[1]


@query("ledger_mark", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' THEN 'unavailable' WHEN o_orderstatus = 'F' THEN 'uploaded' ELSE 'failed' END AS state, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE CAST(o_custkey AS DOUBLE) END AS last_try FROM orders")
def ledger_mark(spark, sf):
    i = items(spark, sf)
    u = i.filter("state = 'queued'").select("key", F.lit(1.0).alias("last_try"))
    return L.mark(i, u, "unavailable").select("key", "state", "last_try")


@query("ledger_windows", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AS done, (SELECT CAST(min(o_custkey * 10) AS DOUBLE) FROM orders WHERE o_orderstatus <> 'F') AS next_due")
def ledger_windows(spark, sf):
    i = items(spark, sf)
    return L.throughput(i, 203600.0).select(F.col("n").alias("done")).withColumn("next_due", L.next_due(i).select("next_due").scalar())


@query("transfer_verify", """
WITH v AS (SELECT p_partkey, CASE WHEN l IS NULL THEN 'missing' WHEN p_size > 25 THEN CASE WHEN l = p_size THEN 'verified' ELSE 'failed' END WHEN l >= 16384 THEN 'verified' ELSE 'failed' END AS verdict
  FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) AS l FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_partkey = p_partkey)
SELECT verdict, count(*) AS n, CAST(CASE verdict WHEN 'failed' THEN 1240.0 END AS DOUBLE) AS next_try FROM v GROUP BY 1""")
def transfer_verify(spark, sf):
    t = load(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 25, F.col("p_size").cast("bigint")).alias("expected"), F.lit(2).alias("attempts"))
    f = load(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").cast("bigint").alias("got"))
    v = L.verify_transfers(t, f, 1000.0)
    return v.groupBy("verdict").agg(F.count("*").alias("n"), F.max("next_try").alias("next_try"))


@query("folder_reconcile", """
SELECT CASE WHEN o_custkey IS NULL THEN 'missing' ELSE 'active' END AS status, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c
FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey GROUP BY 1""")
def folder_reconcile(spark, sf):
    k = load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("path"), F.lit(1).cast("bigint").alias("size"))
    s = load(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key"), F.concat(F.lit("/m/"), F.col("o_custkey")).alias("path"), F.lit(2).cast("bigint").alias("size"))
    return L.reconcile_folder(k, s).groupBy("status").agg(F.count("*").alias("n"))


@query("job_enqueue", """
WITH j AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS c, 1 AS j FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS c, 1 AS w FROM orders WHERE o_orderstatus = 'O')
SELECT CASE WHEN j IS NULL THEN 'pending' WHEN w = 1 AND c LIKE '1%' THEN 'pending' WHEN c LIKE '1%' THEN 'failed' ELSE 'done' END AS state, count(*) AS n FROM j FULL OUTER JOIN w USING (k, c) GROUP BY 1""")
def job_enqueue(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("entity_key"), F.col("o_orderpriority").alias("component"), "o_orderstatus")
    j = o.filter("o_orderstatus = 'F'").select("entity_key", "component", F.when(F.col("component").startswith("1"), "failed").otherwise("done").alias("state")).distinct()
    return L.enqueue_jobs(j, o.filter("o_orderstatus = 'O'")).groupBy("state").agg(F.count("*").alias("n"))


def journal(spark, sf):
    e = events_timed(spark, sf)
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").otherwise("note")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("t").alias("at"))


@query("item_replay")
def item_replay(spark, sf):
    return L.replay(journal(spark, sf))


#: Rows of a staged file, and bytes that a task reads of such files.
FILE_ROWS, SPLIT_BYTES = 500_000, 8 << 20


def _stage(spark, df, name, parts=3):
    """Write rows as a few files for a file stream to pick up."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.repartition(parts).write.parquet(path + "/in")
    return path


@query("stream_ingest_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest_dedupe(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    path = _stage(spark, e.unionByName(e), "ingest")
    src = St.parquet_stream(spark, path + "/in", e)
    St.ingest_once(src, path + "/out", ["event_id"], path + "/cp")
    return spark.read.parquet(path + "/out").select("event_id", "user_id", "event_type")


@query("stream_throughput", """
SELECT epoch(time_bucket(INTERVAL '1 hour', ts)) // 1 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_throughput(spark, sf):
    from pyspark.sql import types as TT  # noqa: F401
    from .tables import epoch_seconds
    e = load(spark, sf, "events").select(F.timestamp_micros((epoch_seconds(F.col("ts")) * 1_000_000).cast("bigint")).alias("at"), "event_type")
    path = _stage(spark, e, "rate", 1)
    out = path + "/out"
    win = St.throughput(St.parquet_stream(spark, path + "/in", e), "at", by="event_type")
    St.run_available(win, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}"), path + "/cp", mode="complete")
    last = spark.read.parquet(out)
    newest = last.agg(F.max("b")).scalar()
    return last.filter(F.col("b") == newest).select(F.unix_seconds("w.start").cast("double").alias("hour"), "event_type", "n")


@query("stream_sessions", f"""
WITH {EVENTS_TIMED_SQL}, l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM ev),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, g, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL""")
def stream_sessions(spark, sf):
    from .tables import epoch_seconds
    e = load(spark, sf, "events").select(F.timestamp_millis((F.round(epoch_seconds(F.col("ts")), 3) * 1000).cast("bigint")).alias("at"), "user_id")
    # One batch of files of a bounded size, so that no task holds more than a few of them.
    files = max(1, -(-e.count() // FILE_ROWS))
    path = _stage(spark, e, "sess", files)
    out = path + "/out"
    ses = St.sessions(St.parquet_stream(spark, path + "/in", e, files), "at", "user_id", "12 hours")
    St.run_available(ses, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}"), path + "/cp", mode="complete", split_bytes=SPLIT_BYTES)
    last = spark.read.parquet(out)
    newest = last.agg(F.max("b")).scalar()
    return last.filter(F.col("b") == newest).groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("stream_state_machine")
def stream_state_machine(spark, sf):
    """Equal to ``item_replay`` once every event has arrived; the tests compare the two."""
    j = journal(spark, sf)
    path = _stage(spark, j, "items", 1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", St.ROCKSDB)
    out = path + "/out"
    states = St.item_states(St.parquet_stream(spark, path + "/in", j))
    St.run_available(states, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}"), path + "/cp", mode="update")
    rows = spark.read.parquet(out)
    rest = ["state", "attempts", "revivals", "next_try", "done_at"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.col("b")).alias("r")).select("key", "r.*")


@query("stream_routing", """
SELECT CASE WHEN doc_id % 4 = 0 THEN 'shard' WHEN doc_id % 4 = 1 THEN 'asset' WHEN doc_id % 4 = 2 THEN 'bundle' ELSE 'no_document' END AS route, count(*) AS n FROM documents GROUP BY 1""")
def stream_routing(spark, sf):
    m = F.col("doc_id") % 4
    d = load(spark, sf, "documents").select(F.when(m == 0, F.concat(F.lit("s"), "doc_id", F.lit(".jsonl.gz"))).when(m == 1, F.lit("manifest_1.json")).when(m == 2, F.lit("lake.zst")).alias("name"))
    return d.groupBy(St.classify(F.col("name")).alias("route")).agg(F.count("*").alias("n"))
