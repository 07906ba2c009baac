"""Reflection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import reflect as Rf
from .registry import query
from .tables import load

NAMES = ("customer", "orders", "lineitem", "part", "nation", "events", "documents", "conversations", "labels")


@query("reflect_profile")
def reflect_profile(spark, sf):
    """Roles of every driver table under names the vocabulary knows."""
    ev = load(spark, sf, "events").select(F.col("user_id").alias("video_key"), F.col("event_type").alias("kind"), F.col("props").alias("value"), (F.col("value") / 1000).alias("confidence"))
    conv = load(spark, sf, "conversations").select(F.col("conv_id").alias("video_key"), (F.col("turn") * 10.0).alias("t0"), "role", "text")
    tables = {"claim": ev, "transcripts": conv, **{n: load(spark, sf, n) for n in NAMES}}
    return spark.createDataFrame(Rf.describe(tables), "tbl string, col string, role string")


@query("dedup_key_discovery", """
SELECT 'orders' AS tbl, CASE WHEN (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) THEN 'o_orderkey' END AS key
UNION ALL SELECT 'part', CASE WHEN (SELECT count(*) = count(DISTINCT p_partkey) FROM part) THEN 'p_partkey' END
UNION ALL SELECT 'conversations', CASE WHEN (SELECT count(*) = count(DISTINCT (conv_id, turn)) FROM conversations) THEN 'conv_id,turn' END""")
def dedup_key_discovery(spark, sf):
    rows = [(n, ",".join(Rf.dedup_keys(load(spark, sf, n)))) for n in ("orders", "part", "conversations")]
    return spark.createDataFrame(rows, "tbl string, key string")


@query("type_inference", """
SELECT 'event_id' AS field, 'BIGINT' AS types UNION ALL SELECT 'event_type', 'STRING' UNION ALL SELECT 'user_id', 'BIGINT' UNION ALL SELECT 'props', 'STRING'""")
def type_inference(spark, sf):
    docs = load(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id", "props")).alias("rec"))
    return Rf.infer_types(docs).select("field", F.array_join("types", ",").alias("types"))


@query("list_column_test", """
SELECT 'tags' AS col, true AS is_list UNION ALL SELECT 'text', false""")
def list_column_test(spark, sf):
    p = load(spark, sf, "part").select(F.concat_ws(", ", "p_name", "p_type").alias("tags"))
    a = G.list_column(p, "tags").select(F.lit("tags").alias("col"), "is_list")
    return a.unionByName(G.list_column(load(spark, sf, "conversations"), "text").select(F.lit("text").alias("col"), "is_list"))


@query("collected_sources", """
SELECT 'speech' AS source, 'prose' AS form, sum(length(replace(t, ' ', '')))::BIGINT AS n
FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) WHERE length(t) >= 2 AND NOT regexp_full_match(t, '\\d+')
UNION ALL SELECT 'meta', 'fact', count(*) FROM events WHERE event_type <> 'x'""")
def collected_sources(spark, sf):
    conv = load(spark, sf, "conversations").select(F.col("conv_id").alias("video_key"), (F.col("turn") * 10.0).alias("t0"), "text")
    words = F.concat(F.lit("seen "), F.col("event_type"), F.lit(" v"), (F.col("event_id") % 97).cast("string"))
    ev = load(spark, sf, "events").select(F.col("user_id").alias("video_key"), F.col("event_type").alias("kind"), words.alias("value"))
    prose, facts = Rf.split_sources(Rf.text_sources({"transcripts": conv, "claim": ev}))
    # Of prose the characters, which splitting into passages must keep; of facts the rows.
    a = prose.groupBy("source").agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n")).withColumn("form", F.lit("prose"))
    return a.unionByName(facts.groupBy("source").agg(F.count("*").alias("n")).withColumn("form", F.lit("fact")))


@query("schema_graph", "SELECT 'posts' AS src, 'creators' AS dst, 'creator_id' AS rel UNION ALL SELECT 'posts', 'entity', 'video_id'")
def schema_graph(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("creator_id"), F.col("o_orderpriority").alias("caption"))
    return spark.createDataFrame(Rf.schema_edges({"posts": o, "creators": c}), "src string, dst string, rel string")
