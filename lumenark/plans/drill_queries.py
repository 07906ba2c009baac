"""Drill-down queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drill as D
from .map_queries import POINTS_SQL, levels
from .registry import query
from .tables import MOMENTS_SQL, load, moments


@query("cell_provenance", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS same_value, min(o_orderkey) AS k FROM orders GROUP BY 1),
e AS (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1)
SELECT o.value, same_value, CASE WHEN same_value = 1 THEN CAST(k AS VARCHAR) END AS own, c_name AS refers_to,
       coalesce(n, 0) AS events, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS customers
FROM o LEFT JOIN e USING (value) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = o.value""")
def cell_provenance(spark, sf):
    tables = {"orders": load(spark, sf, "orders").withColumnRenamed("o_custkey", "cust_key"), "events": load(spark, sf, "events").withColumnRenamed("user_id", "CustKey"),
              "customer": load(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey"), "nation": load(spark, sf, "nation")}
    cells = D.cell_provenance(tables, "orders", "cust_key", ("customer", "custkey"))
    rows_in = lambda t: F.coalesce(F.get(F.transform(F.filter("elsewhere", lambda e: e["table"] == t), lambda e: e["rows"]), F.lit(0)), F.lit(0)).alias(t if t == "events" else t + "s")
    return cells.select("value", "same_value", F.get_json_object("row", "$.o_orderkey").alias("own"), F.get_json_object("refers_to", "$.c_name").alias("refers_to"), rows_in("events"), rows_in("customer"))


@query("capture_blocks", """
SELECT event_id, CASE WHEN event_type = 'click' THEN '{}' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS block, event_type = 'view' AS stub FROM events""")
def capture_blocks(spark, sf):
    """events' properties as the capture block of metadata; a click's metadata is cut off, a view's says it is a stub."""
    e = load(spark, sf, "events")
    whole = F.concat(F.lit('{"capture": '), "props", F.lit(', "identity": {"stub": '), F.when(F.col("event_type") == "view", "true").otherwise("0"), F.lit("}}"))
    meta = F.when(F.col("event_type") == "click", F.rtrim(F.substring(whole, 1, 14))).otherwise(whole)
    block = D.capture_block(meta)
    return e.select("event_id", F.coalesce(F.get_json_object(block, "$.k"), block).alias("block"), D.is_stub(meta).alias("stub"))


@query("bundle_listing", """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS manifest_id,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE 0 END AS n_rows FROM orders""")
def bundle_listing(spark, sf):
    o = load(spark, sf, "orders")
    counts = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.col("o_custkey").alias("claim"), F.lit(1).alias("shot")))).when(F.col("o_orderstatus") == "O", "{broken")
    b = o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("manifest_id"), counts.alias("counts"))
    return D.bundle_listing(b).select("seq", "manifest_id", F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_rows"))


@query("entities_with_clips", """
SELECT o_orderkey AS entity_key, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_clips FROM orders""")
def entities_with_clips(spark, sf):
    parts = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.when(F.col("l_returnflag") == "R", "clip").otherwise("video").alias("kind"))
    return D.with_clips(load(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_key")), parts)


@query("card_view", """
SELECT c_custkey AS entity_key, CASE WHEN c_nationkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS title,
       CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_mktsegment END AS creator, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS duration,
       CAST(c_nationkey AS BIGINT) AS moment_count, c_nationkey % 2 = 1 AS has_speech, '' AS poster FROM customer""")
def card_view(spark, sf):
    c = load(spark, sf, "customer")
    odd = F.col("c_nationkey") % 2 == 1
    cards = c.select(F.col("c_custkey").alias("entity_key"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).otherwise("").alias("title"),
                     F.when(odd, F.col("c_mktsegment")).alias("creator"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("duration"),
                     F.col("c_nationkey").alias("moment_count"), F.when(odd, True).alias("has_speech"))
    return D.card_view(cards).select("entity_key", "title", "creator", "duration", "moment_count", "has_speech", "poster")


@query("map_points", f"""
WITH {POINTS_SQL}, {MOMENTS_SQL},
st AS (SELECT level, cluster, count(*) AS cluster_size, count(DISTINCT entity_key) AS cluster_entities FROM levels GROUP BY ALL)
SELECT level, ref, levels.entity_key, cluster_size, cluster_entities, c_name, text AS said
FROM levels JOIN st USING (level, cluster) LEFT JOIN customer ON c_custkey = levels.entity_key
LEFT JOIN moments ON level = 'moment' AND CAST(id AS VARCHAR) = ref""")
def map_points(spark, sf):
    cards = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), "c_name")
    got = D.map_points(levels(spark, sf), cards, moments(spark, sf))
    return got.select("level", "ref", "entity_key", "cluster_size", "cluster_entities", F.col("card.c_name").alias("c_name"), F.col("moment.text").alias("said"))
