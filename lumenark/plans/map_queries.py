"""Map and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maps as Mp
from .registry import query
from .tables import VECTORS_SQL, load, vectors


def points(spark, sf):
    """Vectors placed by their first two dimensions; the label modulo six names a cluster."""
    return vectors(spark, sf).select(
        F.col("frame_idx").alias("ref"), (F.floor(F.col("frame_idx") / 37)).alias("entity_key"),
        F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"),
        (F.col("entity_key") % 6).alias("cluster"))


POINTS_SQL = VECTORS_SQL + """,
pts AS (SELECT frame_idx AS ref, CAST(floor(frame_idx / 37) AS BIGINT) AS entity_key, v[1] AS x, v[2] AS y, entity_key % 6 AS cluster FROM vec),
votes AS (SELECT entity_key, cluster, count(*) AS n FROM pts GROUP BY ALL),
ent AS (SELECT p.entity_key, avg(x) AS x, avg(y) AS y,
               (SELECT arg_max(v.cluster, v.n * 100 - v.cluster) FROM votes v WHERE v.entity_key = p.entity_key) AS cluster
        FROM pts p GROUP BY p.entity_key),
levels AS (SELECT 'moment' AS level, CAST(ref AS VARCHAR) AS ref, entity_key, x, y, cluster FROM pts
           UNION ALL SELECT 'entity', CAST(entity_key AS VARCHAR), entity_key, x, y, cluster FROM ent)"""


def levels(spark, sf):
    return Mp.all_levels(points(spark, sf))


@query("dominant_cluster", f"""
WITH {POINTS_SQL} SELECT entity_key, round(x, 6) AS x, round(y, 6) AS y, cluster FROM ent""")
def dominant_cluster(spark, sf):
    return Mp.entity_level(points(spark, sf)).select("entity_key", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster")


@query("multi_level_rollup", f"""
WITH {POINTS_SQL}
SELECT level, cluster, count(*) AS size, count(DISTINCT entity_key) AS entities, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy
FROM levels GROUP BY level, cluster""")
def multi_level_rollup(spark, sf):
    return Mp.cluster_stats(levels(spark, sf)).select("level", "cluster", "size", "entities",
                                                      F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("map_meta", f"""
WITH {POINTS_SQL}
SELECT cluster, count(*) AS size, (SELECT count(*) FROM levels WHERE level = 'moment') AS points
FROM levels WHERE level = 'moment' GROUP BY cluster""")
def map_meta(spark, sf):
    return Mp.map_meta(levels(spark, sf), "moment")


@query("map_region", f"""
WITH {POINTS_SQL}
SELECT ref, entity_key, round(x, 6) AS x, round(y, 6) AS y, c_name FROM levels LEFT JOIN customer ON c_custkey = entity_key
WHERE level = 'moment' AND x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2""")
def map_region(spark, sf):
    cards = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), "c_name")
    return (Mp.region(levels(spark, sf), "moment", 0.1, 0.2, -0.1, -0.05, cards, limit=None)
            .select("ref", "entity_key", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "c_name"))


@query("cluster_members", f"""
WITH {POINTS_SQL},
c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM levels WHERE level = 'moment' AND cluster = 2)
SELECT ref, round(pow(x - cx, 2) + pow(y - cy, 2), 8) AS d2 FROM levels, c WHERE level = 'moment' AND cluster = 2
ORDER BY round(pow(x - cx, 2) + pow(y - cy, 2), 12), ref LIMIT 30""")
def cluster_members(spark, sf):
    return Mp.cluster_detail(levels(spark, sf), "moment", 2).select("ref", F.round("d2", 8).alias("d2"))


@query("percentile_rescale", f"""
WITH {POINTS_SQL},
q AS (SELECT quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh, quantile_cont(y, 0.01) AS yl, quantile_cont(y, 0.99) AS yh FROM pts)
SELECT ref, round(greatest(-0.04, least(1.04, (x - xl) / (xh - xl))), 6) AS x, round(greatest(-0.04, least(1.04, (y - yl) / (yh - yl))), 6) AS y FROM pts, q""")
def percentile_rescale(spark, sf):
    return Mp.rescale(points(spark, sf)).select("ref", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


KNN_SQL = f"""
WITH {VECTORS_SQL},
fit AS (SELECT frame_idx, v, v[1] AS x, v[2] AS y FROM vec WHERE entity_key < 5),
rest AS (SELECT frame_idx, v FROM vec WHERE entity_key >= 5),
sim AS (SELECT r.frame_idx AS id, f.x, f.y, f.frame_idx AS f,
        list_dot_product(r.v, f.v) / ((sqrt(list_dot_product(r.v, r.v)) + 1e-9) * (sqrt(list_dot_product(f.v, f.v)) + 1e-9)) AS s
        FROM rest r, fit f),
top AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, f) <= 12),
w AS (SELECT id, x, y, pow(greatest(s, 0), 3) AS w FROM top)
SELECT id, round(CASE WHEN sum(w) > 1e-9 THEN sum(x * w) / sum(w) ELSE avg(x) END, 5) AS x,
       round(CASE WHEN sum(w) > 1e-9 THEN sum(y * w) / sum(w) ELSE avg(y) END, 5) AS y FROM w GROUP BY id"""


def _fit_and_rest(spark, sf):
    v = vectors(spark, sf)
    xy = (F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))
    fit = v.filter("entity_key < 5").select(F.col("frame_idx").alias("id"), "v", *xy)
    rest = v.filter("entity_key >= 5").select(F.col("frame_idx").alias("id"), "v")
    return fit, rest


@query("knn_placement", KNN_SQL)
def knn_placement(spark, sf):
    return Mp.place_rest(*_fit_and_rest(spark, sf)).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("knn_placement_blocks", KNN_SQL)
def knn_placement_blocks(spark, sf):
    """The way of a fit too large to broadcast."""
    return Mp.place_blocks(*_fit_and_rest(spark, sf)).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("cluster_terms", """
WITH w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{M}]*')) AS term FROM documents),
p AS (SELECT lang, term, count(*) AS n FROM w WHERE term NOT IN (
  'a','an','the','is','are','was','were','be','been','being','of','in','on','at','to','for','with','by','from','as','and','or','but','if','then','than','that','this','these','those','it','its','he','she','they','them','his','her','their','i','me','my','we','us','our','you','your','show','find','get','search','video','videos','clip','clips','moment','moments','where','when','what','who','which','someone','something','anyone','anything','some','any','all','one','ones') GROUP BY ALL),
o AS (SELECT term, sum(n) AS all_n FROM p GROUP BY term),
s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
t AS (SELECT p.*, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rn FROM p),
x AS (SELECT t.lang, t.term, n / size AS i, greatest(1e-9, (all_n - n) / greatest(1, (SELECT count(*) FROM documents) - size)) AS o, n
      FROM t JOIN o USING (term) JOIN s USING (lang) WHERE rn <= 400 AND n >= 2)
SELECT lang, term, round(i / (i + o) * ln(1 + n), 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(i / (i + o) * ln(1 + n), 9) DESC, term DESC) AS rank
FROM x QUALIFY rank <= 8""")
def cluster_terms(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("lang").alias("cluster"), "text")
    return Mp.cluster_terms(docs).select(F.col("cluster").alias("lang"), "term", F.round("score", 6).alias("score"),
                                         F.col("rank").cast("bigint").alias("rank"))


@query("cluster_labels")
def cluster_labels(spark, sf):
    v = vectors(spark, sf).select(F.col("frame_idx").alias("id"), "v")
    cl = Mp.cosine_clusters(v)
    docs = cl.join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    labels = Mp.cluster_labels(Mp.cluster_terms(docs), cl)
    return labels.select("cluster", "label")


@query("pca_map")
def pca_map(spark, sf):
    v = vectors(spark, sf).select(F.col("frame_idx").alias("id"), "v")
    return Mp.rescale(Mp.pca_xy(v)).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("kmeans_cosine")
def kmeans_cosine(spark, sf):
    v = vectors(spark, sf).select(F.col("frame_idx").alias("id"), "v")
    return Mp.cosine_clusters(v)


@query("map_axes", """
SELECT 'o_orderkey' AS axis, count(*) AS n, CAST(min(o_orderkey) AS DOUBLE) AS lo, CAST(max(o_orderkey) AS DOUBLE) AS hi FROM orders
UNION ALL SELECT 'o_custkey', count(*), min(o_custkey), max(o_custkey) FROM orders
UNION ALL SELECT 'o_totalprice', count(*), min(o_totalprice), max(o_totalprice) FROM orders""")
def map_axes(spark, sf):
    return Mp.axes(load(spark, sf, "orders").withColumn("constant", F.lit(7)))


@query("map_scatter", """
SELECT c_custkey AS entity_key, round(log10(c_acctbal), 6) AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS colour
FROM customer WHERE c_acctbal > 0""")
def map_scatter(spark, sf):
    cards = load(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_key")
    return Mp.scatter(cards, "c_acctbal", "c_nationkey", "c_mktsegment", log_x=True, limit=None).withColumn("x", F.round("x", 6))


@query("packed_points", f"""
WITH {POINTS_SQL} SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(cluster AS INTEGER) AS cluster, ref FROM levels WHERE level = 'moment'""")
def packed_points(spark, sf):
    return Mp.packed_points(levels(spark, sf), "moment")
