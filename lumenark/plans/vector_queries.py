"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as R
from ..operators import vectors as V
from .registry import query
from .tables import TRACKS_SQL, VECTORS_SQL, frame_index, load, moments, track_index, tracks, vectors

COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _query_vector(spark, sf):
    return vectors(spark, sf).filter("frame_idx = 0").select(F.col("v").alias("q"))


SIM_SQL = VECTORS_SQL + f""",
qv AS (SELECT v AS q FROM vec WHERE frame_idx = 0),
sim AS (SELECT entity_key, frame_idx, {COS.format(a='v', b='q')} AS score FROM vec, qv)"""


@query("dense_topk", f"""
WITH {SIM_SQL}
SELECT frame_idx AS id, round(score, 6) AS sim FROM sim ORDER BY round(score, 9) DESC, frame_idx LIMIT 50""")
def dense_topk(spark, sf):
    hits = V.scored(vectors(spark, sf), _query_vector(spark, sf)).withColumnRenamed("frame_idx", "id")
    return R.top_ranked(hits, 50).select("id", F.round("score", 6).alias("sim"))


@query("segmented_max_rank", f"""
WITH {SIM_SQL}
SELECT entity_key, round(max(score), 6) AS score FROM sim GROUP BY entity_key
ORDER BY round(max(score), 9) DESC, entity_key LIMIT 24""")
def segmented_max_rank(spark, sf):
    hits = V.scored(vectors(spark, sf), _query_vector(spark, sf))
    return V.segmented_max(hits).withColumn("score", F.round("score", 6))


@query("exact_rerank", f"""
WITH {SIM_SQL},
short AS (SELECT entity_key FROM sim GROUP BY entity_key ORDER BY round(max(score), 9) DESC, entity_key LIMIT 3)
SELECT entity_key, frame_idx, round(score, 6) AS score FROM sim WHERE entity_key IN (SELECT entity_key FROM short)
ORDER BY sim.score DESC, entity_key, frame_idx LIMIT 60""")
def exact_rerank(spark, sf):
    v, q = vectors(spark, sf), _query_vector(spark, sf)
    short = V.segmented_max(V.scored(v, q), 3)
    return V.exact_rerank(v, q, short, 60).select("entity_key", "frame_idx", F.round("score", 6).alias("score"))


@query("similar_centroid", f"""
WITH {VECTORS_SQL},
d AS (SELECT v[i] AS x, i FROM vec, range(1, 65) r(i) WHERE entity_key = 0),
c AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(x) AS m FROM d GROUP BY i)),
sim AS (SELECT entity_key, {COS.format(a='v', b='q')} AS score FROM vec, c WHERE entity_key <> 0)
SELECT entity_key, round(max(score), 6) AS score FROM sim GROUP BY entity_key
ORDER BY round(max(score), 9) DESC, entity_key LIMIT 12""")
def similar_centroid(spark, sf):
    return V.similar_entities(vectors(spark, sf), 0).withColumn("score", F.round("score", 6))


@query("similar_to_frame", f"""
WITH {VECTORS_SQL},
qv AS (SELECT v AS q, frame_idx AS used FROM vec WHERE entity_key = 3 ORDER BY abs(frame_idx - 100), frame_idx LIMIT 1),
sim AS (SELECT entity_key, frame_idx, used, {COS.format(a='v', b='q')} AS score FROM vec, qv WHERE entity_key <> 3)
SELECT entity_key, frame_idx, used, round(score, 6) AS score FROM sim ORDER BY sim.score DESC, entity_key, frame_idx LIMIT 40""")
def similar_to_frame(spark, sf):
    v = vectors(spark, sf)
    q = V.frame_vector(v, 3, 100)
    hits = V.scored(v.filter("entity_key <> 3"), q).orderBy(F.col("score").desc(), "entity_key", "frame_idx").limit(40)
    return (hits.withColumn("used", q.select("frame_used").scalar())
            .select("entity_key", "frame_idx", "used", F.round("score", 6).alias("score")))


@query("frame_spread", f"""
WITH RECURSIVE {SIM_SQL},
walk AS (
  SELECT entity_key, CAST([] AS BIGINT[]) AS kept, CAST(0 AS BIGINT) AS n FROM sim GROUP BY entity_key
  UNION ALL
  SELECT w.entity_key, list_append(any_value(w.kept), arg_min(s.frame_idx, struct_pack(a := -s.score, b := s.frame_idx))), w.n + 1
  FROM walk w JOIN sim s ON s.entity_key = w.entity_key AND w.n < 6 AND len(list_filter(w.kept, lambda x: abs(x - s.frame_idx) < 45)) = 0
  GROUP BY w.entity_key, w.n
),
hits AS (SELECT entity_key, unnest(kept) AS frame_idx FROM walk QUALIFY n = max(n) OVER (PARTITION BY entity_key))
SELECT entity_key, frame_idx, CAST(NULL AS DOUBLE) AS t, round(score, 4) AS score, 'frame' AS space
FROM hits JOIN sim USING (entity_key, frame_idx) ORDER BY sim.score DESC, entity_key, frame_idx LIMIT 40""")
def frame_spread(spark, sf):
    return V.search_vector(vectors(spark, sf), _query_vector(spark, sf), "frame", limit=40)


@query("space_inventory", f"""
WITH {VECTORS_SQL}
SELECT 'frame' AS space, count(DISTINCT entity_key) AS entities, CAST(count(*) AS BIGINT) AS frames, CAST(max(len(v)) AS BIGINT) AS dim FROM vec""")
def space_inventory(spark, sf):
    p = vectors(spark, sf).withColumn("n", F.lit(1).cast("bigint")).withColumn("dim", F.size("v").cast("bigint"))
    return V.space_inventory(p)


@query("frame_times", f"""
WITH {VECTORS_SQL}
SELECT entity_key, frame_idx, CASE WHEN entity_key > 0 THEN round(frame_idx / (entity_key * 6.0), 3) END AS t FROM vec""")
def frame_times(spark, sf):
    v = vectors(spark, sf).select("entity_key", "frame_idx")
    fps = v.select("entity_key").distinct().withColumn("fps", F.col("entity_key") * 6.0)
    return V.frame_seconds(v, fps)


def hashing_encoder(texts):
    """Token-hash bag of words, 64 wide: a stand-in where no model is at hand."""
    import zlib

    import numpy as np
    out = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % 64] += 1.0 if h & 64 else -1.0
    return out


@query("hybrid_rrf")
def hybrid_rrf(spark, sf):
    m = moments(spark, sf)
    text = "tion onth rethe"
    vec = V.embed_passages(m, hashing_encoder)
    cards = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_key"), F.col("c_acctbal").alias("duration"),
        F.col("c_mktsegment").alias("creator"), F.lit("all").alias("category"),
        F.array(F.col("c_mktsegment")).alias("collections"), F.lit(None).cast("double").alias("created_at"),
        F.lit(None).cast("bigint").alias("likes"))
    res = R.hybrid(m, cards, text, vec, hashing_encoder([text])[0].tolist())
    return res.hits.select("entity_key", F.round("score", 6).alias("score"), "hit_count", "n_sources", "creator")
