"""Frame-vector search: exact similarity, segmented maximum, spread, nearest frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M

# Shortlist, spread and per-entity share of a result page.
SHORTLIST = 24
SPREAD_S = 1.5
PER_ENTITY = 6
FALLBACK_FPS = 30.0
MAX_FPS = 240.0
UNROLL_DIMS = 128


def similarity(v: Column, q: Sequence[float]) -> Column:
    """Cosine of unit vectors against a fixed query vector.

    Short vectors unroll into generated code; long ones go through one matrix product per
    Arrow batch, where the unrolled expression would no longer compile.
    """
    n = float(np.linalg.norm(q)) or 1.0
    unit = [float(x) / n for x in q]
    if len(unit) <= UNROLL_DIMS:
        return M.dot_literal(v, unit)
    weights = np.asarray(unit)

    @F.pandas_udf("double")
    def matmul(s: pd.Series) -> pd.Series:
        return pd.Series(np.vstack(s.to_numpy()).astype(np.float64) @ weights)

    return matmul(v)


def scored(vec: DataFrame, query: DataFrame, vec_col: str = "v", out: str = "score") -> DataFrame:
    """Cosine against a query vector that is itself a one-row DataFrame (column ``q``)."""
    q = query.select(F.struct(M.unit(F.col("q")).alias("q"))).scalar()
    return (vec.withColumn("__q", q).filter(F.col("__q.q").isNotNull())
            .withColumn(out, M.dot(M.unit(F.col(vec_col)), F.col("__q.q"))).drop("__q"))


def segmented_max(hits: DataFrame, limit: int = SHORTLIST, key: str = "entity_key", score: str = "score") -> DataFrame:
    """Entities ranked by their best frame.

    Every entity is scored; taking the top frames first and grouping them afterwards would
    let one entity's near-duplicates crowd the others out.
    """
    return (hits.groupBy(key).agg(F.max(score).alias(score))
            .orderBy(F.round(score, 9).desc(), F.col(key).asc()).limit(limit))


def exact_rerank(vec: DataFrame, query: DataFrame, keys: DataFrame, limit: int, key: str = "entity_key") -> DataFrame:
    """Frame-exact ranking inside a shortlist; the shortlist is bounded by its own limit."""
    inside = vec.join(F.broadcast(keys.select(key)), key, "left_semi")
    return scored(inside, query).orderBy(F.col("score").desc(), key, "frame_idx").limit(limit)


def spread(hits: DataFrame, limit: int, fps: DataFrame | None = None, gap_s: float = SPREAD_S,
           per_entity: int = PER_ENTITY, key: str = "entity_key", idx: str = "frame_idx",
           score: str = "score") -> DataFrame:
    """One hit per moment: greedy from the best, at most ``per_entity`` per entity.

    Each kept hit rules out at most ``2 * gap - 1`` frames, so with a cap the kept ones are
    always among an entity's best ``(cap - 1) * (2 * gap - 1) + 1`` frames.  That bound is
    applied as a ranking limit (with map-side partials), which makes the per-entity fold
    exact and small whatever the entity's size.  Without a cap, frames are folded in
    stretches between empty gaps instead.
    """
    rows = hits.groupBy(key, idx).agg(F.max(score).alias(score))
    if fps is not None:
        # One row per entity; left to the optimizer to broadcast when it is small.
        rows = rows.join(fps.select(key, F.col("fps").cast("double").alias("fps")), key, "left")
    else:
        rows = rows.withColumn("fps", F.lit(None).cast("double"))
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(FALLBACK_FPS))
    rows = rows.withColumn("gap", F.greatest(F.lit(1), F.round(F.lit(gap_s) * rate)).cast("bigint"))
    usual_gap = max(1, round(gap_s * (FALLBACK_FPS if fps is None else MAX_FPS)))
    by_score = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(idx).asc())
    if per_entity > 0:
        need = lambda g: (per_entity - 1) * (2 * g - 1) + 1
        ranked = lambda df: df.withColumn("rn", F.row_number().over(by_score))
        wide = F.col("gap") > usual_gap
        usual = ranked(rows.filter(~wide)).filter(F.col("rn") <= need(usual_gap))
        # Rates past the usual ceiling keep their own, larger bound.
        rows = usual if fps is None else usual.unionByName(ranked(rows.filter(wide)).filter(F.col("rn") <= need(F.col("gap"))))
        groups = [key]
    else:
        from .sequences import Carry, index_block, with_carry
        # Two frames a full gap apart with nothing between them can never rule each other out.
        near = with_carry(rows, [key], [idx], [Carry("pi", "lag", F.col(idx))], index_block(F.col(idx)))
        near = near.withColumn("cut", F.coalesce(F.col(idx) - F.col("pi") >= F.col("gap"), F.lit(True)).cast("bigint"))
        rows = with_carry(near, [key], [idx], [Carry("prior", "sum", F.col("cut"))], index_block(F.col(idx))) \
            .withColumn("stretch", F.col("prior") + F.col("cut"))
        groups = [key, "stretch"]
    best_first = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(idx).alias("i"), F.col("gap").alias("g"))))
    empty = F.array().cast("array<struct<s:double,i:bigint,g:bigint>>")

    def keep(acc, h):
        clear = F.forall(acc, lambda a: F.abs(a["i"] - h["i"]) >= h["g"])
        room = F.size(acc) < per_entity if per_entity > 0 else F.lit(True)
        return F.when(room & clear, F.concat(acc, F.array(h))).otherwise(acc)

    typed = rows.withColumn(idx, F.col(idx).cast("bigint")).withColumn(score, F.col(score).cast("double"))
    kept = typed.groupBy(*groups).agg(F.aggregate(best_first, empty, keep).alias("kept"))
    return (kept.select(key, F.explode("kept").alias("h"))
            .select(key, F.col("h.i").alias(idx), (-F.col("h.s")).alias(score))
            .orderBy(F.col(score).desc(), key, idx).limit(limit))


def search_vector(vec: DataFrame, query: DataFrame, space: str, limit: int = 40, exclude=None,
                  fps: DataFrame | None = None, gap_s: float = SPREAD_S) -> DataFrame:
    """Ranked, spread frames of one space.

    Suppression runs per entity and the page is a top-k after it, so no candidate pool can
    come up short.
    """
    pool = vec.filter(F.col("space") == space)
    if exclude is not None:
        pool = pool.filter(F.col("entity_key") != F.lit(exclude))
    hits = scored(pool, query).select("entity_key", "frame_idx", "score")
    return shape_hits(spread(hits, limit, fps, gap_s), space, fps)


def shape_hits(hits: DataFrame, space: str, fps: DataFrame | None = None) -> DataFrame:
    """Frame index to seconds (NULL without a known rate), score rounded to 4."""
    if fps is not None:
        hits = hits.join(fps.select("entity_key", "fps"), "entity_key", "left")
    else:
        hits = hits.withColumn("fps", F.lit(None).cast("double"))
    return hits.select("entity_key", "frame_idx",
                       F.round(F.col("frame_idx") / F.when(F.col("fps") > 0, F.col("fps")), 2).alias("t"),
                       F.round("score", 4).alias("score"), F.lit(space).alias("space"))


def frame_vector(vec: DataFrame, entity, frame_idx: int) -> DataFrame:
    """One row (q, frame_used): the stored vector, or the nearest stored frame's."""
    d = F.abs(F.col("frame_idx") - F.lit(frame_idx))
    best = F.min_by(F.struct(F.col("v").alias("q"), F.col("frame_idx").alias("frame_used")), F.struct(d, F.col("frame_idx")))
    return vec.filter(F.col("entity_key") == F.lit(entity)).agg(best.alias("b")).select("b.*")


def similar_to_frame(vec: DataFrame, entity, frame_idx: int, space: str, limit: int = 40,
                     same_entity: bool = False, fps: DataFrame | None = None) -> DataFrame:
    q = frame_vector(vec.filter(F.col("space") == space), entity, frame_idx)
    return search_vector(vec, q, space, limit, None if same_entity else entity, fps)


def centroid(vec: DataFrame, entity) -> DataFrame:
    """One row (q): mean vector of an entity, as a JVM-side partial aggregate of any width."""
    own = vec.filter(F.col("entity_key") == F.lit(entity)).select(array_to_vector("v").alias("f"))
    return own.select(Summarizer.mean(F.col("f")).alias("m")).select(vector_to_array("m").alias("q"))


def similar_entities(vec: DataFrame, entity, limit: int = 12) -> DataFrame:
    """Other entities by their best passage against this one's centroid."""
    hits = scored(vec.filter(F.col("entity_key") != F.lit(entity)), centroid(vec, entity))
    return segmented_max(hits.select("entity_key", "score"), limit)


def space_inventory(payloads: DataFrame) -> DataFrame:
    """(space, entities, frames, dim) without decoding anything."""
    return payloads.groupBy("space").agg(
        F.count_distinct("entity_key").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"),
        F.coalesce(F.max("dim"), F.lit(0)).alias("dim"))


def stride_for(frames: int, dim: int, budget_mb: int = 256) -> int:
    """Smallest stride whose matrix fits the budget; growth costs resolution, not memory."""
    if frames <= 0 or dim <= 0:
        return 1
    room = max(max(budget_mb, 16) * 1048576 // (dim * 4), 1)
    return frames // (room + 1) + 1


def embed_passages(moments: DataFrame, encoder, text: str = "text", batch: int = 128) -> DataFrame:
    """(id, entity_key, v): unit vectors from a user's ``encoder(list[str]) -> 2-D array``."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                m = np.asarray(encoder(pdf[text].iloc[i:i + batch].tolist()), dtype=np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                out.extend((m / np.where(norm == 0, 1.0, norm)).astype(np.float32).tolist())
            yield pd.DataFrame({"id": pdf["id"], "entity_key": pdf["entity_key"], "v": out})

    src = moments.select("id", "entity_key", F.coalesce(text, F.lit("")).alias(text))
    kind = src.schema["entity_key"].dataType.simpleString()
    return src.mapInPandas(run, f"id bigint, entity_key {kind}, v array<float>")


def frame_seconds(frames: DataFrame, fps: DataFrame) -> DataFrame:
    """Seconds of a frame where the entity's rate is known, else NULL."""
    return (frames.join(fps.select("entity_key", "fps"), "entity_key", "left")
            .withColumn("t", F.round(F.greatest(F.col("frame_idx"), F.lit(0)) / F.when(F.col("fps") > 0, F.col("fps")), 3))
            .drop("fps"))


def frame_for_time(points: DataFrame, fps: DataFrame, t: str = "t") -> DataFrame:
    return (points.join(fps.select("entity_key", "fps"), "entity_key", "left")
            .withColumn("frame_idx", F.when(F.col("fps") > 0, F.round(F.greatest(F.col(t), F.lit(0.0)) * F.col("fps")).cast("bigint")))
            .drop("fps"))
