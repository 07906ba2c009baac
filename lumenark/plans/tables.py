"""Adapters: the driver's parquet tables seen through the engine's data model.

Every adapter is a lazy projection over the whole table, so column pruning and filters
still reach the parquet scan.  The ``*_SQL`` strings are the same projections in DuckDB
SQL, used as CTEs by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frameindex import FrameIndex
from ..operators.lexindex import LexicalIndex
from ..session import stored

EPOCH = "1970-01-01 00:00:00"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt over the cluster's cores, for steps that cost far more than reading them."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session time zone is."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"),
                              ts.cast("timestamp_ntz"))
    return micros / F.lit(1_000_000.0)


# 2024-01-01T00:00:00Z, the first day of ``events``.
EVENTS_ORIGIN = 1704067200.0


def events_timed(spark: SparkSession, sf: str) -> DataFrame:
    """events with ``t`` = seconds since the origin."""
    return load(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        F.round(epoch_seconds(F.col("ts")) - F.lit(EVENTS_ORIGIN), 3).alias("t"),
    )


EVENTS_TIMED_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value, props,
         round(epoch_us(ts) / 1000000.0 - 1704067200.0, 3) AS t
  FROM events
)"""


def moments(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as moments: a turn every ten seconds, the role as the source."""
    return load(spark, sf, "conversations").select(
        (F.col("conv_id") * F.lit(10000) + F.col("turn")).alias("id"),
        F.col("conv_id").alias("entity_key"),
        (F.col("turn") * F.lit(10.0)).alias("t_start"),
        (F.col("turn") * F.lit(10.0) + F.lit(10.0)).alias("t_end"),
        F.col("role").alias("source"),
        F.when(F.col("role") == "user", 1.15).when(F.col("role") == "assistant", 1.0)
        .otherwise(0.7).alias("weight"),
        "text",
    )


MOMENTS_SQL = """
moments AS (
  SELECT conv_id * 10000 + turn AS id, conv_id AS entity_key,
         CAST(turn * 10.0 AS DOUBLE) AS t_start, CAST(turn * 10.0 + 10.0 AS DOUBLE) AS t_end,
         role AS source,
         CAST(CASE role WHEN 'user' THEN 1.15 WHEN 'assistant' THEN 1.0 ELSE 0.7 END AS DOUBLE) AS weight,
         text
  FROM conversations
)"""


def moment_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The stored inverted index of the moments, written by the first query that needs it."""
    def build(path: str) -> None:
        LexicalIndex(spark, path).append(moments(spark, sf), 0)

    return LexicalIndex(spark, stored(spark, "moment-index", [f"{sf}/conversations.parquet"], build))


def document_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The same of the documents, weighted by a digit of their length."""
    def build(path: str) -> None:
        docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 7).cast("double").alias("weight"), "source")
        LexicalIndex(spark, path).append(docs, 0)

    return LexicalIndex(spark, stored(spark, "document-index", [f"{sf}/documents.parquet"], build))


def order_slots(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as intervals on its order's timeline: line n covers [3n, 3n + quantity/10)."""
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entity_key"),
        F.col("l_linenumber").alias("idx"),
        (F.col("l_linenumber") * F.lit(3.0)).alias("t0"),
        (F.col("l_linenumber") * F.lit(3.0) + F.col("l_quantity") / 10.0).alias("t1"),
        F.col("l_returnflag").alias("kind"),
    )


SLOTS_SQL = """
slots AS (
  SELECT l_orderkey AS entity_key, l_linenumber AS idx,
         CAST(l_linenumber * 3.0 AS DOUBLE) AS t0,
         CAST(l_linenumber * 3.0 AS DOUBLE) + l_quantity / 10.0 AS t1,
         l_returnflag AS kind
  FROM lineitem
)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as frame vectors: the label is the entity, the vector id the frame."""
    return load(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("entity_key"),
        F.lit("frame").alias("space"),
        F.col("vec_id").alias("frame_idx"),
        F.col("embedding").alias("v"),
    )


VECTORS_SQL = """
vec AS (
  SELECT CAST(label AS BIGINT) AS entity_key, vec_id AS frame_idx, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
)"""


def frame_index(spark: SparkSession, sf: str) -> FrameIndex:
    """The stored coarse-to-fine index of the frame vectors, windows of eight frames or so."""
    def build(path: str) -> None:
        vec = vectors(spark, sf)
        FrameIndex(spark, path).append(vec, 0, budget_bytes=vec.count() * 64 * 4 // 8)

    return FrameIndex(spark, stored(spark, "frame-index", [f"{sf}/embeddings.parquet"], build))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """events as frames of slowly turning vectors: an entity a user, eight components of its clock."""
    turn = [f((F.col("t") / F.lit(40000.0 * i)) + F.col("user_id")) for i in range(1, 5) for f in (F.cos, F.sin)]
    return events_timed(spark, sf).select(F.col("user_id").alias("entity_key"), F.lit("track").alias("space"),
                                          F.round(F.col("t") * 1000).cast("bigint").alias("frame_idx"), F.array(*turn).cast("array<float>").alias("v"))


TRACKS_SQL = EVENTS_TIMED_SQL + """,
tr AS (
  SELECT user_id AS entity_key, CAST(round(t * 1000) AS BIGINT) AS frame_idx,
         CAST(CAST([cos(t / 40000.0 + user_id), sin(t / 40000.0 + user_id), cos(t / 80000.0 + user_id), sin(t / 80000.0 + user_id), cos(t / 120000.0 + user_id), sin(t / 120000.0 + user_id), cos(t / 160000.0 + user_id), sin(t / 160000.0 + user_id)] AS FLOAT[]) AS DOUBLE[]) AS v
  FROM ev
)"""


def track_index(spark: SparkSession, sf: str) -> FrameIndex:
    """The same of the tracks; a window holds some eight frames."""
    def build(path: str) -> None:
        vec = tracks(spark, sf)
        FrameIndex(spark, path).append(vec, 0, budget_bytes=vec.count() * 8 * 4 // 8)

    return FrameIndex(spark, stored(spark, "track-index", [f"{sf}/events.parquet"], build))
