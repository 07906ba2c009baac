"""Frame vectors as a stored coarse-to-fine index: windows with bounds within a budget, exact frames behind them.

Each entity's frames are cut, in order, into windows of ``stride`` frames; the stride is the smallest for
which a batch's windows fit the budget, so growth costs resolution of the coarse table, never memory. A
window is one row: the mean of its unit vectors and the largest distance of a frame from it. For a unit
query no frame of the window has a cosine above ``query . centre + radius``. A search scores the windows,
takes the frames of the most promising for a floor, and opens only windows whose bound reaches it. Its
result is that of scoring every frame.

Defined results. Vectors that are null, empty or hold a null or non-finite component are not indexed; a
zero vector scores 0; repeated frames each count. Components are kept as 32-bit floats. A query meets only
frames of its own space and width. Ties go to the smaller entity and frame. Writing a batch again replaces
it; an empty batch adds nothing.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from .sequences import Carry, index_block, with_carry
from .vectors import scored

BUCKETS = 64
BUDGET_MB = 256
#: Slack of a bound: rounding of the stored centre and of sums of products.
SLACK = 1e-6
WINDOW = ["batch", "bucket", "space", "dim", "entity_key", "window"]


def stride_of(frames: Column, dim: Column, budget_bytes: int) -> Column:
    """Smallest stride whose windows fit the budget."""
    room = F.greatest(F.floor(F.lit(budget_bytes) / (dim * 4)), F.lit(1))
    return F.floor(frames / (room + 1)) + 1


class FrameIndex:
    """An index in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, vec: DataFrame, batch: int = 0, budget_bytes: int = BUDGET_MB * 1048576) -> None:
        """Adds vec(entity_key, space, frame_idx, v); ``budget_bytes`` holds the centres of each of its spaces, and one a tail."""
        sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        rows = (vec.filter(sound & (F.size("v") > 0))
                .select("entity_key", "space", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col("v").cast("array<float>").alias("v"))
                .withColumn("dim", F.size("v")).withColumn("__h", F.xxhash64("v")))
        shape = rows.groupBy("space", "dim").agg(F.count("*").alias("__n"))
        shape = shape.select("space", "dim", stride_of(F.col("__n"), F.col("dim"), budget_bytes).alias("__stride"))
        whole = ["entity_key", "space", "dim"]
        placed = with_carry(rows, whole, ["frame_idx", "__h"], [Carry("__pos", "sum", F.lit(1).cast("bigint"))], index_block(F.col("frame_idx")))
        windows = (placed.join(shape, ["space", "dim"]).withColumn("window", F.floor(F.col("__pos") / F.col("__stride")))
                   .withColumn("bucket", F.pmod(F.xxhash64(*whole, "window"), F.lit(BUCKETS)).cast("int"))
                   .select("bucket", *whole, "window", "frame_idx", "v"))
        self._write(windows, "frames", batch)
        mine = self._read("frames").where(F.col("batch") == batch).withColumn("u", M.unit(F.col("v")))
        key = [c for c in WINDOW if c != "batch"]
        centres = (mine.groupBy(*key).agg(Summarizer.mean(array_to_vector("u")).alias("m"), F.count("*").alias("n"),
                                          F.min("frame_idx").alias("first_idx"), F.max("frame_idx").alias("last_idx"))
                   .withColumn("centre", vector_to_array("m").cast("array<float>")).drop("m"))
        away = F.aggregate(F.zip_with("u", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        radii = mine.join(centres.select(*key, "centre"), key).groupBy(*key).agg(F.sqrt(F.max(away)).alias("radius"))
        self._write(centres.join(radii, key), "windows", batch)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.repartitionByRange("bucket", "entity_key", "window").sortWithinPartitions("bucket", "entity_key", "window") \
            .write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    # ---- reads -----------------------------------------------------------------------

    def bounds(self, query: DataFrame, space: str, exclude=None) -> DataFrame:
        """The windows of ``space`` with ``mid`` and ``bound`` for a one-row query (q): no frame of a window scores above its bound."""
        unit = query.select(F.struct(M.unit(F.col("q")).alias("q"), F.size("q").alias("dim"))).scalar()
        rows = self._read("windows").where(F.col("space") == space)
        if exclude is not None:
            rows = rows.where(F.col("entity_key") != F.lit(exclude))
        rows = rows.withColumn("__q", unit).where(F.col("dim") == F.col("__q.dim"))
        mid = M.dot(F.col("centre"), F.col("__q.q"))
        return rows.withColumn("mid", mid).withColumn("bound", F.col("mid") + F.col("radius") + SLACK).drop("__q", "centre")

    def frames_of(self, windows: DataFrame) -> DataFrame:
        """Stored frames of the given windows; only their directories are opened."""
        return self._read("frames").join(windows.select(*WINDOW), WINDOW, "left_semi")

    def survivors(self, query: DataFrame, space: str, limit: int, exclude=None) -> DataFrame:
        """Windows that may hold one of the ``limit`` best frames."""
        windows = self.bounds(query, space, exclude)
        # Every window holds a frame, so ``limit`` windows give a floor of ``limit`` scores where there are as many.
        likely = windows.orderBy(F.col("mid").desc(), *WINDOW).limit(limit)
        best = scored(self.frames_of(likely), query).select("score").orderBy(F.col("score").desc()).limit(limit)
        floor = best.agg(F.when(F.count("score") == limit, F.min("score"))).first()[0]
        return windows if floor is None else windows.where(F.col("bound") >= floor)

    def search(self, query: DataFrame, space: str, limit: int = 40, exclude=None) -> DataFrame:
        """(entity_key, frame_idx, score): the ``limit`` best frames of a space, as scoring all of them gives."""
        found = scored(self.frames_of(self.survivors(query, space, limit, exclude)), query).select("entity_key", "frame_idx", "score")
        return found.orderBy(F.round("score", 9).desc(), "entity_key", "frame_idx").limit(limit)

    def inventory(self) -> DataFrame:
        """(space, dim, windows, frames, coarse_bytes) without reading a vector."""
        return self._read("windows").groupBy("space", "dim").agg(
            F.count("*").alias("windows"), F.sum("n").alias("frames"), (F.count("*") * F.col("dim") * 4).alias("coarse_bytes"))
