"""Ordered-sequence operators: running state, interval unions, runs, gaps, as-of.

A group (entity, source, text ...) may hold a large share of all rows, so no operator here
hands a whole group to one task.  The time axis is cut into blocks; rows are windowed per
``(group, block)``, each block is reduced to one summary row before the shuffle, and the
state carried into a block is a window over those summaries only.  ``block=None`` falls
back to a plain per-group window for inputs known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import cut_lineage

BLOCK = "__blk"
PART = "__part"
BLOCK_SECONDS = 3600.0
BLOCK_ROWS = 100_000
#: Least width of the cells that a chain of cuts is followed in.
CELL_SECONDS = 64.0


def time_block(t: Column, seconds: float = BLOCK_SECONDS) -> Column:
    return F.floor(t / F.lit(float(seconds))).cast("bigint")


def index_block(i: Column, rows: int = BLOCK_ROWS) -> Column:
    """Blocks of a dense integer position hold at most ``rows`` rows each."""
    return F.floor(i / F.lit(rows)).cast("bigint")


@dataclass(frozen=True)
class Carry:
    """One running value.

    kind: ``max`` / ``sum`` over strictly earlier rows, ``lag`` / ``lead`` one row away,
    ``last`` = latest non-null value up to and including the row, ``next`` = earliest one from the row on.
    """

    out: str
    kind: str
    value: Column


def with_carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Carry],
               block: Column | str | None) -> DataFrame:
    """Add running values over each key's rows in ``order`` (which must be total per key).

    ``block`` may name a column already there: it is kept beside ``PART``, and a second pass
    over the same ``(keys, block)`` then needs no further shuffle. Rows are grouped and joined
    by ``PART``, the struct of keys and block, in which a NULL equals a NULL: rows without a
    key or a time are a group like any other.
    """
    keys = list(keys)
    own = isinstance(block, str)
    staged = df
    for i, s in enumerate(specs):
        val = F.struct(s.value.alias("v")) if s.kind in ("lag", "lead") else s.value
        staged = staged.withColumn(f"__v{i}", val)
    local_keys = keys
    if block is not None:
        name = block if own else BLOCK
        staged = staged if own else staged.withColumn(BLOCK, block)
        if not own or PART not in staged.columns:
            staged = staged.withColumn(PART, F.struct(*keys, name))
        local_keys = [PART]
    w = Window.partitionBy(*local_keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = staged
    for i, s in enumerate(specs):
        v = F.col(f"__v{i}")
        expr = {
            "max": lambda v: F.max(v).over(before),
            "sum": lambda v: F.sum(v).over(before),
            "lag": lambda v: F.lag(v).over(w),
            "lead": lambda v: F.lead(v).over(w),
            "last": lambda v: F.last(v, ignorenulls=True).over(upto),
            "next": lambda v: F.first(v, ignorenulls=True).over(onward),
        }[s.kind](v)
        local = local.withColumn(f"__l{i}", expr)
    if block is None:
        out = local
        for i, s in enumerate(specs):
            c = F.col(f"__l{i}")
            if s.kind in ("lag", "lead"):
                c = c.getField("v")
            elif s.kind == "sum":
                c = F.coalesce(c, F.lit(0))
            out = out.withColumn(s.out, c)
        return out.drop(*[f"__{p}{i}" for i in range(len(specs)) for p in "vl"])

    pos = F.struct(*[F.col(o) for o in order])
    aggs = []
    for i, s in enumerate(specs):
        v = F.col(f"__v{i}")
        aggs.append({
            "max": lambda v: F.max(v),
            "sum": lambda v: F.sum(v),
            "lag": lambda v: F.max_by(v, pos),
            "lead": lambda v: F.min_by(v, pos),
            "last": lambda v: F.max_by(v, F.when(v.isNotNull(), pos)),
            "next": lambda v: F.min_by(v, F.when(v.isNotNull(), pos)),
        }[s.kind](v).alias(f"__s{i}"))
    blocks = staged.groupBy(*local_keys).agg(*aggs)
    bw = Window.partitionBy(*[f"{PART}.{k}" for k in keys]).orderBy(f"{PART}.{name}")
    bbefore = bw.rowsBetween(Window.unboundedPreceding, -1)
    bafter = bw.rowsBetween(1, Window.unboundedFollowing)
    for i, s in enumerate(specs):
        v = F.col(f"__s{i}")
        blocks = blocks.withColumn(f"__c{i}", {
            "max": lambda v: F.max(v).over(bbefore),
            "sum": lambda v: F.sum(v).over(bbefore),
            "lag": lambda v: F.lag(v).over(bw),
            "lead": lambda v: F.lead(v).over(bw),
            "last": lambda v: F.last(v, ignorenulls=True).over(bbefore),
            "next": lambda v: F.first(v, ignorenulls=True).over(bafter),
        }[s.kind](v))
    carried = blocks.drop(*[f"__s{i}" for i in range(len(specs))])
    out = local.join(carried, local_keys, "inner")
    for i, s in enumerate(specs):
        here, there = F.col(f"__l{i}"), F.col(f"__c{i}")
        out = out.withColumn(s.out, {
            "max": lambda a, b: F.greatest(a, b),
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "lag": lambda a, b: F.coalesce(a, b).getField("v"),
            "lead": lambda a, b: F.coalesce(a, b).getField("v"),
            "last": lambda a, b: F.coalesce(a, b),
            "next": lambda a, b: F.coalesce(a, b),
        }[s.kind](here, there))
    return out.drop(*([] if own else [BLOCK, PART]), *[f"__{p}{i}" for i in range(len(specs)) for p in "vlc"])


def blocked(df: DataFrame, t: Column, seconds: float | None) -> tuple[DataFrame, str | None]:
    """Attach the time block once so that several passes share its partitioning."""
    if seconds is None:
        return df, None
    return df.withColumn(BLOCK, time_block(t, seconds)), BLOCK


def _distinct_starts(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per (key, start): repeated sightings collapse before any ordering."""
    return (df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
            .groupBy(*keys, F.col(start).alias("a")).agg(F.max(end).alias("b")))


def _ordered_spans(df, keys, start, end, block_seconds) -> DataFrame:
    spans, blk = blocked(_distinct_starts(df, keys, start, end), F.col("a"), block_seconds)
    return with_carry(spans, keys, ["a"], [Carry("reach", "max", F.col("b"))], blk)


def union_seconds(df: DataFrame, keys: Sequence[str], start: str, end: str,
                  out: str = "covered", block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Measure of the union of each key's intervals.

    Every interval adds only what lies past the furthest end seen so far, so the total is
    a plain sum with map-side partials and needs no island ids.
    """
    spans = _ordered_spans(df, keys, start, end, block_seconds)
    fresh = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce("reach", "a")))
    return spans.groupBy(*keys).agg(F.sum(fresh).alias(out))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0.0,
            block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Maximal runs whose neighbours lie at most ``gap`` apart: (keys, island, t0, t1)."""
    spans = _ordered_spans(df, keys, start, end, block_seconds)
    opened = F.col("reach").isNull() | (F.col("a") - F.col("reach") > F.lit(float(gap)))
    flagged = spans.withColumn("opened", opened.cast("bigint"))
    blk = None if block_seconds is None else BLOCK
    numbered = with_carry(flagged, keys, ["a"], [Carry("prior", "sum", F.col("opened"))], blk)
    return (numbered.groupBy(*keys, (F.col("prior") + F.col("opened")).alias("island"))
            .agg(F.min("a").alias("t0"), F.max("b").alias("t1")))


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, durations: DataFrame,
         duration: str = "duration", floor: float = 1.5,
         block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Uncovered stretches of at least ``floor`` seconds, head and tail included."""
    spans = _ordered_spans(df.join(durations.select(*keys), list(keys), "left_semi"),
                           keys, start, end, block_seconds)
    inner = spans.select(*keys, F.coalesce("reach", F.lit(0.0)).alias("t0"), F.col("a").alias("t1"))
    tail = (spans.groupBy(*keys).agg(F.max("b").alias("t0"))
            .join(durations.select(*keys, F.col(duration).alias("t1")), list(keys), "right")
            .select(*keys, F.coalesce("t0", F.lit(0.0)).alias("t0"), "t1"))
    return inner.unionByName(tail).filter(F.col("t1") - F.col("t0") >= F.lit(float(floor)))


def frame_runs(df: DataFrame, keys: Sequence[str], idx: str = "idx", t_lo: str = "t",
               t_hi: str | None = None, value: str = "value",
               block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Run-length collapse of a per-frame (or per-window) series.

    A run is consecutive indices carrying the same value; an empty value belongs to no run
    and ends the one before it.  Returns (keys, lo, hi, t0, t1, value, ordinal).
    """
    t_hi = t_hi or t_lo
    rows = df.select(*keys, F.col(idx).alias("i"), F.col(t_lo).alias("ta"), F.col(t_hi).alias("tb"),
                     F.col(value).alias("val"))
    filled = rows.filter(F.col("val").isNotNull() & (F.col("val").cast("string") != ""))
    blk = None
    if block_rows is not None:
        filled, blk = filled.withColumn(BLOCK, index_block(F.col("i"), block_rows)), BLOCK
    prev = with_carry(filled, keys, ["i"], [Carry("before", "lag", F.struct("i", "val"))], blk)
    starts = ~F.coalesce((F.col("before.val") == F.col("val")) & (F.col("before.i") + 1 == F.col("i")),
                         F.lit(False))
    flagged = prev.withColumn("opened", starts.cast("bigint"))
    numbered = with_carry(flagged, keys, ["i"], [Carry("prior", "sum", F.col("opened"))], blk)
    return (numbered.groupBy(*keys, (F.col("prior") + F.col("opened") - 1).alias("ordinal"))
            .agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("ta").alias("t0"),
                 F.max("tb").alias("t1"), F.min("val").alias("value")))


def freeze_spans(df: DataFrame, keys: Sequence[str], t: str = "t", diff: str = "mafd",
                 still: float = 0.05, min_frames: int = 3,
                 block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Runs of at least three unchanged frames; a run starts at the frame before it.

    The first frame of a series has nothing to differ from and never counts.
    """
    rows, blk = blocked(df.select(*keys, F.col(t).alias("ft"), F.col(diff).alias("d")), F.col("ft"), block_seconds)
    prev = with_carry(rows, keys, ["ft"], [Carry("pt", "lag", F.col("ft"))], blk)
    state = (prev.filter(F.col("pt").isNotNull())
             .withColumn("flat", F.coalesce(F.col("d") <= still, F.lit(False))))
    numbered = with_carry(state, keys, ["ft"],
                          [Carry("breaks", "sum", (~F.col("flat")).cast("bigint"))], blk)
    # The very first differenced frame has no earlier differenced frame to start from.
    head = with_carry(numbered, keys, ["ft"], [Carry("earlier", "lag", F.col("ft"))], blk)
    return (head.filter("flat")
            .withColumn("from_t", F.coalesce("earlier", "ft"))
            .groupBy(*keys, "breaks")
            .agg(F.min("from_t").alias("t0"), F.max("ft").alias("t1"), F.count("*").alias("frames"))
            .filter(F.col("frames") >= min_frames)
            .select(*keys, F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "frames"))


def as_of(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, mark_t: str, mark_value: str,
          out: str, clamp_first: bool = True, block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Latest mark at or before each point; points before the first mark clamp to it.

    One union and one ordered pass: no per-point lookup and no range join.
    """
    pcols = [c for c in points.columns if c not in keys]
    left = points.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__side"),
                         F.struct(*pcols).alias("__row"),
                         F.lit(None).cast(marks.schema[mark_value].dataType).alias("__mark"))
    right = marks.select(*keys, F.col(mark_t).cast("double").alias("__t"), F.lit(0).alias("__side"),
                         F.lit(None).cast(left.schema["__row"].dataType).alias("__row"),
                         F.col(mark_value).alias("__mark"))
    both, blk = blocked(left.unionByName(right), F.col("__t"), block_seconds)
    found = with_carry(both, keys, ["__t", "__side"], [Carry("__hit", "last", F.col("__mark"))], blk)
    hits = found.filter(F.col("__side") == 1)
    if clamp_first:
        first = marks.groupBy(*keys).agg(F.min_by(mark_value, mark_t).alias("__first"))
        hits = hits.join(first, list(keys), "left").withColumn("__hit", F.coalesce("__hit", "__first"))
    return hits.select(*keys, "__row.*", F.col("__hit").alias(out))


def edges_to_intervals(edges: DataFrame, keys: Sequence[str], edge: str = "edge", digits: int = 3,
                       block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Consecutive edges become intervals, with the midpoint as key frame."""
    e = edges.select(*keys, F.col(edge).alias("t0")).distinct()
    blk = None if block_seconds is None else time_block(F.col("t0"), block_seconds)
    nxt = with_carry(e, keys, ["t0"], [Carry("t1", "lead", F.col("t0"))], blk)
    return (nxt.filter(F.col("t1").isNotNull())
            .withColumn("keyframe", F.round((F.col("t0") + F.col("t1")) / 2.0, digits)))


def consecutive_gaps(df: DataFrame, keys: Sequence[str], t: str = "t",
                     block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """(keys, t, gap) for each positive step between consecutive stamps."""
    rows = df.select(*keys, F.col(t).alias("t")).filter(F.col("t").isNotNull()).distinct()
    blk = None if block_seconds is None else time_block(F.col("t"), block_seconds)
    return (with_carry(rows, keys, ["t"], [Carry("prev_t", "lag", F.col("t"))], blk)
            .filter(F.col("prev_t").isNotNull())
            .select(*keys, "t", (F.col("t") - F.col("prev_t")).alias("gap")))


def median_interval(df: DataFrame, keys: Sequence[str], t: str = "t", out: str = "interval",
                    block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Upper median of the positive gaps.

    Gaps are counted per distinct value first and the rank is found by ranges of values, so
    a key's series reaches the median neither as a list nor in one task.
    """
    from ..functions.quantiles import select_ranks

    step = consecutive_gaps(df, keys, t, block_seconds)
    freq = step.groupBy(*keys, F.col("gap").alias("x")).agg(F.count("*").alias("n"))
    return select_ranks(freq, keys, {out: lambda total: F.floor(total / 2)}).select(*keys, out)


def gap_statistics(df: DataFrame, keys: Sequence[str], t: str = "t",
                   block_seconds: float | None = BLOCK_SECONDS) -> DataFrame:
    """Count, mean and largest gap between sorted stamps."""
    return (consecutive_gaps(df, keys, t, block_seconds).groupBy(*keys)
            .agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")))


def audio_grid(df: DataFrame, keys: Sequence[str], duration: str = "duration",
               window: float = 0.96, hop: float | None = None) -> DataFrame:
    """Fixed analysis windows laid from 0 over the whole duration; the last may be short."""
    win = max(float(window), 0.05)
    step = max(min(float(hop or win / 2.0), win), 0.01)
    n = F.ceil((F.col(duration) - F.lit(1e-6)) / F.lit(step)).cast("bigint")
    return (df.filter(F.col(duration) > 1e-6)
            .select(*keys, F.col(duration).alias("__d"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
            .select(*keys, "i", F.round(F.col("i") * F.lit(step), 4).alias("t0"),
                    F.round(F.least(F.col("i") * F.lit(step) + F.lit(win), F.col("__d")), 4).alias("t1")))


def window_at(t: Column, window: float = 0.96, hop: float | None = None) -> Column:
    """Index of the grid window that starts nearest below ``t``."""
    step = max(min(float(hop or window / 2.0), float(window)), 0.01)
    return F.greatest(F.lit(0), F.floor(t / F.lit(step))).cast("bigint")


def strided(df: DataFrame, keys: Sequence[str], order: str, stride: int,
            block: Column | None = None) -> DataFrame:
    """Every ``stride``-th row of each key, counted in ``order`` from the first."""
    if stride <= 1:
        return df
    blk = index_block(F.col(order)) if block is None else block
    ranked = with_carry(df, keys, [order], [Carry("__pos", "sum", F.lit(1).cast("bigint"))], blk)
    return ranked.filter(F.col("__pos") % stride == 0).drop("__pos")


def across_cuts(frames: DataFrame, bounds: DataFrame, keys: Sequence[str], t: str = "t",
                bound: str = "b", fallback_interval: float = 0.05,
                cell_seconds: float = 10.0) -> DataFrame:
    """Frames within one frame interval of a boundary, else the single nearest frame.

    One ordered pass over frames and boundaries gives each row its neighbours of the other
    side: a frame lies within the tolerance of some boundary if it does of the nearest one
    before or after it, so no pair is formed however sparse or dense a series is. A block of the
    pass is at least ``cell_seconds`` wide.
    """
    keys = list(keys)
    tol = median_interval(frames, keys, t, "tol")
    b = (bounds.select(*keys, F.col(bound).alias("b")).filter(F.col("b") > 0).distinct()
         .join(tol, keys, "left").withColumn("tol", F.coalesce("tol", F.lit(fallback_interval))))
    f = frames.select(*keys, F.col(t).alias("ft")).filter(F.col("ft").isNotNull()).distinct()
    both = (f.unionByName(b, allowMissingColumns=True).filter(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True)))
            .withColumn("__t", F.coalesce(F.col("ft").cast("double"), F.col("b").cast("double"))).withColumn("__side", F.col("b").isNotNull()))
    both, blk = blocked(both, F.col("__t"), max(cell_seconds, BLOCK_SECONDS))
    cut = F.when(F.col("b").isNotNull(), F.struct("b", "tol"))
    near = with_carry(both, keys, ["__t", "__side"], [Carry("lo", "last", F.col("ft")), Carry("hi", "next", F.col("ft")),
                                                      Carry("below", "last", cut), Carry("above", "next", cut)], blk)
    within = lambda gap, tol: F.coalesce(gap <= tol, F.lit(False))
    close = within(F.col("ft") - F.col("below.b"), F.col("below.tol")) | within(F.col("above.b") - F.col("ft"), F.col("above.tol"))
    met = within(F.col("b") - F.col("lo"), F.col("tol")) | within(F.col("hi") - F.col("b"), F.col("tol"))
    nearest = (F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo"))
               .when(F.col("b") - F.col("lo") <= F.col("hi") - F.col("b"), F.col("lo")).otherwise(F.col("hi")))
    return (near.select(*keys, F.when(F.col("b").isNull(), F.when(close, F.col("ft"))).when(~met, nearest).alias(t))
            .filter(F.col(t).isNotNull()).distinct())


def _successors(cuts: np.ndarray, after: np.ndarray, min_shot: float) -> np.ndarray:
    """Index of the first cut ``min_shot`` past each of ``after``; the subtraction decides, as in a plain loop."""
    at = np.searchsorted(cuts, after + min_shot)
    early = (at > 0) & (cuts[np.maximum(at - 1, 0)] - after >= min_shot)
    at = at - early
    late = (at < len(cuts)) & (cuts[np.minimum(at, len(cuts) - 1)] - after < min_shot)
    return at + late


def _chain_edges(chained: DataFrame, keys: list[str], min_shot: float) -> DataFrame:
    """(keys, edge) kept inside chains: ``chained`` has keys, chain, c, opened and prev_c."""
    width = max(2.0 * min_shot, CELL_SECONDS)
    place = [*keys, "chain", "cell"]
    cells = (chained.withColumn("cell", F.floor(F.col("c") / F.lit(width)))
             .groupBy(*place).agg(F.array_sort(F.collect_list("c")).alias("cuts"),
                                  F.max((F.col("opened") == 1) | F.col("prev_c").isNull()).alias("first")))
    cells = cut_lineage(cells)
    at_zero = F.col("chain") == 0
    # Chain 0 starts from the edge at 0; every later chain starts from its own first cut.
    starts = cells.filter("first").select(*place, "cuts", F.when(at_zero, F.lit(0.0)).alias("after"))
    key_fields = [cells.schema[k] for k in place]

    def opening(row_cuts: np.ndarray, after) -> int:
        return 0 if after is None or np.isnan(after) else int(_successors(row_cuts, np.array([after]), min_shot)[0])

    def walk(batches):
        for pdf in batches:
            kept = []
            for row_cuts, after in zip(pdf["cuts"], pdf["after"]):
                i, out = opening(row_cuts, after), []
                while i < len(row_cuts):
                    out.append(row_cuts[i])
                    i = int(_successors(row_cuts, row_cuts[i:i + 1], min_shot)[0])
                kept.append(out)
            yield pdf[keys].assign(edge=kept)

    def walked(df: DataFrame) -> DataFrame:
        out = StructType([*key_fields[:-2], StructField("edge", ArrayType(DoubleType()))])
        return df.select(*keys, "cuts", "after").mapInPandas(walk, out).select(*keys, F.explode("edge").alias("edge"))

    later = cells.filter(~F.col("first"))
    if later.isEmpty():
        return walked(starts)

    def entries(batches):
        for pdf in batches:
            ins, outs = [], []
            for cell, row_cuts, first, chain in zip(pdf["cell"], pdf["cuts"], pdf["first"], pdf["chain"]):
                if first:
                    i = opening(row_cuts, 0.0 if chain == 0 else None)
                    head = np.arange(i, min(i + 1, len(row_cuts)))
                else:
                    # An edge before the cell is less than a shot before any cut past this one.
                    head = np.arange(min(int(_successors(row_cuts, np.array([cell * width]), min_shot)[0]) + 1, len(row_cuts)))
                step = _successors(row_cuts, row_cuts, min_shot)
                step = np.where(step < len(row_cuts), step, np.arange(len(row_cuts)))
                while not np.array_equal(step[step], step):
                    step = step[step]
                ins.append(row_cuts[head])
                outs.append(row_cuts[step[head]])
            yield pdf[place].assign(ins=ins, outs=outs)

    several = cells.join(later.select(*keys, "chain").distinct(), [*keys, "chain"], "left_semi")
    spans = StructType([*key_fields, StructField("ins", ArrayType(DoubleType())), StructField("outs", ArrayType(DoubleType()))])
    spans = cut_lineage(several.select(*place, "cuts", "first").mapInPandas(entries, spans))

    def pointers(batches):
        for pdf in batches:
            following = []
            for outs, heads in zip(pdf["outs"], pdf["heads"]):
                i = _successors(heads, outs, min_shot) if len(heads) else np.ones(len(outs), dtype=int)
                padded = np.append(heads, np.nan)
                following.append(padded[np.minimum(i, len(heads))])
            yield pdf[[*keys, "chain", "ins"]].assign(following=following)

    ahead = spans.select(*keys, "chain", (F.col("cell") - 1).alias("cell"), F.col("ins").alias("heads"))
    shape = StructType([*key_fields[:-1], StructField("ins", ArrayType(DoubleType())), StructField("following", ArrayType(DoubleType()))])
    hops = (spans.join(ahead, place).mapInPandas(pointers, shape)
            .select(*keys, "chain", F.explode(F.arrays_zip("ins", "following")).alias("z"))
            .select(*keys, "chain", F.col("z.ins").alias("c"), F.col("z.following").alias("to")).filter(~F.isnan("to")))
    node = [*keys, "chain", "c"]
    reached = spans.join(cells.filter("first").select(*place), place, "left_semi").select(*keys, "chain", F.explode("ins").alias("c"))
    hops = cut_lineage(hops)
    while not hops.isEmpty():
        reached = cut_lineage(reached.unionByName(reached.join(hops, node).select(*keys, "chain", F.col("to").alias("c"))).distinct())
        further = hops.select(*keys, "chain", F.col("c").alias("to"), F.col("to").alias("then"))
        hops = cut_lineage(hops.join(further, [*keys, "chain", "to"]).select(*keys, "chain", "c", F.col("then").alias("to")))
    # A cell's own entry is the reached cut in it; the walk starts there.
    inside = (reached.withColumn("cell", F.floor(F.col("c") / F.lit(width))).join(later, place)
              .withColumn("cuts", F.filter("cuts", lambda x: x >= F.col("c"))).withColumn("after", F.lit(None).cast("double")))
    return walked(starts).unionByName(walked(inside))


def merge_cuts(cuts: DataFrame, durations: DataFrame, keys: Sequence[str], cut: str = "cut",
               duration: str = "duration", min_shot: float = 0.25) -> DataFrame:
    """Cut times to shot edges: an edge is kept when ``min_shot`` past the last kept one.

    A cut further than ``min_shot`` from the cut before it is kept whatever happened
    earlier, so the greedy choice only runs inside chains of crowded cuts.  0 and the
    duration are always edges; a last cut too close to the end is dropped.

    A chain is cut into cells of fixed width, at least two shots wide, so an edge's successor
    lies in its own cell or the next. For each cut that may be the first edge of its cell the
    cell gives the last edge that follows from it; these entries and their successors are the
    nodes and pointers of a small graph, whose nodes reachable from the chains' first edges
    are found by pointer doubling, log2 of the longest chain's cells rounds. The cells are
    then walked from their entries, independently. Cuts are whole milliseconds, so a cell
    holds at most 1,000 a second of its width, however many rows its key has.
    """
    keys = list(keys)
    rows = (cuts.join(durations.select(*keys, F.col(duration).alias("dur")), keys)
            .select(*keys, "dur", F.round(F.col(cut), 3).alias("c"))
            .filter((F.col("c") > 0) & (F.col("c") < F.col("dur"))).distinct())
    rows, blk = blocked(rows, F.col("c"), BLOCK_SECONDS)
    linked = with_carry(rows, keys, ["c"], [Carry("prev_c", "lag", F.col("c"))], blk)
    opened = F.coalesce(F.col("c") - F.col("prev_c") >= min_shot, F.lit(False))
    flagged = linked.withColumn("opened", opened.cast("bigint"))
    chained = with_carry(flagged, keys, ["c"], [Carry("prior", "sum", F.col("opened"))],
                         blk).withColumn("chain", F.col("prior") + F.col("opened"))
    inner = _chain_edges(chained, keys, min_shot)
    last = inner.groupBy(*keys).agg(F.max("edge").alias("last_edge"))
    trimmed = (inner.join(last, keys).join(durations.select(*keys, F.col(duration).alias("dur")), keys)
               .filter(~((F.col("edge") == F.col("last_edge")) & (F.col("dur") - F.col("edge") < min_shot)))
               .select(*keys, "edge"))
    ends = durations.select(*keys, F.explode(F.array(F.lit(0.0), F.round(duration, 3))).alias("edge"))
    return trimmed.unionByName(ends).distinct()
