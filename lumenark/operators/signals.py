"""Signal summaries over long series: cuts, motion, colour, loudness, captions, per-frame.

series: (entity_key, t, metric, value).  Each summary emits claim-shaped rows
(entity_key, channel, kind, value, num, shot_idx, ordinal).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from . import sequences as S
from .merge import series_per_interval

# Fixed values.
BLACK_YHIGH = 24.0
STILL_MAFD = 0.05
PALETTE_LEVELS = 6
PALETTE_TOP = 6


def _claims(df: DataFrame, channel: str, parts: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(kind, value, num) expressions of one row each to claim rows; a NULL value emits nothing."""
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value"), n.cast("double").alias("num")) for k, v, n in parts])
    return (df.select("entity_key", F.explode(arr).alias("c")).filter(F.col("c.value").isNotNull())
            .select("entity_key", F.lit(channel).alias("channel"), "c.kind", "c.value", "c.num",
                    F.lit(None).cast("int").alias("shot_idx"), F.lit(None).cast("int").alias("ordinal")))


def cut_rhythm(shots: DataFrame) -> DataFrame:
    """Average shot length, cut rate, rhythm and acceleration per entity."""
    s = shots.filter(F.col("t1") > F.col("t0")).withColumn("len", F.col("t1") - F.col("t0")).withColumn("mid", (F.col("t0") + F.col("t1")) / 2.0)
    a = s.groupBy("entity_key").agg(F.count("*").alias("n"), F.sum("len").alias("dur"), F.avg("len").alias("asl"),
                                    F.stddev_pop("len").alias("sd"), M.slope(F.col("len"), F.col("mid")).alias("slope"))
    # Rounded so that a band never hangs on the order in which partial sums met.
    cv, cpm = F.round(M.cv(F.col("sd"), F.col("asl")), 9), F.round((F.col("n") - 1) / F.col("dur") * 60.0, 9)
    return _claims(a, "style", [
        ("asl", F.format_string("%.2fs average shot", "asl"), F.round("asl", 3)),
        ("cut_rate", F.concat(F.format_string("%.1f cuts/min across %d shot", cpm, F.col("n")), F.when(F.col("n") != 1, "s").otherwise("")), F.round(cpm, 2)),
        ("rhythm", M.named_band("rhythm", cv), F.round(M.regularity(F.col("sd"), F.col("asl")), 4)),
        ("acceleration", M.named_band("acceleration", F.col("slope")), F.round("slope", 5))])


def frame_differences(frames: DataFrame, bounds: DataFrame, t: str = "t", diff: str = "mafd", drop_cuts: bool = True) -> DataFrame:
    """(entity_key, t, mafd) without the first frame and, by default, without frames across a cut."""
    first = frames.groupBy("entity_key").agg(F.min(t).alias("t_first"))
    rows = frames.join(first, "entity_key").filter((F.col(t) > F.col("t_first")) & F.col(diff).isNotNull()).select("entity_key", F.col(t).alias("t"), F.col(diff).alias("mafd"))
    if not drop_cuts:
        return rows
    skip = S.across_cuts(frames.select("entity_key", F.col(t).alias("t")).distinct(), bounds, ["entity_key"], "t", "t0")
    return rows.join(skip, ["entity_key", "t"], "left_anti")


def motion(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Motion energy overall and per shot; two readings are the least that describe motion."""
    d = frame_differences(frames, shots)
    whole = d.groupBy("entity_key").agg(F.count("*").alias("n"), F.round(F.avg("mafd"), 9).alias("e")).filter(F.col("n") >= 2)
    total = _claims(whole, "style", [("motion_energy", M.named_band("motion_energy", F.col("e")), F.round("e", 4))])
    per = series_per_interval(d, shots, "entity_key", "t", "mafd", 2, cell_seconds=10.0).withColumn("mean", F.round("mean", 9))
    return total.unionByName(per.join(whole.select("entity_key"), "entity_key", "left_semi").select(
        "entity_key", F.lit("style").alias("channel"), F.lit("motion_energy").alias("kind"), M.named_band("motion_energy", F.col("mean")).alias("value"),
        F.round("mean", 4).alias("num"), F.col("idx").cast("int").alias("shot_idx"), F.lit(None).cast("int").alias("ordinal")))


def colour(stats: DataFrame) -> DataFrame:
    """Brightness, contrast, saturation and temperature from per-frame luma and chroma readings."""
    a = stats.groupBy("entity_key").agg(*[F.avg(c).alias(c) for c in ("yavg", "ylow", "yhigh", "satavg", "uavg", "vavg")]).filter(F.col("yavg").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bright, contrast = F.col("yavg") / 255.0, zero((F.col("yhigh") - F.col("ylow")) / 255.0)
    sat, temp = zero(F.least(F.lit(1.0), F.col("satavg") / 128.0)), zero((F.col("vavg") - F.col("uavg")) / 255.0)
    return _claims(a, "style", [("brightness", M.named_band("brightness", bright), F.round(bright, 4)), ("contrast", M.named_band("contrast", contrast), F.round(contrast, 4)),
                                ("saturation", M.named_band("saturation", sat), F.round(sat, 4)), ("temperature", M.named_band("temperature", temp), F.round(temp, 5))])


def palette(pixels: DataFrame) -> DataFrame:
    """(entity_key, rank, hex, share): most populated cells of a 6x6x6 grid with their own mean colour."""
    step = 256 // PALETTE_LEVELS + 1
    cell = (F.floor(F.col("r") / step) * PALETTE_LEVELS + F.floor(F.col("g") / step)) * PALETTE_LEVELS + F.floor(F.col("b") / step)
    cells = pixels.groupBy("entity_key", cell.alias("cell")).agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    total = cells.groupBy("entity_key").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("entity_key").orderBy(F.col("n").desc(), F.col("cell").desc())
    top = cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PALETTE_TOP)
    return top.join(total, "entity_key").select("entity_key", "rank", F.lower(F.format_string("#%02x%02x%02x", "r", "g", "b")).alias("hex"),
                                                F.round(F.col("n") / F.col("total"), 4).alias("share"))


def loudness(summary: DataFrame, curve: DataFrame, silences: DataFrame, durations: DataFrame, shots: DataFrame) -> DataFrame:
    """Loudness claims: summary(entity_key, lufs, true_peak, lra), curve(entity_key, t, m), silences(entity_key, t0, t1).

    A range of zero only counts when the momentary curve is flat as well. A reading of minus zero is zero.
    """
    plain = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))
    summary, curve = summary.withColumns({c: plain(c) for c in ("lufs", "true_peak")}), curve.withColumn("m", plain("m"))
    c = curve.groupBy("entity_key").agg(F.stddev_pop("m").alias("spread"), F.max("m").alias("peak_m"))
    closed = silences.join(durations.select("entity_key", "duration"), "entity_key").withColumn("t1", F.coalesce("t1", "duration"))
    q = closed.groupBy("entity_key").agg(F.sum(F.greatest(F.lit(0.0), F.col("t1") - F.col("t0"))).alias("quiet"))
    a = summary.join(c, "entity_key", "left").join(q, "entity_key", "left").join(durations.select("entity_key", "duration"), "entity_key", "left")
    ratio = F.coalesce("quiet", F.lit(0.0)) / F.when(F.col("duration") > 0, F.col("duration"))
    ranged = F.when((F.col("lra") > 0.05) | (F.coalesce("spread", F.lit(0.0)) <= 1.0), F.col("lra"))
    main = _claims(a, "audio", [
        ("lufs", F.when(F.col("lufs").isNotNull(), F.format_string("%.1f LUFS integrated", "lufs")), F.round("lufs", 2)),
        ("true_peak", F.when(F.col("true_peak").isNotNull(), F.concat(F.format_string("%.1f dBTP", "true_peak"), F.when(F.col("true_peak") > -1.0, " — clipping").otherwise(""))), F.round("true_peak", 2)),
        ("dynamic_range", F.when(ranged.isNotNull(), M.named_band("dynamic_range", ranged)), F.round(ranged, 2)),
        ("silence_ratio", F.when(ratio.isNotNull(), F.format_string("%.0f%% below -50 dBFS for 0.3s+", ratio * 100)), F.round(ratio, 4)),
        ("loudness_peak", F.when(F.col("peak_m").isNotNull(), F.format_string("%.1f LUFS momentary", "peak_m")), F.round("peak_m", 2))])
    per = series_per_interval(curve, shots, "entity_key", "t", "m", 1, cell_seconds=10.0).withColumn("mean", F.round("mean", 9)).select(
        "entity_key", F.lit("audio").alias("channel"), F.lit("shot_level").alias("kind"), F.format_string("%.1f LUFS", "mean").alias("value"),
        F.round("mean", 2).alias("num"), F.col("idx").cast("int").alias("shot_idx"), F.lit(None).cast("int").alias("ordinal"))
    return main.unionByName(per)


def caption_claims(cards: DataFrame) -> DataFrame:
    """Caption, hashtags and mentions (first-seen order), uploader and likes as claims."""
    text, who = F.trim(F.coalesce("caption", F.lit(""))), F.trim(F.coalesce("creator", F.lit("")))
    row = lambda kind, v, n: cards.select("entity_key", F.lit("caption").alias("channel"), F.lit(kind).alias("kind"), v.alias("value"), n.alias("num"),
                                          F.lit(None).cast("int").alias("shot_idx"), F.lit(None).cast("int").alias("ordinal")).filter(F.coalesce("value", F.lit("")) != "")
    none = F.lit(None).cast("double")
    many = lambda kind, arr: (cards.select("entity_key", F.posexplode(arr).alias("ordinal", "value")).select(
        "entity_key", F.lit("caption").alias("channel"), F.lit(kind).alias("kind"), "value", none.alias("num"), F.lit(None).cast("int").alias("shot_idx"), "ordinal"))
    parts = [row("caption", text, none), many("hashtag", T.hashtags(text)), many("mention", T.mentions(text)), row("uploader", who, none)]
    if "likes" in cards.columns:
        parts.append(row("likes", F.format_number(F.col("likes").cast("bigint"), 0), F.col("likes").cast("double")))
    return reduce(DataFrame.unionByName, parts)


def per_frame(frames: DataFrame, bounds: DataFrame, block_seconds: float = S.BLOCK_SECONDS) -> DataFrame:
    """Whole-entity means, black frames, freeze spans and the count of frames that changed."""
    a = frames.groupBy("entity_key").agg(
        F.count("*").alias("n"), F.avg("yavg").alias("b"), F.min("yavg").alias("bmin"), F.max("yavg").alias("bmax"),
        F.avg("yhigh").alias("hi"), F.avg("ylow").alias("lo"), F.avg("satavg").alias("sat"), F.avg("uavg").alias("u"), F.avg("vavg").alias("v"),
        F.count_if(F.col("yhigh") < BLACK_YHIGH).alias("black"), F.min(F.when(F.col("yhigh") < BLACK_YHIGH, F.col("t"))).alias("black_t"))
    mot = frame_differences(frames, bounds).groupBy("entity_key").agg(F.avg("mafd").alias("mot"))
    moved = frame_differences(frames, bounds, drop_cuts=False).groupBy("entity_key").agg(F.count_if(F.col("mafd") > STILL_MAFD).alias("moved"))
    j = a.filter(F.col("b").isNotNull()).join(mot, "entity_key", "left").join(moved, "entity_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    plain = lambda kind, v: (kind, F.format_string("%.4f", v), F.round(v, 5))
    uniq = F.coalesce("moved", F.lit(0)) + 1
    main = _claims(j, "style", [
        plain("brightness_mean", F.col("b") / 255), plain("brightness_min", F.col("bmin") / 255), plain("brightness_max", F.col("bmax") / 255),
        plain("contrast_mean", zero((F.col("hi") - F.col("lo")) / 255)), plain("saturation_mean", zero(F.col("sat") / 128)),
        plain("temperature_mean", zero((F.col("v") - F.col("u")) / 255)), plain("motion_mean", zero(F.col("mot"))),
        ("black_frames", F.when(F.col("black") > 0, F.format_string("%d frame(s), first at %.2fs", "black", "black_t")), F.col("black")),
        ("unique_frames", F.format_string("%d of %d frames differ from the one before", uniq, F.col("n")), uniq)])
    spans = S.freeze_spans(frames, ["entity_key"], "t", "mafd", STILL_MAFD, 3, block_seconds)
    w = Window.partitionBy("entity_key").orderBy("t0")
    fr = spans.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int")).select(
        "entity_key", F.lit("style").alias("channel"), F.lit("freeze_spans").alias("kind"), F.format_string("%.2f–%.2fs", "t0", "t1").alias("value"),
        F.round(F.col("t1") - F.col("t0"), 3).alias("num"), F.lit(None).cast("int").alias("shot_idx"), "ordinal")
    longest = spans.groupBy("entity_key").agg(F.max(F.col("t1") - F.col("t0")).alias("l"))
    return main.unionByName(fr).unionByName(_claims(longest, "style", [("longest_freeze", F.format_string("%.2fs", "l"), F.round("l", 3))]))


def foreign_detected(entities: DataFrame, shots: DataFrame, own: str) -> DataFrame:
    """Entities whose intervals no other detector wrote: the ones a detector may fill."""
    other = shots.filter(F.col("detector").isNotNull() & (F.col("detector") != own)).select("entity_key").distinct()
    return entities.join(other, "entity_key", "left_anti")
