"""Scoring and banding arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def dot_literal(a: Column, q: Sequence[float]) -> Column:
    """Dot product with a fixed vector, unrolled so that it stays in generated code."""
    total = F.lit(0.0)
    for i, x in enumerate(q):
        total = total + F.get(a, F.lit(i)).cast("double") * F.lit(float(x))
    return total


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def rrf(rank: Column, k: int = RRF_K, weight: float = 1.0) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def bm25_term(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column,
              k1: float = 1.2, b: float = 0.75) -> Column:
    """Okapi term weight; idf is floored so a term in most documents cannot subtract."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def prominence(span: Column, duration: Column) -> Column:
    """1.0 to 1.6 by the share of the entity a fact held; a minute stands in for no duration."""
    known = F.least(F.lit(1.0), span / duration)
    unknown = F.least(F.lit(1.0), F.log1p(span) / F.lit(math.log1p(60.0)))
    share = F.when(F.coalesce(duration, F.lit(0.0)) > 0, known).otherwise(unknown)
    return F.when(F.coalesce(span, F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(1.0 + 0.6 * share)


def certainty(conf: Column) -> Column:
    return F.when(conf.isNull(), F.lit(1.0)).otherwise(
        0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf.cast("double"))))


def band(x: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the first ascending cut that ``x`` lies under, else the last name."""
    out = None
    for c, n in zip(cuts, names):
        out = F.when(x < c, n) if out is None else out.when(x < c, n)
    return out.otherwise(names[-1])


# Band edges and names per measurement.
BANDS = {
    "rhythm": ((0.15, 0.4, 0.8), ("metronomic", "even", "varied", "erratic")),
    "acceleration": ((-0.005, 0.005), ("accelerating", "steady", "decelerating")),
    "motion_energy": ((0.6, 2.0, 6.0), ("still", "gentle", "active", "frenetic")),
    "brightness": ((0.25, 0.45, 0.65), ("dark", "low-key", "balanced", "bright")),
    "contrast": ((0.25, 0.5, 0.72), ("flat", "soft", "punchy", "harsh")),
    "saturation": ((0.12, 0.28, 0.5), ("desaturated", "muted", "saturated", "vivid")),
    "temperature": ((-0.02, 0.02), ("cool", "neutral", "warm")),
    "dynamic_range": ((3.0, 8.0, 15.0), ("compressed", "controlled", "dynamic", "wide")),
}


def named_band(kind: str, x: Column) -> Column:
    return band(x, *BANDS[kind])


def cv(sd: Column, mean: Column) -> Column:
    return F.when(mean > 1e-9, sd / mean).otherwise(F.lit(0.0))


def regularity(sd: Column, mean: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cv(sd, mean)))


def slope(y: Column, x: Column) -> Column:
    """OLS slope of y on x; 0 under three points or without spread in x."""
    spread = F.regr_sxx(y, x)
    return F.when((F.regr_count(y, x) >= 3) & (spread >= 1e-12), F.regr_slope(y, x)).otherwise(F.lit(0.0))


# The five slots of a beat sheet, as shares of the duration.
SLOTS = (("Hook", 0.12), ("Setup", 0.35), ("Turn", 0.60), ("Payoff", 0.85), ("Close", 1.0))


def slot_of(mid: Column, duration: Column) -> Column:
    """Slot by the midpoint's share of the duration; NULL without a duration."""
    pos = F.least(F.lit(0.999999), F.greatest(F.lit(0.0), mid / duration))
    return F.when(duration > 0, band(pos, [c for _, c in SLOTS[:-1]], [n for n, _ in SLOTS]))


def shortfall(decoded: Column, duration: Column, fps: Column) -> Column:
    """Share of the expected frames that never decoded."""
    expected = duration * fps
    return F.when((expected >= 1.0) & (decoded >= 0), F.greatest(F.lit(0.0), 1.0 - decoded / expected)).otherwise(F.lit(0.0))


def backoff_seconds(attempt: Column, base: float = 60.0, ceiling: float = 3600.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(ceiling))
