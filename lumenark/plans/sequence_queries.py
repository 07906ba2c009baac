"""Interval, run and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import query
from .tables import EVENTS_TIMED_SQL, SLOTS_SQL, events_timed, load, order_slots, vectors, VECTORS_SQL

# Events arrive about every five minutes; a sighting lasts 400 s plus ten times its value.
DAY = 86400.0


def sightings(spark, sf):
    return events_timed(spark, sf).select(
        F.col("user_id").alias("entity_key"), F.col("event_type").alias("kind"),
        F.col("t").alias("t0"), F.round(F.col("t") + 400.0 + F.col("value") * 10.0, 3).alias("t1"),
        "event_id", "value")


SIGHTINGS_SQL = EVENTS_TIMED_SQL + """,
sightings AS (
  SELECT user_id AS entity_key, event_type AS kind, t AS t0,
         round(t + 400.0 + value * 10.0, 3) AS t1, event_id, value FROM ev
)"""

ISLAND_SQL = """
reach AS (
  SELECT *, max(t1) OVER (PARTITION BY {k} ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM {src}
),
marked AS (
  SELECT *, sum(CASE WHEN r IS NULL OR t0 - r > {gap} THEN 1 ELSE 0 END)
            OVER (PARTITION BY {k} ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island
  FROM reach
),
isl AS (
  SELECT {k}, island, min(t0) AS a, max(t1) AS b FROM marked GROUP BY {k}, island
)"""


@query("interval_union_coverage", f"""
WITH {SLOTS_SQL}, {ISLAND_SQL.format(k='entity_key', src='slots', gap='0')}
SELECT entity_key, round(sum(b - a), 4) AS covered FROM isl GROUP BY entity_key""")
def interval_union_coverage(spark, sf):
    return (S.union_seconds(order_slots(spark, sf), ["entity_key"], "t0", "t1", block_seconds=10.0)
            .select("entity_key", F.round("covered", 4).alias("covered")))


@query("interval_islands", f"""
WITH {SIGHTINGS_SQL}, {ISLAND_SQL.format(k='entity_key', src='sightings', gap='60')}
SELECT entity_key, CAST(island AS BIGINT) AS island, a AS t0, b AS t1 FROM isl""")
def interval_islands(spark, sf):
    return S.islands(sightings(spark, sf), ["entity_key"], "t0", "t1", gap=60.0, block_seconds=DAY)


@query("interval_gaps", f"""
WITH {SIGHTINGS_SQL},
dur AS (SELECT entity_key, max(t1) + 1000.0 AS d FROM sightings GROUP BY entity_key),
{ISLAND_SQL.format(k='entity_key', src='sightings', gap='0')},
g AS (
  SELECT entity_key, coalesce(lag(b) OVER (PARTITION BY entity_key ORDER BY a), 0.0) AS t0, a AS t1 FROM isl
  UNION ALL
  SELECT i.entity_key, max(i.b) AS t0, max(d.d) AS t1 FROM isl i JOIN dur d USING (entity_key) GROUP BY i.entity_key
)
SELECT entity_key, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM g WHERE t1 - t0 >= 600""")
def interval_gaps(spark, sf):
    s = sightings(spark, sf)
    dur = s.groupBy("entity_key").agg((F.max("t1") + 1000.0).alias("duration"))
    return (S.gaps(s, ["entity_key"], "t0", "t1", dur, floor=600.0, block_seconds=DAY)
            .select("entity_key", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1")))


@query("run_length_collapse", """
WITH r AS (
  SELECT l_orderkey AS k, l_linenumber AS i, min(l_returnflag) AS v, min(l_linenumber * 2.0) AS t
  FROM lineitem GROUP BY ALL
),
f AS (SELECT *, lag(v) OVER w AS pv, lag(i) OVER w AS pi FROM r WHERE v <> 'N' WINDOW w AS (PARTITION BY k ORDER BY i)),
m AS (SELECT *, sum(CASE WHEN pv = v AND pi + 1 = i THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS o FROM f)
SELECT k AS entity_key, CAST(o AS BIGINT) AS ordinal, CAST(min(i) AS BIGINT) AS lo, CAST(max(i) AS BIGINT) AS hi,
       CAST(min(t) AS DOUBLE) AS t0, CAST(max(t) AS DOUBLE) AS t1, min(v) AS value
FROM m GROUP BY k, o""")
def run_length_collapse(spark, sf):
    series = (load(spark, sf, "lineitem")
              .groupBy(F.col("l_orderkey").alias("entity_key"), F.col("l_linenumber").cast("bigint").alias("idx"))
              .agg(F.min("l_returnflag").alias("value"))
              .withColumn("t", F.col("idx") * 2.0)
              .withColumn("value", F.when(F.col("value") != "N", F.col("value"))))
    return S.frame_runs(series, ["entity_key"], block_rows=4)


@query("window_run_collapse", f"""
WITH {EVENTS_TIMED_SQL},
w AS (SELECT user_id AS k, CAST(floor(t / 3600) AS BIGINT) AS i, CASE WHEN count(*) > 1 THEN 'busy' ELSE 'calm' END AS v
      FROM ev GROUP BY ALL),
f AS (SELECT *, lag(v) OVER q AS pv, lag(i) OVER q AS pi FROM w WINDOW q AS (PARTITION BY k ORDER BY i)),
m AS (SELECT *, sum(CASE WHEN pv = v AND pi + 1 = i THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS o FROM f)
SELECT k AS entity_key, CAST(o AS BIGINT) AS ordinal, min(i) AS lo, max(i) AS hi,
       CAST(min(i) * 3600.0 AS DOUBLE) AS t0, CAST(max(i) * 3600.0 + 3600.0 AS DOUBLE) AS t1, min(v) AS value
FROM m GROUP BY k, o""")
def window_run_collapse(spark, sf):
    w = (events_timed(spark, sf)
         .groupBy(F.col("user_id").alias("entity_key"), F.floor(F.col("t") / 3600).cast("bigint").alias("idx"))
         .agg(F.count("*").alias("n"))
         .select("entity_key", "idx", (F.col("idx") * 3600.0).alias("a"), (F.col("idx") * 3600.0 + 3600.0).alias("b"),
                 F.when(F.col("n") > 1, "busy").otherwise("calm").alias("value")))
    return S.frame_runs(w, ["entity_key"], t_lo="a", t_hi="b")


@query("freeze_spans", f"""
WITH {EVENTS_TIMED_SQL},
d AS (SELECT user_id AS k, t, value AS d, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt FROM ev),
e AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS et,
             sum(CASE WHEN d <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
      FROM d WHERE pt IS NOT NULL)
SELECT k AS entity_key, round(min(coalesce(et, t)), 3) AS t0, round(max(t), 3) AS t1, count(*) AS frames
FROM e WHERE d <= 30 GROUP BY k, g HAVING count(*) >= 3""")
def freeze_spans(spark, sf):
    rows = events_timed(spark, sf).select(F.col("user_id").alias("entity_key"), "t", F.col("value").alias("mafd"))
    return S.freeze_spans(rows, ["entity_key"], still=30.0, block_seconds=DAY)


@query("median_interval", f"""
WITH {EVENTS_TIMED_SQL},
g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM (SELECT DISTINCT user_id, t FROM ev)),
r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS rn,
             count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap IS NOT NULL)
SELECT user_id, round(gap, 3) AS gap_s FROM r WHERE rn = n // 2 + 1""")
def median_interval(spark, sf):
    return (S.median_interval(events_timed(spark, sf), ["user_id"], block_seconds=DAY)
            .select("user_id", F.round("interval", 3).alias("gap_s")))


@query("gap_statistics", f"""
WITH {EVENTS_TIMED_SQL},
g AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS gap FROM (SELECT DISTINCT event_type, t FROM ev))
SELECT event_type, count(gap) AS gaps, round(avg(gap), 4) AS mean_gap, round(max(gap), 3) AS max_gap FROM g GROUP BY event_type""")
def gap_statistics(spark, sf):
    return (S.gap_statistics(events_timed(spark, sf), ["event_type"], block_seconds=DAY)
            .select("event_type", "gaps", F.round("mean_gap", 4).alias("mean_gap"), F.round("max_gap", 3).alias("max_gap")))


@query("edges_to_intervals", f"""
WITH {EVENTS_TIMED_SQL},
e AS (SELECT DISTINCT user_id, t AS t0 FROM ev),
n AS (SELECT *, lead(t0) OVER (PARTITION BY user_id ORDER BY t0) AS t1 FROM e)
SELECT user_id, t0, t1, round((t0 + t1) / 2.0, 4) AS keyframe FROM n WHERE t1 IS NOT NULL""")
def edges_to_intervals(spark, sf):
    return S.edges_to_intervals(events_timed(spark, sf), ["user_id"], edge="t", digits=4, block_seconds=DAY)


@query("merged_cuts", f"""
WITH RECURSIVE {EVENTS_TIMED_SQL},
dur AS (SELECT user_id, max(t) + 100.0 AS d FROM ev GROUP BY user_id),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn
      FROM (SELECT DISTINCT e.user_id, round(e.t, 3) AS t FROM ev e JOIN dur USING (user_id) WHERE e.t > 0 AND e.t < d)),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0.0 AS DOUBLE) AS last, CAST(0.0 AS DOUBLE) AS edge FROM dur
  UNION ALL
  SELECT w.user_id, c.rn, CASE WHEN c.t - w.last >= 3600 THEN c.t ELSE w.last END,
         CASE WHEN c.t - w.last >= 3600 THEN c.t END
  FROM walk w JOIN c ON c.user_id = w.user_id AND c.rn = w.rn + 1
),
kept AS (SELECT user_id, edge FROM walk WHERE edge IS NOT NULL AND rn > 0),
lastk AS (SELECT user_id, max(edge) AS m FROM kept GROUP BY user_id)
SELECT k.user_id, k.edge FROM kept k JOIN lastk USING (user_id) JOIN dur USING (user_id)
WHERE NOT (k.edge = m AND d - k.edge < 3600)
UNION SELECT user_id, 0.0 FROM dur UNION SELECT user_id, round(d, 3) FROM dur""")
def merged_cuts(spark, sf):
    ev = events_timed(spark, sf)
    dur = ev.groupBy("user_id").agg((F.max("t") + 100.0).alias("duration"))
    return S.merge_cuts(ev, dur, ["user_id"], cut="t", min_shot=3600.0)


@query("asof_frame", f"""
WITH {EVENTS_TIMED_SQL},
marks AS (SELECT user_id, t AS mt, event_id AS frame FROM ev WHERE event_type = 'view'),
pts AS (SELECT user_id, t, event_id FROM ev WHERE event_type = 'purchase'),
first AS (SELECT user_id, arg_min(frame, mt) AS f0 FROM marks GROUP BY user_id)
SELECT p.user_id, p.event_id, p.t, coalesce(m.frame, first.f0) AS frame
FROM pts p ASOF LEFT JOIN marks m ON p.user_id = m.user_id AND p.t >= m.mt
LEFT JOIN first ON first.user_id = p.user_id""")
def asof_frame(spark, sf):
    ev = events_timed(spark, sf)
    marks = ev.filter("event_type = 'view'").select("user_id", F.col("t").alias("mt"), F.col("event_id").alias("frame"))
    pts = ev.filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    return S.as_of(pts, marks, ["user_id"], "t", "mt", "frame", "frame", block_seconds=DAY)


@query("audio_grid", """
WITH d AS (SELECT o_orderkey AS k, round(o_totalprice / 50000.0, 2) AS dur FROM orders),
g AS (SELECT k, dur, unnest(range(0, CAST(ceil((dur - 1e-6) / 0.48) AS BIGINT))) AS i FROM d WHERE dur > 1e-6)
SELECT k AS o_orderkey, i, round(i * CAST(0.48 AS DOUBLE), 4) AS t0,
       round(least(i * CAST(0.48 AS DOUBLE) + CAST(0.96 AS DOUBLE), dur), 4) AS t1 FROM g""")
def audio_grid(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 50000.0, 2).alias("duration"))
    return S.audio_grid(d, ["o_orderkey"])


@query("strided_sample", f"""
WITH {VECTORS_SQL},
r AS (SELECT entity_key, frame_idx, row_number() OVER (PARTITION BY entity_key ORDER BY frame_idx) - 1 AS p FROM vec)
SELECT entity_key, frame_idx FROM r WHERE p % 7 = 0""")
def strided_sample(spark, sf):
    return S.strided(vectors(spark, sf).select("entity_key", "frame_idx"), ["entity_key"], "frame_idx", 7)


@query("across_cut_frames", f"""
WITH {EVENTS_TIMED_SQL},
f AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type <> 'error'),
b AS (SELECT DISTINCT user_id, t AS b FROM ev WHERE event_type = 'error' AND t > 0),
g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM f),
r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap IS NOT NULL),
tol AS (SELECT user_id, gap AS tol FROM r WHERE rn = n // 2 + 1),
pairs AS (SELECT b.user_id, b.b, f.t, abs(f.t - b.b) AS d, coalesce(tol.tol, 0.05) AS tol
          FROM b JOIN f USING (user_id) LEFT JOIN tol USING (user_id)),
near AS (SELECT * FROM pairs WHERE d <= tol),
lone AS (SELECT user_id, b, arg_min(t, d) AS t FROM pairs p
         WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.user_id = p.user_id AND n.b = p.b) GROUP BY user_id, b)
SELECT user_id, t FROM near UNION SELECT user_id, t FROM lone""")
def across_cut_frames(spark, sf):
    ev = events_timed(spark, sf)
    frames = ev.filter("event_type <> 'error'").select("user_id", "t").distinct()
    bounds = ev.filter("event_type = 'error'").select("user_id", F.col("t").alias("b"))
    return S.across_cuts(frames, bounds, ["user_id"], cell_seconds=36000.0)
