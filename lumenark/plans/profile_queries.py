"""Structure-profile and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import five_numbers, percentiles
from ..functions import maths as M
from ..operators import profile as P
from ..operators import signals as G
from .registry import query
from .tables import EVENTS_TIMED_SQL, events_timed, load

# Conversations as reels: users speak, assistants narrate, anything else is meta; a turn
# lasts as long as its text, and one turn in five has no place on the clock.


def moments(spark, sf):
    c = load(spark, sf, "conversations")
    start = F.when(F.col("turn") % 5 != 4, F.col("turn") * 2.0)
    return c.select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("conv_id").alias("entity_key"), start.alias("t_start"),
        (start + F.round(F.length("text") / 64.0, 3)).alias("t_end"),
        F.when(F.col("role") == "user", "speech").when(F.col("role") == "assistant", "narrative").otherwise("meta").alias("source"),
        (1.0 + F.length("text") % 7).alias("weight"), "text")


def shots(spark, sf):
    li = load(spark, sf, "lineitem").filter("l_quantity > 0").groupBy(F.col("l_orderkey").alias("entity_key"), F.col("l_linenumber").alias("idx")).agg(F.max("l_quantity").alias("q"))
    return li.select("entity_key", "idx", ((F.col("idx") - 1) * 3.0).alias("t0"), ((F.col("idx") - 1) * 3.0 + F.col("q") / 10.0).alias("t1"))


def entities(spark, sf):
    c = load(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("entity_key")).agg((F.max("turn") * 2.0 + 4.0).alias("duration"))


BASE_SQL = """
mo AS (SELECT conv_id * 10000 + turn AS id, conv_id AS entity_key, CASE WHEN turn % 5 <> 4 THEN CAST(turn * 2.0 AS DOUBLE) END AS t_start,
         CASE WHEN turn % 5 <> 4 THEN turn * CAST(2.0 AS DOUBLE) + round(length(text) / CAST(64.0 AS DOUBLE), 3) END AS t_end,
         CASE role WHEN 'user' THEN 'speech' WHEN 'assistant' THEN 'narrative' ELSE 'meta' END AS source,
         CAST(1.0 + length(text) % 7 AS DOUBLE) AS weight, text,
         len(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{M}]*')) AS wc FROM conversations),
sh AS (SELECT l_orderkey AS entity_key, l_linenumber AS idx, CAST((l_linenumber - 1) * 3.0 AS DOUBLE) AS t0,
         (l_linenumber - 1) * CAST(3.0 AS DOUBLE) + max(l_quantity) / CAST(10.0 AS DOUBLE) AS t1 FROM lineitem WHERE l_quantity > 0 GROUP BY l_orderkey, l_linenumber),
en AS (SELECT conv_id AS entity_key, CAST(max(turn) * 2.0 + 4.0 AS DOUBLE) AS duration FROM conversations GROUP BY 1),
tm AS (SELECT * REPLACE (greatest(t_end, t_start) AS t_end) FROM mo WHERE t_start IS NOT NULL)"""

COVER = """{name} AS (SELECT {k}, sum(greatest(0, {b} - greatest({a}, coalesce(r, {a})))) AS covered FROM (
  SELECT *, max({b}) OVER (PARTITION BY {k} ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {src}) GROUP BY {k})"""


@query("pacing", f"""
WITH {BASE_SQL}, {COVER.format(name='cv', k='entity_key', a='t0', b='t1', src='sh')},
s AS (SELECT *, t1 - t0 AS len FROM sh),
a AS (SELECT entity_key, count(*) AS shots, round(quantile_cont(len, 0.5), 3) AS median, round(quantile_cont(len, 0.9), 3) AS p90,
        stddev_pop(len) / avg(len) AS cv, max(t1) AS far, arg_max(t0, struct_pack(a := round(len, 9), b := -t0)) AS hold_t0, max(len) AS hold_len FROM s GROUP BY 1)
SELECT entity_key, shots, round((shots - 1) / (coalesce(duration, far) / 60), 2) AS cuts_per_min, round(greatest(0, least(1, 1 - round(cv, 3))), 3) AS regularity,
  median, p90, round(hold_t0, 2) AS hold_t0, round(covered, 3) AS covered_s
FROM a JOIN cv USING (entity_key) LEFT JOIN en USING (entity_key)""")
def pacing(spark, sf):
    return P.pacing(shots(spark, sf), entities(spark, sf), block_seconds=6.0).select(
        "entity_key", "shots", "cuts_per_min", "regularity", "median", "p90", "hold_t0", "covered_s")


@query("channel_table", f"""
WITH {BASE_SQL}, {COVER.format(name='cv', k='entity_key, source', a='t_start', b='t_end', src='tm')},
c AS (SELECT entity_key, source, count(*) AS moments, CAST(sum(wc) AS BIGINT) AS words, sum(length(text)) AS chars, round(sum(weight), 2) AS weight,
        round(min(t_start), 2) AS first_at FROM mo GROUP BY ALL)
SELECT entity_key, source, moments, words, CAST(chars AS BIGINT) AS chars, weight, first_at, round(coalesce(covered, 0), 3) AS covered_s
FROM c LEFT JOIN cv USING (entity_key, source)""")
def channel_table(spark, sf):
    return P.channels(moments(spark, sf), entities(spark, sf), 30.0).select("entity_key", "source", "moments", "words", "chars", "weight", "first_at", "covered_s")


TIMELINE_SQL = BASE_SQL + """,
reach AS (SELECT *, max(t_end) OVER (PARTITION BY entity_key, source ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tm),
mk AS (SELECT *, sum(CASE WHEN r IS NULL OR t_start - r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_key, source ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS g FROM reach),
isl AS (SELECT entity_key, source, min(t_start) AS a, max(t_end) AS b FROM mk GROUP BY entity_key, source, g),
cell AS (SELECT i.*, duration / 96 AS w, CAST(k AS INTEGER) AS bin FROM isl i JOIN en USING (entity_key), range(0, 96) t(k)),
tl AS (SELECT entity_key, source, bin, least(1.0, sum(greatest(0, least(b, (bin + 1) * w) - greatest(a, bin * w)) / w)) AS occ FROM cell
       WHERE least(b, (bin + 1) * w) > greatest(a, bin * w) GROUP BY ALL)"""


@query("timeline_bins", f"WITH {TIMELINE_SQL} SELECT entity_key, source, bin, round(occ, 5) AS occ FROM tl WHERE round(occ, 5) > 0")
def timeline_bins(spark, sf):
    return P.timeline(moments(spark, sf), entities(spark, sf), block_seconds=40.0).withColumn("occ", F.round("occ", 5)).filter("occ > 0")


@query("segments")
def segments(spark, sf):
    e = entities(spark, sf)
    return P.sections(P.timeline(moments(spark, sf), e), e)


@query("hook_profile", f"""
WITH {BASE_SQL},
x AS (SELECT tm.*, least(3.0, duration) AS win FROM tm JOIN en USING (entity_key)),
a AS (SELECT entity_key, count(*) FILTER (t_start < win AND t_end > 0) AS moments,
        string_agg(DISTINCT source, ',' ORDER BY source) FILTER (t_start < win AND t_end > 0) AS channels,
        CAST(sum(CASE WHEN t_start < win AND t_end > 0 AND source IN ('speech', 'narrative') AND trim(text) <> '' THEN wc ELSE 0 END) AS BIGINT) AS words,
        round(min(t_start) FILTER (source = 'speech'), 2) AS first_speech_at, NOT bool_or(t_start <= 0.25 AND t_end > 0) AS silent_open FROM x GROUP BY 1),
c AS (SELECT entity_key, count(*) FILTER (t0 > 0 AND t0 < least(3.0, duration)) AS cuts FROM sh JOIN en USING (entity_key) GROUP BY 1)
SELECT entity_key, coalesce(moments, 0) AS moments, coalesce(channels, '') AS channels, coalesce(words, 0) AS words, first_speech_at, silent_open, coalesce(cuts, 0) AS cuts
FROM en LEFT JOIN a USING (entity_key) LEFT JOIN c USING (entity_key)""")
def hook_profile(spark, sf):
    return P.hook(moments(spark, sf), shots(spark, sf), entities(spark, sf)).select("entity_key", "moments", "channels", "words", "first_speech_at", "silent_open", "cuts")


@query("evidence_gaps", f"""
WITH {TIMELINE_SQL},
j AS (SELECT entity_key, source, t_start, t_end FROM tm WHERE t_end > t_start),
r2 AS (SELECT *, max(t_end) OVER (PARTITION BY entity_key ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM j),
g AS (SELECT entity_key, coalesce(r, 0) AS t0, t_start AS t1 FROM r2
      UNION ALL SELECT entity_key, coalesce((SELECT max(t_end) FROM j WHERE j.entity_key = en.entity_key), 0), duration FROM en)
SELECT entity_key, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM g WHERE t1 - t0 >= 1.5""")
def evidence_gaps(spark, sf):
    return P.evidence_gaps(moments(spark, sf), entities(spark, sf), block_seconds=20.0).select("entity_key", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("evidence_density", f"""
WITH {BASE_SQL}
SELECT entity_key, CAST(sum(CASE WHEN source = 'speech' THEN wc ELSE 0 END) AS BIGINT) AS words, count(DISTINCT source) AS channels_used,
  round(sum(CASE WHEN source = 'speech' THEN wc ELSE 0 END) / max(duration), 2) AS words_per_s FROM mo JOIN en USING (entity_key) GROUP BY 1""")
def evidence_density(spark, sf):
    return P.density(moments(spark, sf), entities(spark, sf)).select("entity_key", "words", "channels_used", "words_per_s")


@query("five_number_summary", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 1) AS mean, round(quantile_cont(l_extendedprice, 0.5), 1) AS median,
  round(quantile_cont(l_extendedprice, 0.1), 1) AS p10, round(quantile_cont(l_extendedprice, 0.9), 1) AS p90, round(stddev_pop(l_extendedprice), 1) AS sd,
  round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 3) AS cv FROM lineitem GROUP BY 1""")
def five_number_summary(spark, sf):
    return five_numbers(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 3).select(
        "l_returnflag", "n", *[F.round(c, 1).alias(c) for c in ("mean", "median", "p10", "p90", "sd")], "cv")


@query("percentile_points", """
SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.01), 4) AS p1, round(quantile_cont(c_acctbal, 1.0 / 3), 4) AS third, round(quantile_cont(c_acctbal, 0.99), 4) AS p99 FROM customer GROUP BY 1""")
def percentile_points(spark, sf):
    q = percentiles(load(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", {"p1": 0.01, "third": 1 / 3, "p99": 0.99})
    return q.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("p1", "third", "p99")])


@query("ols_slope_regularity", """
SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) >= 3 AND regr_sxx(l_quantity, l_linenumber) >= 1e-12 THEN regr_slope(l_quantity, l_linenumber) ELSE 0 END, 6) AS slope,
  round(greatest(0, least(1, 1 - stddev_pop(l_quantity) / avg(l_quantity))), 5) AS regularity FROM lineitem GROUP BY 1""")
def ols_slope_regularity(spark, sf):
    a = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.round(M.slope(F.col("l_quantity"), F.col("l_linenumber").cast("double")), 6).alias("slope"),
        F.round(M.regularity(F.stddev_pop("l_quantity"), F.avg("l_quantity")), 5).alias("regularity"))
    return a


@query("tertile_archetypes", """
WITH r AS (SELECT o_custkey AS k, round(avg(o_totalprice), 2) AS pace, count(*) * 1.0 AS talk, max(o_orderkey) AS m FROM orders GROUP BY 1),
e AS (SELECT round(quantile_cont(pace, 1.0 / 3), 2) AS pl, round(quantile_cont(pace, 2.0 / 3), 2) AS ph, round(quantile_cont(CAST(talk AS DOUBLE), 1.0 / 3), 2) AS tl, round(quantile_cont(CAST(talk AS DOUBLE), 2.0 / 3), 2) AS th FROM r),
b AS (SELECT k, m, CASE WHEN pace < pl THEN 'slow' WHEN pace < ph THEN 'steady' ELSE 'fast' END AS pace, CASE WHEN talk < tl THEN 'quiet' WHEN talk < th THEN 'mixed' ELSE 'talky' END AS talk FROM r, e)
SELECT pace, talk, count(*) AS n, (SELECT string_agg(k, ',' ORDER BY m DESC) FROM (SELECT CAST(k AS VARCHAR) AS k, m FROM b x WHERE x.pace = b.pace AND x.talk = b.talk ORDER BY m DESC LIMIT 3)) AS examples FROM b GROUP BY pace, talk""")
def tertile_archetypes(spark, sf):
    r = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_key")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("pace_x"), F.count("*").cast("double").alias("talk_x"), F.max("o_orderkey").alias("m"))
    a = P.archetypes(r, "pace_x", "talk_x", "m")
    return a.select("pace", "talk", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


GRAM_SQL = """
st AS (SELECT unnest(string_split('{stop}', ' ')) AS w),
tok AS (SELECT {key} AS g, regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*') AS ws FROM {src}),
pos AS (SELECT g, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok),
g1 AS (SELECT g, ws[i] AS term FROM pos WHERE length(ws[i]) >= 3 AND ws[i] NOT IN (SELECT w FROM st)),
g2 AS (SELECT g, ws[i] || ' ' || ws[i + 1] AS term FROM pos WHERE i + 1 <= len(ws) AND NOT (ws[i] IN (SELECT w FROM st) AND ws[i + 1] IN (SELECT w FROM st))),
g3 AS (SELECT g, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS term FROM pos WHERE i + 2 <= len(ws)
       AND NOT (ws[i] IN (SELECT w FROM st) AND ws[i + 1] IN (SELECT w FROM st) AND ws[i + 2] IN (SELECT w FROM st))),
terms AS (SELECT g, term, count(*) AS n FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3) GROUP BY ALL)"""
STOP_TEXT = " ".join(P.GRAM_STOP).replace("'", "''")
LIFT_EXPR = """round((ln((y_in + 0.3 * (y_in + y_out)) / (n_in + 0.3 * (n_in + n_out) - (y_in + 0.3 * (y_in + y_out))))
  - ln((y_out + 0.3 * (y_in + y_out)) / (n_out + 0.3 * (n_in + n_out) - (y_out + 0.3 * (y_in + y_out)))))
  / sqrt(1 / (y_in + 0.3 * (y_in + y_out)) + 1 / (y_out + 0.3 * (y_in + y_out))), 3)"""


@query("phrase_lift", f"""
WITH src AS (SELECT quality AS q, text FROM documents JOIN labels USING (doc_id)),
{GRAM_SQL.format(stop=STOP_TEXT, key='q', src='src')},
t AS (SELECT term, coalesce(sum(n) FILTER (g = 1), 0) AS y_in, coalesce(sum(n) FILTER (g <> 1), 0) AS y_out FROM terms GROUP BY 1),
s AS (SELECT CAST(sum(y_in) AS DOUBLE) AS n_in, CAST(sum(y_out) AS DOUBLE) AS n_out FROM t)
SELECT term, {LIFT_EXPR} AS z, CAST(y_in AS BIGINT) AS n_in, CAST(y_out AS BIGINT) AS n_out FROM t, s WHERE y_in + y_out >= 3 AND y_in > 0
ORDER BY 2 DESC, term LIMIT 18""")
def phrase_lift(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return P.lift(P.term_rows(d, "quality"), "quality", 1).select("term", "z", "n_in", "n_out")


@query("beat_slots", f"""
WITH {BASE_SQL},
x AS (SELECT tm.*, duration, least(0.999999, greatest(0, (t_start + t_end) / 2 / duration)) AS p FROM tm JOIN en USING (entity_key) WHERE duration > 0),
y AS (SELECT *, CASE WHEN p < 0.12 THEN 'Hook' WHEN p < 0.35 THEN 'Setup' WHEN p < 0.60 THEN 'Turn' WHEN p < 0.85 THEN 'Payoff' ELSE 'Close' END AS slot FROM x)
SELECT slot, source, count(*) AS n, round(sum(t_end - t_start), 3) AS seconds FROM y GROUP BY ALL""")
def beat_slots(spark, sf):
    return P.beat_slots(moments(spark, sf), entities(spark, sf)).groupBy("slot", "source").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 3).alias("seconds"))


BEAT_SQL = BASE_SQL + """,
x AS (SELECT tm.*, duration, least(0.999999, greatest(0, (t_start + t_end) / 2 / duration)) AS p FROM tm JOIN en USING (entity_key) WHERE duration > 0),
y AS (SELECT *, CASE WHEN p < 0.12 THEN 'Hook' WHEN p < 0.35 THEN 'Setup' WHEN p < 0.60 THEN 'Turn' WHEN p < 0.85 THEN 'Payoff' ELSE 'Close' END AS slot FROM x)"""


@query("beat_leads", f"""
WITH {BEAT_SQL},
s AS (SELECT slot, entity_key, source, round(sum(t_end - t_start), 9) AS sec FROM y GROUP BY ALL),
l AS (SELECT slot, entity_key, source FROM s QUALIFY row_number() OVER (PARTITION BY slot, entity_key ORDER BY sec DESC, source DESC) = 1),
v AS (SELECT slot, source, count(*) AS n FROM l GROUP BY ALL)
SELECT slot, source, n, CAST(sum(n) OVER (PARTITION BY slot) AS BIGINT) AS voters, round(n / sum(n) OVER (PARTITION BY slot), 3) AS rate FROM v""")
def beat_leads(spark, sf):
    return P.beat_sheet(moments(spark, sf), shots(spark, sf), entities(spark, sf))["leads"]


@query("beat_citations", f"""
WITH {BEAT_SQL},
o AS (SELECT * FROM y WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY slot, entity_key ORDER BY weight DESC, id) = 1)
SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY weight DESC, id) AS pos, entity_key, id FROM o QUALIFY pos <= 3""")
def beat_citations(spark, sf):
    c = P.beat_sheet(moments(spark, sf), shots(spark, sf), entities(spark, sf))["citations"]
    return c.select("slot", F.col("pos").cast("bigint").alias("pos"), "entity_key", "id")


@query("beat_numbers", f"""
WITH {BEAT_SQL},
u AS (SELECT DISTINCT entity_key, duration FROM y),
sl AS (SELECT * FROM (VALUES ('Hook', 0.0, 0.12), ('Setup', 0.12, 0.35), ('Turn', 0.35, 0.60), ('Payoff', 0.60, 0.85), ('Close', 0.85, 1.0)) v(slot, a, b)),
w AS (SELECT entity_key, slot, CAST(sum(wc) AS BIGINT) AS words FROM y WHERE trim(text) <> '' GROUP BY ALL),
per AS (SELECT u.entity_key, sl.slot, coalesce(words, 0) AS words, (SELECT count(*) FROM sh WHERE sh.entity_key = u.entity_key AND t0 / duration > a AND t0 / duration < b) AS cuts
        FROM u CROSS JOIN sl LEFT JOIN w ON w.entity_key = u.entity_key AND w.slot = sl.slot)
SELECT slot, count(*) AS n, round(quantile_cont(CAST(words AS DOUBLE), 0.5), 3) AS words, round(avg(cuts), 3) AS mean_cuts FROM per GROUP BY slot""")
def beat_numbers(spark, sf):
    b = P.beat_sheet(moments(spark, sf), shots(spark, sf), entities(spark, sf))
    return b["words"].select("slot", "n", F.col("median").alias("words")).join(b["cuts"].select("slot", F.col("mean").alias("mean_cuts")), "slot")


@query("beat_phrases", f"""
WITH {BEAT_SQL},
{GRAM_SQL.format(stop=STOP_TEXT, key='slot', src='y')},
a AS (SELECT term, sum(n) AS all_n FROM terms GROUP BY 1), gs AS (SELECT g, CAST(sum(n) AS DOUBLE) AS n_in FROM terms GROUP BY 1), tt AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM terms),
q AS (SELECT terms.g AS slot, term, n AS y_in, all_n - n AS y_out, n_in, total - n_in AS n_out FROM terms JOIN a USING (term) JOIN gs ON gs.g = terms.g, tt),
z AS (SELECT slot, term, {LIFT_EXPR} AS z FROM q WHERE y_in + y_out >= 3)
SELECT slot, term, z, row_number() OVER (PARTITION BY slot ORDER BY z DESC, term) AS rank FROM z QUALIFY rank <= 8""")
def beat_phrases(spark, sf):
    p = P.beat_sheet(moments(spark, sf), shots(spark, sf), entities(spark, sf))["phrases"]
    return p.select("slot", "term", "z", F.col("rank").cast("bigint").alias("rank"))


@query("beat_outline")
def beat_outline(spark, sf):
    return P.outline(P.beat_sheet(moments(spark, sf), shots(spark, sf), entities(spark, sf)))


@query("hook_openings", f"""
WITH {BASE_SQL},
x AS (SELECT tm.*, least(3.0, duration) AS win FROM tm JOIN en USING (entity_key)),
able AS (SELECT count(DISTINCT entity_key) AS n FROM x),
o AS (SELECT source, count(DISTINCT entity_key) AS n FROM x WHERE t_start <= 0.25 AND t_end > 0 GROUP BY 1),
cv AS (SELECT entity_key, source, round(sum(least(t_end, win) - t_start), 9) AS s FROM x WHERE t_start < win AND least(t_end, win) - t_start > 0 GROUP BY ALL),
l AS (SELECT source, count(*) AS n FROM (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY s DESC, source DESC) = 1) GROUP BY 1)
SELECT 'opens' AS part, source, o.n, round(o.n / able.n, 3) AS rate FROM o, able UNION ALL SELECT 'leads', source, l.n, round(l.n / able.n, 3) FROM l, able""")
def hook_openings(spark, sf):
    h = P.hook_summary(moments(spark, sf), shots(spark, sf), entities(spark, sf))
    return h["opens_with"].withColumn("part", F.lit("opens")).unionByName(h["leads_with"].withColumn("part", F.lit("leads")))


@query("hook_phrases", f"""
WITH {BASE_SQL},
src AS (SELECT CASE WHEN t_start < least(3.0, duration) THEN 'hook' ELSE 'rest' END AS part, text FROM tm JOIN en USING (entity_key) WHERE trim(text) <> ''),
{GRAM_SQL.format(stop=STOP_TEXT, key='part', src='src')},
t AS (SELECT term, coalesce(sum(n) FILTER (g = 'hook'), 0) AS y_in, coalesce(sum(n) FILTER (g <> 'hook'), 0) AS y_out FROM terms GROUP BY 1),
s AS (SELECT CAST(sum(y_in) AS DOUBLE) AS n_in, CAST(sum(y_out) AS DOUBLE) AS n_out FROM t)
SELECT term, {LIFT_EXPR} AS z FROM t, s WHERE y_in + y_out >= 3 AND y_in > 0 ORDER BY 2 DESC, term LIMIT 18""")
def hook_phrases(spark, sf):
    return P.hook_summary(moments(spark, sf), shots(spark, sf), entities(spark, sf))["phrases"].select("term", "z")


@query("entity_features", f"""
WITH {BASE_SQL}, p AS (SELECT entity_key, count(*) AS shots, round(avg(t1 - t0), 3) AS shot_len FROM sh GROUP BY 1),
m AS (SELECT entity_key, count(*) AS moments, CAST(sum(CASE WHEN source = 'speech' THEN wc ELSE 0 END) AS BIGINT) AS words FROM mo GROUP BY 1)
SELECT entity_key, coalesce(shots, 0) AS shots, shot_len, moments, words, round(moments / (duration / 60), 1) AS moments_per_min, round(words / duration, 2) AS words_per_s
FROM en LEFT JOIN p USING (entity_key) LEFT JOIN m USING (entity_key)""")
def entity_features(spark, sf):
    return P.features(moments(spark, sf), shots(spark, sf), entities(spark, sf), 30.0).select(
        "entity_key", "shots", "shot_len", "moments", "words", "moments_per_min", "words_per_s")


@query("channel_presence", f"""
WITH {BASE_SQL} SELECT source, count(DISTINCT entity_key) AS entities, round(count(DISTINCT entity_key) / (SELECT count(*) FROM en), 3) AS rate FROM mo GROUP BY 1""")
def channel_presence(spark, sf):
    return P.channel_presence(moments(spark, sf), entities(spark, sf)).select("source", "entities", "rate")


# ---- signals: events as a frame series, errors as shot boundaries ---------------------

def frames(spark, sf):
    e = events_timed(spark, sf).select(F.col("user_id").alias("entity_key"), "t", "value").groupBy("entity_key", "t").agg(F.max("value").alias("v"))
    return e.select("entity_key", "t", (F.col("v") / 20.0).alias("mafd"), (F.col("v") + 40).alias("yavg"), (F.col("v") / 2).alias("ylow"), (F.col("v") * 1.5).alias("yhigh"),
                    F.col("v").alias("satavg"), (F.col("v") / 4 + 100).alias("uavg"), F.lit(120.0).alias("vavg"))


FRAMES_SQL = EVENTS_TIMED_SQL + """,
fr AS (SELECT user_id AS entity_key, t, max(value) / 20.0 AS mafd, max(value) AS v FROM ev GROUP BY ALL)"""


@query("signal_bands", f"""
WITH {FRAMES_SQL},
a AS (SELECT entity_key, avg(v + 40) / 255 AS b, (avg(v * 1.5) - avg(v / 2)) / 255 AS c, least(1, avg(v) / 128) AS s, (120 - avg(v / 4 + 100)) / 255 AS tp FROM fr GROUP BY 1)
SELECT entity_key, 'brightness' AS kind, CASE WHEN b < 0.25 THEN 'dark' WHEN b < 0.45 THEN 'low-key' WHEN b < 0.65 THEN 'balanced' ELSE 'bright' END AS value, round(b, 4) AS num FROM a
UNION ALL SELECT entity_key, 'contrast', CASE WHEN c < 0.25 THEN 'flat' WHEN c < 0.5 THEN 'soft' WHEN c < 0.72 THEN 'punchy' ELSE 'harsh' END, round(c, 4) FROM a
UNION ALL SELECT entity_key, 'saturation', CASE WHEN s < 0.12 THEN 'desaturated' WHEN s < 0.28 THEN 'muted' WHEN s < 0.5 THEN 'saturated' ELSE 'vivid' END, round(s, 4) FROM a
UNION ALL SELECT entity_key, 'temperature', CASE WHEN tp < -0.02 THEN 'cool' WHEN tp < 0.02 THEN 'neutral' ELSE 'warm' END, round(tp, 5) FROM a""")
def signal_bands(spark, sf):
    return G.colour(frames(spark, sf)).select("entity_key", "kind", "value", "num")


@query("cut_rhythm", """
WITH s AS (SELECT l_orderkey AS entity_key, l_quantity / 10.0 AS len, (l_linenumber - 1) * 3.0 + l_quantity / 20.0 AS mid FROM (
             SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
a AS (SELECT entity_key, count(*) AS n, avg(len) AS asl, sum(len) AS dur, stddev_pop(len) AS sd,
        CASE WHEN count(*) >= 3 AND regr_sxx(len, mid) >= 1e-12 THEN regr_slope(len, mid) ELSE 0 END AS sl FROM s GROUP BY 1)
SELECT entity_key, 'asl' AS kind, CAST(NULL AS VARCHAR) AS value, round(asl, 3) AS num FROM a
UNION ALL SELECT entity_key, 'cut_rate', NULL, round(round((n - 1) / dur * 60, 9), 2) FROM a
UNION ALL SELECT entity_key, 'rhythm', CASE WHEN round(sd / asl, 9) < 0.15 THEN 'metronomic' WHEN round(sd / asl, 9) < 0.4 THEN 'even' WHEN round(sd / asl, 9) < 0.8 THEN 'varied' ELSE 'erratic' END, NULL FROM a
UNION ALL SELECT entity_key, 'acceleration', NULL, round(sl, 5) FROM a""")
def cut_rhythm(spark, sf):
    return G.cut_rhythm(shots(spark, sf)).select(
        "entity_key", "kind", F.when(F.col("kind") == "rhythm", F.col("value")).alias("value"), F.when(F.col("kind") != "rhythm", F.col("num")).alias("num"))


MOTION_BAND = "CASE WHEN {0} < 0.6 THEN 'still' WHEN {0} < 2.0 THEN 'gentle' WHEN {0} < 6.0 THEN 'active' ELSE 'frenetic' END"


@query("motion_energy", f"""
WITH {FRAMES_SQL},
b AS (SELECT DISTINCT user_id AS entity_key, t AS b FROM ev WHERE event_type = 'error' AND t > 0),
g AS (SELECT entity_key, t - lag(t) OVER (PARTITION BY entity_key ORDER BY t) AS gap FROM fr),
r AS (SELECT entity_key, gap, row_number() OVER (PARTITION BY entity_key ORDER BY gap) AS rn, count(*) OVER (PARTITION BY entity_key) AS n FROM g WHERE gap IS NOT NULL),
tol AS (SELECT entity_key, gap AS tol FROM r WHERE rn = n // 2 + 1),
pairs AS (SELECT b.entity_key, b.b, fr.t, abs(fr.t - b.b) AS d, coalesce(tol.tol, 0.05) AS tol FROM b JOIN fr USING (entity_key) LEFT JOIN tol USING (entity_key)),
near AS (SELECT * FROM pairs WHERE d <= tol),
lone AS (SELECT entity_key, b, arg_min(t, d) AS t FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.entity_key = p.entity_key AND n.b = p.b) GROUP BY entity_key, b),
skip AS (SELECT entity_key, t FROM near UNION SELECT entity_key, t FROM lone),
d AS (SELECT entity_key, t, mafd FROM (SELECT *, min(t) OVER (PARTITION BY entity_key) AS first FROM fr) x
      WHERE t > first AND NOT EXISTS (SELECT 1 FROM skip s WHERE s.entity_key = x.entity_key AND s.t = x.t)),
w AS (SELECT entity_key, round(avg(mafd), 9) AS e FROM d GROUP BY 1 HAVING count(*) >= 2),
sh AS (SELECT user_id AS entity_key, event_id AS idx, t AS t0, t + 20000.0 AS t1 FROM ev WHERE event_type = 'error'),
p AS (SELECT sh.entity_key, sh.idx, round(avg(mafd), 9) AS e FROM sh JOIN d ON d.entity_key = sh.entity_key AND d.t >= sh.t0 AND d.t < sh.t1 GROUP BY ALL HAVING count(mafd) >= 2)
SELECT entity_key, 'motion_energy' AS kind, {MOTION_BAND.format('e')} AS value, round(e, 4) AS num, CAST(NULL AS INT) AS shot_idx FROM w
UNION ALL SELECT entity_key, 'motion_energy', {MOTION_BAND.format('e')}, round(e, 4), CAST(idx AS INT) FROM p WHERE entity_key IN (SELECT entity_key FROM w)""")
def motion_energy(spark, sf):
    ev = events_timed(spark, sf)
    sh = ev.filter("event_type = 'error'").select(F.col("user_id").alias("entity_key"), F.col("event_id").alias("idx"), F.col("t").alias("t0"), (F.col("t") + 20000.0).alias("t1"))
    return G.motion(frames(spark, sf), sh).select("entity_key", "kind", "value", "num", "shot_idx")


@query("per_frame_summary", f"""
WITH {FRAMES_SQL}
SELECT entity_key, 'brightness_mean' AS kind, round(avg(v + 40) / 255, 5) AS num FROM fr GROUP BY 1
UNION ALL SELECT entity_key, 'brightness_min', round(min(v + 40) / 255, 5) FROM fr GROUP BY 1
UNION ALL SELECT entity_key, 'unique_frames', CAST(count(*) FILTER (mafd > 0.05 AND t > tf) + 1 AS DOUBLE) FROM (SELECT *, min(t) OVER (PARTITION BY entity_key) AS tf FROM fr) GROUP BY 1""")
def per_frame_summary(spark, sf):
    b = events_timed(spark, sf).filter("event_type = 'error'").select(F.col("user_id").alias("entity_key"), F.col("t").alias("t0"))
    return G.per_frame(frames(spark, sf), b, 86400.0).filter(F.col("kind").isin("brightness_mean", "brightness_min", "unique_frames")).select("entity_key", "kind", "num")


@query("palette_bins", """
WITH p AS (SELECT l_suppkey AS k, CAST(l_quantity * 5 AS INT) AS r, CAST(l_linenumber * 30 AS INT) AS g, CAST(l_discount * 2000 AS INT) AS b FROM lineitem),
c AS (SELECT k, (r // 43) * 36 + (g // 43) * 6 + b // 43 AS cell, count(*) AS n FROM p GROUP BY ALL)
SELECT k AS entity_key, row_number() OVER (PARTITION BY k ORDER BY n DESC, cell DESC) AS rank, round(n / sum(n) OVER (PARTITION BY k), 4) AS share FROM c QUALIFY rank <= 6""")
def palette_bins(spark, sf):
    px = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_key"), (F.col("l_quantity") * 5).cast("int").alias("r"),
                                            (F.col("l_linenumber") * 30).cast("int").alias("g"), F.round(F.col("l_discount") * 2000).cast("int").alias("b"))
    return G.palette(px).select("entity_key", F.col("rank").cast("bigint").alias("rank"), "share")


@query("loudness_claims", f"""
WITH {EVENTS_TIMED_SQL},
a AS (SELECT user_id AS entity_key, -avg(value) / 5 AS lufs, -min(value) / 10 AS tp, max(value) / 20 AS lra, max(t) + 1 AS dur, stddev_pop(-value / 4) AS spread, max(-value / 4) AS pk,
        coalesce(sum(greatest(0, (t + value) - t)) FILTER (event_type = 'error'), 0) AS quiet FROM ev GROUP BY 1),
c AS (SELECT *, quiet / dur AS ratio, CASE WHEN lra > 0.05 OR coalesce(spread, 0) <= 1.0 THEN lra END AS ranged FROM a),
sh AS (SELECT user_id AS entity_key, event_id AS idx, t AS t0, t + 30000.0 AS t1 FROM ev WHERE event_type = 'view'),
p AS (SELECT sh.entity_key, sh.idx, round(avg(-ev.value / 4), 9) AS m FROM sh JOIN ev ON ev.user_id = sh.entity_key AND ev.t >= sh.t0 AND ev.t < sh.t1 GROUP BY ALL HAVING count(ev.value) >= 1)
SELECT entity_key, 'lufs' AS kind, CASE WHEN lufs < 0 THEN '-' ELSE '' END || printf('%.1f', CAST(abs(round(CAST(CAST(lufs AS VARCHAR) AS DECIMAL(38, 20)), 1)) AS DOUBLE)) || ' LUFS integrated' AS value, CAST(round(CAST(CAST(lufs AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS num, CAST(NULL AS INT) AS shot_idx FROM c
UNION ALL SELECT entity_key, 'true_peak', CASE WHEN tp < 0 THEN '-' ELSE '' END || printf('%.1f', CAST(abs(round(CAST(CAST(tp AS VARCHAR) AS DECIMAL(38, 20)), 1)) AS DOUBLE)) || ' dBTP' || CASE WHEN tp > -1.0 THEN ' — clipping' ELSE '' END, CAST(round(CAST(CAST(tp AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE), NULL FROM c
UNION ALL SELECT entity_key, 'dynamic_range', CASE WHEN ranged < 3 THEN 'compressed' WHEN ranged < 8 THEN 'controlled' WHEN ranged < 15 THEN 'dynamic' ELSE 'wide' END, CAST(round(CAST(CAST(ranged AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE), NULL FROM c WHERE ranged IS NOT NULL
UNION ALL SELECT entity_key, 'silence_ratio', CAST(CAST(round(ratio * 100) AS BIGINT) AS VARCHAR) || '% below -50 dBFS for 0.3s+', CAST(round(CAST(CAST(ratio AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE), NULL FROM c
UNION ALL SELECT entity_key, 'loudness_peak', CASE WHEN pk < 0 THEN '-' ELSE '' END || printf('%.1f', CAST(abs(round(CAST(CAST(pk AS VARCHAR) AS DECIMAL(38, 20)), 1)) AS DOUBLE)) || ' LUFS momentary', CAST(round(CAST(CAST(pk AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE), NULL FROM c
UNION ALL SELECT entity_key, 'shot_level', CASE WHEN m < 0 THEN '-' ELSE '' END || printf('%.1f', CAST(abs(round(CAST(CAST(m AS VARCHAR) AS DECIMAL(38, 20)), 1)) AS DOUBLE)) || ' LUFS', CAST(round(CAST(CAST(m AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE), CAST(idx AS INT) FROM p""")
def loudness_claims(spark, sf):
    ev = events_timed(spark, sf).select(F.col("user_id").alias("entity_key"), "t", "value", "event_type", "event_id")
    s = ev.groupBy("entity_key").agg((-F.avg("value") / 5).alias("lufs"), (-F.min("value") / 10).alias("true_peak"), (F.max("value") / 20).alias("lra"))
    sil = ev.filter("event_type = 'error'").select("entity_key", F.col("t").alias("t0"), (F.col("t") + F.col("value")).alias("t1"))
    d = ev.groupBy("entity_key").agg((F.max("t") + 1).alias("duration"))
    sh = ev.filter("event_type = 'view'").select("entity_key", F.col("event_id").alias("idx"), F.col("t").alias("t0"), (F.col("t") + 30000.0).alias("t1"))
    return G.loudness(s, ev.select("entity_key", "t", (-F.col("value") / 4).alias("m")), sil, d, sh).select("entity_key", "kind", "value", "num", "shot_idx")


@query("caption_claims", """
WITH c AS (SELECT c_custkey AS entity_key, '#' || c_mktsegment || ' by @' || c_name || ' #' || c_mktsegment || ' #Tag' || c_nationkey AS caption FROM customer)
SELECT entity_key, 'caption' AS kind, caption AS value, CAST(NULL AS INTEGER) AS ordinal FROM c
UNION ALL SELECT c_custkey, 'hashtag', lower(c_mktsegment), 0 FROM customer UNION ALL SELECT c_custkey, 'hashtag', 'tag' || c_nationkey, 1 FROM customer
UNION ALL SELECT c_custkey, 'mention', 'customer', 0 FROM customer UNION ALL SELECT c_custkey, 'uploader', c_mktsegment, NULL FROM customer""")
def caption_claims(spark, sf):
    c = load(spark, sf, "customer")
    cards = c.select(F.col("c_custkey").alias("entity_key"), F.concat(F.lit("#"), "c_mktsegment", F.lit(" by @"), "c_name", F.lit(" #"), "c_mktsegment", F.lit(" #Tag"), F.col("c_nationkey").cast("string")).alias("caption"),
                     F.col("c_mktsegment").alias("creator"))
    return G.caption_claims(cards).select("entity_key", "kind", "value", "ordinal")
