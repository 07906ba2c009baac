"""Passage, fact, claim and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import claims as C
from ..operators import passages as P
from .registry import query
from .tables import EVENTS_TIMED_SQL, MOMENTS_SQL, events_timed, load, moments


@query("passage_merge", f"""
WITH RECURSIVE {MOMENTS_SQL},
r AS (SELECT entity_key, source, id, t_start AS a, t_end AS b, text, length(text) AS len,
             row_number() OVER (PARTITION BY entity_key, source ORDER BY t_start, t_end, id) AS rn
      FROM moments WHERE text <> ''),
walk AS (
  SELECT entity_key, source, rn, a, b, text, len, CAST(1 AS BIGINT) AS p,
         CASE WHEN len >= 180 OR len + 1 >= 320 THEN 0 ELSE len + 1 END AS st FROM r WHERE rn = 1
  UNION ALL
  SELECT r.entity_key, r.source, r.rn, r.a, r.b, r.text, r.len,
         w.p + CASE WHEN r.len >= 180 OR w.len >= 180 OR w.st = 0 OR r.a - w.b > 14 OR w.st + r.len > 900 THEN 1 ELSE 0 END,
         CASE WHEN r.len >= 180 THEN 0
              WHEN w.len >= 180 OR w.st = 0 OR r.a - w.b > 14 OR w.st + r.len > 900
                THEN CASE WHEN r.len + 1 >= 320 THEN 0 ELSE r.len + 1 END
              ELSE CASE WHEN w.st + r.len + 1 >= 320 THEN 0 ELSE w.st + r.len + 1 END END
  FROM walk w JOIN r ON r.entity_key = w.entity_key AND r.source = w.source AND r.rn = w.rn + 1
)
SELECT entity_key, source, min(a) AS t0, max(b) AS t1, count(*) AS n_rows, md5(string_agg(text, ' ' ORDER BY rn)) AS digest
FROM walk GROUP BY entity_key, source, p""")
def passage_merge(spark, sf):
    rows = moments(spark, sf).select("entity_key", "source", F.col("id").alias("row_id"), F.col("t_start").alias("t0"),
                                     F.col("t_end").alias("t1"), "text")
    out = P.build_passages(rows, block_seconds=30.0)
    counted = rows.filter("text <> ''").withColumnRenamed("t0", "rt0")
    n = (out.join(counted.select("entity_key", "source", "rt0"), ["entity_key", "source"])
         .filter((F.col("rt0") >= F.col("t0")) & (F.col("rt0") < F.col("t1")))
         .groupBy("entity_key", "source", "t0", "t1", "text").agg(F.count("*").alias("n_rows")))
    return n.select("entity_key", "source", "t0", "t1", "n_rows", F.md5(F.col("text").cast("binary")).alias("digest"))


FACTS_SQL = EVENTS_TIMED_SQL + """,
facts AS (SELECT 'archive' AS entity_key, 'visual' AS source, event_type AS text, 'seen' AS kind, t AS t0,
                 round(t + value * 40.0, 3) AS t1, value / 100.0 AS confidence FROM ev)"""


def _facts(spark, sf):
    return events_timed(spark, sf).select(
        F.lit("archive").alias("entity_key"), F.lit("visual").alias("source"), F.col("event_type").alias("text"),
        F.lit("seen").alias("kind"), F.col("t").alias("t0"), F.round(F.col("t") + F.col("value") * 40.0, 3).alias("t1"),
        (F.col("value") / 100.0).alias("confidence"))


@query("fact_runs", f"""
WITH {FACTS_SQL},
w AS (SELECT text, t0 AS a, CASE WHEN t1 > t0 THEN t1 ELSE t0 + 2.5 END AS b, greatest(t1, t0) AS held, confidence FROM facts),
r AS (SELECT *, max(b) OVER q AS rb, max(held) OVER q AS rh FROM w
      WINDOW q AS (PARTITION BY text ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, sum(CASE WHEN rb IS NULL OR a - rb > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY text ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run,
             greatest(0.0, held - greatest(a, coalesce(rh, a))) AS fresh FROM r),
runs AS (SELECT text, run, min(a) AS a, max(b) AS b FROM m GROUP BY text, run),
best AS (SELECT text, a, b FROM runs QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(b - a, 9) DESC, a) = 1)
SELECT text, a AS t0, b AS t1, round(span, 3) AS span, conf
FROM best JOIN (SELECT text, sum(fresh) AS span, max(confidence) AS conf FROM m GROUP BY text) USING (text)""")
def fact_runs(spark, sf):
    out = P.build_facts(_facts(spark, sf), block_seconds=86400.0)
    return out.select("text", "t0", "t1", F.round("span", 3).alias("span"), "conf")


# Every event holds until the next one: an exact tiling per day; 'huge' values hold almost nothing.
TILES_SQL = EVENTS_TIMED_SQL + """,
tiles AS (
  SELECT CAST(floor(t / 86400) AS BIGINT) AS entity_key, 'visual' AS source, 'level' AS kind,
         CASE WHEN value > 120 THEN 'huge' WHEN value > 40 THEN 'high' ELSE 'low' END AS text,
         t AS t0, coalesce(lead(t) OVER (PARTITION BY CAST(floor(t / 86400) AS BIGINT) ORDER BY t), t + 1.0) AS t1
  FROM ev
  UNION ALL
  SELECT CAST(floor(t / 86400) AS BIGINT), 'visual', 'object', event_type, t, t + value * 20.0 FROM ev
)"""


@query("sliver_refusal", f"""
WITH {TILES_SQL},
shape AS (SELECT entity_key, kind, count(*) AS n, min(t0) AS lo, max(t1) AS hi FROM tiles GROUP BY ALL),
reach AS (SELECT *, max(t1) OVER (PARTITION BY entity_key, kind ORDER BY t0, t1, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tiles),
whole AS (SELECT entity_key, kind, sum(greatest(0, t1 - greatest(t0, coalesce(r, t0)))) AS whole FROM reach GROUP BY ALL),
clash AS (SELECT DISTINCT a.entity_key, a.kind FROM tiles a JOIN tiles b
          ON a.entity_key = b.entity_key AND a.kind = b.kind AND a.text <> b.text AND a.t0 < b.t1 AND b.t0 < a.t1),
rivals AS (SELECT s.entity_key, s.kind, whole FROM shape s JOIN whole USING (entity_key, kind)
           WHERE n >= 4 AND hi > lo AND whole / (hi - lo) >= 0.8
             AND (s.entity_key, s.kind) NOT IN (SELECT (entity_key, kind) FROM clash)),
reach2 AS (SELECT *, max(t1) OVER (PARTITION BY entity_key, kind, text ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tiles),
held AS (SELECT entity_key, kind, text, sum(greatest(0, t1 - greatest(t0, coalesce(r, t0)))) AS held FROM reach2 GROUP BY ALL),
lost AS (SELECT entity_key, kind, text FROM held JOIN rivals USING (entity_key, kind) WHERE held / whole < 0.05)
SELECT entity_key, kind, text, count(*) AS n, round(min(t0), 3) AS first_seen
FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.entity_key = t.entity_key AND l.kind = t.kind AND l.text = t.text)
GROUP BY ALL""")
def sliver_refusal(spark, sf):
    ev = events_timed(spark, sf).withColumn("day", F.floor(F.col("t") / 86400).cast("bigint"))
    from ..operators.sequences import Carry, with_carry
    level = with_carry(ev, ["day"], ["t"], [Carry("nxt", "lead", F.col("t"))], F.floor(F.col("t") / 7200).cast("bigint"))
    tiles = level.select(
        F.col("day").alias("entity_key"), F.lit("visual").alias("source"), F.lit("level").alias("kind"),
        F.when(F.col("value") > 120, "huge").when(F.col("value") > 40, "high").otherwise("low").alias("text"),
        F.col("t").alias("t0"), F.coalesce("nxt", F.col("t") + 1.0).alias("t1"))
    seen = ev.select(F.col("day").alias("entity_key"), F.lit("visual").alias("source"), F.lit("object").alias("kind"),
                     F.col("event_type").alias("text"), F.col("t").alias("t0"), (F.col("t") + F.col("value") * 20.0).alias("t1"))
    kept = P.refuse_slivers(tiles.unionByName(seen), block_seconds=7200.0)
    return kept.groupBy("entity_key", "kind", "text").agg(F.count("*").alias("n"), F.round(F.min("t0"), 3).alias("first_seen"))


@query("dedupe_moments", """
WITH m AS (SELECT lang AS entity_key, 'speech' AS source, substr(sha1(lower(text)), 1, 16) AS text_hash, doc_id,
                  CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(doc_id AS DOUBLE) END AS t_start FROM documents)
SELECT entity_key, source, text_hash, doc_id FROM m
QUALIFY row_number() OVER (PARTITION BY entity_key, source, text_hash ORDER BY t_start IS NULL, t_start, doc_id) = 1""")
def dedupe_moments(spark, sf):
    d = load(spark, sf, "documents").select(
        F.col("lang").alias("entity_key"), F.lit("speech").alias("source"), T.text_hash(F.col("text")).alias("text_hash"),
        "doc_id", F.when(F.col("n_chars") % 3 != 0, F.col("doc_id").cast("double")).alias("t_start"))
    d = d.withColumn("t_end", F.col("doc_id").cast("double")).withColumn("is_fact", F.lit(0))
    return P.dedupe_moments(d).select("entity_key", "source", "text_hash", "doc_id")


@query("claim_text", """
WITH c AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'dominant_colour' WHEN 'view' THEN 'transcript' WHEN 'error' THEN 'freeze'
              WHEN 'purchase' THEN 'Novel_Kind' ELSE 'object' END AS kind,
         CASE WHEN value < 5 THEN 'no faces found' WHEN value < 10 THEN CAST(CAST(value AS INT) AS VARCHAR) || ' BPM'
              WHEN value < 20 THEN '' WHEN value < 25 THEN 'well exposed' WHEN value < 40 THEN 'orange'
              ELSE 'a long tail of many words here' END AS v,
         value / 100.0 AS conf FROM events),
w AS (
  SELECT event_id, kind, v,
    CASE WHEN v = '' OR kind = 'freeze' OR conf < 0.05 THEN NULL
         WHEN v = 'no faces found' THEN NULL
         WHEN kind = 'transcript' THEN 'prose'
         WHEN v LIKE '%BPM' THEN NULL
         WHEN kind = 'Novel_Kind' AND v LIKE 'a long%' THEN 'prose'
         ELSE 'fact' END AS form FROM c)
SELECT event_id, form,
  CASE WHEN form = 'prose' THEN v WHEN kind = 'dominant_colour' THEN 'the dominant colour is ' || v
       WHEN kind = 'object' THEN v ELSE 'novel kind ' || v END AS text
FROM w WHERE form IS NOT NULL""")
def claim_text(spark, sf):
    e = load(spark, sf, "events")
    v = F.col("value")
    c = e.select(
        "event_id",
        F.when(F.col("event_type") == "click", "dominant_colour").when(F.col("event_type") == "view", "transcript")
        .when(F.col("event_type") == "error", "freeze").when(F.col("event_type") == "purchase", "Novel_Kind")
        .otherwise("object").alias("kind"),
        F.when(v < 5, "no faces found").when(v < 10, F.concat(F.bround(v).cast("int").cast("string"), F.lit(" BPM")))
        .when(v < 20, "").when(v < 25, "well exposed").when(v < 40, "orange")
        .otherwise("a long tail of many words here").alias("val"), (v / 100.0).alias("conf"))
    return C.admit(c, "kind", "val", "conf").select("event_id", "form", "text")


@query("label_lists", """
WITH c AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '× ' || p_name || ', ' || p_type AS cell FROM part),
l AS (SELECT p_partkey, lower(p_name_) AS label FROM (
        SELECT p_partkey, unnest([trim(regexp_replace(string_split(cell, ',')[1], '^\\s*\\d+\\s*[×x]\\s*', '')), trim(string_split(cell, ',')[2])]) AS p_name_ FROM c))
SELECT label, count(*) AS n FROM l GROUP BY label""")
def label_lists(spark, sf):
    p = load(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("× "), F.col("p_name"), F.lit(", "), F.col("p_type")).alias("cell"))
    return p.select(F.explode(C.labels(F.col("cell"))).alias("l")).groupBy(F.col("l.label").alias("label")).agg(F.count("*").alias("n"))


@query("label_json", """
SELECT lower(p_name) AS label, round(max(p_size / 100.0), 4) AS conf, count(*) AS n FROM part GROUP BY 1
UNION ALL SELECT lower(p_type), NULL, count(*) FROM part GROUP BY 1""")
def label_json(spark, sf):
    p = load(spark, sf, "part")
    one = F.to_json(F.struct(F.col("p_name").alias("label"), (F.col("p_size") / 100.0).alias("conf")))
    cell = F.concat(F.lit("["), one, F.lit(', "'), F.col("p_type"), F.lit('"]'))
    return (p.select(F.explode(C.labels(cell)).alias("l")).groupBy("l.label")
            .agg(F.round(F.max("l.conf"), 4).alias("conf"), F.count("*").alias("n")))


@query("clean_text", """
WITH o AS (SELECT doc_id, text, [x FOR x IN regexp_extract_all(text, '[A-Za-z0-9_-]{24,}') IF regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]')] AS handles FROM documents),
g AS (SELECT doc_id, CASE WHEN len(handles) = 0 THEN trim(text, ' ') ELSE regexp_replace(regexp_replace(
        list_reduce(list_prepend(trim(text, ' '), handles), lambda a, b: replace(a, b, ' ')), '\\s*,\\s*,+', ', ', 'g'), '^[ ,]+|[ ,]+$', '', 'g') END AS t FROM o),
s AS (SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g'), ' ') AS t FROM g)
SELECT doc_id, length(replace(t, ' ', '')) AS chars, md5(replace(t, ' ', '')) AS digest, true AS fits FROM s WHERE length(t) >= 2 AND NOT regexp_full_match(t, '\\d+')""")
def clean_text(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", T.passages_of(T.clean_text(F.col("text"))).alias("p")).filter(F.col("p").isNotNull())
    # Passages hold the whole text between them, blanks at the cuts apart, and none is too long.
    whole = F.replace(F.array_join("p", ""), F.lit(" "), F.lit(""))
    return d.select("doc_id", F.length(whole).cast("bigint").alias("chars"), F.md5(whole.cast("binary")).alias("digest"),
                    (F.array_max(F.transform("p", lambda x: F.length(x))) <= T.MAX_CHARS).alias("fits"))


@query("card_first_non_empty", """
WITH o AS (SELECT o_custkey AS k, max(o_orderpriority) AS title, sum(o_totalprice) AS duration FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_name ELSE '' END AS title,
             CASE WHEN c_acctbal > 0 THEN c_acctbal END AS duration, c_mktsegment AS creator FROM customer)
SELECT k AS entity_key, coalesce(nullif(c.title, ''), o.title) AS title, round(coalesce(c.duration, o.duration), 2) AS duration, creator
FROM c FULL OUTER JOIN o USING (k)""")
def card_first_non_empty(spark, sf):
    c = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_key"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise("").alias("title"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("duration"), F.col("c_mktsegment").alias("creator"))
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_key")).agg(
        F.max("o_orderpriority").alias("title"), F.sum("o_totalprice").alias("duration"))
    return (P.first_non_empty([c, o], "entity_key", ["title", "duration", "creator"])
            .withColumn("duration", F.round("duration", 2)))


@query("card_build", f"""
WITH {MOMENTS_SQL},
p AS (SELECT entity_key, count(*) AS moment_count, sum(length(text)) AS text_len, max(t_end) AS e,
             bool_or(source = 'speech') AS hs,
             count(*) FILTER (source = 'user') AS u, count(*) FILTER (source = 'assistant') AS a FROM moments GROUP BY 1)
SELECT c_custkey AS entity_key, coalesce(moment_count, 0) AS moment_count, CAST(coalesce(text_len, 0) AS BIGINT) AS text_len,
       CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE coalesce(e, 0.0) END AS duration, coalesce(hs, false) AS has_speech,
       nullif(u, 0) AS n_user, nullif(a, 0) AS n_assistant
FROM customer LEFT JOIN p ON c_custkey = entity_key""")
def card_build(spark, sf):
    c = load(spark, sf, "customer")
    meta = c.select(F.col("c_custkey").alias("entity_key"), F.col("c_acctbal").alias("duration"))
    cards = P.build_cards(moments(spark, sf), meta, meta)
    return cards.select("entity_key", "moment_count", "text_len", "duration", "has_speech",
                        F.try_element_at("sources", F.lit("user")).alias("n_user"),
                        F.try_element_at("sources", F.lit("assistant")).alias("n_assistant"))


@query("moment_weights", f"""
WITH {EVENTS_TIMED_SQL}
SELECT event_id, round(CASE WHEN value <= 10 THEN 1.0 WHEN user_id % 2 = 0 THEN 1 + 0.6 * least(1, (value - 10) / 300.0)
   ELSE 1 + 0.6 * least(1, ln(1 + value - 10) / ln(61)) END, 5) AS prominence,
  round(0.5 + 0.5 * greatest(0, least(1, value / 100)), 5) AS certainty FROM ev""")
def moment_weights(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id",
                    F.round(M.prominence(F.col("value") - 10, F.when(F.col("user_id") % 2 == 0, 300.0)), 5).alias("prominence"),
                    F.round(M.certainty(F.col("value") / 100), 5).alias("certainty"))


@query("moments_assembled")
def moments_assembled(spark, sf):
    """Claims and conversation turns become moments; checked against brute force in the tests."""
    prose = moments(spark, sf).select("entity_key", "source", F.col("id").alias("row_id"), F.col("t_start").alias("t0"),
                                      F.col("t_end").alias("t1"), "text")
    facts = events_timed(spark, sf).select(
        F.col("user_id").alias("entity_key"), F.lit("visual").alias("source"), F.col("event_type").alias("text"),
        F.lit("event").alias("kind"), F.col("t").alias("t0"), (F.col("t") + 1.0).alias("t1"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))
    entities = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), F.lit(3600.0).alias("duration"))
    out = P.assemble_moments(prose, facts, entities, "archive")
    return out.select("entity_key", "source", "text_hash", "t_start", "t_end", F.round("weight", 5).alias("weight"))


@query("text_bundle", """
SELECT conv_id AS entity_key, CASE role WHEN 'user' THEN 'transcript' ELSE 'descriptions' END AS part,
       count(*) AS n, sum(length(text)) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY ALL""")
def text_bundle(spark, sf):
    c = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("entity_key"),
        F.when(F.col("role") == "user", "speech").when(F.col("role") == "assistant", "visual").otherwise("other").alias("channel"),
        F.when(F.col("role") == "user", "segment").otherwise("shot_description").alias("kind"),
        F.col("turn").cast("int").alias("shot_idx"), F.lit(None).cast("double").alias("t0"),
        F.lit(0).alias("ordinal"), F.col("text").alias("value"))
    return C.text_bundle(c).groupBy("entity_key", "part").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("claim_rows", """
SELECT CAST(user_id AS VARCHAR) AS entity_key, event_type AS kind, count(*) AS n, count(DISTINCT event_id) AS uids,
       round(sum(round(0.8 * least(1.0, value / 100), 4)), 4) AS conf FROM events GROUP BY ALL""")
def claim_rows(spark, sf):
    e = load(spark, sf, "events").select(
        F.col("user_id").alias("entity_key"), F.lit("style").alias("channel"), F.col("event_type").alias("kind"),
        F.col("event_id").cast("string").alias("value"), F.col("value").alias("num"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.col("event_id").cast("int").alias("ordinal"))
    rows = C.to_claim_rows(e, C.observer_id("events"), F.lit(0.8))
    return rows.groupBy("entity_key", "kind").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("uids"),
                                                  F.round(F.sum("confidence"), 4).alias("conf"))
