"""Lexical and hybrid search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as R
from ..operators.lexindex import LexicalIndex
from ..session import shared_dir, stored
from .registry import query
from .tables import MOMENTS_SQL, document_index, load, moment_index, moments

TOK_SQL = """
tok AS (SELECT id, entity_key, source, weight, text,
               regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS tokens FROM moments),
"""


def bm25_sql(terms, prefix=None, every=False, table="tok", out="scored"):
    """Oracle BM25 over tokenised rows, written with list functions."""
    probes = [(t, False) for t in terms] + ([(prefix, True)] if prefix else [])
    tf = ", ".join(
        f"CAST(len(list_filter(tokens, lambda x: {'starts_with(x, ' + repr(t) + ')' if p else 'x = ' + repr(t)})) AS DOUBLE) AS tf{i}"
        for i, (t, p) in enumerate(probes))
    dfs = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(probes)))
    parts = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        for i in range(len(probes)))
    cond = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(probes)))
    return f"""
{out}_tf AS (SELECT *, len(tokens) AS dl, {tf} FROM {table}),
{out}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {dfs} FROM {out}_tf),
{out} AS (SELECT id, entity_key, source, weight, text, ({parts}) * greatest(coalesce(weight, 1.0), 0.05) AS score
          FROM {out}_tf, {out}_st WHERE {cond})"""


ENTITY_SQL = """
r AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY score DESC, id) AS rn FROM {src}),
g AS (SELECT entity_key,
             sum(CASE WHEN rn = 1 THEN score WHEN rn <= 6 THEN 0.5 * score / rn ELSE 0 END)
               * (1 + 0.08 * (count(DISTINCT source) - 1)) AS score,
             count(*) AS hit_count, count(DISTINCT source) AS n_sources
      FROM r GROUP BY entity_key)"""


@query("lexical_bm25_groups", f"""
WITH {MOMENTS_SQL}, {TOK_SQL} {bm25_sql(['tion', 'onth', 'the', 'que'])}, {ENTITY_SQL.format(src='scored')}
SELECT entity_key, round(score, 5) AS score, hit_count, n_sources FROM g
ORDER BY round(score, 5) DESC, entity_key LIMIT 10""")
def lexical_bm25_groups(spark, sf):
    hits = moment_index(spark, sf).scores(["tion", "onth", "the", "que"])
    return (R.entity_scores(hits).withColumn("score", F.round("score", 5))
            .orderBy(F.col("score").desc(), "entity_key").limit(10))


@query("postings_index", f"""
WITH {MOMENTS_SQL}, {TOK_SQL} p AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf, round(max(1.0 / dl), 6) AS best_share FROM p GROUP BY term""")
def postings_index(spark, sf):
    p = moment_index(spark, sf).read("postings")
    return p.groupBy("term").agg(F.sum("n").cast("bigint").alias("df"), F.sum("cf").cast("bigint").alias("cf"),
                                 F.round(F.max(1.0 / F.col("min_dl")), 6).alias("best_share"))


@query("lexical_escalation", f"""
WITH {MOMENTS_SQL}, {TOK_SQL}
{bm25_sql(['the', 'tion', 'enre'], every=True, out='sa')},
{bm25_sql(['tion', 'enre'], out='so')},
a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rk FROM sa QUALIFY rk <= 50),
o AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rk FROM so QUALIFY rk <= 50),
u AS (SELECT id, 0 AS tier, rk FROM a UNION ALL SELECT id, 1, rk FROM o WHERE (SELECT count(*) FROM a) < 8),
f AS (SELECT id, min(struct_pack(tier := tier, rk := rk)) AS p FROM u GROUP BY id)
SELECT id, CAST(row_number() OVER (ORDER BY p.tier, p.rk) AS BIGINT) AS rank FROM f""")
def lexical_escalation(spark, sf):
    return moment_index(spark, sf).search("the tion enre", limit=50).withColumn("rank", F.col("rank").cast("bigint"))


def _tier(name, inner, where="true"):
    return f"SELECT '{name}' AS shape, id, CAST(rk AS BIGINT) AS rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rk FROM {inner}) AS x WHERE {where}"


@query("lexical_tiers", f"""
WITH {MOMENTS_SQL}, {TOK_SQL}
{bm25_sql(['tion', 'onth'], every=True, out='s1')},
{bm25_sql(['zzqx'], prefix='schlic', out='s3')},
{bm25_sql(['the', 'tion', 'enre'], every=True, out='s2')},
{bm25_sql(['tion', 'enre'], out='s4')},
strict AS ({_tier('strict', 's1', 'rk <= 40')}),
typed AS ({_tier('typed', 's3', 'rk <= 40')}),
narrow AS ({_tier('widened', 's2', 'rk <= 40')}),
wide AS ({_tier('widened', 's4', 'rk <= 40 AND (SELECT count(*) FROM narrow) < 1000')}),
widened AS (SELECT 'widened' AS shape, id, row_number() OVER (ORDER BY tier, rank) AS rank FROM (
  SELECT id, 0 AS tier, rank FROM narrow UNION ALL SELECT id, 1, rank FROM wide WHERE id NOT IN (SELECT id FROM narrow)) AS u)
SELECT * FROM strict UNION ALL SELECT * FROM typed UNION ALL SELECT shape, id, CAST(rank AS BIGINT) AS rank FROM widened""")
def lexical_tiers(spark, sf):
    """All shapes of a search: every word, every word then any, and a half-typed last word."""
    index = moment_index(spark, sf)
    found = [("strict", index.search("tion onth", limit=40, enough=1)), ("widened", index.search("the tion enre", limit=40, enough=1000)),
             ("typed", index.search("zzqx schlic", limit=40))]
    out = None
    for name, df in found:
        part = df.select(F.lit(name).alias("shape"), "id", F.col("rank").cast("bigint").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


@query("lexical_appended", f"""
WITH {MOMENTS_SQL}, {TOK_SQL} {bm25_sql(['que', 'the'])}
SELECT id, round(score, 5) AS score FROM scored""")
def lexical_appended(spark, sf):
    """An index grown by three batches, one of them written twice and one overlapping, scores like one of the whole."""
    index = LexicalIndex(spark, f"{shared_dir(spark).rstrip('/')}/appended-{uuid.uuid4().hex}")
    rows = moments(spark, sf)
    for batch, part in ((0, F.col("entity_key") % 3 == 0), (1, F.col("entity_key") % 3 < 2), (1, F.col("entity_key") % 3 < 2), (2, F.lit(True))):
        index.append(rows.where(part), batch)
    return index.scores(["que", "the"]).select("id", F.round("score", 5).alias("score"))


@query("hybrid_counts", f"""
WITH {MOMENTS_SQL}, {TOK_SQL}
m AS (SELECT id, entity_key, source FROM tok WHERE list_contains(tokens, 'tion') OR list_contains(tokens, 'onth')),
e AS (SELECT entity_key, count(*) AS hit_count, count(DISTINCT source) AS n_sources FROM m GROUP BY entity_key)
SELECT 'hits' AS field, CAST(hit_count AS VARCHAR) AS value, count(*) AS n FROM e GROUP BY hit_count
UNION ALL SELECT 'creators', CAST(entity_key % 7 AS VARCHAR), count(*) FROM e GROUP BY entity_key % 7""")
def hybrid_counts(spark, sf):
    """Hit counts and facets of a search, over every passage that matches."""
    rows = moments(spark, sf)
    cards = rows.select("entity_key").distinct().withColumn("creator", (F.col("entity_key") % 7).cast("string"))
    found = R.hybrid(rows, cards, "tion onth", index=moment_index(spark, sf))
    hits = found.matched.groupBy(F.lit("hits").alias("field"), F.col("hit_count").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return hits.unionByName(found.facets.select("field", "value", "n"))


@query("vocabulary_folded", f"""
WITH {MOMENTS_SQL}, t AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM moments)
SELECT term, CAST(count(DISTINCT id) AS BIGINT) AS df, count(*) AS cf FROM t WHERE starts_with(term, 'e') GROUP BY term""")
def vocabulary_folded(spark, sf):
    """A range of the dictionary of an index that strips accents."""
    def build(path):
        LexicalIndex(spark, path, fold=True).append(moments(spark, sf), 0)

    index = LexicalIndex(spark, stored(spark, "moment-index-folded", [f"{sf}/conversations.parquet"], build), fold=True)
    return index.vocabulary("e").select("term", F.col("df").cast("bigint").alias("df"), F.col("cf").cast("bigint").alias("cf"))


@query("like_fallback", """
SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY w DESC, doc_id) AS BIGINT) AS rank
FROM (SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) AS w FROM documents
      WHERE contains(lower(text), 'tion') OR contains(lower(text), 'schlich') ) QUALIFY rank <= 200""")
def like_fallback(spark, sf):
    return document_index(spark, sf).like("find the tion schlich").withColumn("rank", F.col("rank").cast("bigint"))


@query("rrf_two_rankings", """
WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 200),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 200),
u AS (SELECT id, 1.0 / (60 + rk) AS p FROM a UNION ALL SELECT id, 1.0 / (60 + rk) FROM b)
SELECT id, round(sum(CAST(p AS DOUBLE)), 9) AS fused FROM u GROUP BY id""")
def rrf_two_rankings(spark, sf):
    o = load(spark, sf, "orders")
    a = R.top_ranked(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), 200, digits=None)
    b = R.top_ranked(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("score")), 200, digits=None)
    return R.fuse((a, 1.0), (b, 1.0)).select("id", F.round("fused", 9).alias("fused"))


@query("phrase_bonus", f"""
SELECT doc_id, round(CASE WHEN contains(lower(text), 'of the and') THEN CAST(0.30 AS DOUBLE)
  ELSE CAST(0 AS DOUBLE) END, 2) AS exact_bonus,
  round(CASE WHEN contains(lower(text), 'le la que') THEN CAST(0.30 AS DOUBLE) ELSE
    CAST(least(0.20, 0.07 * CAST(contains(lower(text), 'le la') AS INT) + 0.07 * CAST(contains(lower(text), 'la que') AS INT)) AS DOUBLE) END, 2) AS pair_bonus
FROM documents""")
def phrase_bonus(spark, sf):
    # The first query is all stop words: only the verbatim match can score.
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.round(T.phrase_bonus(F.col("text"), "of the and"), 2).alias("exact_bonus"),
                    F.round(T.phrase_bonus(F.col("text"), "le la que"), 2).alias("pair_bonus"))


@query("facets_topn", """
WITH v AS (
  SELECT 'segment' AS field, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'words', unnest(string_split(c_mktsegment || ' ' || c_name, ' ')) FROM customer),
c AS (SELECT field, value, count(*) AS n FROM v WHERE trim(value) <> '' GROUP BY ALL)
SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 14""")
def facets_topn(spark, sf):
    pool = load(spark, sf, "customer").withColumn("words", F.split(F.concat_ws(" ", "c_mktsegment", "c_name"), " "))
    return (R.facets(pool, {"segment": "c_mktsegment", "nation": "c_nationkey"}, {"words": "words"})
            .withColumn("rank", F.col("rank").cast("bigint")))


@query("suggest_prefix", """
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS w FROM documents),
d AS (SELECT w AS text, count(*) AS df FROM t WHERE starts_with(w, 'sr') AND length(w) > 2 GROUP BY w),
n AS (SELECT DISTINCT source AS text FROM documents WHERE starts_with(lower(source), 'sr')),
u AS (SELECT text, 'name' AS kind, 0 AS prio, 0 AS df FROM n
      UNION ALL SELECT text, 'term', 9, df FROM d WHERE text NOT IN (SELECT lower(text) FROM n))
SELECT text, kind, CAST(df AS BIGINT) AS df FROM u ORDER BY prio, df DESC, text LIMIT 8""")
def suggest_prefix(spark, sf):
    names = load(spark, sf, "documents").groupBy(F.lower("source").alias("text")).agg(F.min("source").alias("shown")).withColumn("prio", F.lit(0))
    return document_index(spark, sf).suggest("sr", names).select("text", "kind", "df")


@query("search_sorts_paging", """
WITH c AS (SELECT o_custkey AS entity_key, max(o_totalprice) AS score, count(*) AS hit_count FROM orders GROUP BY o_custkey),
k AS (SELECT entity_key, score, hit_count, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS duration
      FROM c JOIN customer ON c_custkey = entity_key
      WHERE NOT (coalesce(c_acctbal, 0) > 0 AND c_acctbal < 500) AND hit_count >= 3)
SELECT entity_key, hit_count FROM k ORDER BY duration ASC NULLS LAST, score DESC, entity_key LIMIT 40 OFFSET 20""")
def search_sorts_paging(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_key")).agg(
        F.max("o_totalprice").alias("score"), F.count("*").alias("hit_count"))
    cards = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_acctbal").alias("duration"))
    kept = R.Filters(min_dur=500.0, min_hits=3).apply(g.join(cards, "entity_key"))
    return kept.orderBy(*R.order_columns("shortest")).offset(20).limit(40).select("entity_key", "hit_count")


@query("search_stats", f"""
WITH {MOMENTS_SQL}
SELECT 'moments' AS name, CAST(count(*) AS DOUBLE) AS value FROM moments
UNION ALL SELECT 'entities', CAST(count(*) AS DOUBLE) FROM customer
UNION ALL SELECT 'seconds', round(sum(c_acctbal), 2) FROM customer
UNION ALL SELECT 'creators', CAST(count(DISTINCT c_mktsegment) AS DOUBLE) FROM customer
UNION ALL SELECT 'source:' || source, CAST(count(*) AS DOUBLE) FROM moments GROUP BY source""")
def search_stats(spark, sf):
    cards = load(spark, sf, "customer").select(F.col("c_acctbal").alias("duration"), F.col("c_mktsegment").alias("creator"))
    return R.search_stats(moments(spark, sf), cards).withColumn("value", F.round("value", 2))
