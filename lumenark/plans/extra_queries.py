"""Smaller operators: JSON cells, decode coverage, uploads, loudness logs, transfer tallies, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import maths as M
from ..functions import text as T
from ..operators import ledger as L
from ..operators import merge as Mg
from ..sources import texts as X
from ..streaming import pipelines as St
from .registry import query
from .tables import EVENTS_TIMED_SQL, events_timed, load


@query("flatten_json", "SELECT p_partkey, p_name || ', ' || p_type || ', ' || p_brand AS text FROM part UNION ALL SELECT -p_partkey - 1, p_name FROM part")
def flatten_json(spark, sf):
    p = load(spark, sf, "part")
    doc = F.to_json(F.array(F.struct(F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.lit("x").alias("conf"), F.struct(F.col("p_brand").alias("y"), F.col("p_size").alias("z")).alias("in"))))
    rows = p.select("p_partkey", doc.alias("c")).unionByName(p.select((-F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("c")))
    return rows.select("p_partkey", J.flatten_json(F.col("c")).alias("text"))


@query("decode_coverage", """
SELECT p_partkey, round(CASE WHEN p_size * 2 >= 1 THEN greatest(0, 1 - p_retailprice / 20 / (p_size * 2)) ELSE 0 END, 9) AS missing FROM part""")
def decode_coverage(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.round(M.shortfall(F.col("p_retailprice") / 20, F.col("p_size").cast("double"), F.lit(2.0)), 9).alias("missing"))


@query("retry_backoff", "SELECT o_orderkey, CAST(least(60 * pow(2, greatest(o_custkey % 9 - 1, 0)), 3600) AS DOUBLE) AS wait FROM orders")
def retry_backoff(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", M.backoff_seconds(F.col("o_custkey") % 9).alias("wait"))


@query("bare_uploads", """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0""")
def bare_uploads(spark, sf):
    o = load(spark, sf, "orders")
    mime = F.when(F.col("o_orderstatus") == "F", "video/mp4").otherwise("application/x")
    name = F.when(F.col("o_orderstatus") == "O", "clip.MOV").otherwise("file.bin")
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    caption = F.when(F.col("o_custkey") % 5 == 0, "see key:AbCdEfG").otherwise("a key: word")
    return o.filter(X.bare_upload(mime, name, reply, caption, ("shard",), (".part",))).select("o_orderkey")


@query("export_members", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'saved collections' ELSE '' END AS label FROM pages WHERE page_id % 3 IN (0, 1)""")
def export_members(spark, sf):
    m = F.col("page_id") % 3
    path = F.when(m == 0, "a/saved_collections.json").when(m == 1, "a/saved_posts.json").otherwise("a/liked_comments.json")
    return X.export_members(load(spark, sf, "pages").select("page_id", path.alias("path"))).select("page_id", F.col("base_label").alias("label"))


@query("loudness_log", """
SELECT l_orderkey AS entity_key, -min_by(l_quantity, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT)) AS lufs, CAST(NULL AS DOUBLE) AS true_peak FROM lineitem GROUP BY 1""")
def loudness_log(spark, sf):
    li = load(spark, sf, "lineitem")
    n = ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("bigint")) * 2
    rows = li.select(F.col("l_orderkey").alias("entity_key"), n.alias("line_no"), F.concat(F.lit("  I:  -"), F.col("l_quantity").cast("string"), F.lit(" LUFS")).alias("line"))
    peak = li.select(F.col("l_orderkey").alias("entity_key"), (n + 1).alias("line_no"), F.lit("  Peak: -inf dBFS").alias("line"))
    return X.loudness_summary(rows.unionByName(peak)).select("entity_key", "lufs", "true_peak")


@query("transfer_tally", """
WITH v AS (SELECT p_size, l FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) AS l FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_partkey = p_partkey)
SELECT count(*) AS targets, count(*) FILTER (l = p_size) AS verified, count(*) FILTER (l IS NULL) AS missing, count(*) FILTER (l <> p_size) AS failed, CAST(sum(l) AS BIGINT) AS bytes FROM v""")
def transfer_tally(spark, sf):
    t = load(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("expected"), F.lit(0).alias("attempts"))
    f = load(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").cast("bigint").alias("got"))
    return L.transfer_tally(L.verify_transfers(t, f, 0.0))


@query("journal_tail", f"WITH {EVENTS_TIMED_SQL} SELECT event_id AS id, event_type AS kind FROM ev WHERE event_id > 50 ORDER BY event_id DESC LIMIT 100")
def journal_tail(spark, sf):
    return St.tail(events_timed(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), 50)


@query("late_enrichment", """
WITH b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 3000 THEN c_name END AS name FROM customer WHERE c_nationkey < 15), n AS (SELECT c_custkey AS k, c_mktsegment AS name FROM customer)
SELECT k, coalesce(b.name, n.name) AS name FROM n LEFT JOIN b USING (k)""")
def late_enrichment(spark, sf):
    c = load(spark, sf, "customer")
    base = c.filter("c_nationkey < 15").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 3000, F.col("c_name")).alias("name"))
    return St.enrich_late(base, c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name")), ["k"])


@query("schema_drift", """
SELECT coalesce(s_suppkey, -1) AS k, s_name AS label FROM supplier""")
def schema_drift(spark, sf):
    s = load(spark, sf, "supplier")
    old = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value"))
    new = s.filter("s_acctbal <= 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    both = Mg.widen(old, new).unionByName(Mg.widen(new, old))
    return both.select("k", Mg.pick(both, "value", "name", "title").alias("label"))


@query("word_counts", """
SELECT doc_id, len(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{M}]*')) AS words FROM documents""")
def word_counts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))
