"""Identity and merge queries.  Customers carry the canonical key ``cust_<n>``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import identity as I
from ..operators import merge as M
from ..session import shared_dir
from ..streaming import pipelines as St
from .registry import query
from .tables import EVENTS_TIMED_SQL, SLOTS_SQL, events_timed, load, order_slots


def key(c):
    return F.concat(F.lit("cust_"), F.lpad(c.cast("string"), 6, "0"))


KEY = "'cust_' || lpad(CAST({c} AS VARCHAR), 6, '0')"


def entities(spark, sf):
    """Every customer; its message id is its key plus one, recorded for two of three."""
    c = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        key(c).alias("entity_key"), F.when(c % 3 != 0, c + 1).cast("bigint").alias("msg_id"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("bigint").alias("record_msg_id"))


def messages(spark, sf):
    """Messages seen by the orders: a customer's own id, and a disagreement where status is P."""
    o = load(spark, sf, "orders")
    n = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 2).otherwise(F.col("o_custkey") + 1)
    return o.select(key(F.col("o_custkey")).alias("entity_key"), n.alias("msg_id"), F.lit("orders").alias("source")).distinct()


CAND_SQL = f"""
forms AS (SELECT unnest(['', 'tg', 'msg', 'msg_', 'tg_', 'id', 'up_', 'video_', 'frames_']) AS f),
keys AS (SELECT {KEY.format(c='c_custkey')} AS entity_key, c_custkey AS n FROM customer),
cand AS (
  SELECT entity_key AS alias, entity_key, 0 AS prio FROM keys
  UNION ALL SELECT f || CAST(n + 1 AS VARCHAR), entity_key, 1 FROM keys, forms WHERE n % 3 <> 0
  UNION ALL SELECT f || CAST(m AS VARCHAR), entity_key, 2 FROM (
    SELECT DISTINCT {KEY.format(c='o_custkey')} AS entity_key, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 2 ELSE o_custkey + 1 END AS m FROM orders), forms
    WHERE entity_key IN (SELECT entity_key FROM keys)),
per AS (SELECT alias, entity_key, min(prio) AS prio FROM cand GROUP BY ALL),
won AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY alias ORDER BY prio, entity_key) = 1)"""


def arrival_candidates(spark, sf):
    return I.candidates_from_entities(entities(spark, sf)).unionByName(I.candidates_from_messages(messages(spark, sf)))


def alias_map(spark, sf):
    return I.learn(arrival_candidates(spark, sf), entities(spark, sf))


@query("alias_map", f"WITH {CAND_SQL} SELECT alias, entity_key, prio FROM won")
def alias_learn(spark, sf):
    return alias_map(spark, sf)[0].select("alias", "entity_key", "prio")


@query("alias_conflicts", f"""
WITH {CAND_SQL}
SELECT per.alias, won.entity_key AS kept, per.entity_key AS refused FROM per JOIN won USING (alias) WHERE per.entity_key <> won.entity_key""")
def alias_conflicts(spark, sf):
    return alias_map(spark, sf)[1].select("alias", "kept", "refused")


SPELL = "CASE o_orderkey % 4 WHEN 0 THEN 'tg' || CAST(o_custkey + 1 AS VARCHAR) WHEN 1 THEN 'frames_' || CAST(o_custkey + 1 AS VARCHAR) WHEN 2 THEN " \
        + KEY.format(c="o_custkey") + " ELSE 'lost' || CAST(o_custkey AS VARCHAR) END"


def spelled_orders(spark, sf):
    o = load(spark, sf, "orders")
    k, m = F.col("o_custkey"), F.col("o_orderkey") % 4
    s = (F.when(m == 0, F.concat(F.lit("tg"), (k + 1).cast("string"))).when(m == 1, F.concat(F.lit("frames_"), (k + 1).cast("string")))
         .when(m == 2, key(k)).otherwise(F.concat(F.lit("lost"), k.cast("string"))))
    return o.select("o_orderkey", s.alias("spelling"))


@query("alias_resolve", f"""
WITH {CAND_SQL}, s AS (SELECT o_orderkey, {SPELL} AS spelling FROM orders)
SELECT o_orderkey, coalesce(won.entity_key, CASE WHEN regexp_matches(spelling, '^(tg|frames_)[0-9]+$') THEN regexp_extract(spelling, '([0-9]+)$') ELSE spelling END) AS entity_key,
       won.entity_key IS NOT NULL AS resolved FROM s LEFT JOIN won ON won.alias = s.spelling""")
def alias_resolve(spark, sf):
    return M.resolve(spelled_orders(spark, sf), "spelling", alias_map(spark, sf)[0]).select("o_orderkey", "entity_key", "resolved")


@query("identity_audit", f"""
WITH {CAND_SQL}, s AS (SELECT DISTINCT {SPELL} AS spelling FROM orders),
r AS (SELECT spelling, coalesce(won.entity_key, CASE WHEN regexp_matches(spelling, '^(tg|frames_)[0-9]+$') THEN regexp_extract(spelling, '([0-9]+)$') ELSE spelling END) AS k
      FROM s LEFT JOIN won ON won.alias = s.spelling),
a AS (SELECT 'orders' AS tbl, 'spelling' AS col, count(*) AS spellings, count(DISTINCT k) AS entities,
             count(DISTINCT k) FILTER (k NOT IN (SELECT entity_key FROM keys)) AS unresolved,
             (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT k FROM r WHERE k NOT IN (SELECT entity_key FROM keys) ORDER BY k LIMIT 5)) AS examples FROM r
      UNION ALL
      SELECT 'customer', 'c_custkey', count(*), count(*), 0, NULL FROM customer)
SELECT tbl, col, spellings, entities, unresolved, examples, unresolved = 0 AS ok FROM a""")
def identity_audit(spark, sf):
    cust = load(spark, sf, "customer").select(key(F.col("c_custkey")).alias("c_custkey"))
    sp = I.spelling_columns({("orders", "spelling"): spelled_orders(spark, sf), ("customer", "c_custkey"): cust})
    a = I.audit(sp, alias_map(spark, sf)[0], entities(spark, sf))
    return a.select("tbl", "col", "spellings", "entities", "unresolved", F.array_join("examples", ",").alias("examples"), "ok")


@query("anti_unresolved", f"""
WITH {CAND_SQL}, s AS (SELECT DISTINCT {SPELL} AS spelling FROM orders)
SELECT DISTINCT coalesce(won.entity_key, CASE WHEN regexp_matches(spelling, '^(tg|frames_)[0-9]+$') THEN regexp_extract(spelling, '([0-9]+)$') ELSE spelling END) AS entity_key
FROM s LEFT JOIN won ON won.alias = s.spelling WHERE won.entity_key IS NULL""")
def anti_unresolved(spark, sf):
    sp = I.spelling_columns({("orders", "spelling"): spelled_orders(spark, sf)})
    return I.unresolved(sp, alias_map(spark, sf)[0], entities(spark, sf)).select("entity_key")


@query("orphan_adoption", f"""
WITH {CAND_SQL}, s AS (SELECT DISTINCT o_custkey, {SPELL} AS spelling FROM orders)
SELECT DISTINCT 'lost' || CAST(o_custkey AS VARCHAR) AS alias, 'found_' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS entity_key FROM s
WHERE spelling LIKE 'lost%'""")
def orphan_adoption(spark, sf):
    sp = I.spelling_columns({("orders", "spelling"): spelled_orders(spark, sf)})
    missing = I.unresolved(sp, alias_map(spark, sf)[0], entities(spark, sf))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("n"))
    bridge = c.select(F.concat(F.lit("lost"), F.col("n").cast("string")).alias("spelling"), F.concat(F.lit("found_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("entity_key"))
    return I.adopt_orphans(missing, bridge)[1].select("alias", "entity_key")


@query("content_twins", """
WITH d AS (SELECT doc_id, sha256(text) AS digest, n_chars FROM documents),
g AS (SELECT digest, count(*) AS n, min('docu_' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS leader, max(n_chars) AS size FROM d GROUP BY digest HAVING count(*) > 1)
SELECT 'docu_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS entity_key, digest, leader, n - 1 AS twins, size FROM d JOIN g USING (digest)""")
def content_twins(spark, sf):
    d = load(spark, sf, "documents")
    stem = F.concat(F.lit("docu_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    files = d.select(stem.alias("stem"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("bytes"))
    keys = files.select(F.col("stem").alias("entity_key"))
    aliases = keys.select(F.col("entity_key").alias("alias"), "entity_key")
    return I.content_groups(files, aliases, keys)[1]


@query("content_aliases", """
WITH d AS (SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn,
                  count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS lead FROM documents)
SELECT 'copy' || CAST(doc_id AS VARCHAR) || '_x' AS alias, 'docu_' || lpad(CAST(lead AS VARCHAR), 8, '0') AS entity_key FROM d WHERE rn > 1
UNION ALL SELECT DISTINCT 'sha256:' || digest, 'docu_' || lpad(CAST(lead AS VARCHAR), 8, '0') FROM d""")
def content_aliases(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("bytes"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("lead"))
    name = F.concat(F.lit("docu_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    files = d.join(first, "digest").select(
        F.when(F.col("doc_id") == F.col("lead"), name).otherwise(F.concat(F.lit("copy"), F.col("doc_id").cast("string"), F.lit("_x"))).alias("stem"), "digest", "bytes")
    keys = files.filter(F.col("stem").startswith("docu_")).select(F.col("stem").alias("entity_key"))
    return I.content_groups(files, keys.select(F.col("entity_key").alias("alias"), "entity_key"), keys)[0].select("alias", "entity_key")


@query("reuploads", f"""
WITH m AS (SELECT DISTINCT o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 2 ELSE o_custkey + 1 END AS m FROM orders)
SELECT {KEY.format(c='k')} AS entity_key, count(*) AS messages FROM m GROUP BY k HAVING count(*) > 1""")
def reuploads(spark, sf):
    return I.reuploads(messages(spark, sf))


@query("collection_membership", """
WITH m AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders UNION SELECT c_custkey, c_mktsegment FROM customer)
SELECT o_orderpriority AS collection, count(*) AS n FROM m GROUP BY 1""")
def collection_membership(spark, sf):
    c = load(spark, sf, "customer").select(key(F.col("c_custkey")).alias("entity_key"), F.col("c_mktsegment").alias("collection"))
    o = load(spark, sf, "orders").select(key(F.col("o_custkey")).alias("entity_key"), F.concat(F.lit(" "), "o_orderpriority").alias("collection"))
    return I.collection_counts(I.set_collections(c, o))


@query("identity_arrays", f"""
WITH {CAND_SQL},
a AS (SELECT entity_key, string_agg(alias, ',' ORDER BY alias) AS aliases FROM won WHERE alias <> entity_key GROUP BY 1),
m AS (SELECT entity_key, string_agg(m, ',' ORDER BY m0) AS messages FROM (SELECT DISTINCT {KEY.format(c='o_custkey')} AS entity_key, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 2 ELSE o_custkey + 1 END AS m0, CAST(CASE WHEN o_orderstatus = 'P' THEN o_custkey + 2 ELSE o_custkey + 1 END AS VARCHAR) AS m FROM orders) GROUP BY 1)
SELECT {KEY.format(c='c_custkey')} AS entity_key, aliases, messages, c_mktsegment AS collections FROM customer
LEFT JOIN a ON a.entity_key = {KEY.format(c='c_custkey')} LEFT JOIN m ON m.entity_key = {KEY.format(c='c_custkey')}""")
def identity_arrays(spark, sf):
    c = load(spark, sf, "customer").select(key(F.col("c_custkey")).alias("entity_key"), F.col("c_mktsegment").alias("collection"))
    none = c.select("entity_key", F.lit("").alias("digest"), F.lit(0).alias("twins")).limit(0)
    b = I.bulk_arrays(alias_map(spark, sf)[0], messages(spark, sf), c, none)
    return b.select("entity_key", F.array_join("aliases", ",").alias("aliases"),
                    F.array_join(F.transform("messages", lambda x: x.cast("string")), ",").alias("messages"), F.array_join("collections", ",").alias("collections"))


@query("canonicalise_rows", f"""
WITH {CAND_SQL},
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 1 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN {KEY.format(c='o_custkey')} ELSE '99999' || CAST(o_custkey AS VARCHAR) END AS k,
             CASE WHEN o_orderkey % 2 = 0 THEN 'https://instagram.com/reel/Lnk' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/' ELSE '' END AS url FROM orders)
SELECT o_orderkey, CASE WHEN k LIKE 'cust%' THEN k WHEN url <> '' THEN 'Lnk' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE won.entity_key END AS entity_key
FROM r LEFT JOIN won ON won.alias = k WHERE k LIKE 'cust%' OR url <> '' OR won.entity_key IS NOT NULL""")
def canonicalise_rows(spark, sf):
    o = load(spark, sf, "orders")
    k, m = F.col("o_custkey"), F.col("o_orderkey") % 3
    rows = o.select("o_orderkey", F.when(m == 0, (k + 1).cast("string")).when(m == 1, key(k)).otherwise(F.concat(F.lit("99999"), k.cast("string"))).alias("entity_key"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://instagram.com/reel/Lnk"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("/"))).otherwise("").alias("url"))
    return I.canonicalise_rows(rows, alias_map(spark, sf)[0])[0].select("o_orderkey", "entity_key")


@query("identity_absorb", f"""
WITH {CAND_SQL},
c2 AS (SELECT alias, entity_key, prio FROM won
       UNION ALL SELECT 'supp_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'supp_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 10 FROM supplier
       UNION ALL SELECT f || CAST(s_suppkey * 100 + 1 AS VARCHAR), 'supp_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 11 FROM supplier, forms)
SELECT alias, entity_key FROM c2 QUALIFY row_number() OVER (PARTITION BY alias ORDER BY prio, entity_key) = 1""")
def identity_absorb(spark, sf):
    s = load(spark, sf, "supplier").select(F.concat(F.lit("supp_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("entity_key"),
                                           (F.col("s_suppkey") * 100 + 1).alias("msg_id"))
    return I.absorb(alias_map(spark, sf)[0], entities(spark, sf), s)[0].select("alias", "entity_key")


@query("identity_arrivals", f"WITH {CAND_SQL} SELECT alias, entity_key, prio FROM won")
def identity_arrivals(spark, sf):
    """Identity fed by a stream in two arrivals, the witnesses of some entities before the entities: equal to learning at once."""
    path = f"{shared_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex[:12]}"
    every = arrival_candidates(spark, sf)
    early = F.pmod(F.xxhash64("alias", "entity_key"), F.lit(3)) == 0
    for n, part in enumerate((every.where(early), every.where(~early))):
        part.write.parquet(f"{path}/in/arrival={n}")
        stream = spark.readStream.schema(every.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        St.learn_stream(stream, f"{path}/out", f"{path}/cp")
    return I.learned(spark.read.parquet(f"{path}/out"))[0].select("alias", "entity_key", "prio")


@query("key_shapes", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'up_' || o_custkey WHEN 1 THEN 'tg' || o_custkey WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'Short' || o_custkey ELSE 'a b' END AS k,
       o_orderkey % 5 IN (0, 3) AS canonical, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN o_custkey ELSE 0 END AS message FROM orders""")
def key_shapes(spark, sf):
    n, m = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    k = (F.when(m == 0, F.concat(F.lit("up_"), n)).when(m == 1, F.concat(F.lit("tg"), n)).when(m == 2, n).when(m == 3, F.concat(F.lit("Short"), n)).otherwise("a b"))
    return load(spark, sf, "orders").select("o_orderkey", k.alias("k")).select("o_orderkey", "k", K.looks_canonical(F.col("k")).alias("canonical"), K.message_id_in(F.col("k")).alias("message"))


# ---- merging and relational operators ------------------------------------------------

@query("merge_upsert", """
WITH n AS (SELECT s_suppkey, max(s_name || '!') AS s_name, max(s_acctbal) + 1 AS s_acctbal FROM supplier WHERE s_acctbal > 0 GROUP BY s_suppkey
           UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_acctbal <= 0)
SELECT coalesce(n.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(n.s_name, s.s_name) AS s_name, round(coalesce(n.s_acctbal, s.s_acctbal), 2) AS s_acctbal
FROM supplier s FULL OUTER JOIN n ON n.s_suppkey = s.s_suppkey""")
def merge_upsert(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.filter("s_acctbal > 0").select("s_suppkey", F.concat("s_name", F.lit("!")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal")) \
        .unionByName(s.filter("s_acctbal <= 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return M.upsert(s, new, ["s_suppkey"]).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("merge_append", """
SELECT c_mktsegment, c_nationkey FROM customer GROUP BY ALL
UNION SELECT 'EXTRA', n_nationkey FROM nation""")
def merge_append(spark, sf):
    base = load(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()
    new = base.unionByName(load(spark, sf, "nation").select(F.lit("EXTRA").alias("c_mktsegment"), F.col("n_nationkey").alias("c_nationkey")))
    return M.snapshot_merge(base, new, None)


@query("enrich_nulls", """
WITH b AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS p_brand FROM part),
n AS (SELECT l_partkey, l_returnflag AS p_name, l_linestatus AS p_brand FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_linestatus) = 1)
SELECT p_partkey, coalesce(b.p_name, n.p_name) AS p_name, coalesce(b.p_brand, n.p_brand) AS p_brand FROM b LEFT JOIN n ON l_partkey = p_partkey""")
def enrich_nulls(spark, sf):
    b = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("p_name"),
                                       F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("p_brand"))
    n = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("p_name"), F.col("l_linestatus").alias("p_brand"))
    return M.enrich(b, n, ["p_partkey"])


@query("interval_borrow_join", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_tax ELSE o_totalprice END AS t0,
       CASE WHEN l_discount > 0.05 THEN l_quantity ELSE o_totalprice + 10 END AS t1 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM lineitem)
LEFT JOIN orders ON o_orderkey = l_orderkey""")
def interval_borrow_join(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity").distinct()
    d = F.col("l_discount") > 0.05
    rows = li.select(F.col("l_orderkey").alias("entity_key"), F.col("l_orderkey").alias("shot_idx"), "l_linenumber",
                     F.when(d, F.col("l_tax")).alias("t0"), F.when(d, F.col("l_quantity")).alias("t1"))
    iv = load(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_key"), F.col("o_orderkey").alias("idx"),
                                          F.col("o_totalprice").alias("t0"), (F.col("o_totalprice") + 10).alias("t1"))
    return M.time_link(rows, iv).select(F.col("entity_key").alias("l_orderkey"), "l_linenumber", "t0", "t1")


@query("point_in_interval", f"""
WITH {SLOTS_SQL},
pts AS (SELECT o_orderkey AS entity_key, o_totalprice / 20000.0 AS t FROM orders),
f AS (SELECT p.entity_key, min(idx) AS i FROM pts p JOIN slots s ON s.entity_key = p.entity_key AND p.t >= s.t0 AND p.t < s.t1 GROUP BY 1),
l AS (SELECT entity_key, arg_max(idx, idx) AS li, arg_max(t1, struct_pack(a := idx, b := t1)) AS le FROM slots GROUP BY 1)
SELECT p.entity_key, CAST(coalesce(f.i, CASE WHEN p.t >= l.le THEN l.li END, 0) AS INTEGER) AS idx FROM pts p LEFT JOIN f USING (entity_key) LEFT JOIN l USING (entity_key)""")
def point_in_interval(spark, sf):
    pts = load(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_key"), (F.col("o_totalprice") / 20000.0).alias("t"))
    slots = order_slots(spark, sf).groupBy("entity_key", "idx").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return M.interval_at(pts, slots, "entity_key", "t", ["t"], cell_seconds=5.0).select("entity_key", "idx")


@query("series_per_interval", f"""
WITH {EVENTS_TIMED_SQL},
days AS (SELECT DISTINCT user_id, CAST(floor(t / 86400) AS BIGINT) AS idx FROM ev)
SELECT d.user_id, d.idx, count(*) AS n, round(avg(e.value), 4) AS mean FROM days d JOIN ev e
  ON e.user_id = d.user_id AND e.t >= d.idx * 86400.0 AND e.t < d.idx * 86400.0 + 43200.0 GROUP BY ALL HAVING count(*) >= 2""")
def series_per_interval(spark, sf):
    ev = events_timed(spark, sf)
    days = ev.select("user_id", F.floor(F.col("t") / 86400).cast("bigint").alias("idx")).distinct().withColumn("t0", F.col("idx") * 86400.0) \
        .withColumn("t1", F.col("idx") * 86400.0 + 43200.0)
    return M.series_per_interval(ev, days, "user_id", "t", "value", cell_seconds=43200.0).select("user_id", "idx", "n", F.round("mean", 4).alias("mean"))


@query("clips_in_window", f"""
WITH {SLOTS_SQL} SELECT entity_key, idx, count(*) AS n FROM slots WHERE t1 > 6 AND t0 < 9 GROUP BY ALL""")
def clips_in_window(spark, sf):
    s = order_slots(spark, sf)
    return s.filter((F.col("t1") > 6) & (F.col("t0") < 9)).groupBy("entity_key", "idx").agg(F.count("*").alias("n"))


@query("semi_inventory", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_inventory(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return M.in_inventory(load(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("anti_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_orphans(spark, sf):
    o = load(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return M.orphans(load(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


@query("target_merge", """
WITH a AS (SELECT c_custkey AS k, c_acctbal AS expected, c_name AS name FROM customer WHERE c_acctbal > 1000),
b AS (SELECT o_custkey AS k, sum(o_totalprice) AS expected, 'from orders' AS name FROM orders GROUP BY 1)
SELECT k, round(coalesce(b.expected, a.expected), 2) AS expected, coalesce(a.name, b.name) AS name FROM a FULL OUTER JOIN b USING (k)""")
def target_merge(spark, sf):
    a = load(spark, sf, "customer").filter("c_acctbal > 1000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("expected"), F.col("c_name").alias("name"))
    b = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("expected")).withColumn("name", F.lit("from orders"))
    return M.merge_targets(a, b, ["k"], ["expected"]).withColumn("expected", F.round("expected", 2))


@query("row_count_diff", """
WITH l AS (SELECT o_orderpriority AS "table", count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS "table", count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT "table", l.n AS local, coalesce(b.n, 0) AS bundle, coalesce(b.n, 0) - l.n AS delta, coalesce(b.n, 0) < l.n AS destructive FROM l LEFT JOIN b USING ("table")""")
def row_count_diff(spark, sf):
    o = load(spark, sf, "orders").withColumnRenamed("o_orderpriority", "table")
    return M.row_count_diff(o.groupBy("table").agg(F.count("*").alias("n")), o.filter("o_orderstatus <> 'P'").groupBy("table").agg(F.count("*").alias("n")))


@query("table_counts", "SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark, sf):
    return M.table_counts({n: load(spark, sf, n) for n in ("orders", "part", "pages")})


@query("opaque_columns", """
SELECT 'text' AS "column", count(*) FILTER (text <> '') AS real, false AS opaque FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (lang <> ''), false FROM documents UNION ALL SELECT 'source', count(*) FILTER (source <> ''), false FROM documents
UNION ALL SELECT 'blob', count(*), true FROM documents""")
def opaque_columns(spark, sf):
    d = load(spark, sf, "documents").withColumn("blob", F.repeat(F.sha2("text", 512), 3))
    return M.opaque_columns(d)


@query("substring_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue') OR contains(lower(p_type), 'blue')")
def substring_search(spark, sf):
    return M.substring_search(load(spark, sf, "part"), "BLUE").select("p_partkey")


@query("table_page", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || '|' || p_brand || '|' || p_type), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 10")
def table_page(spark, sf):
    return M.browse_table(load(spark, sf, "part"), "ring", "p_retailprice", True, 50, 10).select("p_partkey", "p_name")


@query("cell_occurrences", """
SELECT 'customer' AS "table", count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey = 3""")
def cell_occurrences(spark, sf):
    t = {"customer": load(spark, sf, "customer").withColumnRenamed("c_nationkey", "nk"), "nation": load(spark, sf, "nation").withColumnRenamed("n_nationkey", "nk"),
         "part": load(spark, sf, "part")}
    return M.value_occurrences(t, "nk", 3)


@query("related_rows", """
SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey = 42""")
def related_rows(spark, sf):
    t = {"orders": (load(spark, sf, "orders"), "o_custkey"), "customer": (load(spark, sf, "customer"), "c_custkey")}
    return M.related_rows(t, "42", ["tg42"]).groupBy("table").agg(F.count("*").alias("n"))


@query("zip_by_position", """
WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region)
SELECT n_name, r_name FROM a LEFT JOIN b USING (i)""")
def zip_by_position(spark, sf):
    a, b = load(spark, sf, "nation").select("n_name", "n_nationkey"), load(spark, sf, "region").select("r_name", "r_regionkey")
    return M.zip_by_position(a, b, "n_nationkey", "r_regionkey").select("n_name", "r_name")


@query("kv_store", """
SELECT CAST(o_custkey AS VARCHAR) AS k, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderstatus)) AS v FROM orders GROUP BY 1""")
def kv_store(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("at"))
    return M.kv_put(o.filter("v = 'F'"), o.filter("v <> 'F'")).select("k", "v")


@query("library_browse", """
WITH i AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000)
SELECT c_custkey AS entity_key, CASE WHEN contains(lower(c_name), '77') AND o_custkey IS NOT NULL THEN 'both' WHEN contains(lower(c_name), '77') OR contains(CAST(c_custkey AS VARCHAR), '77') THEN
  CASE WHEN o_custkey IS NOT NULL THEN 'both' ELSE 'meta' END ELSE 'inside' END AS matched
FROM customer LEFT JOIN i ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND (contains(lower(c_name), '77') OR contains(CAST(c_custkey AS VARCHAR), '77') OR o_custkey IS NOT NULL)""")
def library_browse(spark, sf):
    cards = load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("creator"),
                                               F.col("c_acctbal").alias("duration"), F.lit(None).cast("double").alias("created_at"))
    inside = load(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("entity_key"))
    return M.library_page(cards, creator="MACHINERY", text="77", inside=inside, sort="shortest", limit=None).select("entity_key", "matched")
