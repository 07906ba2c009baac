"""Property-graph and curriculum queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import curriculum as C
from ..operators import graph as G
from ..operators.graphstore import StoredGraph
from ..session import cut_lineage, shared_dir, stored
from .registry import query
from .tables import load

# Customers are the entities; nation is a dimension, order priorities an attribute store,
# parts' names the tags of the orders that hold them.


def cards(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("title"))


def fk_part(spark, sf):
    n = load(spark, sf, "nation")
    return G.dimension_edges(load(spark, sf, "customer"), "c_custkey", "c_nationkey", n, "nation", "n_nationkey", "n_name", "customer", rel="nation")


def attr_part(spark, sf):
    o = load(spark, sf, "orders")
    n = cards(spark, sf).agg(F.count("*")).scalar()
    rows = o.select("o_custkey", F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("channel"))
    return G.attribute_edges(rows, "o_custkey", "kind", "value", "orders", n, "channel")


def graph(spark, sf):
    """The stored graph, written by the first query that needs it."""
    def build(path):
        StoredGraph(spark, path).append(*G.gather(cards(spark, sf), fk_part(spark, sf), attr_part(spark, sf)), 0)

    return StoredGraph(spark, stored(spark, "graph", [f"{sf}/{t}.parquet" for t in ("customer", "nation", "orders")], build))


def part_links(spark, sf):
    """Customers and the parts they ordered, stored."""
    def build(path):
        o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
        li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        edges = o.join(li, "o_orderkey").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"),
                                                F.lit("ordered").alias("rel"), F.lit(1.0).alias("weight"), F.lit("lineitem|l_partkey").alias("ref"))
        StoredGraph(spark, path).append(None, edges, 0)

    return StoredGraph(spark, stored(spark, "part-links", [f"{sf}/{t}.parquet" for t in ("orders", "lineitem")], build))


GRAPH_SQL = """
fk AS (SELECT 'v:' || c_custkey AS src, 'd:nation:' || c_nationkey AS dst, 'nation' AS rel, 1.0 AS weight, 'customer|c_nationkey|' || c_nationkey AS ref
       FROM customer JOIN nation ON n_nationkey = c_nationkey),
ap AS (SELECT DISTINCT o_custkey AS k, lower(o_orderpriority) AS token FROM orders),
ad AS (SELECT token, count(*) AS df FROM ap GROUP BY token HAVING count(*) >= 2 AND count(*) < (SELECT count(*) FROM customer)),
atr AS (SELECT 'v:' || k AS src, 'a:orders.priority:' || token AS dst, 'priority' AS rel, 1.0 AS weight, 'orders|value|' || token AS ref
       FROM ap JOIN ad USING (token) WHERE k IN (SELECT c_custkey FROM customer)),
edges AS (SELECT * FROM fk UNION ALL SELECT * FROM atr),
deg AS (SELECT id, CAST(sum(weight) AS DOUBLE) AS weight FROM (SELECT src AS id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY id),
raw AS (SELECT 'v:' || c_custkey AS id, 'video' AS kind, c_name AS label, 'videos' AS sub FROM customer
        UNION ALL SELECT 'd:nation:' || n_nationkey, 'dim', n_name, 'nation' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
        UNION ALL SELECT 'a:orders.priority:' || token, 'attr', token, 'priority' FROM ad),
nodes AS (SELECT raw.*, coalesce(weight, 0.0) AS weight FROM raw LEFT JOIN deg USING (id))"""


@query("fk_graph", f"WITH {GRAPH_SQL} SELECT src, dst, rel, CAST(weight AS DOUBLE) AS weight, ref FROM fk")
def fk_graph(spark, sf):
    return G.accumulate_edges(fk_part(spark, sf)[1])


@query("attr_graph", f"WITH {GRAPH_SQL} SELECT src, dst, rel, CAST(weight AS DOUBLE) AS weight, ref FROM atr")
def attr_graph(spark, sf):
    return G.build(cards(spark, sf), attr_part(spark, sf))[1]


@query("graph_nodes", f"WITH {GRAPH_SQL} SELECT id, kind, label, sub, weight FROM nodes")
def graph_nodes(spark, sf):
    return graph(spark, sf).nodes().drop("meta")


@query("tag_graph", """
WITH t AS (SELECT DISTINCT l_orderkey AS k, unnest([lower(p_name), lower(p_type)]) AS token FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT token, count(*) AS df FROM t GROUP BY token HAVING count(*) >= 2 AND count(*) < (SELECT count(*) FROM orders))
SELECT 'v:' || k AS src, 't:part.tags:' || token AS dst, df FROM t JOIN d USING (token)""")
def tag_graph(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(", ", "p_name", "p_type").alias("tags"))
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")
    n = load(spark, sf, "orders").agg(F.count("*")).scalar()
    nodes, edges = G.tag_edges(rows, "l_orderkey", "tags", "part", n)
    df = nodes.select(F.col("id").alias("dst"), F.col("meta")["videos"].cast("bigint").alias("df"))
    return edges.join(df, "dst").select("src", "dst", "df")


@query("hashtag_graph", """
WITH t AS (SELECT doc_id, '#' || source || ' #' || lang || ' ' || text AS text FROM documents WHERE text NOT LIKE '{%' AND text NOT LIKE '[%'),
h AS (SELECT DISTINCT doc_id, lower(x) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '#([A-Za-z0-9_À-ɏ]{2,40})', 1)) AS x FROM t))
SELECT token, count(*) AS n FROM h GROUP BY token""")
def hashtag_graph(spark, sf):
    d = load(spark, sf, "documents").filter(~F.col("text").rlike(r"^[\[{]")).select("doc_id", F.concat(F.lit("#"), F.col("source"), F.lit(" #"), F.col("lang"), F.lit(" "), F.col("text")).alias("text"))
    _, edges = G.hashtag_edges(d, "doc_id", "text", "documents")
    return edges.groupBy(F.substring("dst", 3, 100).alias("token")).agg(F.count("*").alias("n"))


@query("graph_neighbors", f"""
WITH {GRAPH_SQL},
f AS (SELECT dst AS id, rel, weight FROM edges WHERE src = 'd:nation:7' UNION ALL SELECT src, rel, weight FROM edges WHERE dst = 'd:nation:7')
SELECT f.id, f.rel, CAST(f.weight AS DOUBLE) AS weight, n.kind, (SELECT count(*) FROM f) AS total FROM f JOIN nodes n USING (id)
ORDER BY f.weight DESC, f.id, f.rel LIMIT 60""")
def graph_neighbors(spark, sf):
    ring, _, total = graph(spark, sf).neighbors("d:nation:7")
    return ring.withColumn("total", total.select("total").scalar()).select("id", "rel", "weight", "kind", "total")


@query("graph_hubs", f"""
WITH {GRAPH_SQL},
h AS (SELECT id FROM nodes WHERE kind <> 'video' ORDER BY weight DESC, id LIMIT 16),
l AS (SELECT src FROM edges JOIN h ON h.id = dst QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, rel) <= 4),
i AS (SELECT id FROM h UNION SELECT src FROM l)
SELECT src, dst, rel FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)""")
def graph_hubs(spark, sf):
    return graph(spark, sf).overview()[2].select("src", "dst", "rel")


@query("graph_deltas", """
WITH e AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, count(*) AS n, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS w, min(CAST(o_orderkey AS VARCHAR)) AS ref FROM orders GROUP BY ALL),
d AS (SELECT id, sum(w) AS degree FROM (SELECT src AS id, w FROM e UNION ALL SELECT dst, w FROM e) GROUP BY id)
SELECT src, dst, w AS weight, ref, d.degree FROM e JOIN d ON d.id = e.src""")
def graph_deltas(spark, sf):
    """Edges that arrive in three batches, one written twice: weights and degrees add up over them."""
    store = StoredGraph(spark, f"{shared_dir(spark).rstrip('/')}/deltas-{uuid.uuid4().hex}")
    o = load(spark, sf, "orders")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.lit("status").alias("rel"),
                     F.floor("o_totalprice").cast("double").alias("weight"), F.col("o_orderkey").cast("string").alias("ref"), (F.col("o_orderkey") % 3).alias("part"))
    for batch in (0, 1, 1, 2):
        part = edges.where(F.col("part") == batch)
        ids = part.select(F.col("src").alias("id")).distinct()
        nodes = ids.select("id", F.lit("customer").alias("kind"), F.col("id").alias("label"), F.lit("").alias("sub"), F.lit(None).cast("map<string,string>").alias("meta"))
        store.append(nodes, part.drop("part"), batch)
    degree = store.nodes().select(F.col("id").alias("src"), F.col("weight").alias("degree"))
    return store.edges().select("src", "dst", "weight", "ref").join(degree, "src")


@query("graph_find", f"""
WITH {GRAPH_SQL}
SELECT id, kind, label, weight FROM nodes WHERE contains(lower(label), 'nation_1') OR (kind = 'attr' AND contains(lower(sub), 'nation_1'))
ORDER BY CASE WHEN starts_with(lower(label), 'nation_1') THEN 0 ELSE 1 END, weight DESC, id LIMIT 30""")
def graph_find(spark, sf):
    return G.find(graph(spark, sf).nodes(), "nation_1").select("id", "kind", "label", "weight")


@query("graph_from_keys", f"""
WITH {GRAPH_SQL},
k AS (SELECT 'v:' || c_custkey AS id FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 24)),
l AS (SELECT dst FROM edges WHERE src IN (SELECT id FROM k) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) <= 5),
i AS (SELECT id FROM k UNION SELECT dst FROM l)
SELECT src, dst, rel FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)""")
def graph_from_keys(spark, sf):
    keys = (load(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(24)
            .select(F.col("c_custkey").alias("entity_key")))
    return graph(spark, sf).from_keys(keys)[1].select("src", "dst", "rel")


@query("graph_counts", f"WITH {GRAPH_SQL} SELECT kind, sub, count(*) AS n FROM nodes GROUP BY ALL")
def graph_counts(spark, sf):
    return G.counts(graph(spark, sf).nodes())


@query("graph_node_detail", """
SELECT o_orderkey, o_custkey FROM orders WHERE contains(lower(o_orderpriority), '1-urgent') AND lower(o_orderstatus) = 'f'""")
def graph_node_detail(spark, sf):
    o = load(spark, sf, "orders")
    return G.node_rows(o, "attr", "o_orderpriority", "1-urgent", "o_orderstatus", "F").select("o_orderkey", "o_custkey")


@query("graph_edge_detail", """
SELECT o_orderkey, o_orderpriority AS value FROM orders WHERE o_custkey = 42 AND contains(lower(o_orderpriority), '1-urgent')""")
def graph_edge_detail(spark, sf):
    edges = graph(spark, sf).links("v:42").where("forward").withColumnsRenamed({"anchor": "src", "other": "dst"})
    o = load(spark, sf, "orders").withColumn("value", F.col("o_orderpriority"))
    found = G.edge_provenance(edges, "v:42", "a:orders.priority:1-urgent", "priority", {"orders": (o, "o_custkey")})
    return (o.limit(0) if found is None else found).select("o_orderkey", "value")


@query("graph_ids", """
SELECT n_nationkey, 'dim' AS kind, 'nation' AS tbl, '' AS name, CAST(n_nationkey AS VARCHAR) AS token FROM nation
UNION ALL SELECT n_nationkey, 'attr', 'claim', 'rhythm', n_name FROM nation""")
def graph_ids(spark, sf):
    n = load(spark, sf, "nation")
    ids = n.select("n_nationkey", G.dim_id("nation", F.col("n_nationkey")).alias("id")).unionByName(
        n.select("n_nationkey", G.attr_id("claim", F.lit("rhythm"), F.col("n_name")).alias("id")))
    p = ids.withColumn("p", G.parse_id(F.col("id")))
    return p.select("n_nationkey", "p.kind", F.col("p.table").alias("tbl"), "p.name", "p.token")


@query("graph_shortest_path", """
WITH RECURSIVE l AS (SELECT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT 'c0' AS id, 0 AS d UNION SELECT e.b, d + 1 FROM walk JOIN e ON e.a = walk.id WHERE d < 4)
SELECT min(d) AS steps FROM walk WHERE id = 'c1'""")
def graph_shortest_path(spark, sf):
    path = part_links(spark, sf).shortest_path("c0", "c1")
    return path.agg((F.count("*") - 1).cast("int").alias("steps"))


# ---- curriculum: orders are entities, their parts' type, brand and size are concepts ----

def part_labels():
    return F.array(F.concat(F.lit("type "), F.lower("p_type")), F.concat_ws(" ", F.lit("type"), F.lower("p_type"), F.lower("p_brand")),
                   F.concat(F.lit("name "), F.col("p_name")))


def order_concepts(spark, sf):
    p = load(spark, sf, "part")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"])
    concept = F.explode(F.transform(part_labels(), concept_of)).alias("concept")
    return rows.select(concept, "l_orderkey").distinct().select("concept", F.col("l_orderkey").cast("string").alias("entity_key"))


def concept_of(label):
    return F.concat(F.lit("t:part.c:"), label)


CONCEPT_SQL = """
m AS (SELECT DISTINCT 't:part.c:' || label AS concept, CAST(l_orderkey AS VARCHAR) AS entity_key, label FROM (
        SELECT l_orderkey, unnest(['type ' || lower(p_type), 'type ' || lower(p_type) || ' ' || lower(p_brand), 'name ' || p_name]) AS label
        FROM lineitem JOIN part ON p_partkey = l_partkey)),
k AS (SELECT concept, label, count(*) AS videos FROM m GROUP BY ALL HAVING count(*) >= 2 ORDER BY videos DESC, label LIMIT 60),
mk AS (SELECT m.concept, entity_key FROM m JOIN k USING (concept)),
sh AS (SELECT a.concept AS src, b.concept AS dst, count(*) AS shared FROM mk a JOIN mk b USING (entity_key) WHERE a.concept <> b.concept GROUP BY ALL HAVING count(*) >= 3),
pe AS (SELECT src, dst, shared, shared / kb.videos AS pf, shared / ka.videos AS pb FROM sh JOIN k ka ON ka.concept = src JOIN k kb ON kb.concept = dst
       WHERE ka.videos > kb.videos),
prereq AS (SELECT src, dst, shared, round(pf, 4) AS p_forward, round(pb, 4) AS p_back, round(pf * (pf - pb), 5) AS strength FROM pe
       WHERE pf >= 0.6 AND round(pf - pb, 12) >= 0.2 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY round(pf * (pf - pb), 5) DESC, src) <= 3)"""


def planned(spark, sf):
    """Members and the plan's concepts, written first: 60 rows that many places read."""
    m = order_concepts(spark, sf)
    labels = load(spark, sf, "part").select(F.explode(part_labels()).alias("label")).distinct().select(concept_of(F.col("label")).alias("concept"), "label")
    kept = cut_lineage(C.concepts(m, labels))
    return m.join(F.broadcast(kept.select("concept")), "concept", "left_semi"), kept


def curriculum(spark, sf):
    members, kept = planned(spark, sf)
    return members, kept, C.prerequisites(members, kept)


@query("curriculum_concepts", f"WITH {CONCEPT_SQL} SELECT concept, label, videos, CAST(videos AS DOUBLE) AS reach FROM k")
def curriculum_concepts(spark, sf):
    return planned(spark, sf)[1].select("concept", "label", "videos", "reach")


@query("prereq_edges", f"WITH {CONCEPT_SQL} SELECT * FROM prereq")
def prereq_edges(spark, sf):
    return curriculum(spark, sf)[2]


LEVEL_SQL = CONCEPT_SQL + """,
lv AS (SELECT concept, 1 AS d FROM k UNION SELECT p.dst, d + 1 FROM lv JOIN prereq p ON p.src = lv.concept),
level AS (SELECT concept, max(d) AS level FROM lv GROUP BY concept)"""


@query("prereq_levels", f"WITH RECURSIVE {LEVEL_SQL} SELECT concept, level FROM level")
def prereq_levels(spark, sf):
    _, kept, pre = curriculum(spark, sf)
    return C.levels(kept, pre)


@query("ready_steps", f"""
WITH {CONCEPT_SQL},
marks AS (SELECT concept FROM k WHERE label LIKE 'type e%' AND label NOT LIKE '%brand%')
SELECT concept FROM k WHERE concept NOT IN (SELECT concept FROM marks)
AND concept NOT IN (SELECT dst FROM prereq WHERE src NOT IN (SELECT concept FROM marks))""")
def ready_steps(spark, sf):
    _, kept, pre = curriculum(spark, sf)
    marks = kept.filter(F.col("label").startswith("type e") & ~F.col("label").contains("brand")).select("concept", F.lit("done").alias("state"))
    return C.ready(kept, pre, marks).select("concept")


@query("curriculum_plan", f"""
WITH RECURSIVE {LEVEL_SQL}
SELECT k.concept, level, CASE WHEN level = 1 THEN 'Foundations' WHEN level = (SELECT max(level) FROM level) THEN 'Furthest out' ELSE 'Stage ' || level END AS stage,
  videos, round(videos / (SELECT count(*) FROM orders), 4) AS share,
  (SELECT count(*) FROM prereq WHERE dst = k.concept) AS n_prereq, (SELECT count(*) FROM prereq WHERE src = k.concept) AS n_unlocks
FROM k JOIN level USING (concept)""")
def curriculum_plan(spark, sf):
    members, kept, pre = curriculum(spark, sf)
    notes = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("entity_key"), F.lit(0.0).alias("t_start"),
                                             F.lit(5.0).alias("t_end"), F.lit("meta").alias("source"), F.lit(1.0).alias("weight"), F.col("o_orderpriority").alias("text"))
    watch = C.concept_moments(members, kept, notes)
    steps = C.plan(kept, pre, C.levels(kept, pre), watch, load(spark, sf, "orders").agg(F.count("*")).scalar())
    return steps.select("concept", "level", "stage", "videos", "share", F.greatest(F.size("prereq"), F.lit(0)).cast("bigint").alias("n_prereq"),
                        F.greatest(F.size("unlocks"), F.lit(0)).cast("bigint").alias("n_unlocks"))


@query("concept_moments", f"""
WITH {CONCEPT_SQL},
mo AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS entity_key, 1.0 + l_quantity / 100 AS weight,
              lower(p_type) || ' and type ' || lower(p_type) || ' of ' || p_name AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
x AS (SELECT k.concept, k.label, mo.*, contains(' ' || text || ' ', ' ' || k.label || ' ') AS said,
             len(' ' || text || ' ') AS dl, (SELECT avg(length(text) + 2) FROM mo) AS avgl
      FROM mk JOIN k USING (concept) JOIN mo USING (entity_key)),
y AS (SELECT *, CASE WHEN said THEN round(2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgl)), 9) ELSE 0 END AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY said DESC, score DESC, weight DESC, length(text) DESC, id) AS pos FROM y QUALIFY pos <= 5)
SELECT concept, pos, id, said FROM z WHERE said OR concept NOT IN (SELECT concept FROM z WHERE said)""")
def concept_moments(spark, sf):
    members, kept = planned(spark, sf)
    p = load(spark, sf, "part")
    li = load(spark, sf, "lineitem")
    mo = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("entity_key"),
        (1.0 + F.col("l_quantity") / 100).alias("weight"), F.lit(0.0).alias("t_start"), F.lit(1.0).alias("t_end"), F.lit("meta").alias("source"),
        F.concat(F.lower("p_type"), F.lit(" and type "), F.lower("p_type"), F.lit(" of "), F.col("p_name")).alias("text"))
    return C.concept_moments(members, kept, mo).select("concept", F.col("pos").cast("bigint").alias("pos"), "id", "said")


@query("curriculum_progress", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'learning' END AS state, count(*) AS n FROM (
  SELECT o_custkey, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey)
WHERE o_orderstatus <> 'P' GROUP BY 1""")
def curriculum_progress(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("concept"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "learning").otherwise("").alias("state"),
        F.struct("o_orderdate", "o_orderkey").alias("at"))
    return C.progress_counts(C.mark(o.limit(0), o))


@query("goal_scope", """
WITH f AS (SELECT o_custkey AS entity_key, max(o_totalprice) AS score FROM orders GROUP BY o_custkey)
SELECT entity_key, round(score, 2) AS weight FROM f ORDER BY score DESC, entity_key LIMIT 400""")
def goal_scope(spark, sf):
    f = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_key")).agg(F.max("o_totalprice").alias("score"))
    return C.goal_scope(f, cards(spark, sf)).select("entity_key", F.round("weight", 2).alias("weight"))


@query("suggest_goals", f"""
WITH {GRAPH_SQL} SELECT id, label FROM nodes WHERE kind = 'attr' ORDER BY weight DESC, label, id LIMIT 14""")
def suggest_goals(spark, sf):
    return C.suggest_goals(graph(spark, sf).nodes()).select("id", "label")
