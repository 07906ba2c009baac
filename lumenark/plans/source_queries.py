"""Source and sink queries.  Files are first written from the driver tables, then read back."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..session import shared_dir
from ..sources import exports as E
from ..sources import files as S
from ..sources import texts as X
from .registry import query
from .tables import EVENTS_TIMED_SQL, VECTORS_SQL, dealt, events_timed, load, vectors


def _fresh(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@query("shard_roundtrip", f"""
WITH {EVENTS_TIMED_SQL} SELECT event_id, user_id AS entity_key, event_type AS kind, value AS num, CAST(NULL AS DOUBLE) AS t1 FROM ev""")
def shard_roundtrip(spark, sf):
    e = events_timed(spark, sf).select("event_id", F.col("user_id").alias("entity_key"), F.col("event_type").alias("kind"), F.col("value").alias("num"))
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("entity_key"), F.col("o_orderkey").alias("idx"))
    path = _fresh(spark, "shards")
    S.write_shards({"claim": e, "shot": o}, path, "s1")
    return S.shard_table(S.read_shards(spark, path), "claim", "event_id bigint, entity_key bigint, kind string, num double, t1 double")


@query("copy_dump", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_name || chr(9) || p_type || chr(92) || 'n' END AS label, p_retailprice FROM part""")
def copy_dump(spark, sf):
    p = load(spark, sf, "part")
    field = F.when(F.col("p_size") > 40, F.lit("\\N")).otherwise(F.concat("p_name", F.lit("\\t"), "p_type", F.lit("\\\\n")))
    body = F.concat_ws("\t", F.col("p_partkey").cast("string"), field, F.col("p_retailprice").cast("string"))
    # One self-contained dump per hundred rows: a header, the rows, the end mark.
    block = p.select(F.floor(F.col("p_partkey") / 100).alias("g"), body.alias("line"), "p_partkey")
    dumps = block.groupBy("g").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(F.concat(
        F.lit("SET x = 1;\nCOPY public.part (p_partkey, \"label\", p_retailprice) FROM stdin;\n"), F.array_join("lines", "\n"), F.lit("\n\\.\n-- done")).alias("value"))
    path = _fresh(spark, "dumps")
    dumps.write.text(path)
    rows = S.read_dumps(spark, path)
    return S.dump_table(rows, "part", {"p_partkey": "bigint", "label": "text", "p_retailprice": "double precision"})


@query("vector_payloads", f"""
WITH {VECTORS_SQL} SELECT entity_key, frame_idx, round(v[1], 6) AS first, round(v[64], 6) AS last FROM vec""")
def vector_payloads(spark, sf):
    @F.pandas_udf("string")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, dtype=np.float32).tobytes().hex())

    @F.pandas_udf("string")
    def framed(i: pd.Series) -> pd.Series:
        return i.map(lambda x: np.asarray([x], dtype=np.int32).tobytes().hex())

    raw = vectors(spark, sf).select(F.concat(F.lit("u"), F.col("frame_idx")).alias("uid"), "entity_key", "space", F.lit(64).alias("dim"), F.lit(1).alias("n"),
                                    F.lit("f32").alias("dtype"), framed("frame_idx").alias("frames"), packed("v").alias("data"))
    torn = raw.withColumn("data", F.lit("zz"))
    good, _ = S.vector_payloads(raw.unionByName(torn.withColumn("uid", F.concat("uid", F.lit("x")))).unionByName(raw))
    return S.unpack_vectors(good).select("entity_key", "frame_idx", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[63].cast("double"), 6).alias("last"))


@query("bundle_verify", """
SELECT 'absent' AS cause, count(*) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL SELECT 'digest differs', count(*) FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def bundle_verify(spark, sf):
    """Each segment has a true part, a forged digest and a part that never arrived."""
    path = _fresh(spark, "bundle")
    c = load(spark, sf, "customer")
    c.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    have = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    seg = c.select("c_mktsegment").distinct()
    lost = seg.select("c_mktsegment", F.concat(F.lit("lost-"), "c_mktsegment").alias("file"), F.lit("0").alias("sha256"))
    one = have.agg(F.min("file")).scalar()
    forged = seg.select("c_mktsegment", one.alias("file"), F.lit("0").alias("sha256"))
    true = have.select(F.lit("").alias("c_mktsegment"), "file", "sha256")
    ok, bad = S.verify_bundle(spark, path, true.unionByName(lost).unionByName(forged))
    return bad.groupBy("cause").agg(F.count("*").alias("n"))


@query("asset_parts", """
SELECT o_orderkey * 10 + n AS msg_id, 'k' || o_custkey AS entity_key, CASE n WHEN 0 THEN 'video' WHEN 3 THEN 'meta' ELSE 'clip' END AS kind,
       CAST(CASE n WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 5.0 END AS DOUBLE) AS t_start FROM orders, range(0, 4) r(n)""")
def asset_parts(spark, sf):
    o = load(spark, sf, "orders")
    m = F.col("o_orderkey") * 10
    part = lambda n, *x: F.struct((m + n).alias("msg_id"), *x)
    clip = lambda n, a, b: part(n, F.lit(n).alias("i"), F.lit(a).alias("t0"), F.lit(b).alias("t1"))
    doc = F.to_json(F.struct(F.concat(F.lit("k"), F.col("o_custkey")).alias("key"), F.lit(9.0).alias("duration"), F.lit(5.0).alias("chunk_seconds"), part(0).alias("video"),
                             F.array(clip(1, 0.0, 5.0), clip(2, 5.0, 9.0)).alias("chunks"), F.array(part(3, F.lit("meta").alias("kind"))).alias("assets")))
    return S.asset_parts(o.select(doc.alias("doc"))).select("msg_id", "entity_key", "kind", "t_start")


@query("clip_at", """
SELECT l_orderkey AS entity_key, CAST(l_quantity AS DOUBLE) AS t, CASE WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 40 THEN 1 ELSE 1 END AS seq FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)""")
def clip_at(spark, sf):
    o = load(spark, sf, "orders")
    clips = o.select(F.col("o_orderkey").alias("entity_key"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(20.0 * i).alias("t_start"), F.lit(20.0 * i + 20).alias("t_end")) for i in (0, 1)])).alias("c")) \
        .select("entity_key", "c.*").withColumn("kind", F.lit("clip"))
    pts = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.col("l_quantity").alias("t")).distinct()
    return S.clip_at(clips, pts).select("entity_key", "t", "seq")


@query("best_artefact", """
SELECT o_custkey AS entity_key, o_orderpriority AS kind, arg_max(o_orderkey, struct_pack(a := o_orderstatus <> 'P', b := CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE 0 END, c := o_orderkey)) AS path FROM orders GROUP BY ALL""")
def best_artefact(spark, sf):
    o = load(spark, sf, "orders")
    a = o.select(F.col("o_custkey").alias("entity_key"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("msg_id"),
                 F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("double")).otherwise(F.lit(0.0)).alias("created_at"), F.col("o_orderkey").alias("path"))
    return S.best_artefact(a).select("entity_key", "kind", "path")


@query("import_accounting", """
SELECT o_orderpriority AS cause, CASE o_orderstatus WHEN 'P' THEN 'skip' ELSE 'lost' END AS severity, count(*) AS rows FROM orders GROUP BY ALL ORDER BY rows DESC, cause LIMIT 4""")
def import_accounting(spark, sf):
    r = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("cause"), F.when(F.col("o_orderstatus") == "P", "skip").otherwise("lost").alias("severity"))
    return S.drop_accounting(r)[1]


@query("bundle_tally", """
SELECT count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderpriority LIKE '1%') AS shards, CAST(sum(o_custkey) AS BIGINT) AS bytes, 'behind' AS verdict FROM orders""")
def bundle_tally(spark, sf):
    o = load(spark, sf, "orders")
    log = o.select(F.when(F.col("o_orderpriority").startswith("1"), "shard").otherwise("bundle").alias("kind"), (F.col("o_orderstatus") != "P").alias("ok"),
                   F.col("o_custkey").alias("bytes"), F.lit(2).alias("schema"), F.col("o_orderkey").alias("at"))
    return S.bundle_tally(log, 3).select("ok", "failed", "shards", "bytes", "verdict")


@query("html_anchors", """
SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["'']', 1)) AS href FROM pages""")
def html_anchors(spark, sf):
    return X.page_anchors(load(spark, sf, "pages"), "page_id", "html")


@query("html_links", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["'']', 1)) AS href FROM pages)
SELECT page_id, href AS url, count(*) AS n FROM a WHERE regexp_matches(href, '^/[a-z]{3,}$') GROUP BY ALL""")
def html_links(spark, sf):
    links = X.html_links(load(spark, sf, "pages"), "page_id", "html", link=r"(?<= )/[a-z]{3,}(?= )")
    return links.groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query("markdown_labels", """
SELECT c_custkey AS doc, 'https://instagram.com/reel/Code' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS url, c_mktsegment AS label FROM customer
UNION ALL SELECT c_custkey, 'https://instagram.com/p/Post' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 'top' FROM customer""")
def markdown_labels(spark, sf):
    c = load(spark, sf, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    text = F.concat(F.lit("https://instagram.com/p/Post"), k, F.lit("/\n\n## "), "c_mktsegment", F.lit(" ##\nsee https://instagram.com/reel/Code"), k, F.lit("/ today\n"))
    return X.markdown_links(c.select(F.col("c_custkey").alias("doc"), text.alias("text")), default="top").select("doc", "url", "label")


@query("tree_links", """
SELECT c_custkey AS doc, 'https://instagram.com/reel/Code' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS url, lower(c_mktsegment) AS label FROM customer
UNION ALL SELECT c_custkey, 'https://instagram.com/p/Post' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 'uncategorised' FROM customer""")
def tree_links(spark, sf):
    c = load(spark, sf, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    node = F.concat(F.lit('{"saved": [{"title": "somebody", "href": "https://instagram.com/p/Post'), k, F.lit('/"}, {"string_map_data": {"Name": {"value": "'), F.lower("c_mktsegment"),
                    F.lit('"}, "Post": {"href": "https://instagram.com/reel/Code'), k, F.lit('/"}}}], "owner": 3}'))
    return X.tree_links(c.select(F.col("c_custkey").alias("doc"), node.alias("text"))).select("doc", "url", "label").distinct()


EXPORTS_SQL = """ex AS (
  SELECT 'dump' || (c_custkey // 40) AS dump, (c_custkey // 40) % 5 AS form, c_custkey,
         'Code' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key,
         CASE (c_custkey // 40) % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 2 THEN lower(c_mktsegment) WHEN 4 THEN 'uncategorised' ELSE c_mktsegment END AS label
  FROM customer)"""


def _exports(spark, sf):
    """Forty customers a file, as archives of two kinds, a JSON tree, a list with headers and one without."""
    import io
    import json
    import zipfile

    def archive(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
        return out.getvalue()

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def write(batches):
        for batch in batches:
            out, size = [], 0
            for g, rows in zip(*batch.columns):  # one file's rows at a time become Python objects
                g, rows = g.as_py(), rows.as_py()
                at = [(r["segment"], "https://instagram.com/reel/" + r["code"]) for r in rows]
                tree = json.dumps({"saved": [{"string_map_data": {"Name": {"value": s.lower()}, "Post": {"href": u}}} for s, u in at]})
                form = g % 5
                if form == 0:
                    out.append((f"dump{g}.zip", archive({"saved/saved_posts.json": tree, "your/comments.json": tree.replace("Code", "Other")})))
                elif form == 1:
                    out.append((f"dump{g}.zip", archive({"page.html": "".join(f"<h2>{s}</h2><p><a href='{u}'>x</a></p>" for s, u in at)})))
                elif form == 2:
                    out.append((f"dump{g}.json", tree.encode()))
                elif form == 3:
                    out.append((f"dump{g}.md", "".join(f"# {s} #\n- {u}\n" for s, u in at).encode()))
                else:
                    out.append((f"dump{g}.txt", "\n".join(u for _, u in at).encode()))
                size += len(out[-1][1])
                if size > E.BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    c = load(spark, sf, "customer")
    code = F.concat(F.lit("Code"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    rows = c.groupBy(F.floor(F.col("c_custkey") / 40).alias("g")).agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("segment"), code.alias("code"))).alias("rows"))
    return rows.mapInArrow(write, "path string, content binary")


@query("mixed_exports", f"""
WITH {EXPORTS_SQL} SELECT dump, key, label FROM ex""")
def mixed_exports(spark, sf):
    links = E.read_exports(_exports(spark, sf)).links
    return links.select(F.split_part("path", F.lit("."), F.lit(1)).alias("dump"), K.key_from_url(F.col("url")).alias("key"), "label")


@query("export_formats", f"""
WITH {EXPORTS_SQL}
SELECT dump, CASE form WHEN 0 THEN 'archive' WHEN 1 THEN 'archive' WHEN 2 THEN 'json' ELSE 'markdown' END AS format, CAST(CASE WHEN form < 2 THEN 1 ELSE 0 END AS BIGINT) AS n_members,
       CAST(0 AS BIGINT) AS n_damaged, count(*) AS n_links FROM ex GROUP BY dump, form""")
def export_formats(spark, sf):
    return E.read_exports(_exports(spark, sf)).summary().withColumn("path", F.split_part("path", F.lit("."), F.lit(1))).withColumnRenamed("path", "dump")


@query("export_tally", f"""
WITH {EXPORTS_SQL} SELECT label, count(*) AS n FROM ex GROUP BY label""")
def export_tally(spark, sf):
    """Labels of the links, one count for each link and label it was filed under."""
    return X.dedupe_links(E.read_exports(_exports(spark, sf)).links)[1]


@query("export_slices", """
SELECT 'Code' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS collections, arg_min(o_orderstatus, o_orderkey) AS owner FROM orders GROUP BY 1""")
def export_slices(spark, sf):
    o = load(spark, sf, "orders")
    r = o.select(F.concat(F.lit("instagram.com/reel/Code"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("url"), F.col("o_orderpriority").alias("collection"),
                 F.col("o_orderstatus").alias("owner"), F.lit(None).cast("double").alias("taken_at"), F.lit(None).cast("string").alias("caption"), F.col("o_orderkey").alias("seq"))
    return X.slices_per_key(r).select("key", F.array_join("collections", ",").alias("collections"), "owner")


@query("caption_roundtrip", """
SELECT 'Code' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, lower(c_mktsegment) || ',zeta' AS collections, c_name AS uploader, c_custkey * 1000 AS views, CAST(c_nationkey AS BIGINT) AS likes FROM customer""")
def caption_roundtrip(spark, sf):
    c = dealt(load(spark, sf, "customer"))
    k = F.concat(F.lit("Code"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    cap = X.build_caption(F.concat(F.lit("https://www.instagram.com/reel/"), k, F.lit("/")), k, F.array(F.lit("zeta"), F.lower("c_mktsegment"), F.lit("zeta")), F.col("c_name"),
                          F.col("c_custkey") * 1000, F.col("c_nationkey").cast("bigint"), F.lit(7).cast("bigint"), F.repeat(F.col("c_name"), 90))
    return X.parse_captions(c.select(cap.alias("text"))).select("key", F.array_join("collections", ",").alias("collections"), "uploader", "views", "likes")


LOG_SQL = """lg AS (SELECT l_orderkey AS entity_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS rn, l_quantity AS q FROM lineitem)"""


def _log(spark, sf):
    """A silence log per order: quantities under 15 open a span, others close one."""
    li = load(spark, sf, "lineitem").withColumn("q", F.col("l_quantity"))
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("entity_key"), F.row_number().over(w).alias("line_no"), "q")


@query("silence_log", f"""
WITH {LOG_SQL},
n AS (SELECT *, lead(q) OVER (PARTITION BY entity_key ORDER BY rn) AS nq FROM lg)
SELECT entity_key, greatest(0, q - 5) AS t0, CASE WHEN nq >= 15 THEN nq END AS t1 FROM n WHERE q < 15 AND (nq IS NULL OR nq >= 15)""")
def silence_log(spark, sf):
    lg = _log(spark, sf)
    line = F.when(F.col("q") < 15, F.concat(F.lit("silence_start: "), (F.col("q") - 5).cast("string"))) \
        .otherwise(F.concat(F.lit("silence_end: "), F.col("q").cast("string"), F.lit(" | silence_duration: 1.0")))
    return X.silences(lg.select("entity_key", "line_no", line.alias("line")))


@query("cut_log", "SELECT l_orderkey AS entity_key, l_quantity AS t, l_discount AS score FROM lineitem")
def cut_log(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.concat(
        F.lit("[x] lavfi.scd.score: "), F.col("l_discount").cast("string"), F.lit(", lavfi.scd.time: "), F.col("l_quantity").cast("string"), F.lit("\nnoise")).alias("text"))
    return X.cut_times(li)


@query("frame_log", f"WITH {LOG_SQL} SELECT entity_key, rn AS idx, q AS t, 'lavfi.r128.M' AS metric, -q AS value FROM lg")
def frame_log(spark, sf):
    lg = _log(spark, sf)
    head = F.concat(F.lit("frame:"), F.col("line_no").cast("string"), F.lit(" pts:1 pts_time:"), F.col("q").cast("string"))
    kv = F.concat(F.lit("lavfi.r128.M=-"), F.col("q").cast("string"))
    lines = lg.select("entity_key", (F.col("line_no") * 2).alias("line_no"), head.alias("line")).unionByName(lg.select("entity_key", (F.col("line_no") * 2 + 1).alias("line_no"), kv.alias("line")))
    return X.frame_metrics(lines)


@query("redact_secrets", """
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, 'thereading', '<WORD>'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\\b\\d{7,12}:[A-Za-z0-9_-]{30,}\\b', '<TOKEN>', 'g')) AS digest FROM documents""")
def redact_secrets(spark, sf):
    d = load(spark, sf, "documents")
    out = T.redact(F.col("text"), {"thereading": "WORD"}, {r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}": "EMAIL", r"\b\d{7,12}:[A-Za-z0-9_-]{30,}\b": "TOKEN"})
    return d.select("doc_id", F.md5(out.cast("binary")).alias("digest"))
