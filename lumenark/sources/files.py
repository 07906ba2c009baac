"""File sources and sinks: evidence shards, COPY dumps, vector payloads, bundles, media files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

# Numeric types of a dump by a fragment of their name, first match wins.
TYPE_FRAGMENTS = (
    ("bool", "bigint"), ("smallint", "bigint"), ("bigint", "bigint"), ("integer", "bigint"), ("int", "bigint"), ("serial", "bigint"),
    ("double", "double"), ("real", "double"), ("numeric", "double"), ("decimal", "double"), ("float", "double"),
    ("json", "string"), ("text", "string"), ("char", "string"), ("timestamp", "string"), ("date", "string"), ("time", "string"),
    ("uuid", "string"), ("bytea", "binary"),
)
SHARD_MAGIC = "evidence-shard"

# Candidate keys of a table, most specific first.
KEY_RULES = (("uid",), ("entity_key", "idx"), ("entity_key", "kind", "name"), ("entity_key", "t0"), ("entity_key",))


def affinity(declared: str) -> str:
    low = declared.lower()
    return next((t for fragment, t in TYPE_FRAGMENTS if fragment in low), "string")


def table_keys(columns: Sequence[str]) -> list[str]:
    have = set(columns)
    return next((list(rule) for rule in KEY_RULES if have.issuperset(rule)), [])


def table_meta(df: DataFrame, declared: dict[str, str] | None = None) -> dict:
    """{columns, keys}: declared types stand, others need a value somewhere; one aggregate decides."""
    declared = declared or {}
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first().asDict()
    names = {"boolean": "INTEGER", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL"}
    cols = {c: t for c, t in declared.items() if c in filled}
    for f in df.schema.fields:
        if f.name not in cols and filled[f.name]:
            cols[f.name] = names.get(f.dataType.simpleString(), "TEXT")
    return {"columns": cols, "keys": table_keys(list(cols))}


# ---- shards --------------------------------------------------------------------------

def write_shards(tables: dict[str, DataFrame], path: str, session: str, magic: str = SHARD_MAGIC) -> None:
    """gzip JSON lines, one folder per shard part: each task writes a header line and its rows.

    The job's commit protocol makes the files appear whole or not at all.
    """
    import json
    header = json.dumps({"_": magic, "session": session, "tables": {n: table_meta(df) for n, df in tables.items()}})
    rows = None
    for name, df in tables.items():
        part = df.select(F.to_json(F.struct(F.lit(name).alias("t"), "*"), {"ignoreNullFields": "false"}).alias("value"))
        rows = part if rows is None else rows.unionByName(part)

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            if first and len(pdf):
                yield pd.DataFrame({"value": [header]})
                first = False
            yield pdf

    rows.mapInPandas(with_header, "value string").write.mode("overwrite").text(path, compression="gzip")


def read_shards(spark: SparkSession, path: str, magic: str = SHARD_MAGIC) -> DataFrame:
    """(file, line_no, tbl, rec): rows of every shard up to its first unreadable line.

    A gzip file is one unsplittable stream, so its lines arrive in order inside one task;
    the cut is found while they stream past.  Files that do not open with the header are
    no shards and yield nothing.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        current, line, state = None, 0, "skip"
        for pdf in batches:
            out = []
            for name, text in zip(pdf["file"], pdf["value"]):
                if name != current:
                    current, line, state = name, 0, "head"
                line += 1
                if state in ("skip", "torn") or not text.strip():
                    continue
                try:
                    rec = json.loads(text)
                except ValueError:
                    state = "torn" if state == "rows" else "skip"
                    continue
                if state == "head":
                    state = "rows" if isinstance(rec, dict) and rec.get("_") == magic else "skip"
                elif isinstance(rec, dict) and rec.get("t"):
                    out.append((name, line, str(rec["t"]), text))
            yield pd.DataFrame(out, columns=["file", "line_no", "tbl", "rec"])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.mapInPandas(scan, "file string, line_no bigint, tbl string, rec string")


def shard_table(shards: DataFrame, table: str, schema: str) -> DataFrame:
    """One table of the shards in a declared schema; absent fields stay NULL."""
    return shards.filter(F.col("tbl") == table).select(F.from_json("rec", schema).alias("r")).select("r.*")


# ---- COPY dumps ----------------------------------------------------------------------

def copy_field(field: Column) -> Column:
    r"""One COPY field: \N is NULL, then a single left-to-right pass over its escapes."""
    known = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\u000b"}
    # An escaped backslash first becomes a mark no dump contains, so that it cannot start
    # another escape, and turns into a backslash last.
    out = F.replace(field, F.lit("\\\\"), F.lit("\u0000"))
    for code, char in known.items():
        out = F.replace(out, F.lit("\\" + code), F.lit(char))
    out = F.replace(F.regexp_replace(out, r"\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))
    return F.when(field != "\\N", F.when(field.contains("\\"), out).otherwise(field))


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(file, tbl, cols, fields) of every row inside COPY ... FROM stdin blocks of many dumps.

    A dump splits like any text file: the open block is carried from split to split by file
    offset, so one huge dump is read by many tasks.
    """
    from ..operators.sequences import Carry, with_carry
    head = r"(?i)^COPY\s+(\S+)\s*\((.*)\)\s+FROM\s+stdin;"
    v = F.regexp_replace("value", r"[\r\n]+$", "")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
                                         F.monotonically_increasing_id().alias("pos"), v.alias("line"))
    name = F.regexp_replace(F.element_at(F.split(F.regexp_extract("line", head, 1), r"\."), -1), '"', "")
    cols = F.transform(F.split(F.regexp_extract("line", head, 2), ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    is_head, is_end = F.col("line").rlike(head), F.col("line") == "\\."
    mark = F.when(is_head, F.struct(name.alias("tbl"), cols.alias("cols"))).when(
        is_end, F.struct(F.lit("").alias("tbl"), F.array().cast("array<string>").alias("cols")))
    open_block = with_carry(lines, ["file"], ["pos"], [Carry("block", "last", mark)], "offset")
    parts = F.split("line", "\t")
    width = F.size("block.cols")
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit("\\N"), width)), F.lit(1), width)
    return (open_block.filter(~is_head & ~is_end & (F.coalesce("block.tbl", F.lit("")) != ""))
            .select("file", F.col("block.tbl").alias("tbl"), F.col("block.cols").alias("cols"), padded.alias("fields")))


def dump_table(rows: DataFrame, table: str, types: dict[str, str]) -> DataFrame:
    """One table of the dumps with its declared column types; unreadable numbers become NULL."""
    own = rows.filter(F.col("tbl") == table).withColumn("m", F.map_from_arrays("cols", F.transform("fields", copy_field)))
    def typed(c, t):
        v, kind = F.try_element_at("m", F.lit(c)), affinity(t)
        return (F.when(v.isin("t", "f"), (v == "t").cast("bigint")) if "bool" in t.lower() else v.try_cast(kind) if kind in ("bigint", "double") else v).alias(c)
    return own.select(*[typed(c, t) for c, t in types.items()])


# ---- vectors -------------------------------------------------------------------------

def vector_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, skipped) from hex payload rows; a repeated uid counts once."""
    p = rows.withColumn("bytes", F.try_to_binary("data", F.lit("hex"))).withColumn("frame_bytes", F.try_to_binary("frames", F.lit("hex")))
    ok = (F.coalesce("uid", F.lit("")) != "") & F.col("bytes").isNotNull() & (F.length("bytes") > 0) & (F.coalesce("space", F.lit("")) != "") \
        & F.col("entity_key").isNotNull() & (F.coalesce("dim", F.lit(0)) > 0)
    good = p.filter(ok).select("uid", "entity_key", "space", "dim", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("dtype", F.lit("f16")).alias("dtype"), "frame_bytes", "bytes")
    return good.dropDuplicates(["uid"]), p.filter(~ok | ok.isNull())


def unpack_vectors(payloads: DataFrame) -> DataFrame:
    """(entity_key, space, frame_idx, v): one row per frame; buffers of the wrong length yield none."""
    kind = payloads.schema["entity_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {"f16": np.float16, "f32": np.float32}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                t = sizes.get(r.dtype)
                if t is None or r.dim <= 0 or r.n <= 0 or r.bytes is None or len(r.bytes) != r.n * r.dim * np.dtype(t).itemsize:
                    continue
                m = np.frombuffer(bytes(r.bytes), dtype=t).reshape(r.n, r.dim).astype(np.float32)
                f = np.frombuffer(bytes(r.frame_bytes), dtype=np.int32) if r.frame_bytes is not None and len(r.frame_bytes) == 4 * r.n else np.arange(r.n)
                yield pd.DataFrame({"entity_key": r.entity_key, "space": r.space, "frame_idx": f.astype(np.int64), "v": list(m)})

    return payloads.mapInPandas(run, f"entity_key {kind}, space string, frame_idx bigint, v array<float>")


# ---- bundles and files ---------------------------------------------------------------

def verify_bundle(spark: SparkSession, path: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, rejected) parts of manifest(file, sha256): present, and equal to their digest."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("got"), F.col("length").alias("bytes"))
    j = manifest.join(files, "file", "left")
    ok = F.coalesce(F.col("got") == F.col("sha256"), F.lit(False))
    return j.filter(ok), j.filter(~ok).withColumn("cause", F.when(F.col("got").isNull(), "absent").otherwise("digest differs"))


def asset_parts(manifests: DataFrame) -> DataFrame:
    """manifest JSON rows (column ``doc``) to one row per asset, the newest row per message."""
    part = "struct<msg_id:bigint,file_id:string,name:string,bytes:bigint,sha256:string,i:int,t0:double,t1:double,kind:string>"
    doc = F.from_json("doc", f"struct<key:string,duration:double,chunk_seconds:double,video:{part},chunks:array<{part}>,assets:array<{part}>>")
    m = manifests.select(doc.alias("m")).filter(F.coalesce("m.key", F.lit("")) != "")
    def shaped(kind, p, seq, a, b):
        return F.struct(kind.alias("kind"), seq.alias("seq"), p["msg_id"].alias("msg_id"), p["file_id"].alias("file_id"), p["name"].alias("name"),
                        F.coalesce(p["bytes"], F.lit(0)).alias("bytes"), p["sha256"].alias("sha256"), a.alias("t_start"), b.alias("t_end"))
    none = F.lit(None).cast("double")
    video = F.when(F.col("m.video.msg_id").isNotNull(), F.array(shaped(F.lit("video"), F.col("m.video"), F.lit(0), F.lit(0.0), F.col("m.duration"))))
    empty = F.array().cast("array<struct<kind:string,seq:int,msg_id:bigint,file_id:string,name:string,bytes:bigint,sha256:string,t_start:double,t_end:double>>")
    chunks = F.transform("m.chunks", lambda p: shaped(F.lit("clip"), p, F.coalesce(p["i"], F.lit(0)), F.coalesce(p["t0"], F.lit(0.0)), F.coalesce(p["t1"], F.lit(0.0))))
    assets = F.transform("m.assets", lambda p: shaped(F.coalesce(p["kind"], F.lit("asset")), p, F.lit(0), none, none))
    rows = m.select(F.col("m.key").alias("entity_key"), F.col("m.chunk_seconds").alias("chunk_seconds"),
                    F.explode(F.concat(F.coalesce(video, empty), F.coalesce(chunks, empty), F.coalesce(assets, empty))).alias("p")).select("entity_key", "chunk_seconds", "p.*")
    rest = [c for c in rows.columns if c != "msg_id"]
    return rows.filter(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.max_by(F.struct(*rest), F.struct("entity_key", "kind", "seq")).alias("x")).select("msg_id", "x.*")


def clip_at(parts: DataFrame, points: DataFrame) -> DataFrame:
    """points(entity_key, t) with the clip that covers them, else the entity's last clip."""
    from ..operators.merge import interval_at
    clips = parts.filter(F.col("kind") == "clip").select("entity_key", "seq", "t_start", "t_end")
    return interval_at(points, clips, "entity_key", "t", ["t"], "seq", "t_start", "t_end", missing=None)


def latest_part(parts: DataFrame, kind: str) -> DataFrame:
    own = parts.filter(F.col("kind") == kind)
    return own.groupBy("entity_key").agg(F.max_by(F.struct("msg_id", "file_id", "name", "bytes"), F.col("msg_id")).alias("p")).select("entity_key", "p.*")


def best_artefact(artefacts: DataFrame) -> DataFrame:
    """Per entity and kind the row with a message, then the newest, then the highest message."""
    rank = F.struct(F.col("msg_id").isNotNull().alias("has"), F.coalesce("created_at", F.lit(0.0)).alias("c"), F.coalesce("msg_id", F.lit(0)).alias("m"))
    rest = [c for c in artefacts.columns if c not in ("entity_key", "kind")]
    return artefacts.groupBy("entity_key", "kind").agg(F.max_by(F.struct(*rest), rank).alias("a")).select("entity_key", "kind", "a.*")


def drop_accounting(rejected: DataFrame, shown: int = 4) -> tuple[DataFrame, DataFrame]:
    """(totals by severity, largest causes) of rejected rows that carry cause and severity."""
    by = rejected.groupBy("severity", "cause").agg(F.count("*").alias("rows"))
    return by.groupBy("severity").agg(F.sum("rows").alias("rows")), by.orderBy(F.col("rows").desc(), "cause").limit(shown)


def bundle_tally(log: DataFrame, known_schema: int) -> DataFrame:
    """One row over an import log (kind, ok, bytes, schema, at) with a schema verdict."""
    a = log.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("kind") == "shard").alias("shards"),
                F.count_if(F.col("kind") == "bundle").alias("bundles"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                F.max("schema").alias("max_schema"), F.max("at").alias("newest"))
    return a.withColumn("verdict", F.when(F.col("max_schema").isNull(), "empty").when(F.col("max_schema") > known_schema, "ahead")
                        .when(F.col("max_schema") < known_schema, "behind").otherwise("current"))
