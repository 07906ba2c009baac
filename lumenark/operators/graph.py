"""Property graph over entities: build, neighbourhoods, hubs, find, provenance, paths.

nodes(id, kind, label, sub, weight, meta MAP<STRING,STRING>)
edges(src, dst, rel, weight, ref); an edge always runs entity -> thing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, written

# Least support, token length, fan-out.
MIN_SUPPORT = 2
MAX_TOKEN = 48
FANOUT = 60


# ---- ids -----------------------------------------------------------------------------

def entity_id(key: Column) -> Column:
    return F.concat(F.lit("v:"), key.cast("string"))


def dim_id(table: str, row: Column) -> Column:
    return F.concat(F.lit(f"d:{table}:"), row.cast("string"))


def tag_id(table: str, column: str, token: Column) -> Column:
    return F.concat(F.lit(f"t:{table}.{column}:"), token)


def attr_id(table: str, attribute: Column, token: Column) -> Column:
    return F.concat(F.lit(f"a:{table}."), attribute, F.lit(":"), token)


def hashtag_id(token: Column) -> Column:
    return F.concat(F.lit("h:"), token)


def parse_id(node: Column) -> Column:
    """struct(kind, table, name, token); an unknown id parses to an empty kind."""
    kind, rest = F.substring(node, 1, 1), F.substring(node, 3, 1_000_000)
    head, tail = F.split_part(rest, F.lit(":"), F.lit(1)), F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)
    names = {"v": "video", "d": "dim", "t": "tag", "a": "attr", "h": "hashtag"}
    word = F.lit("")
    for k, n in names.items():
        word = F.when(kind == k, n).otherwise(word)
    dotted = kind.isin("t", "a")
    return F.struct(
        word.alias("kind"),
        F.when(dotted, F.split_part(head, F.lit("."), F.lit(1)))
        .when(kind == "d", F.regexp_extract(rest, r"^(.*):[^:]*$", 1)).otherwise("").alias("table"),
        F.when(dotted, F.regexp_extract(head, r"^[^.]*\.(.*)$", 1)).otherwise("").alias("name"),
        F.when(kind.isin("v", "h"), rest).when(dotted, tail)
        .when(kind == "d", F.regexp_extract(rest, r"([^:]*)$", 1)).otherwise("").alias("token"))


# ---- tokens --------------------------------------------------------------------------

def clean_tokens(items: Column) -> Column:
    """The tokens of an array of strings; what is none, or NULL, is left out. Each string is cleaned once."""
    cleaned = F.transform(items, lambda x: F.lower(F.regexp_replace(T.squeeze(x), r"^[\"'\[\]{}()]+|[\"'\[\]{}()]+$", "")))
    return F.filter(cleaned, lambda s: (F.length(s) >= 2) & (F.length(s) <= MAX_TOKEN) & ~F.replace(s, F.lit("."), F.lit("")).rlike(r"^\d+$"))


def is_structured(value: Column) -> Column:
    s = F.trim(value)
    return F.coalesce(s.rlike(r"^[\[{]") & F.try_parse_json(s).isNotNull(), F.lit(False))


def split_list(value: Column) -> Column:
    """Items of a list-shaped cell: JSON array items, JSON object keys, or separated parts."""
    s = F.trim(value)
    doc = F.try_parse_json(s)
    items = F.from_json(s, "array<variant>")

    def item(v):
        kind = F.schema_of_variant(v)
        # Of a record, the first field holding text.
        rec = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
                       lambda x: (F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != ""))
        return F.when(kind.startswith("OBJECT"), F.try_variant_get(F.get(rec, F.lit(0)), "$", "string")).otherwise(
            F.when(~kind.startswith("ARRAY"), F.try_variant_get(v, "$", "string")))

    shape = F.schema_of_variant(doc)
    from_array = F.filter(F.transform(items, item), lambda x: x.isNotNull())
    from_object = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    parts = F.filter(F.split(s, r"[,;|/]| - "), lambda p: F.trim(p) != "")
    plain = F.when(F.size(parts) > 1, parts).when(F.length(s) <= MAX_TOKEN, F.array(s)).otherwise(F.array().cast("array<string>"))
    # Only a cell that opens like JSON is ever parsed.
    json = F.when(shape.startswith("ARRAY"), from_array).when(shape.startswith("OBJECT"), from_object).otherwise(plain)
    return (F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>"))
            .when(s.rlike(r"^[\[{]"), json).otherwise(plain))


def list_tokens(value: Column) -> Column:
    return F.array_distinct(clean_tokens(split_list(value)))


def list_column(df: DataFrame, column: str) -> DataFrame:
    """One row (seen, listy, mean_words, is_list), judged on all cells of the column in one aggregate."""
    s = df.select(F.trim(F.col(column).cast("string")).alias("s")).filter(F.coalesce("s", F.lit("")) != "")
    t = s.select("s", clean_tokens(split_list(F.col("s"))).alias("t"))
    n_words = F.aggregate(F.transform("t", lambda x: F.size(F.split(x, r"\s+"))), F.lit(0), lambda a, b: a + b)
    agg = t.agg(F.count("*").alias("seen"),
                F.count_if((F.size("t") >= 2) | (F.col("s").rlike(r"^[\[{]") & (F.size("t") >= 1))).alias("listy"),
                (F.sum(n_words) / F.sum(F.size("t"))).alias("mean_words"))
    return agg.withColumn("is_list", F.coalesce((F.col("seen") >= 4) & (F.col("listy") / F.col("seen") >= 0.55)
                                                & (F.col("mean_words") <= 4.0), F.lit(False)))


# ---- build ---------------------------------------------------------------------------

def _meta(**pairs) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def entity_nodes(cards: DataFrame) -> DataFrame:
    have = set(cards.columns)
    label = [F.nullif(F.col(c), F.lit("")) for c in ("title", "caption") if c in have]
    return cards.select(entity_id(F.col("entity_key")).alias("id"), F.lit("video").alias("kind"),
                        F.coalesce(*label, F.concat(F.lit("video "), F.col("entity_key").cast("string"))).alias("label"),
                        F.lit("videos").alias("sub"), _meta(key=F.col("entity_key")).alias("meta"))


def dimension_edges(fact: DataFrame, key: str, local: str, dim: DataFrame, dim_table: str, remote: str, label: str,
                    fact_table: str, rel: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Foreign-key links.  The dimension joins once per distinct (entity, row), and its side
    is left to the optimizer, which broadcasts it when its measured size allows."""
    import re
    rel = rel or re.sub(r"(?i)[_ ]?id$", "", local) or dim_table
    links = fact.select(F.col(key).alias("k"), F.col(local).alias("row")).filter(F.col("row").isNotNull()) \
        .groupBy("k", "row").agg(F.count("*").alias("n"))
    d = dim.select(F.col(remote).alias("row"), F.col(label).cast("string").alias("label")).filter(F.col("label").isNotNull())
    j = links.join(d, "row")
    nodes = d.join(links.select("row").distinct(), "row", "left_semi").select(
        dim_id(dim_table, F.col("row")).alias("id"), F.lit("dim").alias("kind"), "label", F.lit(dim_table).alias("sub"),
        _meta(table=F.lit(dim_table), row_id=F.col("row"), id_column=F.lit(remote)).alias("meta")).dropDuplicates(["id"])
    edges = j.select(entity_id(F.col("k")).alias("src"), dim_id(dim_table, F.col("row")).alias("dst"), F.lit(rel).alias("rel"),
                     F.col("n").cast("double").alias("weight"),
                     F.concat(F.lit(f"{fact_table}|{local}|"), F.col("row").cast("string")).alias("ref"))
    return nodes, edges


def _supported(pairs: DataFrame, by: Sequence[str], n_entities: Column, least: int) -> DataFrame:
    """Tokens with enough support that do not mark every entity."""
    df = pairs.groupBy(*by).agg(F.count("*").alias("df"))
    return df.withColumn("N", n_entities).filter((F.col("df") >= least) & ((F.col("df") < F.col("N")) | (F.col("N") <= 1))).drop("N")


def tag_edges(df: DataFrame, key: str, column: str, table: str, n_entities: Column) -> tuple[DataFrame, DataFrame]:
    """List-valued column to tags; the (entity, token) pairs are distinct before counting.

    A cell is split once per distinct value, not once per row or entity.
    """
    cells = df.select(F.col(key).alias("k"), F.col(column).cast("string").alias("cell")).filter(F.col("cell").isNotNull()).distinct()
    words = cells.select("cell").distinct().select("cell", F.explode(list_tokens(F.col("cell"))).alias("token"))
    pairs = cells.join(words, "cell").select("k", "token").distinct()
    kept = _supported(pairs, ["token"], n_entities, MIN_SUPPORT)
    nid = tag_id(table, column, F.col("token"))
    nodes = kept.select(nid.alias("id"), F.lit("tag").alias("kind"), F.col("token").alias("label"), F.lit(column).alias("sub"),
                        _meta(table=F.lit(table), column=F.lit(column), token=F.col("token"), videos=F.col("df")).alias("meta"))
    edges = pairs.join(kept, "token").select(
        entity_id(F.col("k")).alias("src"), nid.alias("dst"), F.lit(column).alias("rel"), F.lit(1.0).alias("weight"),
        F.concat(F.lit(f"{table}|{column}|"), F.col("token")).alias("ref"))
    return nodes, edges


def hashtag_edges(df: DataFrame, key: str, column: str, table: str) -> tuple[DataFrame, DataFrame]:
    text = F.col(column)
    pairs = (df.filter(text.contains("#") & ~is_structured(text))
             .select(F.col(key).alias("k"), F.explode(F.transform(
                 F.regexp_extract_all(text, F.lit(T.HASHTAG_GRAPH), F.lit(1)), F.lower)).alias("token")).distinct())
    nid = hashtag_id(F.col("token"))
    nodes = pairs.select("token").distinct().select(
        nid.alias("id"), F.lit("hashtag").alias("kind"), F.concat(F.lit("#"), F.col("token")).alias("label"),
        F.lit("hashtags").alias("sub"), _meta(token=F.col("token")).alias("meta"))
    edges = pairs.select(entity_id(F.col("k")).alias("src"), nid.alias("dst"), F.lit("hashtag").alias("rel"),
                         F.lit(1.0).alias("weight"), F.concat(F.lit(f"{table}|{column}|#"), F.col("token")).alias("ref"))
    return nodes, edges


def attribute_edges(df: DataFrame, key: str, attr: str, value: str, table: str, n_entities: Column,
                    channel: str | None = None, source: str = "meta") -> tuple[DataFrame, DataFrame]:
    """Entity-attribute-value rows: one node per (property, value) shared by several entities.

    A row's value is cleaned once, by the generator; a filter on the token would clean it again. The
    (entity, property, value) rows are written once: support, nodes and edges all come from them.
    """
    rows = (df.filter(F.col(attr).isNotNull() & ~is_structured(F.col(value).cast("string")))
            .select(F.col(key).alias("k"), F.col(attr).cast("string").alias("attribute"),
                    (F.col(channel) if channel else F.lit(None)).cast("string").alias("chan"),
                    F.explode(clean_tokens(F.array(F.col(value).cast("string")))).alias("token")))
    pairs = written(rows.groupBy("k", "attribute", "token").agg(F.min("chan").alias("lo"), F.max("chan").alias("hi")), "attributes")
    kept = _supported(pairs, ["attribute", "token"], n_entities, MIN_SUPPORT)
    chans = pairs.groupBy("attribute", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nid = attr_id(table, F.col("attribute"), F.col("token"))
    nodes = kept.join(chans, ["attribute", "token"]).select(
        nid.alias("id"), F.lit("attr").alias("kind"), F.col("token").alias("label"), F.col("attribute").alias("sub"),
        _meta(table=F.lit(table), column=F.lit(value), attribute_column=F.lit(attr), attribute=F.col("attribute"),
              token=F.col("token"), videos=F.col("df"),
              source=F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(source))).alias("meta"))
    edges = pairs.join(kept.select("attribute", "token"), ["attribute", "token"]).select(
        entity_id(F.col("k")).alias("src"), nid.alias("dst"), F.col("attribute").alias("rel"), F.lit(1.0).alias("weight"),
        F.concat(F.lit(f"{table}|{value}|"), F.col("token")).alias("ref"))
    return nodes, edges


def accumulate_edges(edges: DataFrame) -> DataFrame:
    """Same (src, dst, rel) adds weight and keeps one ref (the least, so that it is stable)."""
    return (edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst", "rel")
            .agg(F.sum("weight").alias("weight"), F.min("ref").alias("ref")))


def degree(edges: DataFrame) -> DataFrame:
    """(id, weight): edge weight over both ends; each edge is read once."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("weight"))


def gather(cards: DataFrame, *parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes without weight, edges not yet added up) from the cards and any number of (nodes, edges) parts.

    Edges whose entity has no card are left out.
    """
    ents = entity_nodes(cards)
    nodes, edges = ents, None
    for n, e in parts:
        nodes = nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    known = ents.select(F.col("id").alias("src"))
    first = nodes.groupBy("id").agg(F.min_by(F.struct("kind", "label", "sub", "meta"), F.struct("label", "sub")).alias("n"))
    return first.select("id", "n.*"), edges.join(known, "src", "left_semi")


def build(cards: DataFrame, *parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from the cards and any number of (nodes, edges) parts, weights added up."""
    nodes, edges = gather(cards, *parts)
    edges = accumulate_edges(edges)
    full = nodes.join(degree(edges), "id", "left").select(
        "id", "kind", "label", "sub", F.coalesce("weight", F.lit(0.0)).alias("weight"), "meta")
    return full, edges


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Replace both tables of the stored graph."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


# ---- reads ---------------------------------------------------------------------------

def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    i = ids.select("id").distinct()
    return (edges.join(i.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(i.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def both_ways(edges: DataFrame, node: str) -> DataFrame:
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), "rel", "weight", "ref")
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("id"), "rel", "weight", "ref")
    return out.unionByName(back)


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, limit: int = FANOUT,
              kinds: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ring, edges among ring and centre, one row (total, truncated))."""
    limit = max(1, limit)
    found = both_ways(edges, node).join(nodes.select("id", "kind", "label", "sub"), "id")
    if kinds:
        found = found.filter(F.col("kind").isin(*kinds))
    ring = found.orderBy(F.col("weight").desc(), "id", "rel").limit(limit)
    ids = ring.select("id").unionByName(nodes.filter(F.col("id") == node).select("id"))
    total = found.agg(F.count("*").alias("total")).withColumn("truncated", F.greatest(F.lit(0), F.col("total") - limit))
    return ring, edges_among(edges, ids), total


def _top_links(edges: DataFrame, anchor: str, other: str, n: int) -> DataFrame:
    w = Window.partitionBy(anchor).orderBy(F.col("weight").desc(), F.col(other).asc(), F.col("rel").asc())
    return edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 16, per_hub: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hubs, ids shown, edges among them): biggest hubs with a few entities each."""
    hubs = nodes.filter(F.col("kind") != "video").orderBy(F.col("weight").desc(), "id").limit(max(1, limit))
    own = edges.join(hubs.select(F.col("id").alias("dst")), "dst", "left_semi")
    ids = hubs.select("id").union(_top_links(own, "dst", "src", per_hub).select("src")).distinct()
    return hubs, ids, edges_among(edges, ids)


def from_keys(nodes: DataFrame, edges: DataFrame, keys: DataFrame, limit: int = 24, per_entity: int = 5):
    """(ids, edges among them) for a set of entities and their strongest links."""
    v = keys.select(entity_id(F.col("entity_key")).alias("id")).distinct().orderBy("id").limit(max(1, limit))
    own = edges.join(v.select(F.col("id").alias("src")), "src", "left_semi")
    ids = v.union(_top_links(own, "src", "dst", per_entity).select("dst")).distinct() \
        .join(nodes.select("id"), "id", "left_semi")
    return ids, edges_among(edges, ids)


def find(nodes: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """Label substring, prefix matches first; an attribute also answers to its property."""
    q = text.strip().lower()
    lab = F.lower("label")
    hit = lab.contains(q) | ((F.col("kind") == "attr") & F.lower("sub").contains(q))
    return (nodes.filter(hit).orderBy(F.when(lab.startswith(q), 0).otherwise(1), F.col("weight").desc(), "id")
            .limit(max(1, limit)))


def node_rows(table: DataFrame, node_kind: str, column: str, token: str, attr_column: str | None = None,
              attribute: str | None = None) -> DataFrame:
    """Source rows behind a node: its own row, or the rows that mention it."""
    c = F.col(column).cast("string")
    if node_kind == "dim":
        return table.filter(c == token)
    hit = F.lower(c).contains(token.lower())
    if node_kind == "attr":
        hit = hit & (F.lower(F.col(attr_column).cast("string")) == attribute.lower())
    return table.filter(hit)


def edge_provenance(edges: DataFrame, src: str, dst: str, rel: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame | None:
    """Rows that make an edge true, found through its ``table|column|value`` ref.

    ``tables`` maps a table name to (DataFrame, key column); only the one edge row is read
    by the driver.
    """
    row = edges.filter((F.col("src") == src) & (F.col("dst") == dst) & (F.col("rel") == rel)).select("ref").first()
    if row is None:
        return None
    table, column, *value = (row["ref"] or "").split("|")
    if table not in tables:
        return None
    df, key = tables[table]
    own = df.filter(F.col(key).cast("string") == src[2:])
    needle = value[0] if value else ""
    c = F.col(column).cast("string")
    return own.filter(c == needle) if dst.startswith("d:") else own.filter(F.lower(c).contains(needle.lstrip("#").lower()))


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", "sub").agg(F.count("*").alias("n"))


def shortest_path(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame | None:
    """(pos, id) along a shortest chain of relationships; None if there is none, or none within ``rounds`` if given.

    Both ends grow breadth-first, the smaller frontier first.  A frontier is a distinct set
    of nodes joined to the edge table; each round is written to the checkpoint folder, so
    lineage stays flat and the driver reads only counts and the rows of the final chain.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = cut_lineage(links)
    if a == b:
        return spark.createDataFrame([(0, a)], "pos int, id string")
    if any(links.filter(F.col("src") == x).isEmpty() for x in (a, b)):
        return None
    side = {s: {"seen": cut_lineage(spark.createDataFrame([(n, None, 0)], "id string, parent string, depth int")), "n": 1, "d": 0}
            for s, n in (("a", a), ("b", b))}
    for _ in range(rounds) if rounds is not None else count():
        me, other = ("a", "b") if side["a"]["n"] <= side["b"]["n"] else ("b", "a")
        mine = side[me]
        front = mine["seen"].filter(F.col("depth") == mine["d"]).select(F.col("id").alias("src"))
        grown = (links.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
                 .join(mine["seen"].select("id"), "id", "left_anti")
                 .select("id", "parent", F.lit(mine["d"] + 1).alias("depth")))
        grown = cut_lineage(grown)
        mine["d"] += 1
        mine["n"] = grown.count()
        if mine["n"] == 0:
            return None
        mine["seen"] = mine["seen"].unionByName(grown)
        meet = grown.join(side[other]["seen"].select("id", F.col("depth").alias("od")), "id") \
            .orderBy("od", "id").select("id").first()
        if meet is not None:
            def back(seen, node):
                chain = [node]
                while True:
                    p = seen.filter(F.col("id") == chain[-1]).select("parent").first()["parent"]
                    if p is None:
                        return chain
                    chain.append(p)
            full = back(side["a"]["seen"], meet["id"])[::-1] + back(side["b"]["seen"], meet["id"])[1:]
            return spark.createDataFrame(list(enumerate(full)), "pos int, id string")
    return None
