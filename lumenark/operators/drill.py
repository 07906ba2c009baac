"""Drill-downs: what a cell is and points at, cards as served, bundles, clips, map points.

Each is a relation over all rows of its tables; a single cell, card or point is a filter on it, which
reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maps import cluster_stats
from .reflect import norm


def cell_provenance(tables: dict[str, DataFrame], table: str, column: str, target: tuple[str, str] | None = None) -> DataFrame:
    """(value, same_value, row, refers_to, elsewhere) of every value of a column; NULL and blank cells say nothing.

    ``same_value`` counts the rows with the value. ``row`` is the row it stands in, as JSON, only where that is
    one row: of several, none is where the cell came from. ``refers_to`` is the least row, as JSON, of the
    ``target`` (table, column) it points at. ``elsewhere`` lists (table, column, rows) of the other tables that
    have the value in a column of the same name, up to case and punctuation; most rows first. Values are
    compared as strings.
    """
    shown = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    own = tables[table].withColumn("__value", shown(column)).filter(F.col("__value").isNotNull())
    row = F.to_json(F.struct(*[F.col(c) for c in tables[table].columns]))
    out = own.groupBy(F.col("__value").alias("value")).agg(F.count("*").alias("same_value"), F.any_value(row).alias("row"))
    out = out.withColumn("row", F.when(F.col("same_value") == 1, F.col("row")))
    if target is not None:
        there, key = tables[target[0]], target[1]
        refers = there.select(shown(key).alias("value"), F.to_json(F.struct("*")).alias("refers_to")).filter(F.col("value").isNotNull())
        out = out.join(refers.groupBy("value").agg(F.min("refers_to").alias("refers_to")), "value", "left")
    else:
        out = out.withColumn("refers_to", F.lit(None).cast("string"))
    parts = []
    for name, df in tables.items():
        same = next((c for c in df.columns if norm(c) == norm(column)), None)
        if name != table and same is not None:
            parts.append(df.select(shown(same).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("rows"))
                         .select("value", F.struct((-F.col("rows")).alias("o"), F.lit(name).alias("table"), F.lit(same).alias("column"), F.col("rows").alias("rows")).alias("e")))
    kind = "array<struct<table:string,column:string,rows:bigint>>"
    if not parts:
        return out.withColumn("elsewhere", F.array().cast(kind))
    found = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.array_sort(F.collect_list("e")).alias("__e"))  # one entry a table at most
    listed = F.transform("__e", lambda e: F.struct(e["table"].alias("table"), e["column"].alias("column"), e["rows"].alias("rows")))
    return out.join(found, "value", "left").withColumn("elsewhere", F.coalesce(listed, F.array()).cast(kind)).drop("__e")


def capture_block(meta: Column) -> Column:
    """The ``capture`` object of JSON metadata as JSON; ``{}`` where there is none or the text is no JSON."""
    block = F.get_json_object(F.when(F.try_parse_json(meta).isNotNull(), meta), "$.capture")
    return F.when(F.ltrim(block).startswith("{"), block).otherwise(F.lit("{}"))


def is_stub(meta: Column) -> Column:
    """Whether ``identity.stub`` of JSON metadata says so; blank, zero, false, empty or unreadable do not."""
    said = F.get_json_object(F.when(F.try_parse_json(meta).isNotNull(), meta), "$.identity.stub")
    return F.coalesce(~said.isin("", "false", "[]", "{}") & (F.coalesce(said.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def bundle_listing(bundles: DataFrame) -> DataFrame:
    """Bundles newest first (a missing manifest_id counts as 0), ``counts`` as a map; counts that are no JSON are empty."""
    counts = F.coalesce(F.from_json("counts", "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    return bundles.withColumn("counts", counts).orderBy(F.coalesce("manifest_id", F.lit(0)).desc(), F.col("seq").desc())


def keys_with_clips(parts: DataFrame) -> DataFrame:
    """(entity_key) of every entity that has a clip."""
    return parts.filter(F.col("kind") == "clip").select("entity_key").distinct()


def with_clips(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """entities with ``has_clips``."""
    have = keys_with_clips(parts).withColumn("has_clips", F.lit(True))
    return entities.join(have, "entity_key", "left").withColumn("has_clips", F.coalesce("has_clips", F.lit(False)))


def card_view(cards: DataFrame) -> DataFrame:
    """Cards as served: the key for a missing title, blanks and zeroes for missing values; other columns stay out."""
    text = {"caption", "creator", "category", "poster"}
    number = {"duration": "double", "fps": "double", "size_mb": "double", "moment_count": "bigint", "text_len": "bigint"}
    flags = {"has_speech", "has_narrative"}
    have = lambda c: F.col(c) if c in cards.columns else F.lit(None)
    out = [F.col("entity_key"), F.coalesce(F.nullif(have("title").cast("string"), F.lit("")), F.col("entity_key").cast("string")).alias("title")]
    out += [F.coalesce(have(c).cast("string"), F.lit("")).alias(c) for c in sorted(text)]
    out += [F.coalesce(have(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in number.items()]
    out += [F.coalesce(have(c).cast("boolean"), F.lit(False)).alias(c) for c in sorted(flags)]
    out += [F.col(c) for c in ("width", "height", "likes", "created_at", "sources") if c in cards.columns]
    return cards.select(*out)


def map_points(levels: DataFrame, cards: DataFrame, moments: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every point of a map with what lies behind it: its card, its cluster's size, label and entities, and its passage.

    A point of an entity has no passage of its own; those are its moments, by ``entity_key``.
    """
    stats = cluster_stats(levels).select("level", "cluster", F.col("size").alias("cluster_size"), F.col("entities").alias("cluster_entities"))
    if labels is not None:
        stats = stats.join(labels.select("cluster", F.col("label").alias("cluster_label")), "cluster", "left")
    card = cards.select("entity_key", F.struct(*[c for c in cards.columns if c != "entity_key"]).alias("card"))
    said = moments.select(F.lit("moment").alias("level"), F.col("id").cast("string").alias("ref"), F.struct(*moments.columns).alias("moment"))
    return levels.join(stats, ["level", "cluster"], "left").join(card, "entity_key", "left").join(said, ["level", "ref"], "left")
