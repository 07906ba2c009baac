"""Merging tables whose schemas drift: widen, upsert, enrich, tolerant reads, relational joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_columns(src: DataFrame, dst: DataFrame) -> DataFrame:
    have = set(dst.columns)
    return src.select(*[c for c in src.columns if c in have])


def widen(df: DataFrame, like: DataFrame) -> DataFrame:
    """Add the columns only ``like`` has, typed and empty; nothing is ever renamed or dropped."""
    have = set(df.columns)
    extra = {f.name: F.lit(None).cast(f.dataType) for f in like.schema.fields if f.name not in have}
    return df.withColumns(extra) if extra else df


def pick(df: DataFrame, *names: str) -> Column:
    """Per row the first non-null of the named columns that exist here."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Replace rows by key: incoming beats base, and among incoming rows the last in ``order``.

    An aggregate with map-side partials; a key repeated by millions of incoming rows never
    gathers in one task.
    """
    keys = list(keys)
    new = incoming.withColumn("__side", F.lit(1)).withColumn("__ord", order if order is not None else F.lit(None).cast("string"))
    rows = base.withColumn("__side", F.lit(0)).withColumn("__ord", F.lit(None).cast(new.schema["__ord"].dataType))
    both = rows.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__side", "__ord")]
    tie = F.to_json(F.struct(*rest))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__side", "__ord", tie.alias("t"))).alias("r"))
    return best.select(*keys, "r.*")


def insert_or_ignore(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append only the rows whose key is new; one row per new key."""
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    fresh = incoming.join(base.select(*keys).distinct(), keys, "left_anti")
    tie = F.to_json(F.struct(*rest)) if rest else F.lit("")
    one = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), tie).alias("r")).select(*keys, "r.*") if rest else fresh.distinct()
    return base.unionByName(one, allowMissingColumns=True)


def snapshot_merge(base: DataFrame, incoming: DataFrame, primary_key: Sequence[str] | None) -> DataFrame:
    """One table of a snapshot: replace by primary key, else append what is not there yet.

    A NULL in a row to append equals a NULL in a row that is there.
    """
    wide = widen(base, incoming)
    if primary_key:
        return upsert(wide, incoming, primary_key)
    if not incoming.columns:
        return wide
    there = wide.select(*[F.col(c).alias(f"__there_{c}") for c in incoming.columns]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__there_{c}")) for c in incoming.columns])
    return wide.unionByName(incoming.join(there, same, "left_anti").distinct(), allowMissingColumns=True)


def enrich(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Fill NULLs of existing rows from incoming ones; never overwrite, never add rows.

    Of several incoming rows of a key the first in ``order`` (then by its values) fills, so what is
    filled together came together.
    """
    keys = list(keys)
    fill = [c for c in base.columns if c not in keys and c in incoming.columns]
    if not fill:
        return base
    row = F.struct(*fill)
    once = incoming.groupBy(*keys).agg(F.min_by(row, F.struct((order if order is not None else F.lit(0)).alias("o"), row.alias("r"))).alias("__first"))
    j = base.join(once, keys, "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"__first.{c}")).alias(c) if c in fill else F.col(c) for c in base.columns])


def time_link(rows: DataFrame, intervals: DataFrame, key: str = "entity_key", start: str = "t0", end: str = "t1",
              link: str = "shot_idx", idx: str = "idx", i_start: str = "t0", i_end: str = "t1") -> DataFrame:
    """Borrow a span from the interval a row points at; the end only when the start was borrowed."""
    iv = intervals.select(F.col(key), F.col(idx).alias(link), F.col(i_start).alias("__s0"), F.col(i_end).alias("__s1"))
    j = rows.join(iv, [key, link], "left")
    return (j.withColumn("__e", F.when(F.col(start).isNull(), F.col("__s1")).otherwise(F.col(end)))
            .withColumn(start, F.coalesce(start, "__s0")).withColumn(end, F.col("__e")).drop("__s0", "__s1", "__e"))


def interval_cells(intervals: DataFrame, t0: str, t1: str, cell_seconds: float) -> DataFrame:
    """Intervals with ``__class`` and ``__cell``: two rows an interval at most, however long it is.

    An interval of class c is no longer than a cell of its class, which is ``cell_seconds * 2 ** c`` wide.
    """
    length = (F.col(t1) - F.col(t0)) / F.lit(float(cell_seconds))
    classed = intervals.filter(F.col(t1) > F.col(t0)).withColumn("__class", F.greatest(F.ceil(F.log2(length)), F.lit(0)).cast("int"))
    width = F.lit(float(cell_seconds)) * F.pow(F.lit(2.0), F.col("__class"))
    return classed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(t0) / width), F.floor(F.col(t1) / width))))


def intervals_containing(points: DataFrame, intervals: DataFrame, key: str, t: str, t0: str = "t0", t1: str = "t1",
                         cell_seconds: float = 60.0) -> DataFrame:
    """Every (point, interval) pair with t0 <= t < t1, met through time cells of one key, of doubling width by interval length.

    A point probes one cell of each class that the intervals have (some tens at most, whatever their
    lengths) and meets only the intervals there, so neither a hot key nor a long timeline nor a
    long interval turns into many rows.
    """
    wide = interval_cells(intervals, t0, t1, cell_seconds)
    classes = wide.agg(F.array_sort(F.collect_set("__class"))).scalar()
    width = F.lit(float(cell_seconds)) * F.pow(F.lit(2.0), F.col("__class"))
    p = points.withColumn("__class", F.explode(classes)).withColumn("__cell", F.floor(F.col(t) / width))
    return p.join(wide, [key, "__class", "__cell"]).filter((F.col(t) >= F.col(t0)) & (F.col(t) < F.col(t1))).drop("__class", "__cell")


def interval_at(points: DataFrame, intervals: DataFrame, key: str, t: str, point_id: Sequence[str], idx: str = "idx",
                t0: str = "t0", t1: str = "t1", cell_seconds: float = 60.0, missing: int | None = 0) -> DataFrame:
    """points with ``idx``: the first interval holding t, else the last one past the end, else ``missing``."""
    hit = intervals_containing(points, intervals, key, t, t0, t1, cell_seconds)
    first = hit.groupBy(key, *point_id).agg(F.min(idx).alias("__i"))
    last = intervals.groupBy(key).agg(F.max_by(F.struct(idx, t1), F.col(idx)).alias("__last"))
    j = points.join(first, [key, *point_id], "left").join(last, key, "left")
    tail = F.when(F.col(t) >= F.col(f"__last.{t1}"), F.col(f"__last.{idx}"))
    return j.withColumn(idx, F.coalesce("__i", tail, F.lit(missing))).drop("__i", "__last")


def series_per_interval(series: DataFrame, intervals: DataFrame, key: str, t: str, value: str, least: int = 2,
                        idx: str = "idx", t0: str = "t0", t1: str = "t1", cell_seconds: float = 60.0) -> DataFrame:
    """Mean and count of a series inside each interval that holds at least ``least`` readings."""
    hit = intervals_containing(series, intervals.select(key, idx, t0, t1), key, t, t0, t1, cell_seconds)
    return (hit.groupBy(key, idx).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
            .filter(F.col("n") >= least))


def in_inventory(df: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    return df.join(inventory.select(key).distinct(), key, "left_semi")


def orphans(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def resolve(df: DataFrame, column: str, aliases: DataFrame, out: str = "entity_key", rules=None) -> DataFrame:
    """Spelling to key: the raw spelling's alias, else the ruled spelling's alias, else itself.

    ``resolved`` says whether an alias was found.  The alias map joins as an ordinary side:
    the optimizer broadcasts it while it is small and shuffles it when it is not.
    """
    from ..functions.keys import string_rules
    ruled = (rules or string_rules)(F.col(column))
    raw = aliases.select(F.col("alias").alias("__raw"), F.col("entity_key").alias("__k1"))
    alt = aliases.select(F.col("alias").alias("__alt"), F.col("entity_key").alias("__k2"))
    j = (df.withColumn("__raw", F.trim(F.col(column).cast("string"))).withColumn("__alt", ruled)
         .join(raw, "__raw", "left").join(alt, "__alt", "left"))
    hit = F.coalesce("__k1", "__k2")
    return (j.withColumn(out, F.coalesce(hit, F.nullif("__alt", F.lit("")))).withColumn("resolved", hit.isNotNull())
            .drop("__raw", "__alt", "__k1", "__k2"))


def merge_targets(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], keep_from_secondary: Sequence[str]) -> DataFrame:
    """Full outer union of two target lists: the first wins, some fields prefer the second."""
    keys = list(keys)
    cols = [c for c in primary.columns if c not in keys]
    a = primary.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in cols])
    b = secondary.select(*keys, *[(F.col(c) if c in secondary.columns else F.lit(None)).alias(f"__b_{c}") for c in cols])
    j = a.join(b, keys, "full_outer")
    return j.select(*keys, *[
        (F.coalesce(f"__b_{c}", f"__a_{c}") if c in keep_from_secondary else F.coalesce(f"__a_{c}", f"__b_{c}")).alias(c)
        for c in cols])


def row_count_diff(local: DataFrame, bundle: DataFrame) -> DataFrame:
    """(table, local, bundle, delta, destructive) from two (table, n) listings."""
    j = local.select("table", F.col("n").alias("local")).join(bundle.select("table", F.col("n").alias("bundle")), "table", "full_outer")
    l, b = F.coalesce("local", F.lit(0)), F.coalesce("bundle", F.lit(0))
    return j.select("table", l.alias("local"), b.alias("bundle"), (b - l).alias("delta"), (b < l).alias("destructive"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): one count per table, unioned into a single job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def opaque_columns(df: DataFrame, least: int = 256) -> DataFrame:
    """(column, real, opaque): string columns whose every value is a long encoded payload."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.coalesce(c, F.lit("")) != "").alias("real"),
                            F.count_if(F.col(c).rlike(f"^[A-Za-z0-9+/=]{{{least},}}$")).alias("blobs")).alias(c) for c in strings])
    return (one.select(F.explode(F.array(*strings)).alias("s")).select("s.*")
            .select("column", "real", ((F.col("real") > 0) & (F.col("real") == F.col("blobs"))).alias("opaque")))


def substring_search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose any string column contains the text, ASCII case folded; wildcards are literal."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in cols])
    return df.filter(hit)


def browse_table(df: DataFrame, text: str = "", order: str = "", desc: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of any table: searched, ordered by the named column, or by all columns if there is none of that name."""
    out = substring_search(df, text) if text else df
    rest = [F.to_json(F.struct(c)) if f.dataType.typeName() in ("map", "variant") else F.col(c) for c, f in zip(df.columns, df.schema.fields) if c != order]
    first = [F.col(order).desc() if desc else F.col(order).asc()] if order in df.columns else []
    return out.orderBy(*first, *rest).offset(max(0, offset)).limit(max(0, limit))


def render_cells(df: DataFrame) -> DataFrame:
    """Binary cells as their size; everything else as it is."""
    return df.select(*[F.concat(F.lit("‹"), F.length(f.name).cast("string"), F.lit(" bytes›")).alias(f.name)
                       if f.dataType.typeName() == "binary" else F.col(f.name) for f in df.schema.fields])


def value_occurrences(tables: dict[str, DataFrame], column: str, value) -> DataFrame:
    """(table, n): how often one value occurs in every table that has the column."""
    parts = [df.filter(F.col(column) == F.lit(value)).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
             for name, df in tables.items() if column in df.columns]
    return reduce(DataFrame.unionByName, parts)


def related_rows(tables: dict[str, tuple[DataFrame, str]], key: str, spellings: Sequence[str] = ()) -> DataFrame:
    """(table, row): all rows of every table that carry the key or one of its spellings."""
    wanted = [key, *spellings]
    parts = [df.filter(F.col(k).cast("string").isin(*wanted))
             .select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, (df, k) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, group: str | None = None) -> DataFrame:
    """i-th row of the left gets the i-th of the right, missing ones stay NULL; positions per group."""
    from .sequences import Carry, with_carry
    keys = [group] if group else ["__g"]
    one = lambda df: df if group else df.withColumn("__g", F.lit(0))
    number = lambda df, o: with_carry(one(df), keys, [o], [Carry("__pos", "sum", F.lit(1).cast("bigint"))],
                                      F.abs(F.floor(F.col(o).cast("double") / 100_000)).cast("bigint"))
    return number(left, left_order).join(number(right, right_order), [*keys, "__pos"], "left").drop("__pos", "__g")


def kv_put(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value table (k, v, at) after changes: the latest value per key."""
    both = store.unionByName(changes)
    return both.groupBy("k").agg(F.max_by(F.struct("v", "at"), F.struct("at", "v")).alias("x")).select("k", "x.v", "x.at")


def kv_get(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("k") == key).select("v")


def library_page(cards: DataFrame, creator: str = "", category: str = "", collection: str = "", text: str = "",
                 has: Sequence[str] = (), inventory: DataFrame | None = None, inside: DataFrame | None = None,
                 sort: str = "recent", limit: int | None = 40, offset: int = 0) -> DataFrame:
    """Library browse with a ``matched`` column: meta, inside or both.

    ``inside`` holds the keys a search found; sorting by length puts missing lengths first,
    as the original does.
    """
    df = cards
    if creator:
        df = df.filter(F.col("creator") == creator)
    if category:
        df = df.filter(F.col("category") == category)
    if collection:
        df = df.filter(F.array_contains("collections", collection))
    if "speech" in has:
        df = df.filter("has_speech")
    if "narrative" in has:
        df = df.filter("has_narrative")
    if "playable" in has and inventory is not None:
        df = in_inventory(df, inventory, "entity_key")
    if text:
        fields = [c for c in ("entity_key", "title", "caption", "creator", "category") if c in df.columns]
        meta = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in fields])
        df = df.withColumn("__meta", meta)
        if inside is not None:
            df = df.join(inside.select("entity_key").distinct().withColumn("__in", F.lit(True)), "entity_key", "left")
        else:
            df = df.withColumn("__in", F.lit(None).cast("boolean"))
        df = (df.filter(F.col("__meta") | F.col("__in").isNotNull())
              .withColumn("matched", F.when(F.col("__meta") & F.col("__in").isNotNull(), "both")
                          .when(F.col("__meta"), "meta").otherwise("inside")).drop("__meta", "__in"))
    order = {"recent": [F.col("created_at").desc()], "oldest": [F.col("created_at").asc()],
             "longest": [F.col("duration").desc()], "shortest": [F.col("duration").asc_nulls_first()],
             "liked": [F.col("likes").desc()], "moments": [F.col("moment_count").desc()]}.get(sort, [])
    df = df.orderBy(*order, F.col("entity_key").asc())
    return df if limit is None else df.offset(offset).limit(limit)
