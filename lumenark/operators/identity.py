"""Identity: many spellings of an entity resolved to one key, and the audit of that claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .merge import resolve

# Witnesses in the order of their strength.
PASSES = ("self", "message", "ledger", "content", "orphan")


def candidates_from_entities(entities: DataFrame) -> DataFrame:
    """Aliases an entity table offers: each key itself, its permalink, its message spellings."""
    have = set(entities.columns)
    e = entities.filter(K.looks_canonical(F.col("entity_key"))).select(
        F.col("entity_key").cast("string").alias("entity_key"),
        *[(F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in (("url", "string"), ("msg_id", "bigint"), ("record_msg_id", "bigint"))])
    own = e.select(F.col("entity_key").alias("alias"), "entity_key", F.lit("self").alias("kind"), F.lit(0).alias("prio"))
    link = e.select(K.key_from_url(F.col("url")).alias("alias"), "entity_key", F.lit("url").alias("kind"), F.lit(1).alias("prio"))
    return own.unionByName(link).unionByName(_message_aliases(e, "msg_id", 1)).unionByName(_message_aliases(e, "record_msg_id", 1)) \
        .filter(F.col("alias").isNotNull())


def _message_aliases(df: DataFrame, column: str, prio: int) -> DataFrame:
    return df.select(F.explode(K.spellings(F.col(column))).alias("alias"), "entity_key",
                     F.lit("message").alias("kind"), F.lit(prio).alias("prio"))


def candidates_from_messages(messages: DataFrame, prio: int = 2) -> DataFrame:
    return _message_aliases(messages.select(F.col("entity_key").cast("string"), "msg_id"), "msg_id", prio)


def candidates_from_ledger(ledger: DataFrame) -> DataFrame:
    """Ledger items (entity_key, url, msg_id, record_msg_id) as weaker witnesses."""
    return candidates_from_entities(ledger).withColumn("prio", F.lit(3)).filter(F.col("kind") != "self")


def learn(candidates: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, conflicts): the strongest witness of each alias wins, the others are kept as conflicts.

    A candidate whose target is no known key, or whose alias is another entity's own key, is
    no alias.  The witnesses of an alias are brought together once and ordered by strength; disagreements
    come from those of other targets only.
    """
    known = keys.select(F.col("entity_key").cast("string").alias("entity_key")).distinct()
    ok = (candidates.filter(F.trim("alias") != "")
          .join(known.filter(K.looks_canonical(F.col("entity_key"))), "entity_key", "left_semi")
          .join(known.select(F.col("entity_key").alias("alias"), F.lit(True).alias("is_key")), "alias", "left")
          .filter(F.col("is_key").isNull() | (F.col("alias") == F.col("entity_key"))))
    strongest = Window.partitionBy("alias").orderBy("prio", "entity_key", "kind")
    aliases = ok.withColumn("rn", F.row_number().over(strongest)).filter(F.col("rn") == 1).select("alias", "entity_key", "kind", "prio")
    lost = (ok.withColumn("kept", F.first("entity_key").over(strongest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .filter(F.col("entity_key") != F.col("kept"))
            .groupBy("alias", "kept", F.col("entity_key").alias("refused")).agg(F.min(F.struct("prio", "kind")).alias("w"))
            .select("alias", "kept", "refused", F.col("w.kind").alias("kind")))
    return aliases, lost


def content_groups(files: DataFrame, aliases: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias candidates, twins) from files(stem, digest, bytes) with equal content.

    One canonical key in a group makes every other stem its alias; several make the keys
    twins.  A twin group is kept as one row per member with the group's digest and leader,
    never as pairs: copies of one file may be a third of everything.
    """
    known = keys.select(F.col("entity_key").cast("string").alias("key")).distinct()
    r = resolve(files, "stem", aliases, "key").join(known.withColumn("is_key", F.lit(True)), "key", "left")
    groups = r.groupBy("digest").agg(F.count_distinct(F.when(F.col("is_key"), F.col("key"))).alias("n_keys"),
                                     F.min(F.when(F.col("is_key"), F.col("key"))).alias("leader"), F.max("bytes").alias("bytes"))
    single = groups.filter(F.col("n_keys") == 1)
    alias = (r.join(single.select("digest", "leader"), "digest").filter(F.col("is_key").isNull())
             .select(F.col("stem").cast("string").alias("alias"), F.col("leader").alias("entity_key")).distinct()
             .unionByName(single.select(F.concat(F.lit("sha256:"), "digest").alias("alias"), F.col("leader").alias("entity_key")))
             .withColumn("kind", F.lit("content")).withColumn("prio", F.lit(4)))
    twins = (r.filter("is_key").join(groups.filter(F.col("n_keys") > 1).select("digest", "leader", "n_keys", F.col("bytes").alias("size")), "digest")
             .select(F.col("key").alias("entity_key"), "digest", "leader", (F.col("n_keys") - 1).alias("twins"), "size").distinct())
    return alias, twins


def twins_of(twins: DataFrame, key: str) -> DataFrame:
    """Members of one entity's twin group other than itself."""
    own = twins.filter(F.col("entity_key") == key).select("digest")
    return twins.join(own, "digest", "left_semi").filter(F.col("entity_key") != key)


def spelling_columns(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(tbl, col, spelling): the distinct spellings of every key column."""
    parts = [df.select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), F.col(c).cast("string").alias("spelling"))
             .filter(F.col("spelling").isNotNull()).distinct() for (t, c), df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def unresolved(spellings: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """(tbl, col, entity_key): spellings that name no known entity even after resolution."""
    known = keys.select(F.col("entity_key").cast("string").alias("entity_key")).distinct()
    return (resolve(spellings, "spelling", aliases).filter(F.col("entity_key").isNotNull())
            .join(known, "entity_key", "left_anti").select("tbl", "col", "entity_key").distinct())


def adopt_orphans(missing: DataFrame, bridge: DataFrame, advisory: set[tuple[str, str]] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(stub entities, alias candidates) for orphan spellings a recorded bridge (spelling, entity_key) names.

    A spelling seen only in advisory columns is a finding of nothing and stays out.
    """
    flag = F.lit(False)
    for t, c in advisory:
        flag = flag | ((F.col("tbl") == t) & (F.col("col") == c))
    real = missing.withColumn("adv", flag).groupBy(F.col("entity_key").alias("spelling")).agg(F.bool_and("adv").alias("only_adv"))
    named = real.filter(~F.col("only_adv")).join(bridge.select(F.col("spelling").cast("string"), "entity_key"), "spelling") \
        .filter(K.looks_canonical(F.col("entity_key")))
    stubs = named.select("entity_key", K.canonical_url(F.col("entity_key")).alias("url"), F.lit(True).alias("is_stub")).dropDuplicates(["entity_key"])
    alias = named.select(F.col("spelling").alias("alias"), "entity_key", F.lit("message").alias("kind"), F.lit(5).alias("prio"))
    return stubs, alias


def audit(spellings: DataFrame, aliases: DataFrame, keys: DataFrame, advisory: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """Per key column: spellings, entities, unresolved, up to five examples, verdict."""
    known = keys.select(F.col("entity_key").cast("string").alias("entity_key")).distinct().withColumn("known", F.lit(True))
    r = resolve(spellings, "spelling", aliases).join(known, "entity_key", "left")
    per = r.groupBy("tbl", "col").agg(F.count("*").alias("spellings"), F.count_distinct("entity_key").alias("entities"),
                                      F.count_distinct(F.when(F.col("known").isNull(), F.col("entity_key"))).alias("unresolved"))
    bad = r.filter(F.col("known").isNull() & F.col("entity_key").isNotNull()).select("tbl", "col", "entity_key").distinct()
    w = Window.partitionBy("tbl", "col").orderBy("entity_key")
    five = (bad.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5)
            .groupBy("tbl", "col").agg(F.array_sort(F.collect_list("entity_key")).alias("examples")))
    flag = F.lit(False)
    for t, c in advisory:
        flag = flag | ((F.col("tbl") == t) & (F.col("col") == c))
    return (per.join(five, ["tbl", "col"], "left").withColumn("advisory", flag)
            .withColumn("ok", F.col("advisory") | (F.col("unresolved") == 0)))


def reuploads(messages: DataFrame) -> DataFrame:
    """Entities that sit at more than one message."""
    return (messages.select("entity_key", "msg_id").distinct().groupBy("entity_key")
            .agg(F.count("*").alias("messages")).filter(F.col("messages") > 1))


def note_messages(base: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_key, msg_id, source) after additive, deduplicated notes of positive ids."""
    good = new.filter(K.looks_canonical(F.col("entity_key")) & (F.col("msg_id") > 0))
    both = base.withColumn("p", F.lit(0)).unionByName(good.withColumn("p", F.lit(1)))
    return (both.groupBy("entity_key", "msg_id").agg(F.min_by("source", F.struct("p", "source")).alias("source")))


def set_collections(base: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_key, collection) membership after additive filing; blanks never file."""
    rows = new.withColumn("collection", F.trim("collection")).filter(F.coalesce("collection", F.lit("")) != "")
    return base.select("entity_key", "collection").unionByName(rows.select("entity_key", "collection")).distinct()


def collection_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("collection").agg(F.count_distinct("entity_key").alias("n"))


def bulk_arrays(aliases: DataFrame, messages: DataFrame, collections: DataFrame, twins: DataFrame) -> DataFrame:
    """Card columns: aliases, messages and collections of an entity, and its twin group.

    Each list is deduplicated before it is gathered, so its length is the number of an
    entity's own spellings or filings; twins stay a group reference because their lists
    would be quadratic in the number of copies.
    """
    a = aliases.filter(F.col("kind") != "self").select("entity_key", "alias").distinct() \
        .groupBy("entity_key").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    m = messages.select("entity_key", "msg_id").distinct().groupBy("entity_key").agg(F.array_sort(F.collect_list("msg_id")).alias("messages"))
    c = collections.select("entity_key", "collection").distinct().groupBy("entity_key") \
        .agg(F.array_sort(F.collect_list("collection")).alias("collections"))
    t = twins.select("entity_key", F.col("digest").alias("twin_group"), "twins").dropDuplicates(["entity_key"])
    return (a.join(m, "entity_key", "full_outer").join(c, "entity_key", "full_outer").join(t, "entity_key", "full_outer"))


def canonicalise_rows(rows: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, alias candidates, refused) of incoming entity rows whose key may be a legacy spelling.

    A row's own permalink outranks the alias map; a row neither can place is refused to a
    side output.
    """
    from .merge import resolve as _resolve
    r = _resolve(rows.withColumn("__old", F.col("entity_key").cast("string")), "__old", aliases, "__alias_key")
    own = K.looks_canonical(F.col("__old"))
    url = K.key_from_url(F.col("url")) if "url" in rows.columns else F.lit(None).cast("string")
    true_key = F.when(own, F.col("__old")).otherwise(F.coalesce(url, "__alias_key"))
    placed = r.withColumn("__key", true_key).withColumn("__ok", K.looks_canonical(F.col("__key")))
    kept = placed.filter("__ok").withColumn("entity_key", F.col("__key")).withColumn("rehomed", F.col("__old") != F.col("__key"))
    drop = ["__old", "__alias_key", "__key", "__ok", "resolved"]
    cand = kept.filter("rehomed").select(F.col("__old").alias("alias"), "entity_key", F.lit("message").alias("kind"), F.lit(1).alias("prio"))
    return kept.drop(*drop), cand, placed.filter(~F.col("__ok")).drop(*drop)


def absorb(state: DataFrame, keys: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identity after newly arrived entity rows: what is known outranks what is new."""
    new = candidates_from_entities(arrived).withColumn("prio", F.col("prio") + 10)
    old = state.select("alias", "entity_key", "kind", "prio")
    every = keys.select(F.col("entity_key").cast("string").alias("entity_key")).unionByName(
        arrived.filter(K.looks_canonical(F.col("entity_key"))).select(F.col("entity_key").cast("string").alias("entity_key"))).distinct()
    return learn(old.unionByName(new), every)


def learned(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, conflicts) of the witnesses that ``learn_stream`` has written, over all batches.

    Pairs are merged by strength, whatever batch brought them first, so the map is that of learning from
    everything at once: an entity that arrives late makes earlier witnesses of it count.
    """
    own = pairs.filter((F.col("kind") == "self") & (F.col("alias") == F.col("entity_key")))
    return learn(pairs.select("alias", "entity_key", "kind", "prio"), own.select("entity_key"))


def forget(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.filter((F.col("alias") != alias) | (F.col("kind") == "self"))


def refresh(entities: DataFrame, messages: DataFrame, ledger: DataFrame, files: DataFrame | None = None):
    """(aliases, conflicts, twins): every pass over the witnesses, strongest first."""
    keys = entities.select("entity_key")
    cand = candidates_from_entities(entities).unionByName(candidates_from_messages(messages)).unionByName(candidates_from_ledger(ledger))
    aliases, conflicts = learn(cand, keys)
    if files is None:
        return aliases, conflicts, None
    extra, twins = content_groups(files, aliases, keys)
    aliases, conflicts = learn(cand.unionByName(extra), keys)
    return aliases, conflicts, twins
