"""From rows and claims to moments: passage merge, fact runs, sliver refusal, cards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..functions import maths as M
from ..functions import text as T
from .sequences import BLOCK, BLOCK_SECONDS, Carry, blocked, union_seconds, with_carry

# Passage and fact shaping.
TARGET_CHARS = 320
STANDALONE_CHARS = 180
MERGE_GAP_S = 14.0
FACT_GAP_S = 1.0
POINT_WIDTH_S = 2.5
TILE_SHARE = 0.8
PARTITION_MIN = 4
SLIVER_FLOOR = 0.05

# Weight per source; any other source weighs 1.
SOURCE_WEIGHT = {"narrative": 1.30, "speech": 1.15, "visual": 1.00, "caption": 0.95, "ocr": 0.85, "meta": 0.70}


def source_weight(source: Column) -> Column:
    out = F.lit(1.0)
    for name, w in SOURCE_WEIGHT.items():
        out = F.when(source == name, F.lit(w)).otherwise(out)
    return out


def _step(state: int, length: int) -> tuple[bool, int]:
    """One row into a buffer holding ``state`` characters: (opens a passage, new state)."""
    opens = state == 0 or state + length > T.MAX_CHARS
    state = (0 if opens else state) + length + 1
    return opens, (0 if state >= TARGET_CHARS else state)


def _exit_states(keys: Sequence[str]):
    """Buffer state a block hands on, as a number or as a table over its entry states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [*keys, BLOCK]
        open_key, fixed, state, table = None, False, 0, None

        def emit():
            return (*open_key, fixed, int(state), None if fixed else table.astype(np.int32).tolist())

        for pdf in batches:
            done = []
            for row in zip(*(pdf[c] for c in cols), pdf["len"], pdf["hard"]):
                key, length, hard = row[:-2], int(row[-2]), bool(row[-1])
                if key != open_key:
                    if open_key is not None:
                        done.append(emit())
                    open_key, fixed, state, table = key, False, 0, np.arange(TARGET_CHARS)
                if hard:
                    fixed, state = True, 0
                if fixed:
                    state = 0 if length >= STANDALONE_CHARS else _step(state, length)[1]
                else:
                    table[(table > 0) & (table + length > T.MAX_CHARS)] = 0
                    table = table + length + 1
                    table[table >= TARGET_CHARS] = 0
            yield pd.DataFrame(done, columns=[*cols, "fixed", "exit", "table"])
        if open_key is not None:
            yield pd.DataFrame([emit()], columns=[*cols, "fixed", "exit", "table"])

    return run


def _chain_states(keys: Sequence[str]):
    """Follow a chain of blocks without any certain boundary from its known first exit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        state, outs = 0, []
        for fixed, ex, table in zip(pdf["fixed"], pdf["exit"], pdf["table"]):
            state = int(ex) if fixed else int(table[state])
            outs.append(state)
        out = pdf[[*keys, BLOCK]].copy()
        out["entry"] = outs
        return out

    return run


def _mark_openings(keys: Sequence[str]):
    """Rows of a block in order -> whether each opens a passage, from the entry state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [*keys, BLOCK]
        open_key, state = None, 0
        for pdf in batches:
            flags = np.zeros(len(pdf), dtype=bool)
            for i, row in enumerate(zip(*(pdf[c] for c in cols), pdf["len"], pdf["hard"], pdf["entry"])):
                key, length, hard = row[:-3], int(row[-3]), bool(row[-2])
                if key != open_key:
                    open_key, state = key, int(row[-1])
                if hard:
                    state = 0
                if length >= STANDALONE_CHARS:
                    flags[i], state = True, 0
                else:
                    flags[i], state = _step(state, length)
            yield pdf.drop(columns=["len", "hard", "entry"]).assign(opens=flags)

    return run


def build_passages(rows: DataFrame, keys: Sequence[str] = ("entity_key", "source"), row_id: str = "row_id",
                   t0: str = "t0", t1: str = "t1", text: str = "text",
                   block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Merge short neighbouring rows of one entity and source into passages.

    A long row, a long predecessor or a pause is a boundary whatever came before, so most
    blocks of the time axis begin from a known state.  Where a run crosses a block edge, the
    block before it is reduced to the state it hands on (a table over its possible entry
    states when it holds no certain boundary), and only those tables are chained.  No task
    ever holds more than one block of one group.
    """
    keys = list(keys)
    spec = rows.filter(F.coalesce(text, F.lit("")) != "")
    a, b = F.col(t0).cast("double"), F.col(t1).cast("double")
    timed = spec.filter(a.isNotNull()).select(
        *keys, F.col(row_id).alias("rid"), a.alias("a"),
        F.when(b.isNull() | (b <= a), a + POINT_WIDTH_S).otherwise(b).alias("b"),
        F.col(text).alias("txt"), F.length(text).alias("len"))
    timed, blk = blocked(timed, F.col("a"), block_seconds)
    order = ["a", "b", "rid"]
    prev = with_carry(timed, keys, order, [Carry("p", "lag", F.struct("b", "len", BLOCK))], blk)
    hard = F.coalesce(F.col("p.b").isNull() | (F.col("len") >= STANDALONE_CHARS) | (F.col("p.len") >= STANDALONE_CHARS)
                      | (F.col("a") - F.col("p.b") > MERGE_GAP_S), F.lit(True))
    marked = prev.withColumn("hard", hard).withColumn("pblk", F.col(f"p.{BLOCK}")).drop("p")

    slim = marked.select(*keys, BLOCK, *order, "len", "hard", "pblk")
    crossing = (slim.filter(~F.col("hard") & (F.col("pblk") < F.col(BLOCK)))
                .select(*keys, F.col(BLOCK).alias("into"), F.col("pblk").alias(BLOCK)))
    source = (slim.join(crossing.select(*keys, BLOCK).distinct(), [*keys, BLOCK], "left_semi")
              .repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, *order)
              .select(*keys, BLOCK, "len", "hard"))
    key_schema = [slim.schema[k] for k in keys] + [slim.schema[BLOCK]]
    exits = source.mapInPandas(_exit_states(keys), TT.StructType([
        *key_schema, TT.StructField("fixed", TT.BooleanType()), TT.StructField("exit", TT.IntegerType()),
        TT.StructField("table", TT.ArrayType(TT.IntegerType()))]))
    upto = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = exits.withColumn("chain", F.sum(F.col("fixed").cast("int")).over(upto))
    states = chained.groupBy(*keys, "chain").applyInPandas(
        _chain_states(keys), TT.StructType([*key_schema, TT.StructField("entry", TT.IntegerType())]))
    entries = (crossing.join(states, [*keys, BLOCK]).select(*keys, F.col("into").alias(BLOCK), "entry"))

    staged = (slim.drop("pblk").join(entries, [*keys, BLOCK], "left")
              .withColumn("entry", F.coalesce("entry", F.lit(0)))
              .repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, *order))
    flagged = staged.mapInPandas(_mark_openings(keys), TT.StructType([
        *key_schema, *[slim.schema[c] for c in order], TT.StructField("opens", TT.BooleanType())]))
    numbered = with_carry(flagged, keys, order, [Carry("prior", "sum", F.col("opens").cast("bigint"))], BLOCK)
    member = numbered.select(*keys, BLOCK, *order, (F.col("prior") + F.col("opens").cast("bigint")).alias("pno"))
    full = member.join(timed.select(*keys, BLOCK, *order, "txt"), [*keys, BLOCK, *order])
    placed = (full.groupBy(*keys, "pno")
              .agg(F.min("a").alias("t0"), F.max("b").alias("t1"),
                   F.array_sort(F.collect_list(F.struct(*order, "txt"))).alias("parts"))
              .select(*keys, "t0", "t1", F.trim(F.array_join(F.transform("parts", lambda p: p["txt"]), " ")).alias("text"))
              .filter(F.col("text") != ""))
    loose = (spec.filter(a.isNull()).select(*keys, F.col(text).alias("text")).distinct()
             .join(placed.select(*keys, "text").distinct(), [*keys, "text"], "left_anti")
             .select(*keys, F.lit(None).cast("double").alias("t0"), F.lit(None).cast("double").alias("t1"), "text"))
    return placed.unionByName(loose)


def build_facts(rows: DataFrame, keys: Sequence[str] = ("entity_key", "source"), t0: str = "t0", t1: str = "t1",
                text: str = "text", conf: str = "confidence", block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """One moment per repeated fact: its longest run, the seconds it held, its best confidence.

    Repeated sightings collapse per start before ordering, so a fact seen by many observers
    costs one row; placement widens instants, coverage does not.
    """
    keys = [*keys, text]
    a, b = F.col(t0).cast("double"), F.col(t1).cast("double")
    spec = rows.filter(F.coalesce(text, F.lit("")) != "").select(
        *keys, a.alias("a"), F.when(b.isNull() | (b <= a), a + POINT_WIDTH_S).otherwise(b).alias("b"),
        F.when(b > a, b).otherwise(a).alias("held"), F.col(conf).cast("double").alias("conf"))
    starts = spec.filter(F.col("a").isNotNull()).groupBy(*keys, "a").agg(
        F.max("b").alias("b"), F.max("held").alias("held"), F.max("conf").alias("conf"))
    starts, blk = blocked(starts, F.col("a"), block_seconds)
    reach = with_carry(starts, keys, ["a"], [Carry("reach", "max", F.col("b")), Carry("hreach", "max", F.col("held"))], blk)
    opened = F.col("reach").isNull() | (F.col("a") - F.col("reach") > FACT_GAP_S)
    fresh = F.greatest(F.lit(0.0), F.col("held") - F.greatest(F.col("a"), F.coalesce("hreach", "a")))
    flagged = reach.withColumn("opened", opened.cast("bigint")).withColumn("fresh", fresh)
    numbered = with_carry(flagged, keys, ["a"], [Carry("prior", "sum", F.col("opened"))], blk)
    runs = (numbered.groupBy(*keys, (F.col("prior") + F.col("opened")).alias("run"))
            .agg(F.min("a").alias("ra"), F.max("b").alias("rb"), F.sum("fresh").alias("span"), F.max("conf").alias("conf"))
            .drop("run"))
    untimed = spec.filter(F.col("a").isNull()).groupBy(*keys).agg(F.max("conf").alias("conf")).select(
        *keys, F.lit(None).cast("double").alias("ra"), F.lit(None).cast("double").alias("rb"),
        F.lit(0.0).alias("span"), "conf")
    every = runs.unionByName(untimed)
    rank = F.when(F.col("ra").isNotNull(), F.struct(F.round(F.col("rb") - F.col("ra"), 9).alias("w"), (-F.col("ra")).alias("s")))
    return (every.groupBy(*keys).agg(F.max_by(F.struct("ra", "rb"), rank).alias("best"),
                                     F.sum("span").alias("span"), F.max("conf").alias("conf"))
            .select(*keys, F.col("best.ra").alias("t0"), F.col("best.rb").alias("t1"), "span", "conf"))


def competing_kinds(facts: DataFrame, keys: Sequence[str], t0: str = "t0", t1: str = "t1", text: str = "text",
                    kind: str = "kind", block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """(keys, kind, whole): kinds whose values divide one timeline between them.

    Two different values overlap somewhere exactly when, at some sighting, the furthest
    reaching earlier sighting carries another value and ends past its start; one running
    maximum decides it, and no pairs are formed.
    """
    gk = [*keys, kind]
    s = (facts.filter(F.col(t0).isNotNull() & F.col(t1).isNotNull() & (F.coalesce(kind, F.lit("")) != ""))
         .select(*gk, F.col(t0).cast("double").alias("a"),
                 F.greatest(F.col(t0), F.col(t1)).cast("double").alias("b"), F.col(text).alias("v")))
    shape = s.groupBy(*gk).agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("b").alias("hi"))
    whole = union_seconds(s, gk, "a", "b", "whole", block_seconds)
    distinct, blk = blocked(s.groupBy(*gk, "a", "v").agg(F.max("b").alias("b")), F.col("a"), block_seconds)
    lead = with_carry(distinct, gk, ["a", "b", "v"], [Carry("far", "max", F.struct("b", "v"))], blk)
    clash = lead.filter((F.col("far.v") != F.col("v")) & (F.col("a") < F.col("far.b"))).select(*gk).distinct()
    return (shape.filter((F.col("n") >= PARTITION_MIN) & (F.col("hi") > F.col("lo"))).join(whole, gk)
            .filter((F.col("whole") / (F.col("hi") - F.col("lo")) >= TILE_SHARE) & (F.col("whole") > 0))
            .join(clash, gk, "left_anti").select(*gk, "whole"))


def refuse_slivers(facts: DataFrame, keys: Sequence[str] = ("entity_key", "source"), t0: str = "t0", t1: str = "t1",
                   text: str = "text", kind: str = "kind", block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Drop the values that held under 5 % of a timeline they were competing for."""
    gk = [*keys, kind]
    rivals = competing_kinds(facts, keys, t0, t1, text, kind, block_seconds)
    placed = facts.filter(F.col(t0).isNotNull() & F.col(t1).isNotNull()) \
        .withColumn("__end", F.greatest(F.col(t0), F.col(t1)))
    held = union_seconds(placed, [*gk, text], t0, "__end", "held", block_seconds)
    lost = held.join(rivals, gk).filter(F.col("held") / F.col("whole") < SLIVER_FLOOR).select(*gk, text)
    return facts.join(lost, [*gk, text], "left_anti")


def dedupe_moments(moments: DataFrame, is_fact: str = "is_fact") -> DataFrame:
    """One row per (entity, source, text): prose before facts, placed before untimed, earliest.

    An aggregate with map-side partials, not a ranking window: copies of one text never
    gather in one task.
    """
    first = F.struct(F.col(is_fact), F.col("t_start").isNull().alias("u"), F.col("t_start"), F.col("t_end"))
    rest = [c for c in moments.columns if c not in ("entity_key", "source", "text_hash")]
    return (moments.groupBy("entity_key", "source", "text_hash")
            .agg(F.min_by(F.struct(*rest), first).alias("m"))
            .select("entity_key", "source", "text_hash", *[F.col(f"m.{c}").alias(c) for c in rest]))


def assemble_moments(prose: DataFrame, facts: DataFrame, entities: DataFrame, src_table: str = "",
                     block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """prose (entity_key, source, row_id, t0, t1, text) and facts (…, kind, confidence) to moments.

    Rows whose key names no entity are left out; ``entities`` carries duration.
    """
    known = entities.select("entity_key").distinct()
    passages = build_passages(prose.join(known, "entity_key", "left_semi"), block_seconds=block_seconds)
    kept = refuse_slivers(facts.join(known, "entity_key", "left_semi"), block_seconds=block_seconds)
    runs = build_facts(kept, block_seconds=block_seconds).join(
        entities.select("entity_key", "duration"), "entity_key", "left")
    w = source_weight(F.col("source"))
    shaped = passages.select("entity_key", "source", "t0", "t1", "text", w.alias("weight"), F.lit(0).alias("is_fact")) \
        .unionByName(runs.select("entity_key", "source", "t0", "t1", "text",
                                 (w * M.prominence(F.col("span"), F.col("duration")) * M.certainty(F.col("conf"))).alias("weight"),
                                 F.lit(1).alias("is_fact")))
    rows = shaped.select("entity_key", "source", F.col("t0").alias("t_start"), F.col("t1").alias("t_end"),
                         F.lit(src_table).alias("src_table"), "weight", "text",
                         T.text_hash(F.col("text")).alias("text_hash"), "is_fact")
    return (dedupe_moments(rows).drop("is_fact")
            .withColumn("id", F.xxhash64("entity_key", "source", "text_hash")))


def first_non_empty(sources: Sequence[DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """Per key and field the first value that is neither NULL nor blank, in source order."""
    parts = None
    for prio, df in enumerate(sources):
        have = set(df.columns)
        p = df.select(F.col(key), F.lit(prio).alias("__p"),
                      *[(F.col(f) if f in have else F.lit(None)).alias(f) for f in fields])
        parts = p if parts is None else parts.unionByName(p)
    def first(f):
        ok = F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        return F.min_by(F.col(f), F.when(ok, F.struct("__p", F.col(f).cast("string").alias("s")))).alias(f)
    return parts.groupBy(key).agg(*[first(f) for f in fields])


def source_counts(moments: DataFrame) -> DataFrame:
    """Per entity: moment_count, text_len, a source -> count map and the speech / narrative flags.

    The map is built from one row per source, never from the moments themselves.
    """
    per = moments.groupBy("entity_key", "source").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("t_end").alias("last_end"))
    return per.groupBy("entity_key").agg(
        F.sum("n").alias("moment_count"), F.sum("chars").alias("text_len"), F.max("last_end").alias("span_end"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"),
        F.bool_or(F.col("source") == "speech").alias("has_speech"),
        F.bool_or(F.col("source") == "narrative").alias("has_narrative"))


def build_cards(moments: DataFrame, meta: DataFrame, canonical: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """The serving table: one row per canonical entity that has moments or metadata."""
    counts = source_counts(moments)
    keys = (counts.select("entity_key").union(meta.select("entity_key")).distinct()
            .join(canonical.select("entity_key").distinct(), "entity_key", "left_semi"))
    cards = keys.join(meta, "entity_key", "left").join(counts, "entity_key", "left")
    if "duration" in meta.columns:
        cards = cards.withColumn("duration", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), "span_end", F.lit(0.0)))
    if identity is not None:
        cards = cards.join(identity, "entity_key", "left")
    return (cards.drop("span_end").withColumn("moment_count", F.coalesce("moment_count", F.lit(0)))
            .withColumn("text_len", F.coalesce("text_len", F.lit(0)))
            .withColumn("has_speech", F.coalesce("has_speech", F.lit(False)))
            .withColumn("has_narrative", F.coalesce("has_narrative", F.lit(False))))
