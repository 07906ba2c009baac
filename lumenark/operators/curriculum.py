"""Prerequisite-ordered curriculum over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .passages import POINT_WIDTH_S

# Concepts per plan, least support, least overlap, least P, margin, prerequisites.
BREADTH = 60
MIN_SUPPORT = 2
MIN_SHARED = 3
P_MIN = 0.60
MARGIN = 0.20
MAX_PREREQ = 3
PLAN_MOMENTS = 5
STEP_MOMENTS = 24
SCOPE_FLOOR = 3
CONCEPT_KINDS = ("tag", "hashtag", "attr")


def membership(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(concept, entity_key) pairs of concept nodes, inside a scope of entities if given."""
    links = (edges.filter(F.col("src").startswith("v:"))
             .select(F.col("dst").alias("concept"), F.substring("src", 3, 1_000_000).alias("entity_key")).distinct())
    kinds = nodes.filter(F.col("kind").isin(*CONCEPT_KINDS)).select(F.col("id").alias("concept"))
    links = links.join(kinds, "concept", "left_semi")
    if scope is not None:
        links = links.join(scope.select(F.col("entity_key").cast("string")).distinct(), "entity_key", "left_semi")
    return links


def concepts(members: DataFrame, labels: DataFrame, weights: DataFrame | None = None, breadth: int = BREADTH,
             min_support: int = MIN_SUPPORT) -> DataFrame:
    """(concept, label, videos, reach): the best covered concepts, bounded by ``breadth``."""
    m = members
    if weights is not None:
        m = m.join(weights.select(F.col("entity_key").cast("string"), "weight"), "entity_key", "left")
    else:
        m = m.withColumn("weight", F.lit(1.0))
    c = m.groupBy("concept").agg(F.count("*").alias("videos"), F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 4).alias("reach"))
    return (c.filter(F.col("videos") >= min_support).join(labels.select("concept", "label"), "concept")
            .orderBy(F.col("videos").desc(), "label", "concept").limit(breadth))


def prerequisites(members: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst, shared, p_forward, p_back, strength): what is seen before what.

    Entities are first reduced to their distinct sets of the plan's concepts with a count
    (map-side combined), so no entity ever meets another. Each distinct set then counts, once for
    each of its concepts, the rarer ones beside it: sparse counters, combined before they are
    shuffled. ``kept`` is the plan, as many rows as its reader asked for; it is written first,
    since four places read it.
    """
    w = Window.orderBy(F.col("videos").desc(), "concept")
    kept = cut_lineage(kept.select("concept", "videos"))
    ranked = kept.select("concept", "videos", (F.row_number().over(w) - 1).alias("i"))
    own = members.join(F.broadcast(ranked.select("concept", "i")), "concept")
    sets = own.groupBy("entity_key").agg(F.array_sort(F.collect_set("i")).alias("s"))
    patterns = sets.groupBy("s").agg(F.count("*").alias("n"))
    rows = patterns.select("s", "n", F.posexplode("s").alias("at", "a"))
    rarer = rows.select("a", "n", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
    pairs = rarer.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    A = ranked.select(F.col("i").alias("a"), F.col("concept").alias("src"), F.col("videos").alias("na"))
    B = ranked.select(F.col("i").alias("b"), F.col("concept").alias("dst"), F.col("videos").alias("nb"))
    e = (pairs.filter(F.col("shared") >= MIN_SHARED).join(A, "a").join(B, "b")
         .filter(F.col("na") > F.col("nb"))
         .withColumn("pf", F.col("shared") / F.col("nb")).withColumn("pb", F.col("shared") / F.col("na"))
         .filter((F.col("pf") >= P_MIN) & (F.round(F.col("pf") - F.col("pb"), 12) >= MARGIN)))
    out = e.select("src", "dst", "shared", F.round("pf", 4).alias("p_forward"), F.round("pb", 4).alias("p_back"),
                   F.round(F.col("pf") * (F.col("pf") - F.col("pb")), 5).alias("strength"))
    best = Window.partitionBy("dst").orderBy(F.col("strength").desc(), F.col("src").asc())
    return out.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= MAX_PREREQ).drop("rn")


def levels(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, level): longest path from a root.  Support falls strictly along every edge,
    so there is no cycle and the relaxation settles within the longest path's length."""
    e = cut_lineage(edges.select("src", "dst"))
    cur = cut_lineage(kept.select("concept", F.lit(1).alias("level")))
    while True:
        up = (e.join(cur.withColumnRenamed("concept", "src"), "src").groupBy(F.col("dst").alias("concept"))
              .agg((F.max("level") + 1).alias("up")))
        nxt = cut_lineage(cur.join(up, "concept", "left").select(
            "concept", F.greatest("level", F.coalesce("up", F.lit(1))).alias("level"),
            (F.coalesce("up", F.lit(1)) > F.col("level")).alias("moved")))
        cur = nxt.select("concept", "level")
        if nxt.filter("moved").isEmpty():
            break
    return cur


def stage_name(level, top):
    return (F.when(level == 1, F.lit("Foundations")).when(level == top, F.lit("Furthest out"))
            .otherwise(F.concat(F.lit("Stage "), level.cast("string"))))


def concept_moments(members: DataFrame, kept: DataFrame, moments: DataFrame, limit: int = PLAN_MOMENTS) -> DataFrame:
    """Best passages per concept: those that say its phrase, else the heaviest of its entities.

    Every entity of a concept takes part.  A moment meets only the concepts of its own
    entity, and the per-concept ranking keeps ``limit`` rows map-side before it shuffles.
    """
    m = moments.withColumn("entity_key", F.col("entity_key").cast("string")).withColumn(
        "norm", F.concat(F.lit(" "), F.array_join(T.search_tokens(F.coalesce("text", F.lit(""))), " "), F.lit(" ")))
    avg_len = m.agg(F.avg(F.length("norm"))).scalar()
    phrase = F.array_join(T.search_tokens(F.regexp_replace("label", "^#", "")), " ")
    small = kept.select("concept", phrase.alias("phrase"))
    both = (members.join(F.broadcast(small), "concept").join(m, "entity_key").withColumn("avg_len", avg_len))
    needle = F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    # Shared edge spaces: double them so that back-to-back mentions count.
    hay = F.replace(F.col("norm"), F.lit(" "), F.lit("  "))
    wide = F.concat(F.lit(" "), F.replace(F.col("phrase"), F.lit(" "), F.lit("  ")), F.lit(" "))
    tf = F.when((F.length("phrase") > 1) & F.col("norm").contains(needle),
                (F.length(hay) - F.length(F.replace(hay, wide, F.lit("")))) / F.length(wide)).otherwise(F.lit(0.0))
    score = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.length("norm") / F.col("avg_len")))
    ranked = both.withColumn("tf", tf).withColumn("score", F.round(score, 9)).withColumn("said", F.col("tf") > 0)
    w = Window.partitionBy("concept").orderBy(
        F.col("said").desc(), F.col("score").desc(), F.coalesce("weight", F.lit(1.0)).desc(), F.length("text").desc(), F.col("id").asc())
    top = ranked.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    top = top.withColumn("any_said", F.bool_or("said").over(Window.partitionBy("concept")))
    start = F.coalesce("t_start", F.lit(0.0))
    end = F.when(F.col("t_end") > start, F.col("t_end")).otherwise(start + POINT_WIDTH_S)
    return (top.filter(~F.col("any_said") | F.col("said"))
            .select("concept", "pos", "id", "entity_key", F.round(start, 2).alias("t_start"), F.round(end, 2).alias("t_end"),
                    F.round(end - start, 2).alias("seconds"), "source", "said", F.substring("text", 1, 600).alias("excerpt")))


def plan(kept: DataFrame, prereq: DataFrame, level: DataFrame, watch: DataFrame, scope_size) -> DataFrame:
    """One row per step in curriculum order, with its prerequisites, unlocks and watch time."""
    names = kept.select(F.col("concept").alias("c2"), F.col("label").alias("l2"))
    needs = (prereq.join(names, F.col("src") == F.col("c2")).groupBy(F.col("dst").alias("concept"))
             .agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), F.col("l2").alias("label")))).alias("needs")))
    opens = (prereq.join(names, F.col("dst") == F.col("c2")).groupBy(F.col("src").alias("concept"))
             .agg(F.array_sort(F.collect_list("l2")).alias("unlocks")))
    time = watch.groupBy("concept").agg(F.round(F.sum("seconds"), 1).alias("seconds"), F.bool_or("said").alias("said"))
    top = level.agg(F.max("level")).scalar()
    steps = (kept.join(level, "concept").join(needs, "concept", "left").join(opens, "concept", "left").join(time, "concept", "left"))
    return (steps.withColumn("top", top).withColumn("scope_n", scope_size)
            .select("concept", "label", "level", stage_name(F.col("level"), F.col("top")).alias("stage"), "videos", "reach",
                    F.round(F.col("videos") / F.greatest(F.col("scope_n"), F.lit(1)), 4).alias("share"),
                    F.transform("needs", lambda x: x["label"]).alias("prereq"), "unlocks",
                    F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("said", F.lit(False)).alias("said"))
            .orderBy("level", F.col("reach").desc(), "label"))


def stages(steps: DataFrame) -> DataFrame:
    return steps.groupBy("level", "stage").agg(F.count("*").alias("steps"), F.round(F.sum("seconds"), 1).alias("seconds"))


def ready(kept: DataFrame, prereq: DataFrame, marks: DataFrame) -> DataFrame:
    """Unmarked steps none of whose prerequisites is still unmarked."""
    done = marks.filter(F.col("state") == "done").select("concept")
    unmet = (prereq.join(done.withColumnRenamed("concept", "src"), "src", "left_anti").select(F.col("dst").alias("concept")).distinct())
    return kept.join(done, "concept", "left_anti").join(unmet, "concept", "left_anti")


def mark(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Progress after changes (concept, state, at): the latest state wins, blank clears."""
    both = marks.unionByName(changes)
    last = both.groupBy("concept").agg(F.max_by(F.struct("state", "at"), F.struct("at", "state")).alias("m"))
    return last.select("concept", "m.state", "m.at").filter(F.coalesce("state", F.lit("")) != "")


def progress_counts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("state").agg(F.count("*").alias("n"))


def goal_scope(found: DataFrame, archive: DataFrame, cap: int = 400) -> DataFrame:
    """(entity_key, weight): a goal's search results when they are at least three, else everything.

    ``found`` is already a ranked page of at most ``cap`` rows; the whole archive is never capped.
    """
    page = found.orderBy(F.col("score").desc(), "entity_key").limit(cap)
    n = page.agg(F.count("*")).scalar()
    goal = page.select("entity_key", F.when(F.col("score") > 0, F.col("score")).otherwise(F.lit(1.0)).alias("weight")).filter(n >= SCOPE_FLOOR)
    rest = archive.select("entity_key", F.lit(1.0).alias("weight")).filter(n < SCOPE_FLOOR)
    return goal.unionByName(rest)


def suggest_goals(nodes: DataFrame, limit: int = 14) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*CONCEPT_KINDS)).orderBy(F.col("weight").desc(), "label", "id").limit(limit)
