"""Lexical, dense and hybrid moment search.

Scoring a query is one scan with column expressions: term frequencies are counted inside
each row behind a substring test, corpus statistics are one aggregate read back as scalar subqueries, and every
candidate list ends in a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from .lexindex import LexicalIndex

CANDIDATES = 200


def tokenised(moments: DataFrame) -> DataFrame:
    """moments with their tokens and length; persist it when many queries follow."""
    toks = T.search_tokens(F.coalesce(F.col("text"), F.lit("")))
    return moments.withColumn("tokens", toks).withColumn("dl", F.size("tokens"))


def postings(moments: DataFrame) -> DataFrame:
    """Inverted index (term, id, tf, dl): one row per distinct term of a passage."""
    t = tokenised(moments)
    exploded = t.select("id", "dl", F.explode("tokens").alias("term"))
    return exploded.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def _count_term(low: Column, term: str, prefix: bool) -> Column:
    """Occurrences of a term as a whole token (or as a token's head) without tokenising.

    The substring test is cheap and rules out nearly every row before the pattern runs.
    """
    edge = r"[\p{L}\p{M}\p{N}]"
    pattern = rf"(?<!{edge}){T.re.escape(term)}" + ("" if prefix else rf"(?!{edge})")
    return F.when(low.contains(term), F.regexp_count(low, F.lit(pattern))).otherwise(F.lit(0)).cast("double")


def bm25_scores(moments: DataFrame, terms: Sequence[str], prefix: str | None = None,
                require_all: bool = False, within: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """moments with ``bm25`` for the rows that match; ``score`` = bm25 scaled by weight.

    Document frequencies, corpus size and mean length come from one aggregate over the
    same scan; ``within`` and ``among`` (entity_key) narrow the rows that are scored, not these statistics.
    """
    probes = [(t, False) for t in terms] + ([(prefix, True)] if prefix else [])
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    combine = (lambda a, b: a & b) if require_all else (lambda a, b: a | b)
    counts = [_count_term(low, term, pre) for term, pre in probes]
    length = F.regexp_count(low, F.lit(r"[\p{L}\p{M}\p{N}]+"))
    stats = moments.select(length.alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)]).agg(
        F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(probes))])
    likely = present = None
    for (term, _), c in zip(probes, counts):
        seen, here = low.contains(term), c > 0
        likely = seen if likely is None else combine(likely, seen)
        present = here if present is None else combine(present, here)
    # One scalar subquery, carried as a column and read by every term.
    inside = moments if within is None else moments.filter(within)
    if among is not None:
        inside = inside.join(among, "entity_key", "left_semi")
    t = inside.filter(likely).filter(present).withColumns(
        {"dl": length, "corpus": stats.select(F.struct("*")).scalar()})
    corpus = F.col("corpus")
    for i, c in enumerate(counts):
        t = t.withColumn(f"tf{i}", c)
    score = F.lit(0.0)
    for i in range(len(probes)):
        score = score + M.bm25_term(F.col(f"tf{i}"), corpus.getField(f"df{i}"), corpus.getField("n"),
                                    F.col("dl"), corpus.getField("avgdl"))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(0.05)) \
        if "weight" in moments.columns else F.lit(1.0)
    return (t.withColumn("bm25", score).withColumn("score", F.col("bm25") * weight)
            .drop("dl", "corpus", *[f"tf{i}" for i in range(len(probes))]))


def top_ranked(df: DataFrame, limit: int, by: str = "score", tie: str = "id", digits: int | None = 9) -> DataFrame:
    """Best ``limit`` rows with a 1-based ``rank``.

    The limit runs first (a distributed top-k), so the ranking window only ever sees
    ``limit`` rows.
    """
    key = F.round(by, digits) if digits is not None else F.col(by)
    best = df.withColumn("__o", key).orderBy(F.col("__o").desc(), F.col(tie).asc()).limit(limit)
    w = Window.orderBy(F.col("__o").desc(), F.col(tie).asc())
    return best.withColumn("rank", F.row_number().over(w)).drop("__o")


def lexical(moments: DataFrame, query: str, limit: int = CANDIDATES, enough: int = 8, within: Column | None = None,
            among: DataFrame | None = None) -> DataFrame:
    """(id, rank): AND hits; short lists are widened with OR hits, none at all with prefix hits.

    The three shapes are branches of one plan: each is cut to ``limit`` rows, and a branch
    is let through by a count over the cut of the branch before it.
    """
    all_terms, _ = T.query_terms(query, "and")
    if not all_terms:
        return moments.select("id", F.lit(None).cast("int").alias("rank")).limit(0)
    any_terms, _ = T.query_terms(query, "or")
    head, prefix = T.query_terms(query, "prefix")

    strict = top_ranked(bm25_scores(moments, all_terms, require_all=True, within=within, among=among), limit).select("id", "rank")
    loose = top_ranked(bm25_scores(moments, any_terms, within=within, among=among), limit).select("id", "rank")
    typed = top_ranked(bm25_scores(moments, head, prefix, within=within, among=among), limit).select("id", "rank")

    n_strict = strict.agg(F.count("*")).scalar()
    n_loose = loose.agg(F.count("*")).scalar()
    # AND was empty and OR stayed under the bar: OR hits lead, or the prefix shape if OR found none.
    tiers = (strict.withColumn("tier", F.lit(0))
             .unionByName(loose.filter(n_strict < enough).withColumn("tier", F.lit(1)))
             .unionByName(typed.filter((n_strict == 0) & (n_loose == 0)).withColumn("tier", F.lit(2))))
    first = tiers.groupBy("id").agg(F.min(F.struct("tier", "rank")).alias("p"))
    w = Window.orderBy("p.tier", "p.rank")
    return first.select("id", F.row_number().over(w).alias("rank"))


def like_fallback(moments: DataFrame, query: str, limit: int = CANDIDATES) -> DataFrame:
    """Substring match on any content token, heaviest first (ASCII case folded)."""
    toks = [t for t in T.re.findall(T.QUERY_TOKEN, query) if t.lower() not in T.STOPWORDS]
    if not toks:
        return moments.select("id", F.lit(None).cast("int").alias("rank")).limit(0)
    cond = F.lit(False)
    for t in toks:
        cond = cond | F.lower("text").contains(t.lower())
    return top_ranked(moments.filter(cond), limit, by="weight").select("id", "rank")


def dense(vectors: DataFrame, q: Sequence[float], limit: int = CANDIDATES, id_col: str = "id",
          vec_col: str = "v") -> DataFrame:
    """Exhaustive cosine against unit vectors: (id, sim, rank)."""
    length = sum(x * x for x in q) ** 0.5 or 1.0
    unit_q = [x / length for x in q]
    scored = vectors.select(F.col(id_col).alias("id"), M.dot_literal(F.col(vec_col), unit_q).alias("sim"))
    return top_ranked(scored, limit, by="sim")


def fuse(*rankings: tuple[DataFrame, float]) -> DataFrame:
    """Reciprocal rank fusion of ``(ranking, weight)`` pairs: (id, fused)."""
    parts = None
    for r, w in rankings:
        p = r.select("id", M.rrf(F.col("rank"), weight=w).alias("part"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("id").agg(F.sum("part").alias("fused"))


def entity_scores(hits: DataFrame, key: str = "entity_key", score: str = "score",
                  source: str = "source", tie: str = "id") -> DataFrame:
    """Best moment plus damped corroboration, times a bonus for independent sources."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    top = hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 6)
    damped = F.sum(F.when(F.col("rn") == 1, F.col(score)).otherwise(0.5 * F.col(score) / F.col("rn")))
    sums = top.groupBy(key).agg(damped.alias("sum_part"))
    spread = hits.groupBy(key).agg(F.count("*").alias("hit_count"), F.count_distinct(source).alias("n_sources"))
    return (sums.join(spread, key)
            .select(key, (F.col("sum_part") * (1.0 + 0.08 * (F.col("n_sources") - 1))).alias("score"),
                    "hit_count", "n_sources"))


@dataclass(frozen=True)
class Filters:
    """Facet filters of the grouped result; an unknown duration passes both bounds."""

    creator: str | None = None
    category: str | None = None
    collection: str | None = None
    min_dur: float | None = None
    max_dur: float | None = None
    min_hits: int | None = None

    def on_cards(self) -> bool:
        """Whether any filter but ``min_hits`` is set."""
        return bool(self.creator or self.category or self.collection) or self.min_dur is not None or self.max_dur is not None

    def apply(self, df: DataFrame) -> DataFrame:
        dur = F.coalesce(F.col("duration"), F.lit(0.0))
        if self.creator:
            df = df.filter(F.coalesce("creator", F.lit("")) == self.creator)
        if self.category:
            df = df.filter(F.coalesce("category", F.lit("")) == self.category)
        if self.collection:
            df = df.filter(F.array_contains("collections", self.collection))
        if self.min_dur is not None:
            df = df.filter(~((dur > 0) & (dur < self.min_dur)))
        if self.max_dur is not None:
            df = df.filter(~((dur > 0) & (dur > self.max_dur)))
        if self.min_hits is not None:
            df = df.filter(F.col("hit_count") >= self.min_hits)
        return df


SORTS = ("relevance", "recent", "oldest", "longest", "shortest", "liked", "matches")


def order_columns(sort: str, key: str = "entity_key") -> list[Column]:
    """A missing value always sorts last; ties fall back to the score, then the key."""
    dur = F.when(F.coalesce(F.col("duration"), F.lit(0.0)) > 0, F.col("duration"))
    lead = {
        "recent": [F.col("created_at").desc_nulls_last()],
        "oldest": [F.col("created_at").asc_nulls_last()],
        "longest": [dur.desc_nulls_last()],
        "shortest": [dur.asc_nulls_last()],
        "liked": [F.col("likes").desc_nulls_last()],
        "matches": [F.col("hit_count").desc()],
    }.get(sort, [])
    return [*lead, F.col("score").desc(), F.col(key).asc()]


def facets(pool: DataFrame, columns: dict[str, str], arrays: dict[str, str] | None = None,
           n: int = 14) -> DataFrame:
    """(field, value, n): most frequent values first, ties by value, ``n`` per field."""
    parts = None
    for field, col in columns.items():
        p = pool.select(F.lit(field).alias("field"), F.trim(F.col(col).cast("string")).alias("value"))
        parts = p if parts is None else parts.unionByName(p)
    for field, col in (arrays or {}).items():
        p = pool.select(F.lit(field).alias("field"), F.explode(col).alias("value")) \
            .withColumn("value", F.trim("value"))
        parts = p if parts is None else parts.unionByName(p)
    counted = (parts.filter(F.col("value").isNotNull() & (F.col("value") != ""))
               .groupBy("field", "value").agg(F.count("*").alias("n")))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    moments: DataFrame
    facets: DataFrame
    matched: DataFrame


def hybrid(moments: DataFrame, cards: DataFrame, query: str, vectors: DataFrame | None = None,
           query_vector: Sequence[float] | None = None, limit: int = 24, offset: int = 0,
           sources: Sequence[str] | None = None, entity_key=None, candidates: int = CANDIDATES,
           sort: str = "relevance", filters: Filters = Filters(), moments_shown: int = 24,
           index: LexicalIndex | None = None) -> SearchResult:
    """Lexical and dense candidates fused by reciprocal rank, grouped per entity.

    Source, entity and card filters come before the candidate cut, so a search filtered by
    them loses no match to it. Facets are counted before the facet filters, so an active filter still
    shows its own count. ``candidates`` is how deep each ranking is read. With a stored ``index`` of the
    moments the words are looked up there, and ``hit_count``, ``n_sources``, ``min_hits`` and the facets count
    every passage that matches; without one they count the candidates.
    """
    within = None
    for wanted in ([F.col("source").isin(*sources)] if sources else []) + ([F.col("entity_key") == F.lit(entity_key)] if entity_key is not None else []):
        within = wanted if within is None else within & wanted

    def ranked(among: DataFrame | None) -> DataFrame:
        words = lexical(moments, query, candidates, within=within, among=among) if index is None else index.search(query, candidates, within=within, among=among)
        lists = [(words, 1.0)]
        if vectors is not None and query_vector is not None:
            inside = moments if within is None else moments.filter(within)
            inside = inside if among is None else inside.join(among, "entity_key", "left_semi")
            near = vectors if within is None and among is None else vectors.join(inside.select("id"), "id", "left_semi")
            lists.append((dense(near, query_vector, candidates), 1.0))
        rows = moments.join(fuse(*lists), "id")
        return rows.withColumn(
            "score", F.round(F.col("fused") * F.coalesce(F.col("weight"), F.lit(1.0))
                             * (1.0 + T.phrase_bonus(F.col("text"), query)), 6))

    if index is None:
        scored = ranked(None)
        pool = cards.join(entity_scores(scored), "entity_key")
        kept = filters.apply(pool)
        if filters.on_cards():
            scored = ranked(replace(filters, min_hits=None).apply(cards).select("entity_key"))
            kept = filters.apply(cards.join(entity_scores(scored), "entity_key"))
    else:
        every = index.matches(query, within).groupBy("entity_key").agg(F.count("*").alias("hit_count"), F.count_distinct("source").alias("n_sources"))
        pool = cards.join(every, "entity_key")
        scored = ranked(filters.apply(pool).select("entity_key") if filters.on_cards() or filters.min_hits is not None else None)
        # An entity that only its vectors put forward has no word that matches.
        counted = entity_scores(scored).drop("hit_count", "n_sources").join(every, "entity_key", "left")
        kept = filters.apply(cards.join(counted.fillna(0, ["hit_count", "n_sources"]), "entity_key"))
    order = order_columns(sort)
    page = kept.orderBy(*order).offset(offset).limit(limit)
    w = Window.partitionBy("entity_key").orderBy(F.coalesce("t_start", F.lit(-1.0)), "id")
    shown = (scored.join(page.select("entity_key"), "entity_key", "left_semi")
             .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= moments_shown))
    array_cols = {"collections": "collections"} if "collections" in cards.columns else {}
    scalar_cols = {f: c for f, c in (("creators", "creator"), ("categories", "category")) if c in cards.columns}
    return SearchResult(page, shown, facets(pool, scalar_cols, array_cols), pool)


def suggest(cards: DataFrame, moments: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Names by prefix first, then corpus words strictly longer than the prefix."""
    p = prefix.strip().lower()
    names = None
    for prio, col in enumerate(("creator", "category")):
        if col not in cards.columns:
            continue
        part = (cards.filter(F.lower(col).startswith(p)).groupBy(F.lower(col).alias("text"))
                .agg(F.min(col).alias("shown")).select("text", "shown", F.lit(prio).alias("prio"), F.lit(0).cast("bigint").alias("df")))
        names = part if names is None else names.unionByName(part)
    terms = (moments.select("id", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("text"))
             .filter(F.col("text").startswith(p) & (F.length("text") > len(p)))
             .groupBy("text").agg(F.count("*").alias("df"))
             .select("text", F.col("text").alias("shown"), F.lit(9).alias("prio"), "df"))
    both = terms if names is None else names.unionByName(terms)
    once = both.groupBy("text").agg(F.min_by(F.struct("shown", "prio", "df"), "prio").alias("s"))
    return (once.select(F.col("s.shown").alias("text"), F.when(F.col("s.prio") < 9, "name").otherwise("term").alias("kind"),
                        F.col("s.prio").alias("prio"), F.col("s.df").alias("df"))
            .orderBy("prio", F.col("df").desc(), "text").limit(limit))


def search_stats(moments: DataFrame, cards: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """(name, value): corpus totals; distinct creators exclude blanks."""
    m = moments.agg(F.count("*").cast("double").alias("moments"))
    c = cards.agg(F.count("*").cast("double").alias("entities"),
                  F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"),
                  F.count_distinct(F.when(F.col("creator") != "", F.col("creator"))).cast("double").alias("creators"))
    by_source = moments.groupBy(F.concat(F.lit("source:"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))).alias("name")) \
        .agg(F.count("*").cast("double").alias("value"))
    out = m.unpivot([], ["moments"], "name", "value") \
        .unionByName(c.unpivot([], ["entities", "seconds", "creators"], "name", "value")).unionByName(by_source)
    if collections is not None:
        k = collections.agg(F.count_distinct("collection").cast("double").alias("collections"),
                            F.count("*").cast("double").alias("memberships"))
        out = out.unionByName(k.unpivot([], ["collections", "memberships"], "name", "value"))
    return out
