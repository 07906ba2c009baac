"""A stored inverted index: postings by term and passage block, a sorted term dictionary, corpus totals.

Three tables in one folder, each grown by whole batches:

* ``postings``: a row for each term and block of passages, with the passages (id, term frequency,
  length, weight, entity, source) as an array and the block's bounds (largest frequency and weight,
  least length) beside it. Rows lie in a directory by hash of the term and sorted by term inside, so
  a query opens the directories of its own terms and, by the page statistics, their rows in them.
* ``terms``: a row for each term and batch with its document and collection frequency, range-partitioned
  and sorted by term. A prefix is a range of it.
* ``totals``: passages and tokens of a batch.

A block holds about ``BLOCK`` passages whatever the corpus, so the postings of a word that every
passage has are as many rows as there are blocks, dealt over tasks. The text itself is never read
again. The best passages are found in two steps over the same rows: the bounds alone rank the blocks,
the most promising ones are scored, and of the others only those are opened whose bound reaches the
score of the last passage kept. The result is that of scoring everything.

Defined results. Ids are unique; a passage whose id the index has is skipped, so a batch can be
replayed. NULL texts have no tokens but count as passages. ``fold`` strips accents from Latin letters,
in passages and queries alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T

BLOCK, BUCKETS = 4096, 64
#: Blocks of a directory that one task groups and writes.
SLICE = 16
#: Blocks that are scored first, to learn what the others must reach.
SEEDS = 4
_PASSAGE = ("id", "dl", "weight", "entity_key", "source")
_POSTING = ("id", "tf", "dl", "weight", "entity_key", "source")


def _tokens(text: Column, fold: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return T.search_tokens(T.fold_accents(text) if fold else text)


def _counted(rows: DataFrame) -> DataFrame:
    """(attributes, term, tf) of passages with ``tokens``, counted inside the row: equal tokens stand together once they are sorted."""
    same = rows.select(*_PASSAGE, F.sort_array("tokens").alias("s"))
    heads = F.filter(F.transform("s", lambda t, i: F.struct(t.alias("term"), i.alias("at"))),
                     lambda h: (h["at"] == 0) | (h["term"] != F.get("s", h["at"] - 1)))
    same = same.select(*_PASSAGE, heads.alias("heads"))
    terms = F.transform("heads", lambda h, k: F.struct(h["term"].alias("term"), (F.coalesce(F.get("heads", k + 1)["at"], F.col("dl")) - h["at"]).alias("tf")))
    return same.select(*_PASSAGE, F.explode(terms).alias("t")).select(*_PASSAGE, "t.term", "t.tf")


class LexicalIndex:
    """An index in the folder ``path``; ``fold`` must be the one it was begun with."""

    def __init__(self, spark: SparkSession, path: str, fold: bool = False):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._kinds: dict[str, str] | None = None

    # ---- writing ---------------------------------------------------------------------

    def _has(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        if table == "passages":
            return self.spark.read.parquet(f"{self.path}/passages")
        if self._kinds is None:
            self._kinds = {f.name: f.dataType.simpleString() for f in self.read("passages").schema}
        posts = ", ".join(f"{c}: {'int' if c == 'tf' else self._kinds[c]}" for c in _POSTING)
        schema = {
            "postings": f"term string, block string, n bigint, cf bigint, max_tf int, min_dl int, max_weight double, posts array<struct<{posts}>>, batch int, bucket int",
            "terms": "term string, df bigint, cf bigint, batch int", "totals": "n bigint, tokens bigint, batch int"}[table]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def append(self, moments: DataFrame, batch: int) -> None:
        """Adds the passages (id, text, and weight, entity_key, source where there are such columns) that the index does not have.

        ``batch`` names the batch: writing one again replaces what it wrote before, so a run that was lost can be repeated.
        """
        have = set(moments.columns)
        rows = moments.select(
            "id", _tokens(F.col("text"), self.fold).alias("tokens"), (F.col("weight") if "weight" in have else F.lit(1.0)).cast("double").alias("weight"),
            *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("entity_key", "source")])
        if self._has("passages"):
            rows = rows.join(self.read("passages").where(F.col("batch") != batch).select("id"), "id", "left_anti")
        here = f"batch={batch}"
        rows = rows.withColumn("dl", F.size("tokens"))
        blocks = max(1, -(-moments.count() // BLOCK))
        rows.select(*_PASSAGE).write.mode("overwrite").parquet(f"{self.path}/passages/{here}")
        self._grouped(rows, batch, blocks, self._repeated(here)).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/{here}")
        mine = self.read("postings").where(F.col("batch") == batch)
        mine.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).repartitionByRange("term").sortWithinPartitions("term") \
            .write.mode("overwrite").parquet(f"{self.path}/terms/{here}")
        self.spark.read.parquet(f"{self.path}/passages/{here}").agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("bigint")).alias("tokens")) \
            .write.mode("overwrite").parquet(f"{self.path}/totals/{here}")

    def _repeated(self, here: str) -> bool:
        """Whether a batch has a passage twice: its counts then add up in one posting."""
        passages = self.spark.read.parquet(f"{self.path}/passages/{here}")
        return not passages.groupBy(*_PASSAGE).count().where("count > 1").isEmpty()

    def _grouped(self, rows: DataFrame, batch: int, blocks: int, repeated: bool) -> DataFrame:
        """Rows of ``postings`` of passages with ``tokens`` and ``dl``, as they are written.

        One shuffle, by directory and a slice of the blocks: what is grouped and sorted after it lies there already.
        """
        number = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        place = ("bucket", "slice", "term", "number")
        counted = _counted(rows).withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), "number": number}) \
            .withColumn("slice", F.pmod("number", F.lit(max(1, blocks // SLICE)))).repartition("bucket", "slice")
        if repeated:
            counted = counted.groupBy(*place, *_PASSAGE).agg(F.sum("tf").cast("int").alias("tf"))
        lists = counted.groupBy(*place).agg(
            F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
            F.max(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.05))).alias("max_weight"), F.collect_list(F.struct(*_POSTING)).alias("posts"))
        block = F.concat_ws(".", F.lit(str(batch)), F.col("number").cast("string"))
        return lists.select("term", block.alias("block"), "n", "cf", "max_tf", "min_dl", "max_weight", "posts", "bucket").sortWithinPartitions("bucket", "term", "block")

    # ---- the dictionary --------------------------------------------------------------

    def vocabulary(self, prefix: str = "") -> DataFrame:
        """(term, df, cf) of the terms that begin with ``prefix``: a range of the sorted dictionary."""
        rows = self.read("terms")
        if prefix:
            rows = rows.where(F.col("term").startswith(prefix))
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def suggest(self, prefix: str, names: DataFrame | None = None, limit: int = 8) -> DataFrame:
        """(text, kind, prio, df): ``names`` (text, shown, prio) by prefix first, then terms strictly longer than it."""
        p = prefix.strip().lower()
        terms = self.vocabulary(p).where(F.length("term") > len(p)).select(
            F.col("term").alias("text"), F.col("term").alias("shown"), F.lit(9).alias("prio"), "df")
        if names is not None:
            terms = names.where(F.col("text").startswith(p)).select("text", "shown", "prio", F.lit(0).cast("bigint").alias("df")).unionByName(terms)
        once = terms.groupBy("text").agg(F.min_by(F.struct("shown", "prio", "df"), "prio").alias("s"))
        return once.select(F.col("s.shown").alias("text"), F.when(F.col("s.prio") < 9, "name").otherwise("term").alias("kind"),
                           F.col("s.prio").alias("prio"), F.col("s.df").alias("df")).orderBy("prio", F.col("df").desc(), "text").limit(limit)

    # ---- scoring ---------------------------------------------------------------------

    def probes(self, terms: Sequence[str], prefix: str | None = None) -> list[tuple[str, bool]]:
        """Index tokens of query terms, once each; the last one may be a prefix."""
        def parts(term: str) -> list[str]:
            term = term.lower()
            return re.findall(r"[^\W_]+", "".join(dict(T._MARKED).get(c, c) for c in term) if self.fold else term)

        out = dict.fromkeys((p, False) for t in terms for p in parts(t))
        tail = parts(prefix) if prefix else []
        out |= dict.fromkeys([(p, False) for p in tail[:-1]] + [(p, True) for p in tail[-1:]])
        return list(out)

    def _lists(self, probes: Sequence[tuple[str, bool]]) -> DataFrame:
        """Posting rows of the probes, with the numbers of those that a row's term meets in ``probe``."""
        term, bucket = F.col("term"), F.col("bucket")
        wanted, meets = F.lit(False), []
        for i, (t, is_prefix) in enumerate(probes):
            hit = term.startswith(t) if is_prefix else (term == t)
            wanted = wanted | (hit if is_prefix else hit & (bucket == F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS))))
            meets.append(F.when(hit, F.lit(i)))
        return self.read("postings").where(wanted).withColumn("probe", F.explode(F.array_compact(F.array(*meets))))

    def _corpus(self, probes: Sequence[tuple[str, bool]]) -> Row:
        """n, avgdl and the document frequency of each probe: one row, read by every score of a query."""
        exact = [t for t, p in probes if not p]
        out = self.read("totals").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
        if exact:
            out = out.crossJoin(F.broadcast(self.read("terms").where(F.col("term").isin(exact)).agg(  # one row each
                *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).cast("double").alias(f"df{i}") for i, (t, p) in enumerate(probes) if not p])))
        for i, (t, p) in enumerate(probes):
            if p:  # a passage with several of the terms counts once
                held = self.read("postings").where(F.col("term").startswith(t)).select(F.explode("posts.id").alias("id"))
                out = out.withColumn(f"df{i}", held.agg(F.count_distinct("id").cast("double")).scalar())
        return out.first()

    def _bm25(self, probes: Sequence[tuple[str, bool]], corpus: Row) -> Column:
        """Of columns tf0, tf1, ... and dl."""
        n, avgdl = F.lit(corpus["n"]), F.lit(corpus["avgdl"] or 1.0)
        score = F.lit(0.0)
        for i in range(len(probes)):
            score = score + M.bm25_term(F.col(f"tf{i}"), F.lit(corpus[f"df{i}"]), n, F.col("dl"), avgdl)
        return score

    def _scored(self, lists: DataFrame, probes: Sequence[tuple[str, bool]], corpus: Row, require_all: bool, within: Column | None,
                among: DataFrame | None = None) -> DataFrame:
        rows = lists.select("probe", F.explode("posts").alias("p")).select("probe", *[F.col(f"p.{c}").alias(c) for c in _POSTING])
        if within is not None:
            rows = rows.where(within)
        if among is not None:
            rows = rows.join(among, "entity_key", "left_semi")
        tfs = [F.coalesce(F.sum(F.when(F.col("probe") == i, F.col("tf"))), F.lit(0)).cast("double").alias(f"tf{i}") for i in range(len(probes))]
        hits = rows.groupBy("id").agg(*tfs, *[F.first(c).alias(c) for c in ("dl", "weight", "entity_key", "source")])
        if require_all:
            for i in range(len(probes)):
                hits = hits.where(F.col(f"tf{i}") > 0)
        return hits.select("id", "entity_key", "source", "weight", self._bm25(probes, corpus).alias("bm25")) \
            .withColumn("score", F.col("bm25") * F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.05)))

    def scores(self, terms: Sequence[str], prefix: str | None = None, require_all: bool = False, within: Column | None = None,
               among: DataFrame | None = None) -> DataFrame:
        """(id, entity_key, source, weight, bm25, score) of every passage that matches; ``within`` (attributes only) and ``among`` (entity_key) narrow them."""
        probes = self.probes(terms, prefix)
        return self._scored(self._lists(probes), probes, self._corpus(probes), require_all, within, among)

    def bounds(self, probes: Sequence[tuple[str, bool]], corpus: Row | None = None) -> DataFrame:
        """(block, bound): no passage of a block scores higher; of the postings only the bounds are read."""
        corpus = corpus or self._corpus(probes)
        rows = self._lists(probes).groupBy("block", "probe").agg(F.sum("max_tf").alias("tf"), F.min("min_dl").alias("dl"), F.max("max_weight").alias("weight"))
        wide = rows.groupBy("block").agg(
            *[F.coalesce(F.max(F.when(F.col("probe") == i, F.col("tf"))), F.lit(0)).cast("double").alias(f"tf{i}") for i in range(len(probes))],
            F.min("dl").alias("dl"), F.max("weight").alias("weight"))
        return wide.select("block", (self._bm25(probes, corpus) * F.col("weight")).alias("bound"))

    def best(self, terms: Sequence[str], limit: int, prefix: str | None = None, require_all: bool = False, within: Column | None = None,
             among: DataFrame | None = None) -> DataFrame:
        """The ``limit`` best rows of ``scores`` with a ``rank``, ties by id; blocks that cannot hold one are not opened."""
        probes = self.probes(terms, prefix)
        lists, corpus = self._lists(probes), self._corpus(probes)
        if corpus["n"] > SEEDS * BLOCK:  # else the first blocks to score are all blocks
            bounds = self.bounds(probes, corpus)
            first = bounds.orderBy(F.col("bound").desc(), "block").limit(SEEDS).select("block")
            seeds = self._scored(lists.join(first, "block", "left_semi"), probes, corpus, require_all, within, among).select("score").orderBy(F.col("score").desc()).limit(limit)
            least = seeds.agg(F.when(F.count("*") == limit, F.min("score"))).first()[0] or 0.0
            # A margin of one unit in the last digit of the order below.
            lists = lists.join(bounds.where(F.col("bound") >= least - 1e-8).select("block"), "block", "left_semi")
        found = self._scored(lists, probes, corpus, require_all, within, among)
        kept = found.withColumn("o", F.round("score", 9)).orderBy(F.col("o").desc(), "id").limit(limit)
        return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.col("o").desc(), "id"))).drop("o")

    def matches(self, query: str, within: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """(id, entity_key, source) of every passage that has any content word of the query, or its half-typed last word if none has."""
        terms, _ = T.query_terms(query, "or")
        found = self.scores(terms, within=within, among=among)
        if not terms or not found.isEmpty():
            return found.select("id", "entity_key", "source")
        head, prefix = T.query_terms(query, "prefix")
        return self.scores(head, prefix, within=within, among=among).select("id", "entity_key", "source")

    def search(self, query: str, limit: int = 200, enough: int = 8, within: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """(id, rank): passages with all words; fewer than ``enough`` are followed by those with any, none at all by prefix matches.

        A wider shape is only run if the one before it left too few; at most ``limit`` ids are handed on between them.
        """
        strict, _ = T.query_terms(query, "and")
        if not strict:
            return self.read("passages").select("id", F.lit(None).cast("int").alias("rank")).limit(0)
        shapes = [("and", True), ("or", False), ("prefix", False)]
        kept: list = []
        for mode, every in shapes:
            terms, prefix = T.query_terms(query, mode)
            ids = [r["id"] for r in self.best(terms, limit, prefix, every, within, among).select("id", "rank").orderBy("rank").collect()]
            seen = set(kept)
            kept += [i for i in ids if i not in seen]
            if len(ids) >= enough or (mode != "and" and kept):
                break
        kind = self.read("passages").schema["id"].dataType.simpleString()
        return self.spark.createDataFrame([(i, n + 1) for n, i in enumerate(kept)], f"id {kind}, rank int")

    def like(self, query: str, limit: int = 200) -> DataFrame:
        """(id, rank): passages with a word that contains a content token of the query, heaviest first.

        A token has no separators, so it stands inside one term: the dictionary is searched instead of the text.
        """
        tokens = [p for t in re.findall(T.QUERY_TOKEN, query) if t.lower() not in T.STOPWORDS for p, _ in self.probes([t])]
        if not tokens:
            return self.read("passages").select("id", F.lit(None).cast("int").alias("rank")).limit(0)
        wanted = F.lit(False)
        for t in tokens:
            wanted = wanted | F.col("term").contains(t)
        terms = self.vocabulary().where(wanted).select("term")
        bucketed = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows = self.read("postings").join(bucketed, ["bucket", "term"], "left_semi").select(F.explode("posts").alias("p")).select("p.id", "p.weight").distinct()
        kept = rows.orderBy(F.col("weight").desc(), "id").limit(limit)
        return kept.select("id", F.row_number().over(Window.orderBy(F.col("weight").desc(), "id")).alias("rank"))
