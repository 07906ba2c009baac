"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``length`` consecutive words of a benchmark item, or all words of a shorter one. A
document contains a window where it contains all its word shingles (of ``width`` words) at
consecutive positions. Each corpus shingle that occurs in the benchmark is found once and written;
the counts of these order the shingles of every window by rarity. Exact containment makes a single
shingle necessary, so the prefix of a window is its rarest one: only its places are candidates. The
positional and the length bound drop those whose window would begin before the document or end after
it, and the rest is verified shingle by shingle against the written places.

Shingles are compared as 64-bit hashes, all of a window together.

Defined results. NULL and empty texts, and those without a word, have no words, no hits and the
digest of the empty string. A benchmark item without words has no window; repeated items are one.
Repeated documents each get the same result. An empty benchmark hits nothing. Other columns of
either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import SEPARATORS, Scratch, row_key, spare_names, table, words_of

#: A broadcast of shingle hashes is asked for up to this size of their file (2 million hashes); beyond it they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
KEY = ["k1", "k2"]


def item_windows(items: DataFrame, length: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, win, n): the windows of every item as space-joined words."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))).alias("s"))
    win = F.slice("w", F.col("s") + 1, length)
    return at.select("item_id", F.array_join(win, " ").alias("win"), F.size(win).alias("n")).distinct()


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of each run of ``width`` words, in order."""
    last = F.greatest(F.size(words) - (width - 1), F.lit(0))
    return F.transform(F.slice(words, 1, last), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))


def contained(docs: DataFrame, items: DataFrame, length: int = 13, width: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Every occurrence of a benchmark window: (k1, k2, start, n, win), keyed by ``row_key(doc_id, text)``.

    ``docs`` has doc_id and text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    wins = scratch.keep(item_windows(items, length).select("win", "n").distinct(), "windows")
    parts = wins.select("win", "n", F.least("n", F.lit(width)).alias("k"), F.split("win", " ").alias("w"))
    by_width = [r["k"] for r in parts.select("k").distinct().collect()]  # at most ``width`` values
    if not by_width:
        return wins.select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("start"), "n", "win").limit(0)
    places, needed = None, None
    words = docs.select(*row_key("doc_id", "text"), words_of(F.col("text")).alias("w"))
    for k in sorted(by_width):
        mine = parts.where(F.col("k") == k).select("win", "n", F.posexplode(shingle_hashes(F.col("w"), k)).alias("off", "h"))
        mine = scratch.keep(mine, f"shingles{k}")
        known = scratch.keep(mine.select("h").distinct(), f"known{k}")
        if scratch.bytes_of(f"known{k}") <= BROADCAST_BYTES:
            known = F.broadcast(known)
        runs = words.select(*KEY, F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h"))
        hits = runs.join(known, "h").select(*KEY, "n_words", "pos", F.lit(k).alias("k"), "h")
        needs = mine.withColumn("k", F.lit(k))
        places = hits if places is None else places.unionByName(hits)
        needed = needs if needed is None else needed.unionByName(needs)
    places = scratch.keep(places, "places")
    counts = places.groupBy("k", "h").agg(F.count("*").alias("freq"))
    ordered = needed.join(counts, ["k", "h"], "left")
    rarest = F.min_by(F.struct("h", "off"), F.struct(F.col("freq"), F.col("off")))
    prefix = ordered.groupBy("win", "n", "k").agg(F.count("freq").alias("met"), F.count("*").alias("all"), rarest.alias("p")) \
        .where(F.col("met") == F.col("all")).select("win", "n", "k", F.col("p.h").alias("h"), F.col("p.off").alias("off"), "all")
    start = F.col("pos") - F.col("off")
    tried = places.join(prefix, ["k", "h"]).where((start >= 0) & (start + F.col("n") <= F.col("n_words"))) \
        .select(*KEY, start.alias("start"), "n", "k", "win", "all").distinct()
    asked = tried.join(needed.select("win", "k", "off", "h"), ["win", "k"]).withColumn("pos", F.col("start") + F.col("off"))
    met = asked.join(places.select(*KEY, "k", "pos", "h"), [*KEY, "k", "pos", "h"])
    return met.groupBy(*KEY, "start", "n", "win", "all").agg(F.size(F.collect_set("off")).alias("found")) \
        .where(F.col("found") == F.col("all")).select(*KEY, "start", "n", "win")


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, k1, k2, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    Contaminated: hit words are at least one in ``share``.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(contained(rows, items, length, scratch=scratch), "found")
    end = F.col("start") + F.col("n")
    reach = F.max("end").over(Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select(*KEY, "start", end.alias("end")).distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
    hit = spans.groupBy(*KEY).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit"))
    owners = item_windows(items, length).select("item_id", "win")
    whose = found.select(*KEY, "win").distinct().join(owners, "win").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    counted = rows.select("doc_id", *row_key("doc_id", "text"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(hit.join(whose, KEY, "full"), KEY, "left").select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids")) \
        .withColumn("n_items", F.size("item_ids").cast("bigint")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns unchanged."""
    names = spare_names(docs, "bad1", "bad2")
    bad = contamination(docs, items, **options).where("contaminated").select("k1", "k2").distinct().toDF(*names)
    row = row_key_of(docs)
    return docs.join(bad, (row[0] == F.col(names[0])) & (row[1] == F.col(names[1])), "left_anti")


def row_key_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The key of ``contamination`` computed on a table with further columns."""
    a, b = docs[id_col].cast("bigint"), docs[text_col].cast("string")
    return [F.xxhash64(F.lit(17), a, b), F.hash(F.lit(29), a, b)]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}') IF x <> ''] AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}') IF x <> ''] AS w
  FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM bs
), sizes AS (
  SELECT DISTINCT n FROM bw
), ds AS (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n
), f AS (
  SELECT ds.doc_id, ds.s, ds.n, bw.item_id FROM ds JOIN bw ON ds.n = bw.n AND array_to_string(ds.w[ds.s + 1 : ds.s + ds.n], ' ') = bw.win
), spots AS (
  SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM f) AS t
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM spots GROUP BY doc_id
), who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) AS t GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN who ON d.doc_id = who.doc_id
"""
