"""Line deduplication over a corpus: hashes in range order, first occurrences streamed, run-length keep bitmaps.

A line's key is the line without white space at its ends, A-Z folded. Every key of ``min_chars``
code points or more becomes one row (hash, document, position). The rows are dealt by ranges of the
hash and sorted within a range by hash, document and position, so the rows of one key stream by and
the first of them names the document that keeps the line. Of the text nothing else is shuffled:
what comes back is a keep bitmap for each document that loses lines, run-length coded.

Hot keys. A key may hold a third of all lines. The most frequent ranges of hashes are counted first
(65,536 counters), and within the crowded ones the keys themselves: at most ``4096`` keys can hold
more than ``1 / 4096`` of all lines, so this table is broadcast whatever the corpus. A hot key's
least document is an aggregate; its rows are settled where they lie and never meet.

Defined results. A NULL or empty text is one empty line. Rows that share an id are one document, so
repeated rows keep and lose the same lines; a NULL id is one document that comes after all others.
Lines of too short keys stay. An empty table gives no rows. Other columns are neither read nor
changed, whatever their names. Keys are compared as two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import LOWER, UPPER, Scratch, ascii_lower, spare_names, table

#: Fixed by the line rule: white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: At most so many keys can hold more than one part in so many of all lines.
HOT_KEYS = 4096
#: A key of fewer lines never counts as hot.
HOT_ROWS = 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line whose key has ``min_chars`` code points or more."""
    lines = rows.select("doc_id", "th", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(71), "key").alias("h2"))


def hot_keys(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, keeper) of the keys that hold more than ``1 / HOT_KEYS`` of a written table of lines, at most ``HOT_KEYS`` rows."""
    crowd = F.shiftright("h1", 48)
    counts = scratch.keep(lines.groupBy(crowd.alias("crowd")).agg(F.count("*").alias("n")), "crowds")
    least = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    crowded = counts.where(F.col("n") > least).select("crowd")
    inside = lines.withColumn("crowd", crowd).join(F.broadcast(crowded), "crowd", "left_semi")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    keys = inside.groupBy("h1", "h2").agg(F.count("*").alias("n"), keeper.alias("keeper")).where(F.col("n") > least)
    return scratch.keep(keys.select("h1", "h2", "keeper"), "hot")


def later_lines(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc_id, th, pos) of the lines whose key stands in a document before."""
    dealt = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    settled = dealt.where("keeper IS NOT NULL").where(~F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")))
    ranged = dealt.where("keeper IS NULL").select("h1", "h2", "doc_id", "pos", "th").repartitionByRange("h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("first", F.first("doc_id").over(stream)).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return settled.select("doc_id", "th", "pos").unionByName(seen.select("doc_id", "th", "pos"))


def run_lengths(positions: Column) -> Column:
    """Sorted distinct positions of dropped lines as lengths of runs kept, dropped, kept, dropped ...; what follows is kept."""
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) < p - 1))
    ends = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i + 1) > p + 1, F.lit(True)))
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"), F.concat(F.array(F.lit(-1)), ends).alias("before"))
    real = F.filter(spans, lambda x: x["s"].isNotNull())
    return F.flatten(F.transform(real, lambda x: F.array(x["s"] - x["before"] - 1, x["e"] - x["s"] + 1)))


def bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that loses lines: doc_id, th (hash of its text), n_dropped and ``keep``, its run-length keep bitmap."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = scratch.keep(line_hashes(rows.withColumn("th", F.xxhash64("text")), min_chars), "lines")
    later = later_lines(lines, hot_keys(lines, scratch))
    # Written, so that the sorted positions are a column that the run lengths read, not an expression evaluated for each of them.
    dropped = scratch.keep(later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "dropped")
    return dropped.select("doc_id", "th", F.size("positions").cast("bigint").alias("n_dropped"), run_lengths(F.col("positions")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that a bitmap drops; all of it where there is none."""
    flags = F.flatten(F.transform(keep, lambda n, k: F.array_repeat(k % 2 == 0, n)))
    left = F.zip_with(lines_of(text), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))


def deduplicate(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines dropped from their texts; a text that loses no line stays as it is, NULL included."""
    d, h, n, keep = spare_names(docs, "doc", "th", "n", "keep")
    found = bitmaps(docs, min_chars, id_col, text_col).toDF(d, h, n, keep)
    text = F.col(text_col).cast("string")
    joined = docs.join(found, docs[id_col].cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    changed = F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(kept_text(text, F.col(keep)))
    return joined.withColumn(text_col, changed).select(*docs.columns)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bitmaps(docs).toDF("d", "h", "n", "keep")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left").select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH l AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) AS t
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT k.*, o.keeper IS NOT NULL AND k.doc_id <> o.keeper AS dropped FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
