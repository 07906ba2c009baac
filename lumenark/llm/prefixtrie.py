"""The prefix trie of conversations by truncation peeling.

Every conversation is a path: a running hash of its turns for each depth. The trie is never built
from the root. Peeling starts at the largest depth: the conversations that end there are the first
nodes; their last turn is stripped, they meet the conversations that end one turn earlier, and all
are grouped by path again. So each step discovers the nodes of one depth and finishes their
aggregates at once (members, children, leaves, tokens saved), from sums that the children carried
up. A step is one grouping with map-side sums, so a first turn that a third of all conversations
share costs one row a task. Each level is written, which cuts lineage. Where a conversation has no
company, its turns are stripped all at once down to the first node that it shares, so there are as
many steps as the deepest shared node has turns, however long single conversations are.

The ids that end in a node are hashed in order without meeting as one list: blocks of 4,096
consecutive ids are joined to strings first, then the blocks of a node stream through one digest.

Defined results. NULL role or text is empty. Turns are ordered by ``turn``, NULL first; turns that
tie by role, the first 64 characters of the text, and hash, so repeated rows stay repeated turns.
Rows without a conversation id belong to none. A conversation without turns ends in the root. An
empty table has no nodes. Other columns are not read, whatever their names. Turns are compared as
two 64-bit hashes. A conversation's own path, 24 bytes a turn, is one row, as a document is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, table

#: Ids of a block are consecutive, so a block holds so many at most.
BLOCK_BITS = 12


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, chars): the turns of (conv_id, turn, role, text) in order, from 1, as hashes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(43), text, role).alias("h2"), F.length(text).alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "h1", "h2")
    return turns.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "h1", "h2", "chars")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of turns (conv_id, part, pos, h1, h2, chars) in order of part and position.

    ``path[d]`` names the prefix of d turns by a running hash and has the code points of its texts.
    A row with ``part`` -1 for each conversation stands for the empty prefix.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("d", F.row_number().over(order) - 1)
    root = F.col("d") == 0
    x1 = F.when(root, F.lit(0)).otherwise(F.xxhash64("d", "h1", "h2"))
    x2 = F.when(root, F.lit(0)).otherwise(F.xxhash64("h2", "d", "h1"))
    running = placed.select("conv_id", "d", F.sum("chars").over(so_far).alias("total"), F.bit_xor(x1).over(so_far).alias("p1"), F.bit_xor(x2).over(so_far).alias("p2"))
    steps = F.array_sort(F.collect_list(F.struct("d", "p1", "p2", "total")))
    path = F.transform(steps, lambda s: F.struct(s["p1"].alias("p1"), s["p2"].alias("p2"), s["total"].alias("total")))
    return running.groupBy("conv_id").agg(path.alias("path"))


NODE = "depth int, p1 bigint, p2 bigint, above1 bigint, above2 bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _named(depth: Column) -> list[Column]:
    """Depth, name and parent's name of the node at ``depth`` of a path; the root has its own name twice."""
    at, above = F.get("path", depth), F.get("path", F.greatest(depth - 1, F.lit(0)))
    return [depth.cast("int").alias("depth"), at["p1"].alias("p1"), at["p2"].alias("p2"), above["p1"].alias("above1"), above["p2"].alias("above2")]


def tails(chains: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries): the nodes that a single path goes through, and what is left of every path above them.

    Copies of a conversation are one path. Where a path is alone, nothing can meet it, so all turns down
    to the first shared node are stripped at once; ``entries`` (at, path, conv_id, n_convs, child, leaves,
    saved) take part in the peeling from depth ``at`` on. So a conversation of many turns costs no steps.
    """
    merged = scratch.keep(chains.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "merged")
    steps = merged.select("conv_id", F.posexplode("path").alias("d", "x")).groupBy("d", "x.p1", "x.p2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    alone = steps.where("n = 1").groupBy("conv_id").agg(F.min("d").alias("first"))
    depth, total = F.size("path") - 1, lambda d: F.get("path", d)["total"]
    split = scratch.keep(merged.join(alone, "conv_id", "left").withColumn("depth", depth).withColumn("first", F.coalesce("first", F.col("depth") + 1)), "split")
    d = F.col("d")
    one = F.lit(1).cast("bigint")
    nodes = split.where("first <= depth").withColumn("d", F.explode(F.sequence("first", "depth"))).select(
        *_named(d), "conv_id", "n_convs", (d < F.col("depth")).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        ((F.col("n_convs") - 1) * (total(F.col("depth")) - F.when(d > 0, total(d - 1)).otherwise(0))).alias("saved_tokens"))
    cut = F.col("first") <= F.col("depth")
    entries = split.where("first > 0").select(
        (F.col("first") - 1).alias("at"), F.slice("path", F.lit(1), F.col("first")).alias("path"), "conv_id", "n_convs", cut.cast("bigint").alias("child"),
        cut.cast("bigint").alias("leaves"), F.when(cut, (F.col("n_convs") - 1) * (total(F.col("depth")) - total(F.col("first") - 1))).otherwise(0).cast("bigint").alias("saved"))
    return nodes, entries


def peel(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of written paths."""
    spark = chains.sparkSession
    nodes, entries = tails(chains, scratch)
    entries.write.partitionBy("at").mode("overwrite").parquet(scratch.path("entries"))
    entries = spark.read.schema(entries.schema).parquet(scratch.path("entries"))
    deepest = entries.agg(F.max("at")).first()[0]
    survivors = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = entries.where(F.col("at") == depth).drop("at")
        if survivors is not None:
            level = level.unionByName(survivors.select(
                F.slice("path", 1, depth + 1).alias("path"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("child"),
                F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        grouped = level.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        last = F.get("path", F.lit(depth))["total"] - (F.get("path", F.lit(depth - 1))["total"] if depth else 0)
        met = grouped.select(
            "path", *_named(F.lit(depth)), "conv_id", "n_convs", "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"))
        survivors = scratch.keep(met, f"levels/level={depth}")
    if survivors is None:
        return nodes
    return nodes.unionByName(spark.read.schema(NODE).parquet(scratch.path("levels")).select(*nodes.columns))


def end_digests(chains: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): digest of the ids, ascending and joined by commas, of the conversations that end in a node."""
    import pyarrow as pa

    last = F.element_at("path", -1)
    ended = chains.select((F.size("path") - 1).alias("depth"), last["p1"].alias("p1"), last["p2"].alias("p2"), "conv_id", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = ended.groupBy("depth", "p1", "p2", "block").agg(ids.alias("ids"))
    streamed = blocks.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "block")
    schema = "depth int, p1 bigint, p2 bigint, ends_sha256 string"

    def digest(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for d, p1, p2, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "ids"))):
                if (d, p1, p2) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, p1, p2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _rows(done)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    def _rows(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                                          ["depth", "p1", "p2", "ends_sha256"])

    return streamed.select("depth", "p1", "p2", "ids").mapInArrow(digest, schema)


def trie(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each node of the trie of turns (conv_id, part, pos, h1, h2, chars), as ``paths`` takes them."""
    scratch = scratch or Scratch(turns.sparkSession, "prefix-trie")
    chains = scratch.keep(paths(turns), "paths")
    nodes = peel(chains, scratch)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("above1"), F.col("p2").alias("above2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(above, ["depth", "above1", "above2"], "left").join(end_digests(chains), ["depth", "p1", "p2"], "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def marked(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns with a row for the empty prefix of each conversation, those without turns included."""
    none = [F.lit(0).cast(t).alias(c) for c, t in (("pos", "int"), ("h1", "bigint"), ("h2", "bigint"), ("chars", "int"))]
    return turns.unionByName(convs.select("conv_id", F.lit(-1).alias("part"), *none))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations of a table (conv_id, turn, role, text)."""
    turns = numbered_turns(rows).withColumn("part", F.lit(0))
    return trie(marked(turns, turns.select("conv_id").distinct()))


def shared_turns(conv_id: Column) -> Column:
    """Turns that a rebuilt conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced by those of the first conversation of its hundred, ready for ``trie``."""
    h = shared_turns(F.col("conv_id"))
    convs = turns.select("conv_id").distinct()
    wants = convs.select(F.col("conv_id").alias("want"), (F.col("conv_id") - F.col("conv_id") % 100).alias("conv_id"), h.alias("h")).where("h > 0")
    head = turns.where("pos <= 5").join(wants, "conv_id").where("pos <= h").select(F.col("want").alias("conv_id"), F.lit(0).alias("part"), "pos", "h1", "h2", "chars")
    tail = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", "h1", "h2", "chars")
    return marked(head.unionByName(tail), convs)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "prefix-trie")
    turns = scratch.keep(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return trie(rebuilt(turns), scratch)


#: The remainder of CRC-32 bit by bit: 4294967295 and 3988292384 are fixed by its definition.
OP11_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) AS r
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], range(0, 8 * length(s))), lambda x, i:
      xor(((CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(s, i // 8 + 1, 1))) ELSE x END) >> 1),
          CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(s, i // 8 + 1, 1))) ELSE x END) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t) AS ids
), r AS (
  SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, list(md5(role) || md5(text)) OVER w AS key
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM c
), lengths AS (
  SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id
), nodes AS (
  SELECT p.d, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (p.d = last), '')) AS ends_sha256
  FROM p JOIN lengths ON p.conv_id = lengths.conv_id GROUP BY p.d, p.key
), up AS (
  SELECT nodes.*, key[1 : greatest(d - 1, 0)] AS above FROM nodes
), kids AS (
  SELECT d - 1 AS d, above AS key, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT p.d, p.key, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((up.n_convs - 1) * up.chars) AS saved
  FROM up LEFT JOIN kids ON kids.d = up.d AND kids.key = up.key JOIN p ON p.conv_id = up.conv_id AND p.d <= up.d
  GROUP BY p.d, p.key
)
SELECT up.conv_id, up.d AS depth, parent.conv_id AS parent_conv_id, up.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, up.ends_sha256
FROM up LEFT JOIN kids ON kids.d = up.d AND kids.key = up.key
JOIN sums ON sums.d = up.d AND sums.key = up.key
LEFT JOIN nodes AS parent ON up.d > 0 AND parent.d = up.d - 1 AND parent.key = up.above
"""
