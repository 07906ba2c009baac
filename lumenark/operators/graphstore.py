"""The property graph as stored tables: links by node, node rows, degrees; grown and updated by batches of deltas.

Every edge lies in ``links`` twice, once under each end, in a directory by hash of that end and sorted by
it inside. So the surroundings of some nodes are read from their own directories, without a shuffle of
the edge table, and a join on few nodes prunes the others at run time. ``nodes`` and ``degrees`` are
dealt alike. A batch of edges adds to the weight of those that exist and to the degrees of their ends;
nothing that was written is read or rewritten for it. Reads add up the batches of the nodes they touch.

Defined results. A node that comes again keeps its first row. Edges of one (src, dst, rel) are one edge:
weights add up, the least ``ref`` stays. Edges from a node to itself are dropped. Writing a batch again
replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .graph import FANOUT, accumulate_edges

BUCKETS = 32
LINKS = "anchor string, other string, forward boolean, rel string, weight double, ref string, batch int, bucket int"
NODES = "id string, kind string, label string, sub string, meta map<string,string>, batch int, bucket int"
DEGREES = "id string, weight double, batch int, bucket int"


def bucket_of(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


class StoredGraph:
    """A graph in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str, key: str, batch: int) -> None:
        df.withColumn("bucket", bucket_of(F.col(key))).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key) \
            .write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def append(self, nodes: DataFrame | None, edges: DataFrame | None, batch: int) -> None:
        """Adds nodes (id, kind, label, sub, meta) and edge deltas (src, dst, rel, weight, ref)."""
        if edges is not None:
            e = written(accumulate_edges(edges), "edges")  # dealing rows by range reads them twice
            ends = F.explode(F.array(F.struct(F.col("src").alias("anchor"), F.col("dst").alias("other"), F.lit(True).alias("forward")),
                                     F.struct(F.col("dst").alias("anchor"), F.col("src").alias("other"), F.lit(False).alias("forward"))))
            self._write(e.select(ends.alias("x"), "rel", F.col("weight").cast("double").alias("weight"), "ref")
                        .select("x.anchor", "x.other", "x.forward", "rel", "weight", "ref"), "links", "anchor", batch)
            mine = self._read("links", LINKS).where(F.col("batch") == batch)
            self._write(mine.groupBy(F.col("anchor").alias("id")).agg(F.sum("weight").alias("weight")), "degrees", "id", batch)
        if nodes is not None:
            self._write(nodes.select("id", "kind", "label", "sub", "meta"), "nodes", "id", batch)

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _batches(self, table: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len([s for s in fs.listStatus(path) if s.isDirectory()]) if fs.exists(path) else 0

    # ---- tables ----------------------------------------------------------------------

    def _merged(self, links: DataFrame) -> DataFrame:
        if self._batches("links") < 2:
            return links.drop("batch", "bucket")
        return links.groupBy("anchor", "other", "forward", "rel").agg(F.sum("weight").alias("weight"), F.min("ref").alias("ref"))

    def edges(self) -> DataFrame:
        """(src, dst, rel, weight, ref)."""
        return self._merged(self._read("links", LINKS).where("forward")).select(F.col("anchor").alias("src"), F.col("other").alias("dst"), "rel", "weight", "ref")

    def links(self, node: str) -> DataFrame:
        """Links of one node: one directory is opened."""
        key = F.lit(node)
        return self._merged(self._read("links", LINKS).where((F.col("bucket") == bucket_of(key)) & (F.col("anchor") == key)))

    def links_of(self, ids: DataFrame) -> DataFrame:
        """Links of the nodes in ``ids`` (id); only their directories are opened."""
        wanted = ids.select(F.col("id").alias("anchor")).distinct().withColumn("bucket", bucket_of(F.col("anchor")))
        return self._merged(self._read("links", LINKS).join(wanted, ["bucket", "anchor"], "left_semi"))

    def nodes(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, kind, label, sub, weight, meta) of the nodes in ``ids``, or of all; ``weight`` is the degree."""
        rows, sums = self._read("nodes", NODES), self._read("degrees", DEGREES)
        if ids is not None:
            wanted = ids.select("id").distinct().withColumn("bucket", bucket_of(F.col("id")))
            rows, sums = (t.join(wanted, ["bucket", "id"], "left_semi") for t in (rows, sums))
        if self._batches("nodes") > 1:
            row = F.struct("kind", "label", "sub", "meta")
            rows = rows.groupBy("id").agg(F.min_by(row, "batch").alias("n")).select("id", "n.*")
        if self._batches("degrees") > 1:
            sums = sums.groupBy("id").agg(F.sum("weight").alias("weight"))
        return rows.join(sums.select("id", "weight"), "id", "left").select("id", "kind", "label", "sub", F.coalesce("weight", F.lit(0.0)).alias("weight"), "meta")

    # ---- reads -----------------------------------------------------------------------

    def among(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends in ``ids``, read from the directories of ``ids``."""
        ids = ids.select("id").distinct()
        own = self.links_of(ids).where("forward").select(F.col("anchor").alias("src"), F.col("other").alias("dst"), "rel", "weight", "ref")
        return own.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel", "weight", "ref")

    def neighbors(self, node: str, limit: int = FANOUT, kinds: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ring, edges among ring and centre, one row (total, truncated))."""
        limit = max(1, limit)
        own = self.links(node).select(F.col("other").alias("id"), "rel", "weight", "ref")
        found = own.join(self.nodes(own).select("id", "kind", "label", "sub"), "id")
        if kinds:
            found = found.where(F.col("kind").isin(*kinds))
        ring = found.orderBy(F.col("weight").desc(), "id", "rel").limit(limit)
        centre = self.spark.createDataFrame([(node,)], "id string")
        total = found.agg(F.count("*").alias("total")).withColumn("truncated", F.greatest(F.lit(0), F.col("total") - limit))
        return ring, self.among(ring.select("id").unionByName(centre)), total

    def _strongest(self, ids: DataFrame, n: int) -> DataFrame:
        w = Window.partitionBy("anchor").orderBy(F.col("weight").desc(), F.col("other").asc(), F.col("rel").asc())
        return self.links_of(ids).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(F.col("other").alias("id"))

    def overview(self, limit: int = 16, per_hub: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hubs, ids shown, edges among them): the biggest hubs by stored degree, with a few entities each."""
        hubs = self.nodes().where(F.col("kind") != "video").orderBy(F.col("weight").desc(), "id").limit(max(1, limit))
        hubs = cut_lineage(hubs)  # ``limit`` rows, read by all that follows
        ids = hubs.select("id").union(self._strongest(hubs, per_hub)).distinct()
        return hubs, ids, self.among(ids)

    def from_keys(self, keys: DataFrame, limit: int = 24, per_entity: int = 5) -> tuple[DataFrame, DataFrame]:
        """(ids, edges among them) for a set of entities and their strongest links."""
        v = keys.select(F.concat(F.lit("v:"), F.col("entity_key").cast("string")).alias("id")).distinct().orderBy("id").limit(max(1, limit))
        v = cut_lineage(v)
        ids = v.union(self._strongest(v, per_entity)).distinct()
        ids = ids.join(self.nodes(ids).select("id"), "id", "left_semi")
        return ids, self.among(ids)

    def shortest_path(self, a: str, b: str, rounds: int | None = None) -> DataFrame | None:
        """(pos, id) along a shortest chain of links; None if there is none, or none within ``rounds`` if given.

        Both ends grow breadth-first, the smaller frontier first, and each round opens the directories of
        its frontier only. The chain is read back in one job, a join of each depth with the one below it.
        """
        if a == b:
            return self.spark.createDataFrame([(0, a)], "pos int, id string")
        side = {s: {"seen": [cut_lineage(self.spark.createDataFrame([(n, None)], "id string, parent string"))], "n": 1} for s, n in (("a", a), ("b", b))}
        for _ in range(rounds) if rounds is not None else count():
            me, other = ("a", "b") if side["a"]["n"] <= side["b"]["n"] else ("b", "a")
            mine, front = side[me]["seen"], side[me]["seen"][-1]
            grown = self.links_of(front).groupBy(F.col("other").alias("id")).agg(F.min("anchor").alias("parent"))
            for earlier in mine[-2:]:  # links go both ways, so a node seen longer ago cannot be met again
                grown = grown.join(earlier.select("id"), "id", "left_anti")
            grown = cut_lineage(grown)
            side[me]["n"] = grown.count()
            if side[me]["n"] == 0:
                return None
            mine.append(grown)
            seen = side[other]["seen"]
            meet = grown.join(_at_depths(seen), "id").orderBy("depth", "id").select("id", "depth").first()
            if meet is not None:
                up, down = (len(mine) - 1, meet["depth"]) if me == "a" else (meet["depth"], len(mine) - 1)
                first = self._chain(side["a"]["seen"][: up + 1], meet["id"])
                second = self._chain(side["b"]["seen"][: down + 1], meet["id"])
                full = first.select((F.lit(up) - F.col("back")).alias("pos"), "id").unionByName(
                    second.where("back > 0").select((F.lit(up) + F.col("back")).alias("pos"), "id"))
                return full.select(F.col("pos").cast("int").alias("pos"), "id")
        return None

    def _chain(self, seen: Sequence[DataFrame], node: str) -> DataFrame:
        """(back, id): ``node`` of the last of ``seen`` and its parents up to the first."""
        at = self.spark.createDataFrame([(node,)], "id string")
        out = at.select(F.lit(0).alias("back"), "id")
        for back, rows in enumerate(reversed(list(seen[1:])), start=1):
            at = rows.join(F.broadcast(at), "id").select(F.col("parent").alias("id"))  # one row
            out = out.unionByName(at.select(F.lit(back).alias("back"), "id"))
        return out


def _at_depths(seen: Sequence[DataFrame]) -> DataFrame:
    out = None
    for depth, rows in enumerate(seen):
        part = rows.select("id", F.lit(depth).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out
