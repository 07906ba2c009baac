"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``depth`` nearest pivots in order. Every vector is posted in the
inverted files of these pivots with its rank there. A query runs through the files of its own ``visits``
nearest pivots and adds up, for each posting met, how far the two ranks lie inside the depth; a pivot missing
on one side counts as ranked at ``depth``. That sum tells directions apart; how far it lies above the
block's mean, times the vector's length, stands for the inner product, and the ``share`` of the
vectors where it is largest is ranked again by the exact inner product in double precision.

Scale. Vectors are dealt over blocks by a hash of their id, so equal or crowded vectors spread; a
block holds the inverted files of its own vectors. Query blocks meet index blocks, each pair one
bounded task that returns the best of every query; the merge ranks these few rows a query.

Pivots are chosen from at most ``sample`` vectors (those of least hash), each next one farthest from
those before, so that a crowded spot gives one pivot. Every vector is indexed. How large a share has to
be ranked exactly is measured on some of the queries against all rows. Recall is in the README.

Defined results. Vectors that are NULL, zero, hold a NULL or non-finite component, or have another
number of components than most, take no part, nor do rows without an id. Rows that share an id are
one vector, the one of least hash. Ties in score go to the smaller id. Fewer candidates than asked
for are all returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, arrow_map, table


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one double vector per id, of the commonest dimension."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite).where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), F.hash("v"))).alias("v"))


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Farthest-first pivots out of a bounded sample of ``rows`` (id, v)."""
    found = rows.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in found], dtype=np.float64)
    if not len(x):
        return x.reshape(0, 0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    picked, nearest = [0], unit @ unit[0]
    while len(picked) < min(pivots, len(x)):
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-12:
            break
        picked.append(k)
        nearest = np.maximum(nearest, unit @ unit[k])
    return unit[picked]


def permutations(v: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int16)


def build(rows: DataFrame, pivots: np.ndarray, depth: int) -> DataFrame:
    """Index rows (id, v, perm)."""
    import pyarrow as pa

    def post(batch):
        v = _matrix(batch.column("v"))
        perm = permutations(v, pivots, depth)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([p.tobytes() for p in perm], type=pa.binary())], ["id", "v", "perm"])

    return arrow_map(rows, post, "id bigint, v array<double>, perm binary", rows=4096, size=32 << 20)


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class InvertedFiles:
    """Postings of a block of vectors: for each pivot the positions that rank it, and the weight of that rank."""

    def __init__(self, perm: np.ndarray, pivots: int):
        n, self.depth = perm.shape
        pivot, rank = perm.ravel(), np.tile(np.arange(self.depth, dtype=np.int16), n)
        order = np.argsort(pivot, kind="stable")
        self.position = np.repeat(np.arange(n), self.depth)[order]
        self.rank = rank[order]
        self.start = np.searchsorted(pivot[order], np.arange(pivots + 1))
        self.n = n

    def nearness(self, perm: np.ndarray) -> np.ndarray:
        """``depth - max(rank of query, rank of vector)`` summed over shared pivots; footrule distance is a constant minus twice this."""
        out = np.zeros(self.n, dtype=np.int32)
        for rank, pivot in enumerate(perm.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            out[self.position[a:b]] += self.depth - np.maximum(self.rank[a:b], rank)
        return out


def _blocked(index: DataFrame, block: int) -> tuple[Column, int]:
    blocks = max(1, -(-index.count() // block))
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), blocks


def needed_share(index: DataFrame, queries: DataFrame, n_pivots: int, visits: int, top: int, block: int, recall: float, trials: int) -> float:
    """The share of each block that holds ``recall`` of the true neighbours of ``trials`` queries, those of least hash.

    Every row of the index is compared with them exactly, which is work in proportion to the rows.
    """
    import pyarrow as pa

    asked = queries.orderBy(F.xxhash64(F.lit(13), "id"), "id").limit(trials).select("id", "v", "perm").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, vectors, perms = asked.column("id").to_pylist(), _matrix(asked.column("v")), _perms(asked)
    here, _ = _blocked(index, block)

    def place(t):
        v, mine = _matrix(t.column("v")), t.column("id").to_numpy()
        files, length = InvertedFiles(_perms(t), n_pivots), np.sqrt((v * v).sum(axis=1))
        out = []
        for query, q, perm in zip(ids, vectors, perms):
            nearness = files.nearness(perm[:visits])
            order = (nearness - nearness.mean()) * length
            score = np.where(mine == query, -np.inf, v @ q)
            best = np.argsort(-score, kind="stable")[:top]
            best = best[np.isfinite(score[best])]
            at = np.searchsorted(np.sort(-order), -order[best], side="right") / len(mine)
            out.append((np.full(len(best), query), score[best], at))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "score", "at"])

    found = index.groupBy(here.alias("b")).applyInArrow(place, "query_id bigint, score double, at double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    needed = found.withColumn("r", rank).where(F.col("r") <= top).agg(F.percentile("at", recall)).first()[0]
    return 1.0 if needed is None else min(1.0, 1.1 * needed)


def search(index: DataFrame, queries: DataFrame, n_pivots: int, visits: int, top: int, share: float, block: int, query_block: int) -> DataFrame:
    """The best ``top`` of each query (id, v, perm): (query_id, vec_id, score, rank)."""
    import pyarrow as pa

    here, blocks = _blocked(index, block)
    query_blocks = max(1, -(-queries.count() // query_block))
    there = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(query_blocks)).cast("int")
    left = index.select(here.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "id", "v", "perm")
    right = queries.select(there.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "v", "perm")
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(vectors, asked):
        if not vectors.num_rows or not asked.num_rows:
            return kinds.empty_table()
        vectors = vectors.sort_by("id")
        ids, v = vectors.column("id").to_numpy(), _matrix(vectors.column("v"))
        files, length = InvertedFiles(_perms(vectors), n_pivots), np.sqrt((v * v).sum(axis=1))
        keep = min(len(ids), max(10 * top, int(np.ceil(share * len(ids)))) + 1)
        out = []
        for query, q, perm in zip(asked.column("id").to_pylist(), _matrix(asked.column("v")), _perms(asked)):
            order = files.nearness(perm[:visits])
            order = (order - order.mean()) * length
            least = np.partition(order, len(ids) - keep)[len(ids) - keep]
            above = np.flatnonzero(order > least)
            near = np.concatenate([above, np.flatnonzero(order == least)[: keep - len(above)]])  # ties to the smaller id
            near = near[ids[near] != query]
            score = (v[near] * q).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:top]
            out.append((np.full(len(best), query), ids[near][best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=kinds)

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _perms(t) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("perm").to_pylist()), dtype=np.int16).reshape(t.num_rows, -1)


def nearest(vectors: DataFrame, asks: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 1024, depth: int = 128, visits: int = 64,
            share: float | None = None, recall: float = 0.97, trials: int = 32, sample: int = 4096, block: int = 16_384, query_block: int = 1024) -> DataFrame:
    """For every vector whose ``id`` satisfies ``asks``, its ``top`` nearest others by inner product.

    ``share`` is the part of the index ranked exactly for a query, at least ten times ``top`` of each
    block: higher is slower and finds more. Without one it is what ``recall`` took for ``trials`` of the
    queries, measured on all rows, so it grows with the dimension as far as the vectors call for it.
    ``visits`` is how many of its nearest pivots' files a query reads.
    """
    scratch = Scratch(vectors.sparkSession, "pivots")
    rows = scratch.keep(usable(vectors, id_col, vector_col), "rows")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("v") == sizes["d"])
    found = choose_pivots(rows, pivots, sample)
    index = scratch.keep(build(rows, found, min(depth, len(found))), "index")
    if share is None:
        share = needed_share(index, index.where(asks), len(found), visits, top, block, recall, trials)
    return search(index, index.where(asks), len(found), visits, top, share, block, query_block)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
