"""Packing documents into sequences of a fixed length by dominance reduction and best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most
``capacity`` counts however many documents there are. The driver packs that histogram: sets that
the Martello-Toth criterion proves dominating are fixed for good, what is left goes best fit,
longest first. The plan is a list of patterns with multiplicities; each piece finds its place from
its rank among the pieces of its length, which is counted in two steps so that one frequent length
never meets in one task.

Defined results. A NULL or empty text is the end id alone, one piece of length 1. Repeated rows
are packed each for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, arrow_map, table
from lumenark.llm.encode import STATE, encoder

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, tie bigint"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, behind a first one that takes the remainder."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``tie`` tells pieces apart whose document id repeats."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tail = int(end_id).to_bytes(4, "little")

    def encode(batch):
        enc = encoder(tokenizer, room=400_000, words=400_000)  # words after line ends are looked up one by one
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = enc.encode(text) + tail
            whole = zlib.crc32(raw)
            for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                out.append((doc, k, start, length, zlib.crc32(raw[4 * start: 4 * (start + length)]), whole))
        cols = list(zip(*out))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return arrow_map(rows, encode, PIECE_SCHEMA, keeps=STATE)


class Histogram:
    """Counts by length, with the neighbours that the criterion asks for."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def largest(self, at_most: int) -> int:
        """The largest length present that is no longer than ``at_most``; 0 if none is."""
        at = np.flatnonzero(self.n[: max(at_most, 0) + 1])
        return int(at[-1]) if len(at) else 0

    def above(self, length: int) -> int:
        at = np.flatnonzero(self.n[length + 1:])
        return int(at[0]) + length + 1 if len(at) else 0

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for length in np.flatnonzero(self.n).tolist():
            out += [length] * min(k - len(out), int(self.n[length]))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two present lengths of the largest sum that fits ``room``, the longer as long as may be; (0, 0) if none fits."""
        sizes = np.flatnonzero(self.n)
        partner = np.array([self.largest(min(room - int(s), int(s) - (self.n[s] < 2))) for s in sizes], dtype=np.int64)
        total = np.where(partner > 0, sizes + partner, 0)
        if not len(total) or total.max() == 0:
            return 0, 0
        i = int(np.flatnonzero(total == total.max())[-1])
        return int(sizes[i]), int(partner[i])

    def take(self, lengths: list[int]) -> int:
        """Removes as many copies of a set as there are; returns how many."""
        use = Counter(lengths)
        m = min(int(self.n[s]) // k for s, k in use.items())
        for s, k in use.items():
            self.n[s] -= m * k
        return m


def dominating(h: Histogram, item: int, capacity: int) -> list[int] | None:
    """A set holding ``item`` that dominates every other feasible one, by the Martello-Toth criterion, or None.

    ``item`` is already taken out of ``h``. Each rule stays true while copies of the set are
    removed, so a set may be fixed as often as the counts allow.
    """
    room = capacity - item
    low = h.smallest(3)
    fits = sum(1 for k in range(len(low)) if sum(low[: k + 1]) <= room)
    if fits == 0:
        return [item]
    partner = h.largest(room)
    if fits == 1 or partner == room:
        return [item, partner]
    if fits == 2:
        a, b = h.best_pair(room)
        if partner >= a + b:
            return [item, partner]
        if partner == a:
            above = h.above(b)
            if a == b or not above or item + 2 * above > capacity:
                return [item, a, b]
    return None


def reduce_instance(h: Histogram, capacity: int) -> list[tuple[list[int], int]]:
    """Fixes dominating sets until none is left for any length; the rest stays in ``h``."""
    fixed: list[tuple[list[int], int]] = []
    again = True
    while again:
        again = False
        for item in np.flatnonzero(h.n)[::-1].tolist():
            while h.n[item]:
                h.n[item] -= 1
                found = dominating(h, item, capacity)
                h.n[item] += 1
                if found is None:
                    break
                fixed.append((found, h.take(found)))
                again = True
    return fixed


def best_fit(h: Histogram, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over groups of equal bins."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    for length in np.flatnonzero(h.n)[::-1].tolist():
        left = int(h.n[length])
        h.n[length] = 0
        while left:
            room = min((r for r in groups if r >= length), default=capacity)
            held, m = groups[room].pop() if room in groups else ([], left)
            if room in groups and not groups[room]:
                del groups[room]
            each = room // length
            full = min(m, left // each)
            if full:
                groups.setdefault(room - each * length, []).append((held + [length] * each, full))
                left -= full * each
            if full < m and left:
                groups.setdefault(room - left * length, []).append((held + [length] * left, 1))
                full, left = full + 1, 0
            if held and full < m:
                groups.setdefault(room, []).append((held, m - full))
    return [g for found in groups.values() for g in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, number of such sequences) that hold every piece once."""
    h = Histogram(counts, capacity)
    fixed = reduce_instance(h, capacity)
    return fixed + best_fit(h, capacity)


def slots(patterns: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence, offset): ranks from the first on lie in the sequences from there on."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def place(found: DataFrame, capacity: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    import pyarrow as pa

    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    at = slots(plan(counts, capacity), capacity)
    buckets = max(1, -(-sum(counts.values()) // per_bucket))
    split = found.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "tie", "piece"))
    sizes = split.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "b", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = split.withColumn("inside", inside).join(base, ["length", "b"]).withColumn("rank", F.col("base") + F.col("inside") - 1)
    firsts = {int(s): (int(i), int(j)) for s, i, j in zip(*_runs(at[:, 0]))} if len(at) else {}

    def locate(batch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for s in np.unique(length).tolist():
            mine = length == s
            i, j = firsts[s]
            k = i + np.searchsorted(at[i:j, 1], rank[mine], side="right") - 1
            sequence[mine] = at[k, 2] + rank[mine] - at[k, 1]
            offset[mine] = at[k, 3]
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)],
                                          keep + ["sequence_id", "offset"])

    return arrow_map(ranked, locate, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", rows=10_000)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[starts], starts, np.concatenate([starts[1:], [len(sorted_values)]])


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts, counts and packs documents; one row for each piece."""
    found = Scratch(docs.sparkSession, "pieces").keep(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return place(found, capacity)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
