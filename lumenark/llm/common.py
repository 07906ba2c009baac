"""What several operators share: scratch tables, table reading, the word rule, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.session import shared_dir

#: Fixed by the word rule: what is no digit, ASCII letter or non-ASCII character separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the cluster's shared folder: written once, read many times.

    A written table cuts lineage: a lost executor costs at most the tasks it was running.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bytes_of(self, name: str) -> int:
        """Bytes of a written table, as its file system counts them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; NULL and empty texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def row_key(*columns: str) -> list[Column]:
    """Two hashes that tell rows apart where an id repeats or is NULL."""
    return [F.xxhash64(F.lit(17), *[F.col(c) for c in columns]).alias("k1"), F.hash(F.lit(29), *[F.col(c) for c in columns]).alias("k2")]


WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False  # A-Z are folded, so they belong to words
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"): ord("Z") + 1] += 32


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and each row's offset in them; NULL is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def small_batches(batches, rows: int = 512, size: int = 4 << 20):
    """Arrow batches cut so that each holds few rows and, one long text aside, few bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n


#: What a Python worker keeps between tasks, by name. Workers serve one operator after another, so each drops what others left.
WORKER: dict[str, object] = {}


def release(keeps: str | None) -> None:
    for name in [n for n in WORKER if n != keeps]:
        del WORKER[name]


def arrow_map(df: DataFrame, fn: Callable, schema: str, rows: int = 512, size: int = 4 << 20, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` over small batches; ``fn`` takes a batch and returns one, or None. ``keeps`` names the worker state it uses."""

    def run(batches):
        release(keeps)
        for batch in small_batches(batches, rows, size):
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
