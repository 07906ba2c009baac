"""Token-ID output: one Parquet row per document, its ids a list column.

Layout. Rows lie in ascending id order over files whose names sort alike. ``ids`` is
dictionary-encoded (a vocabulary's ids pack into 16 bits and fewer), ids and offsets are
delta-encoded, all pages are compressed. Row groups and pages are small enough that the page
index (minima and maxima of each page) lets a reader fetch a few documents, or only the metadata
columns, without the rest of the file.

Defined results. A NULL or empty text has the end id alone. A NULL id sorts first. Rows with one
id keep their own rows, ordered by a hash of the text. An empty table gives an empty file set.
Columns other than the id and the text are neither read nor written, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import Scratch, arrow_map, table
from lumenark.llm.encode import STATE, encoder

FILE_SCHEMA = "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>"
#: Row groups of 32 MB and pages of 256 KB or 500 documents; ids by dictionary, positions by delta.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 options: dict | None = None) -> None:
    """Encodes ``text_col`` with the vocabulary file ``tokenizer`` and writes the token table to ``path``."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    tail = int(end_id).to_bytes(4, "little")
    state: dict = {}

    def encode(batch):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key = TaskContext.get().taskAttemptId()
        if state.get("task") != key:
            state.update(task=key, at=0)
        ids, ends = encoder(tokenizer).encode_column(batch.column("text"), tail)
        at = state["at"] + ends[:-1]
        state["at"] += int(ends[-1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(at), pa.array(np.diff(ends)),
                                           pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4")))], ["doc_id", "part", "at", "n_tokens", "ids"])

    arrow_map(ordered, encode, FILE_SCHEMA, rows=4096, size=8 << 20, keeps=STATE).write.options(**{**FILE_OPTIONS, **(options or {})}).mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A token table with ``start``, the ids of all documents before each.

    Only what is asked for is read: ``where`` on ``doc_id`` prunes row groups and pages, and
    without ``ids`` in ``columns`` the token pages stay untouched.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return with_start(rows if where is None else rows.where(where), spark, path).select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # One row for each task that wrote a file: some thousands at most, whatever the corpus.
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("at"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers, from the files."""
    import pyarrow as pa

    def crc(batch):
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "at", "n_tokens")] + [pa.array(sums, type=pa.int64())],
                                          ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    out = arrow_map(rows, crc, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return with_start(out, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").path("ids")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return digests(spark, path)
