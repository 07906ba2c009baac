"""Structured Streaming: deduplicated ingest, windows, sessions, routing, the item state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import START, STALE_S, step
from ..operators.merge import enrich, insert_or_ignore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore"


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def classify(name: Column) -> Column:
    """Route of a message by its document name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (F.when(low == "", "no_document").when(low.rlike(r"\.jsonl\.gz$"), "shard").when(low.rlike(r"manifest.*\.json$"), "asset")
            .when(low.rlike(r"\.(zst|part\d+|db)$"), "bundle").otherwise("uninteresting"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", split_bytes: int | None = None) -> list[dict]:
    """Everything that has arrived, then stop; the cursor only moves with a finished batch. Returns the progress of each batch.

    State is kept in RocksDB, so it may exceed an executor's memory and a checkpoint holds what changed. A commit
    writes the log of its changes, and no row is looked up only to keep the store's row count.
    ``split_bytes`` bounds the input of a task, where its rows grow many times once they are read.
    """
    conf = stream.sparkSession.conf
    own = {f"{STORE}.providerClass": ROCKSDB, f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
           f"{STORE}.rocksdb.trackTotalNumberOfRows": "false"} | ({"spark.sql.files.maxPartitionBytes": str(split_bytes)} if split_bytes else {})
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"]]


def debounced(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 45):
    """A rebuild at most every ``seconds``, fed with all rows that arrived meanwhile."""
    return (stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{seconds} seconds").start())


def ingest_once(stream: DataFrame, target: str, keys: list[str], checkpoint: str, within: tuple[str, str] | None = None) -> list[dict]:
    """Append each key once: a replayed row finds its key already there. Returns the progress of each batch.

    The keys seen are the stream's own state, dealt by key: a batch looks up its own keys and reads
    nothing that it wrote before, however long the past is. Every batch lands in its own folder of the
    target, so a batch that was lost half way overwrites itself. ``within`` (time column, delay)
    forgets keys older than the delay, where replays cannot come later. NULL is a key like any other.
    """
    if within is None:
        fresh = stream.dropDuplicates(keys)
    else:
        fresh = stream.withWatermark(*within).dropDuplicatesWithinWatermark(keys)
    return run_available(fresh, lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n:08d}"), checkpoint)


def learn_stream(candidates: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Keeps the strongest witness of every (alias, entity_key) of a stream of candidates; see ``identity.learned``.

    The state is one row a pair, and a batch writes the pairs whose witness it changed.
    """
    per = candidates.filter(F.trim("alias") != "").groupBy("alias", "entity_key").agg(F.min(F.struct("prio", "kind")).alias("w"))
    rows = per.select("alias", "entity_key", "w.prio", "w.kind")
    return run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n:08d}"), checkpoint, mode="update")


def enrich_late(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Late evidence fills what is empty, never replaces; new keys are appended."""
    return insert_or_ignore(enrich(base, batch, keys), batch, keys)


def throughput(stream: DataFrame, at: str, watermark: str = "1 hour", window: str = "1 hour", slide: str | None = None, by: str | None = None) -> DataFrame:
    """Events per (sliding) window, closed by the watermark."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    keys = [w.alias("w"), *([by] if by else [])]
    return stream.withWatermark(at, watermark).groupBy(*keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))


def tail(journal: DataFrame, after_id: int = 0, limit: int = 100) -> DataFrame:
    """Newest journal rows after an id."""
    return journal.filter(F.col("id") > after_id).orderBy(F.col("id").desc()).limit(limit)


class ItemMachine(StatefulProcessor):
    """One capture item: folds its events in order and repairs a fetch nothing finished."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempts int, revivals int, next_try double, done_at double, last_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.item.get() if self.item.exists() else None
        item, last = (tuple(held[:5]), held[5]) if held else (START, None)
        events = pd.concat(list(rows)).sort_values("seq")
        for kind, at in zip(events["kind"], events["at"]):
            if item[0] == "fetching" and last is not None and at - last > STALE_S and kind == "claim":
                item = ("queued", *item[1:])
            item = step(item, kind, float(at))
            last = float(at)
        self.item.update((*item, last))
        yield pd.DataFrame({"key": [key[0]], "state": [item[0]], "attempts": [item[1]], "revivals": [item[2]], "next_try": [item[3]], "done_at": [item[4]],
                            "at": [last]})

    def close(self) -> None:
        pass


def item_states(stream: DataFrame) -> DataFrame:
    """(key, state, attempts, ...) after each batch of (key, seq, kind, at) events."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ItemMachine(), outputMode="Update", timeMode="None",
        outputStructType=f"key {kind}, state string, attempts int, revivals int, next_try double, done_at double, at double")
