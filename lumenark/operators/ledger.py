"""Ledgers: capture items, transfers, local files and jobs, in batch.

item(key, state, attempts, revivals, next_try, done_at, ...); times are epoch seconds.
The transition rule is one pure function, shared with the streaming state machine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import backoff_seconds

# States, retry, revival, park and staleness rules.
QUEUED, FETCHING, UPLOADED, FAILED, UNAVAILABLE = "queued", "fetching", "uploaded", "failed", "unavailable"
MAX_ATTEMPTS = 5
RETRY_S = 900.0
REVIVE_S, MAX_REVIVALS = 4 * 3600.0, 6
PARK_S = 30 * 86400.0
STALE_S = 1800.0
PLAUSIBLE_BYTES = 16 * 1024

START = (QUEUED, 0, 0, 0.0, None)


def step(item: tuple, kind: str, at: float) -> tuple:
    """(state, attempts, revivals, next_try, done_at) after one event."""
    state, attempts, revivals, due, done = item
    if state in (UPLOADED, UNAVAILABLE) and kind != "requeue":
        return item
    if kind == "claim":
        return (FETCHING, attempts + 1, revivals, due, done)
    if kind == "done":
        return (UPLOADED, attempts, revivals, due, at)
    if kind == "gone":
        return (UNAVAILABLE, attempts, revivals, due, done)
    if kind == "requeue":
        return (QUEUED, 0, revivals, 0.0, None)
    if kind == "fail":
        if attempts < MAX_ATTEMPTS:
            return (FAILED, attempts, revivals, at + RETRY_S, done)
        if revivals < MAX_REVIVALS:
            return (FAILED, 0, revivals + 1, at + REVIVE_S, done)
        return (FAILED, attempts, revivals, at + PARK_S, done)
    return item


def claim_order(items: DataFrame, membership: DataFrame, now: float, skip: Sequence[str] = ()) -> DataFrame:
    """Due items in queue order, without those filed under a skipped collection."""
    due = items.filter(F.col("state").isin(QUEUED, FAILED) & (F.coalesce("next_try", F.lit(0.0)) <= now))
    if skip:
        out = membership.filter(F.col("collection").isin(*skip)).select("key").distinct()
        due = due.join(out, "key", "left_anti")
    return due.orderBy("position", "key")


def repair_stale(items: DataFrame, now: float, older_than: float = STALE_S) -> DataFrame:
    stale = (F.col("state") == FETCHING) & (F.col("last_try").isNull() | (F.col("last_try") < now - older_than))
    return items.withColumn("state", F.when(stale, QUEUED).otherwise(F.col("state")))


def requeue(items: DataFrame, states: Sequence[str] = (FAILED,), reset_attempts: bool = True) -> DataFrame:
    hit = F.col("state").isin(*states)
    out = items.withColumn("next_try", F.when(hit, F.lit(0.0)).otherwise(F.col("next_try")))
    if reset_attempts:
        out = out.withColumn("attempts", F.when(hit, F.lit(0)).otherwise(F.col("attempts")))
    return out.withColumn("state", F.when(hit, QUEUED).otherwise(F.col("state")))


def rebind(items: DataFrame, channel: str) -> DataFrame:
    """Items of another channel lose their message and are queued again."""
    moved = F.coalesce("channel", F.lit("")) != channel
    return (items.withColumn("state", F.when(moved & (F.col("state") == UPLOADED), QUEUED).otherwise(F.col("state")))
            .withColumn("msg_id", F.when(~moved, F.col("msg_id"))).withColumn("channel", F.lit(channel)))


def mark(items: DataFrame, updates: DataFrame, state: str) -> DataFrame:
    """Terminal transition that sets only the supplied fields; updates hold one row per key."""
    fields = [c for c in updates.columns if c != "key" and c in items.columns]
    u = updates.select("key", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in fields])
    j = items.join(u, "key", "left")
    cols = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else
            (F.when(F.col("__hit"), state).otherwise(F.col("state")).alias("state") if c == "state" else F.col(c)) for c in items.columns]
    return j.select(*cols)


def state_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count("*").alias("n"))


def collection_progress(items: DataFrame, membership: DataFrame) -> DataFrame:
    return membership.join(items.select("key", "state"), "key").groupBy("collection").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == UPLOADED).alias("done"),
        F.count_if(F.col("state") == FAILED).alias("failed"))


def next_due(items: DataFrame) -> DataFrame:
    return items.filter(F.col("state").isin(QUEUED, FAILED)).agg(F.min("next_try").alias("next_due"))


def failures(items: DataFrame, limit: int = 100) -> DataFrame:
    return items.filter(F.col("state").isin(FAILED, UNAVAILABLE)).orderBy(F.col("last_try").desc(), "key").limit(limit)


def throughput(items: DataFrame, now: float, window: float = 3600.0) -> DataFrame:
    return items.filter((F.col("state") == UPLOADED) & (F.col("done_at") > now - window)).agg(F.count("*").alias("n"))


def queue_page(items: DataFrame, state: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    df = items.filter(F.col("state") == state) if state else items
    return df.orderBy("position", "key").offset(offset).limit(limit)


def export_urls(items: DataFrame, state: str = UPLOADED) -> DataFrame:
    return items.filter(F.col("state") == state).orderBy("position", "key").select("url")


def asset_queue(items: DataFrame) -> DataFrame:
    """Uploaded videos without an asset set, oldest first."""
    return items.filter((F.col("state") == UPLOADED) & (F.coalesce("assets_msg_id", F.lit(0)) == 0) & (F.coalesce("msg_id", F.lit(0)) > 0)
                        & (F.coalesce("ext", F.lit("")) != "photo")).orderBy(F.coalesce("done_at", "added_at"), "key")


def asset_counts(items: DataFrame) -> DataFrame:
    v = items.filter((F.col("state") == UPLOADED) & (F.coalesce("msg_id", F.lit(0)) > 0) & (F.coalesce("ext", F.lit("")) != "photo"))
    return v.agg(F.count("*").alias("videos"), F.count_if(F.coalesce("assets_msg_id", F.lit(0)) > 0).alias("with_assets"),
                 F.coalesce(F.sum("assets_clips"), F.lit(0)).alias("clips"))


def add_many(items: DataFrame, membership: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new items, new membership, counts) of incoming(key, collection, position); a bad link has no key."""
    good = incoming.filter(F.col("key").isNotNull())
    one = good.groupBy("key").agg(F.min("position").alias("position"))
    j = one.join(items.select("key", "state"), "key", "left")
    counts = j.agg(F.count_if(F.col("state").isNull()).alias("added"), F.count_if(F.col("state").isNotNull() & (F.col("state") != UPLOADED)).alias("known"),
                   F.count_if(F.col("state") == UPLOADED).alias("captured")).withColumn("bad", incoming.filter(F.col("key").isNull()).agg(F.count("*")).scalar())
    fresh = j.filter(F.col("state").isNull()).select("key", "position", F.lit(QUEUED).alias("state"))
    filed = membership.select("key", "collection").unionByName(good.filter(F.coalesce("collection", F.lit("")) != "").select("key", "collection")).distinct()
    return fresh, filed, counts


def adopt(items: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after adoption, counts): found(key, msg_id) are captured; a wrong message is corrected."""
    f = found.groupBy("key").agg(F.max("msg_id").alias("new_msg"))
    j = items.join(f, "key", "full_outer")
    fresh, moved = F.col("state").isNull() | (F.col("state") != UPLOADED), F.col("msg_id") != F.col("new_msg")
    hit = F.col("new_msg").isNotNull()
    counts = j.agg(F.count_if(hit & fresh).alias("adopted"), F.count_if(hit & ~fresh & F.coalesce(moved, F.lit(True))).alias("corrected"))
    out = j.select("key", F.coalesce("new_msg", "msg_id").alias("msg_id"), F.when(hit, UPLOADED).otherwise(F.col("state")).alias("state"))
    return out, counts


def replay(events: DataFrame) -> DataFrame:
    """Items after their ordered events (key, seq, kind, at): the batch twin of the stream.

    Events stream past one key after another in sorted Arrow batches; the task holds one
    item, not one key's events.
    """
    import pandas as pd

    def run(batches):
        key, item = None, START
        for pdf in batches:
            out = []
            for k, kind, at in zip(pdf["key"], pdf["kind"], pdf["at"]):
                if k != key:
                    if key is not None:
                        out.append((key, *item))
                    key, item = k, START
                item = step(item, kind, at)
            yield pd.DataFrame(out, columns=["key", "state", "attempts", "revivals", "next_try", "done_at"])
        if key is not None:
            yield pd.DataFrame([(key, *item)], columns=["key", "state", "attempts", "revivals", "next_try", "done_at"])

    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", "seq", "kind", "at").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInPandas(run, f"key {kind}, state string, attempts int, revivals int, next_try double, done_at double")


# ---- transfers, files, jobs ----------------------------------------------------------

def verify_transfers(targets: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """Verdict per target: size as expected, plausible without an expectation, or set aside with a backoff."""
    j = targets.join(files.select("key", "got"), "key", "left")
    expects = F.coalesce("expected", F.lit(0)) > 0
    good = F.when(expects, F.col("got") == F.col("expected")).otherwise(F.col("got") >= PLAUSIBLE_BYTES)
    verdict = F.when(F.col("got").isNull(), "missing").when(good, "verified").otherwise("failed")
    attempts = F.coalesce("attempts", F.lit(0)) + (verdict == "failed").cast("int")
    return j.withColumn("verdict", verdict).withColumn("attempts", attempts).withColumn(
        "next_try", F.when(F.col("verdict") == "failed", F.lit(now) + backoff_seconds(F.col("attempts"))))


def transfer_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("targets"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "missing", "failed")],
                        F.coalesce(F.sum("got"), F.lit(0)).alias("bytes"))


def target_priority(targets: DataFrame) -> DataFrame:
    return targets.orderBy(F.col("indexed").desc(), F.col("moments").desc(), F.col("created_at").desc_nulls_last(), "key")


def reconcile_folder(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, path, size, status): seen files are active, known ones no scan saw are missing."""
    s = seen.groupBy("key").agg(F.max_by(F.struct("path", "size"), F.col("path")).alias("s"))
    j = known.join(s, "key", "full_outer")
    return j.select("key", F.coalesce("s.path", "path").alias("path"), F.coalesce("s.size", "size").alias("size"),
                    F.when(F.col("s").isNotNull(), "active").otherwise("missing").alias("status"))


def enqueue_jobs(jobs: DataFrame, wanted: DataFrame, force: bool = False) -> DataFrame:
    """(entity_key, component, state): new jobs are pending; only settled failures come back unless forced."""
    w = wanted.select("entity_key", "component").distinct().withColumn("w", F.lit(True))
    j = jobs.join(w, ["entity_key", "component"], "full_outer")
    again = F.col("w") & (F.lit(force) | F.col("state").isin("failed", "skipped", "deferred"))
    return j.select("entity_key", "component", F.when(F.col("state").isNull() | F.coalesce(again, F.lit(False)), "pending").otherwise(F.col("state")).alias("state"))
