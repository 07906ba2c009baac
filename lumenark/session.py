"""Session construction and lineage cutting."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lumenark", cores: str | int = "*", shuffle: int = 8,
                  memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from ``spark-submit``; no operator here builds one.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a private one only on a local master without one.

    On a cluster a folder of one machine would lose what other machines wrote, so a missing
    setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, unlike a local one."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder as Parquet and read from there: for rows that several steps read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None]) -> str:
    """Folder of a derived table set, built once for each state of the files it derives from.

    ``build(folder)`` writes it. The folder's name carries names, sizes and times of the input files, so
    changed input gives another one; it appears by a rename when whole, so readers never see half of it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for path in inputs:
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    digest = hashlib.sha256("\n".join([name, *sorted(seen)]).encode()).hexdigest()[:24]
    final = f"{shared_dir(spark).rstrip('/')}/{name}-{digest}"
    target = jvm.org.apache.hadoop.fs.Path(final)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        part = f"{final}-{uuid.uuid4().hex}"
        build(part)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), target) and not fs.exists(target):
            raise OSError(f"could not move {part} to {final}")
    return final
