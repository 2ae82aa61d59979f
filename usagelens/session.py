"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Files that a task writes at a time, at most.
OPEN_FILES = 40


def configure(spark: SparkSession) -> SparkSession:
    """Set the options that affect results (UTC calendar, ANSI, JSON keys), skew, writes and stream state.

    The state of a stream is kept on the executors' disks, so it may outgrow memory, and each
    batch adds a log of its changes to the checkpoint in place of new state files. A task
    that writes to some folders by column keeps a file open in each, so whole rows are not
    sorted, and spilled, for the order of folders; beyond that many folders they are.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.ansi.enabled", "true")
    conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    conf.set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES))
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="usagelens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"usagelens-{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with a writer's options, and continue from the written table.

    The frame is then computed a single time however often it is read, survives
    the loss of executors, and its size on disk is known to the optimizer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
