"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension of at most this many rows is sent to every executor; its rows hold a
# handful of narrow columns, so that is some tens of megabytes.
BROADCAST_ROWS = 200_000

# Where a local session without a checkpoint folder remembers its own.
_FALLBACK = "tidemark.local.folder"

# Set on a session only where the caller (or the cluster) has not chosen.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Run names and deadlines are UTC instants, so the session must be too.

    Python workers look for the package where the driver found it, which serves local
    sessions started in any folder; on a cluster it is installed or sent along.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def release(spark: SparkSession) -> None:
    """Remove every table this application has written to the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_FALLBACK, None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, seen by every executor.

    The folder comes from the session. Only a local session, where driver and
    executors are one process, may fall back to a temporary folder; on a cluster
    such a path would be lost with its machine. Everything an application writes
    lies under its own id, to be cleared as a whole once it is done.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_FALLBACK, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_FALLBACK, base)
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/{application}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for several readers.

    Cuts the lineage: later branches scan the columns they need instead of
    repeating the shuffles above, and losing executors loses none of it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs started inside, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def counted(df: DataFrame, purpose: str, weight: Column | None = None) -> DataFrame:
    """A small derived table, written and then counted before it is broadcast.

    It comes back marked for broadcast if it proved small, and plain otherwise, in
    which case joins with it shuffle and adaptive execution splits hot keys. Keys
    such as the period have a few dozen values, so a shuffle on them is worth
    avoiding whenever it can be. Rows that hold an array count by ``weight``, its
    length; plain rows are counted from the file footers.
    """
    table = written(df, purpose)
    if weight is None:
        size = table.count()
    else:
        size = table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_ROWS else table
