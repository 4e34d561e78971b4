"""Session helpers: a session for tests and benches, and shared scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "packetloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the given session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only for a local master, where all tasks see one disk, may that setting be absent:
    then a temporary folder is made, once per session. Elsewhere its absence is an error,
    for executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("packetloom.scratch", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set("packetloom.scratch", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root for stream state and written tables.

    Paths are grouped by application, so they can be removed when it has ended.
    """
    app = spark.sparkContext.applicationId
    return os.path.join(shared_root(spark), "packetloom", app, *_SCOPES, f"{label}-{uuid.uuid4().hex}")


_SCOPES: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What the package writes to the shared folder inside goes when the block ends.

    Use results, write them or collect them, before the block ends. Blocks may be nested.
    """
    app = spark.sparkContext.applicationId
    folder = os.path.join(shared_root(spark), "packetloom", app, *_SCOPES, f"scope-{uuid.uuid4().hex}")
    _SCOPES.append(os.path.basename(folder))
    try:
        yield
    finally:
        _SCOPES.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Remove what this application wrote below the shared root; whether there was anything.

    Call it when no result of the package that is still in use reads such a table.
    """
    app = spark.sparkContext.applicationId
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_root(spark), "packetloom", app))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result is read several times: it is computed once, survives the
    loss of executors, and its real size is known to the planner, which then
    chooses between broadcast and shuffle by itself.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
