"""Session for tests and benchmarks, and the shared folder that jobs write to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stayframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot interprets methods above 8000 bytecodes; past this limit Spark generates smaller ones instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a folder of its own; on a cluster its absence is an error,
    since a machine-local folder would not outlive (or be visible beyond) one node.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="stayframe-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make reliable checkpoints possible, in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark) + "/checkpoints")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written below the shared root and read from there."""
    path = new_workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_workspaces(spark: SparkSession, older_than: timedelta) -> int:
    """Delete workspaces that were last written to before ``older_than``; returns how many. Frames that still read one fail."""
    jvm, root = spark._jvm, f"{shared_root(spark)}/stayframe"
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(root)):
        return 0
    before = (time.time() - older_than.total_seconds()) * 1000
    old = [status.getPath() for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root)) if status.getModificationTime() < before]
    return sum(bool(fs.delete(path, True)) for path in old)


def new_workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root."""
    path = f"{shared_root(spark)}/stayframe/{name}-{uuid.uuid4().hex}"
    for made in _recorders.get():
        made.append(path)
    return path


_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded_workspaces() -> Iterator[list[str]]:
    """The workspaces that this thread makes in the block, as they come; for :func:`drop_workspaces` once nothing reads them."""
    made: list[str] = []
    token = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(token)


def drop_workspaces(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete workspaces. Frames that still read one fail."""
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
