"""Session building and shared storage for intermediate tables.

Lineage is cut by writing a table below the folder named by
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
a re-read and never a recomputation of everything above.
"""

from __future__ import annotations

import atexit
import contextlib
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "procura", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` decides. Where neither that setting nor
    ``SparkContext.setCheckpointDir`` named a folder, a temporary one is used in
    local mode only; on a cluster that would be a folder of one machine, so it
    is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="procura-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_registered: set[str] = set()
_scopes: list[list[str]] = []


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; ``codec`` is Parquet's compression, if not the session's.

    The files stay until the Python driver ends, since the returned frame reads
    them lazily.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/procura-{spark.sparkContext.applicationId}"
    if root not in _registered:
        _registered.add(root)
        atexit.register(_delete, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, others: list[str]) -> Iterator[None]:
    """At the end of a block that doesn't fail, delete the tables that ``materialise`` wrote in it, and some others.

    What is still to be read must be written by ``keep``.
    """
    own = list(others)
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.pop()
    for path in own:
        _delete(spark, path)


def keep(df: DataFrame, label: str, paths: list[str]) -> DataFrame:
    """``materialise``, for longer than the current block; the path goes to ``paths``."""
    _scopes.append(paths)
    try:
        return materialise(df, label)
    finally:
        _scopes.pop()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_object(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Send an object of known small size to the executors; the result reads it there.

    It travels as bytes that carry the code of this package's classes, which
    the executors need not have installed.
    """
    payload = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(payload.value)
