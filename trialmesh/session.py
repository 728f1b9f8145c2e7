"""Session settings, the shared work folder and small plan helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_fallback_folder: str | None = None
_work_folders: dict[str, str] = {}


def build_session(app: str = "trialmesh", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides, and adaptive execution coalesces or splits from there.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    In local mode without that setting a temporary one, which goes when the process ends.
    """
    global _fallback_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _fallback_folder is None:
        _fallback_folder = tempfile.mkdtemp(prefix="trialmesh-")
        atexit.register(shutil.rmtree, _fallback_folder, ignore_errors=True)
    return _fallback_folder


def work_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one; Hadoop deletes it when the application ends, also after failures."""
    app = spark.sparkContext.applicationId
    if app not in _work_folders:
        folder = os.path.join(shared_folder(spark), f"trialmesh-{app}-{uuid.uuid4().hex[:8]}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _work_folders[app] = folder
    return _work_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for work of this application."""
    return os.path.join(work_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """``df`` written to the shared folder for the length of a block, for steps that finish inside it."""
    path = new_path(df.sparkSession, name)
    try:
        df.write.mode("overwrite").parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint, only after checking that ``df`` has at most ``max_rows`` rows."""
    return F.broadcast(df) if fits(df, max_rows) else df
