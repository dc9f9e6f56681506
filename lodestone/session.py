"""Session construction and the shared scratch location."""

from __future__ import annotations

import io
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

from lodestone.sources import files

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a member named twice in a JSON object the last counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Whole documents travel in Arrow batches, and a reader's Python objects take many times their bytes:
    # what a worker holds at once is bounded by both limits, whatever the size of its task.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_FILES, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", 8  # files a task writes at once, beyond which it sorts its rows


def build_session(
    app_name: str = "lodestone",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the plans rely on.

    ``shuffle_partitions`` is an upper bound: AQE coalesces small partitions, so
    a cluster should set it high (about total input bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    ship_package(session)
    return session


def apply_runtime_conf(spark: SparkSession) -> None:
    """Pin the run-time settings on a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


@contextmanager
def _held(spark: SparkSession, key: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_released(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written here gives its shuffle files back once it is done, not when the driver next collects garbage."""
    return _held(spark, SHUFFLE_CLEANUP, "true", "false")


def unsorted_writes(spark: SparkSession) -> AbstractContextManager[None]:
    """A task that writes few folders here does so side by side, without sorting its rows by folder."""
    return _held(spark, OPEN_FILES, str(WRITERS), "0")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests, a laptop) a local temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def _work_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that cuts lineage."""
    return f"{_work_root(spark)}/{name}-{uuid.uuid4().hex}"


def clean_work(spark: SparkSession, max_age_hours: float = 24.0, name: str = "") -> int:
    """Delete this application's work tables of that age (and name); how many went."""
    limit = (time.time() - max_age_hours * 3600) * 1000
    tables = files.list_dir(spark, _work_root(spark))
    old = [path for table, path, _, modified in tables if modified < limit and table.startswith(name)]
    return sum(files.delete(spark, path) for path in old)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for name in (os.path.basename(package), "queries"):
            for folder, _, names in os.walk(os.path.join(root, name)):
                for file in names:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        z.write(path, os.path.relpath(path, root))
    target = f"{shared_dir(spark)}/lodestone-code/{application}/{uuid.uuid4().hex}/lodestone.zip"
    files.write_new(spark, target, archive.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
