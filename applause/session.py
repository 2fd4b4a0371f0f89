"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "applause", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack trace for every Column
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only ever used by a ``local`` master, where driver
    and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if "APPLAUSE_LOCAL_DIR" not in os.environ:
        folder = os.environ["APPLAUSE_LOCAL_DIR"] = tempfile.mkdtemp(prefix="applause-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return os.environ["APPLAUSE_LOCAL_DIR"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the folder of the run that is under way."""
    return f"{(_RUNS[-1] if _RUNS else shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_RUNS: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Everything that is written inside goes to one folder, which is gone afterwards.

    Results must be collected or saved inside: they are read from there.
    """
    path = scratch_path(spark, "run")
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        remove(spark, path)


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The result is worked out once, survives the loss of any executor and carries real statistics. Shuffle files of its
    making are deleted as soon as it is written. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, "cut")
    with dropping_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    cut = df.sparkSession.read.schema(df.schema).parquet(path)
    cut._written = path
    return cut


def release(df: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for a frame that nothing reads any more."""
    remove(df.sparkSession, df._written)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the results made and collected inside are deleted with the result, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
