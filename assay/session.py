"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders written by ``cut`` in each open block of ``passing``, the innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("assay_passing", default=())

# Planner settings the jobs are written for.  All are runtime choices of
# adaptive execution: nothing below depends on the size of one cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", app: str = "assay", **extra: str) -> SparkSession:
    """A local session with the settings above, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only in a local session, as in
    tests, a temporary folder is made and set on the context where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assay-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage where a result feeds several later branches, so that it
    is computed once and survives the loss of an executor.  ``spread`` writes as
    many files as the session has shuffle partitions: for short rows that stand
    for much work each, which a split by bytes would leave to a few tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    rows = df.repartition(width(spark)) if spread else df
    rows.write.parquet(path)
    blocks = _PASSING.get()
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go.

    Spark deletes them once the driver's collector finds their plans gone, and a driver with memory to spare seldom
    collects: without this, the files of all steps of a long job are on disk together.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, by the file system that it is in."""
    if not path.startswith(scratch_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes within this block are gone after it.

    What is needed later is written by ``lasting``.
    """
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            remove(spark, path)


def lasting(df: DataFrame) -> DataFrame:
    """``cut``, for a table that outlives the innermost block of ``passing``; it goes with the one around that, if there is one."""
    token = _PASSING.set(_PASSING.get()[:-1])
    try:
        return cut(df)
    finally:
        _PASSING.reset(token)
