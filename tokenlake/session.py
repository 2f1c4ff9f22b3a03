"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tokenlake") -> SparkSession:
    """Session for tests and local benches. On a cluster, use the cluster's session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a generated method above 8000 bytes is not JIT-compiled by the JVM;
        # run such a stage operator by operator instead (the uint256 decode)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: what tasks of these queries need: amounts are decoded in methods small enough for the JVM to compile, and a task takes what it can
#: sort without spilling (the logs' texts take 10 to 20 times their Parquet size in memory)
TUNED = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


#: a shuffle begins with a partition for so many bytes of the tables, and AQE joins those below its advisory size: the logs' shuffles
#: carry up to twice the tables' bytes, so no task sorts more than some 8 MB of them however large the tables are
BYTES_PER_PARTITION = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tuned(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """The given session with the settings of TUNED that it has not set itself, and with shuffles cut for so large an input at least."""
    for key, value in TUNED.items():
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)
    needed = -(-input_bytes // BYTES_PER_PARTITION)
    if needed > int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(needed))
    return spark


#: Spark removes an execution's shuffle files when it ends; else they stay until the driver happens to collect its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, SHUFFLE_CLEANUP is on unless the session has set it itself: a chain of jobs holds the shuffle files of one at a time.

    For jobs that write their result and are not executed again: a second execution of a frame would run its stages anew.
    """
    if SHUFFLE_CLEANUP in spark.conf.getAll:
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster sets this to shared storage. Where it is unset, a local session gets a temporary
    folder (driver and tasks are one process there); on a cluster that is an error, because no
    executor could see such a folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="tokenlake-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
