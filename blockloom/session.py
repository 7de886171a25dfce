"""Session helpers: builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Spark 4.1 may treat a union of two shuffled inputs as still partitioned and drop the next shuffle,
# while adaptive execution coalesces the inputs differently: keys then meet in different tasks.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


# A runtime filter is merged in one task from one array of a mebibyte for each partition, so that task's garbage
# grows with the partitions.
RUNTIME_FILTERS = "spark.sql.optimizer.runtime.bloomFilter.enabled"


def prepare(spark: SparkSession) -> None:
    """Settings every session needs before running these operators, and the package on the workers."""
    spark.conf.set(UNION_PARTITIONING, "false")
    ship_package(spark)


def local_session(cores: str | int = "*", app: str = "blockloom") -> SparkSession:
    """A local session for tests and benches. On a cluster pass your own session instead."""
    parts = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config(UNION_PARTITIONING, "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BLOCKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pyspark.udf.faulthandler.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a fresh one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so an executor loss cannot change the rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Partitions for CPU-bound Python stages: fixed, because byte-sized coalescing would put many
    small but expensive groups into one task."""
    prepare(spark)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


PART_BYTES = 4 << 20  # bytes of input files for each task of a large shuffle
MOST_PARTS = 20_000


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a frame reads."""
    spark, size = df.sparkSession, 0
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for file in map(path, df.inputFiles()):
        size += file.getFileSystem(conf).getFileStatus(file).getLen()
    return size


def part_count(df: DataFrame, share: int = 1) -> int:
    """Partitions of a shuffle of `df`: as many as the session's, more where its input is large, so that what a task
    sorts or holds doesn't grow with the tables; `share` times as much lies in one."""
    return max(task_count(df.sparkSession), min(MOST_PARTS, -(-input_bytes(df) // (share * PART_BYTES))))


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, through Spark's own file service."""
    context = spark.sparkContext
    if any(f.endswith("/blockloom.zip") for f in context.listFiles):
        return  # already there
    home = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "blockloom"), "zip", home, "blockloom")
    context.addPyFile(archive)
