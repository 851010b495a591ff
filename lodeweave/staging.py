"""Working tables in the folder that driver and executors share, instead of cached blocks: nothing is left to release by hand."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that stage_in_passes() takes at once. Only how much disk is needed at a time depends on it.
ROWS_A_PASS = 100_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and the executors are threads of the driver."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeweave-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def working_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    at, files = file_system(spark, folder)
    files.deleteOnExit(at)
    return folder


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are what later steps read, so the shuffles that made them go from the executors' disks at once."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """df, written and read again: later plans begin here, and a lost executor costs nothing."""
    folder = working_path(df.sparkSession, label)
    _write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _write(df: DataFrame, folder: str) -> None:
    with freed_shuffles(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(folder)


def stage_in_passes(rows: DataFrame, make: Callable[[DataFrame], DataFrame], by: list[str], label: str) -> DataFrame:
    """make(rows), staged. Of many rows make() gets a share at a time, so the disks hold the shuffles of one share only.

    Rows that are equal in `by` are in the same share; what make() gives of the shares is what it gives of all rows.
    """
    spark = rows.sparkSession
    folder, passes = working_path(spark, label), max(1, -(-rows.count() // ROWS_A_PASS))
    for n in range(passes):
        made = make(rows if passes == 1 else rows.filter(F.pmod(F.xxhash64(*by), F.lit(passes)) == n))
        _write(made, folder)
    return spark.read.schema(made.schema).parquet(folder)
