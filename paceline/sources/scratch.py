"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: During a write: shuffle files go when it ends, and Arrow batches stay small, so that Python workers need little memory.
_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine, which is then set, only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="paceline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, since nobody reads them again.  The table goes by ``discard``, or when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paceline-{name}-{uuid.uuid4().hex}"
    with settled(spark):
        df.write.parquet(path)
    at, fs = hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables that no frame still to be run reads."""
    for table in tables:
        at, fs = hadoop(table.sparkSession, table.scratch_path)
        fs.delete(at, True)


def publish(df: DataFrame, path: str) -> DataFrame:
    """``df`` at ``path``, by one rename of a finished table; a table that is there already is used instead."""
    spark = df.sparkSession
    at, fs = hadoop(spark, path)
    if not fs.exists(at):
        made = f"{path}-{uuid.uuid4().hex}"
        with settled(spark):
            df.write.parquet(made)
        temporary, _ = hadoop(spark, made)
        if not fs.rename(temporary, at) or fs.exists(hadoop(spark, f"{path}/{made.rsplit('/', 1)[1]}")[0]):
            fs.delete(hadoop(spark, f"{path}/{made.rsplit('/', 1)[1]}")[0], True)  # somebody else was first
            fs.delete(temporary, True)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The path as Hadoop knows it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """The settings of scratch writes, and those of before again."""
    before = {k: spark.conf.get(k) for k in _WRITES}
    for k, v in _WRITES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
