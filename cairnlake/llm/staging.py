"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cairnlake.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the statements run within as each one ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _folder(spark: SparkSession) -> str:
    if not getattr(spark.sparkContext, "_cairnlake_staged", False):
        spark.sparkContext._cairnlake_staged = True
        atexit.register(clear, spark)
    return f"{ensure_checkpoint_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: later
    stages neither recompute it nor depend on an executor's disk.  ``by``: a
    column by whose values the files are kept apart."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    with shuffles_dropped(spark):
        (w.partitionBy(by) if by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def staged_texts(df: DataFrame, name: str, by: str) -> str:
    """The folder of text files with the one other column of ``df``, a line feed behind each value."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).text(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that everything later was staged from."""
    for t in tables:
        _delete(t.sparkSession, t._staged_path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this application; runs by itself as it ends.
    Results not yet computed from them can't be computed afterwards."""
    if spark.sparkContext._jsc is not None:
        try:
            _delete(spark, _folder(spark))
        except Exception:  # the application is ending: what can't be deleted stays in its folder
            return
