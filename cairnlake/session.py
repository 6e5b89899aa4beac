"""Session helpers: shared checkpoint folder, checked broadcasts, table access."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes of estimated size.
BROADCAST_LIMIT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a context folder exists (tests in
    local mode) is a folder of this machine chosen.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = jsc.getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = os.path.join(tempfile.gettempdir(), "cairnlake-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast where the estimated size proves it small; else leave the
    choice (shuffled join with AQE skew handling) to the optimiser."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table too small to be read by all cores, dealt to them, for work that is
    heavy by the row; larger ones are split as they are read and stay so."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    small = estimated_bytes(df) < cores * 4 * (4 << 20)
    return df.repartition(cores, *keys) if small else df


def bounded(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``df`` for a broadcast, where counting shows at most ``most_rows`` rows;
    else ``df`` as it is, which leaves the join to the optimiser."""
    rows = df.limit(most_rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most_rows else df


def listed(spark: SparkSession, rows: list[tuple], schema: str, most_rows: int = 10_000) -> DataFrame:
    """Rows the driver holds already, for a broadcast if they are few."""
    d = spark.createDataFrame(rows, schema)
    return F.broadcast(d) if len(rows) <= most_rows else d


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_cairnlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cairnlake-"), "cairnlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith((".py", ".npz", ".json")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cairnlake", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._cairnlake_shipped = True
