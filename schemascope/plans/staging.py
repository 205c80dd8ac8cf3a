"""Tables written between the steps of an iterative job."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) a temporary folder
    is made and set; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back.

    This cuts lineage, fixes ids made by ``monotonically_increasing_id`` and
    survives lost executors. Tables still there when the driver ends are
    deleted then; ``release`` deletes one earlier.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/schemascope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            _delete(df.sparkSession, path)
            _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast, if it has at most ``most`` rows; a larger one is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the folder is the cluster's to clean
            return
