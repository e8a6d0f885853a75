"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local mode) a folder of our own is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="hitlens-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/hitlens/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hpath)
    # with its scheme, as Arrow's file systems need it: file:///...
    full = files.makeQualified(hpath).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of shared_path that is used up, before the session ends."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of what has ended go: Spark removes them only after
    the driver's JVM has collected the frames that made them, which may be late.
    Twice, as frames may end up unused shortly after the step itself."""
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, so a
    lost executor costs a reread and not a recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
