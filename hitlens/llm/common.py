"""Shared plumbing: stage tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
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


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches that go to Python workers while the block runs;
    then the session has its own settings again."""
    bounds = {"maxRecordsPerBatch": str(2000), "maxBytesPerBatch": str(8 << 20)}
    own = {f"spark.sql.execution.arrow.{k}": spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    try:
        yield
    finally:
        for name, v in own.items():
            spark.conf.set(name, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, so a
    lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut, without copying, to at most `rows` rows and about `size`
    bytes (one row may be larger); empty batches are left out. At the end the
    worker, which Spark uses again, gives free memory back."""
    for batch in batches:
        step = rows if batch.nbytes <= size else max(1, min(rows, batch.num_rows * size // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns what the process has freed to the system, as far as that is possible."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
