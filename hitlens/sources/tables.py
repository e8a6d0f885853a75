"""Readers and writers of hit tables: one loader for CSV and Parquet, sinks, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hitlens.schema import HITS


def load(spark: SparkSession, path: str | list[str], kind: str | None = None, schema: StructType | None = None, header: bool = True, sep: str = ",", rows: int | None = None) -> DataFrame:
    """A lazy scan of one or more files, globs or folders (their union). kind: csv or
    parquet, by default from the name (.csv, .tsv; else parquet)."""
    paths = [path] if isinstance(path, str) else list(path)
    bare = paths[0].lower().removesuffix(".gz")
    kind = kind or ("csv" if bare.endswith((".csv", ".tsv")) else "parquet")
    if kind not in ("csv", "parquet"):
        raise ValueError(f"kind {kind!r}: csv or parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", header).option("sep", "\t" if bare.endswith(".tsv") else sep)
    df = getattr(reader, kind)(paths) if kind == "csv" else reader.parquet(*paths)
    return df if rows is None else df.limit(rows)


def load_hits(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    return load(spark, path, kind, HITS)


def load_lookup(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headerless two-column file as (scop_id, lineage)."""
    return load(spark, path, "csv", StructType().add("scop_id", "string").add("lineage", "string"), header=False, sep=sep)


def schema_of(spark: SparkSession, path: str) -> StructType:
    """The schema of a Parquet dataset, without reading rows."""
    return spark.read.parquet(path).schema


def sweep(spark: SparkSession, root: str, moltypes: list[str], ksizes: range, schema: StructType | None = None) -> DataFrame:
    """All results of a sweep, stored as a dataset partitioned by moltype and
    ksize: one scan, pruned to the wanted partitions; missing ones are no error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("ignoreMissingFiles", "true").parquet(root).filter(F.col("moltype").isin(moltypes) & F.col("ksize").between(ksizes.start, ksizes.stop - 1))


def result_path(root: str, moltype: str, ksize: int, kind: str = "parquet", filtered: bool = False) -> str:
    """Where a sweep keeps the result of one moltype and ksize, as a file or folder of its own."""
    end = {"parquet": ".pq", "csv": ".csv"}[kind]
    return f"{root.rstrip('/')}/multisearch.{moltype}.k{ksize}{'.filtered' if filtered else ''}{end}"


def sweep_files(spark: SparkSession, root: str, moltypes: list[str], ksizes: range, kind: str = "parquet", schema: StructType | None = None, filtered: bool = False) -> DataFrame | None:
    """The union of the results that result_path names, with moltype and ksize;
    missing ones are left out. None if there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for moltype in moltypes:
        for ksize in ksizes:
            path = files.Path(result_path(root, moltype, ksize, kind, filtered))
            if path.getFileSystem(conf).exists(path):
                one = load(spark, path.toString(), kind, schema).withColumns({"moltype": F.lit(moltype), "ksize": F.lit(ksize)})
                out = one if out is None else out.unionByName(one)
    return out


def save(df: DataFrame, path: str, kind: str = "parquet", skip_existing: bool = False, partition_by: list[str] = (), max_records: int = 0, sep: str = ",", row_group_bytes: int = 0) -> None:
    """Write df; skip_existing leaves an existing result as it is, else it is
    replaced. max_records: rows of a file; row_group_bytes: size of a Parquet
    row group (0: Spark's own)."""
    writer = df.write.mode("ignore" if skip_existing else "overwrite").option("maxRecordsPerFile", max_records)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True).option("sep", sep)
    getattr(writer, kind)(path)


def transcode(spark: SparkSession, csv: str, parquet: str | None = None, schema: StructType | None = None) -> str:
    """CSV to Parquet; by default next to it, .csv replaced by .pq."""
    target = parquet or csv.removesuffix(".gz").removesuffix(".csv") + ".pq"
    save(load(spark, csv, "csv", schema), target)
    return target


def as_text(df: DataFrame, sep: str = "\t") -> DataFrame:
    """(line): rows as delimited text, for display."""
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": sep}).alias("line"))
