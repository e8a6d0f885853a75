"""Incremental cleaning of hit files: what arrived since the last run, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitlens.operators.hits import clean_hits
from hitlens.schema import HITS


def append_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame]):
    """Read the Parquet hit files that are new in folder and append what clean
    makes of them to target. Returns when all are done; checkpoint remembers them."""
    arriving = spark.readStream.schema(HITS).parquet(folder)
    query = clean(arriving).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def clean_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str, query_metadata: DataFrame, match_metadata: DataFrame, logged: list[str], moltype: str, ksize: int):
    """Read the Parquet hit files that are new in folder, clean them (without
    state: a filter and two stream-static joins) and append them to target.
    Returns when all are done; checkpoint remembers them."""
    return append_new_files(spark, folder, target, checkpoint, lambda arriving: clean_hits(arriving, query_metadata, match_metadata, logged, moltype, ksize))
