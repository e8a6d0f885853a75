"""Joins with a table of unique keys that split hot keys over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of a mean partition on, and from LEAST rows on.
PART, LEAST = 0.25, 256
SALT, TIMES = "__skew_salt", "__skew_times"


def hot_keys(counts: DataFrame) -> list[tuple]:
    """(key, tasks) of the hot keys of counts (key, rows): those with more rows
    than PART of a mean partition, so at most partitions / PART of them."""
    key, rows = counts.columns
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(rows)).first()[0] or 0
    most = max(int(total * PART / partitions), LEAST)
    hot = counts.groupBy(key).agg(F.sum(rows).alias(rows)).filter(F.col(rows) > most)
    return [tuple(r) for r in hot.select(key, F.ceil(F.col(rows) / most).cast("int")).collect()]


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], by: Column, counts: DataFrame) -> DataFrame:
    """The inner join of rows and unique (one row for each value of `on`).

    counts: how many of rows each value of its first column, one of `on`, has
    (staged: it is read twice). The rows of a hot key are dealt over several
    tasks by a hash of `by`, and its row of unique is sent to each of these. No
    more copies are made than partitions / PART; that also bounds the list of
    hot keys, which is broadcast.
    """
    hot = hot_keys(counts)
    if not hot:
        return rows.join(unique, on)
    key = counts.columns[0]
    known = F.broadcast(rows.sparkSession.createDataFrame(hot, f"`{key}` long, {TIMES} int"))
    salted = rows.join(known, key, "left").withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(by), F.col(TIMES)).cast("int"), F.lit(0)))
    copied = unique.join(known, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(TIMES), F.lit(1)) - 1)))
    return salted.drop(TIMES).join(copied.drop(TIMES), [*on, SALT]).drop(SALT)
