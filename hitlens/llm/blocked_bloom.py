"""A blocked Bloom filter in DataFrame functions, and joins behind it.

The filter is a table of 256-bit blocks made by a bit_or aggregation, with
BITS_EACH bits for each listed key however long the list is. Up to
BROADCAST_BLOCKS blocks it is broadcast; a larger filter is left to Spark's
choice of a join. Either way the joins behind it are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import fresh

#: 2^17 blocks of 36 bytes are 4.7 MB, the most that is broadcast.
BROADCAST_BLOCKS = 1 << 17
BITS_EACH = 16
WORDS = 8


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each of the WORDS 32-bit words of a block."""
    h = F.xxhash64(F.lit(2), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)]


def blocks_for(n: int) -> int:
    blocks = 1
    while blocks * 256 < n * BITS_EACH:
        blocks *= 2
    return min(blocks, 1 << 30)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the first column of listed: (block, w0, ..., w7)."""
    key = F.col(listed.columns[0])
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(key))]
    return listed.groupBy(_block(key, blocks).alias("block")).agg(*words)


def with_maybe(rows: DataFrame, key: str, listed: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column flag: false only if key is certainly not among
    the values of listed's one column (of the same type; staged or cheap, it is
    read twice). A null key is certainly not listed."""
    listed = listed.filter(F.col(listed.columns[0]).isNotNull())
    blocks = blocks_for(listed.count())
    block, words = fresh(rows, "block"), fresh(rows, "words")
    filled = bloom(listed, blocks)
    filled = filled.select(F.col("block").alias(block), F.struct(*filled.columns[1:]).alias(words))
    placed = rows.withColumn(block, F.when(F.col(f"`{key}`").isNotNull(), _block(F.col(f"`{key}`"), blocks)))
    probed = placed.join(F.broadcast(filled) if blocks <= BROADCAST_BLOCKS else filled, block, "left")
    hit = F.col(words).isNotNull()
    for i, b in enumerate(_bits(F.col(f"`{key}`"))):
        hit = hit & (F.col(f"{words}.w{i}").bitwiseAND(b) != 0)
    return probed.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(hit, F.lit(False)).alias(flag))


def maybe_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose key passes the filter of listed: all that are listed, few others."""
    flag = fresh(rows, "maybe")
    return with_maybe(rows, key, listed, flag).filter(flag).drop(flag)


def only_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose key is listed: rows that miss the filter are not shuffled."""
    return _exact(maybe_listed(rows, key, listed), key, listed, "left_semi")


def without_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose key is not listed (or null): only rows that the filter
    lets pass go to the exact anti join."""
    flag = fresh(rows, "maybe")
    probed = with_maybe(rows, key, listed, flag)
    checked = _exact(probed.filter(flag), key, listed, "left_anti")
    return probed.filter(~F.col(flag)).unionByName(checked).drop(flag)


def _exact(rows: DataFrame, key: str, listed: DataFrame, how: str) -> DataFrame:
    other = fresh(rows, "listed_key")
    return rows.join(listed.toDF(other), F.col(f"`{key}`") == F.col(other), how)
