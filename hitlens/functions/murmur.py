"""MurmurHash3 x64-128 (first word) for columns of strings, vectorised.

Spark has no such hash, so an Arrow-fed pandas UDF computes it: strings of one
length are a byte matrix and are hashed together with NumPy's 64-bit words.
"""

from __future__ import annotations

import sys
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# executors get the UDF by value and need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def murmur64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """The first 64-bit word of MurmurHash3 x64-128 of each row of a byte matrix."""
    n, length = rows.shape
    h = [np.full(n, seed, np.uint64), np.full(n, seed, np.uint64)]
    blocks = length // 16
    padded = np.zeros((n, (blocks + 1) * 16), np.uint8)
    padded[:, :length] = rows
    words = padded.view("<u8")

    def scramble(k, first):
        a, b, r = (_C1, _C2, 31) if first else (_C2, _C1, 33)
        return _rotl(k * a, r) * b

    for i in range(blocks):
        h[0] = (_rotl(h[0] ^ scramble(words[:, 2 * i], True), 27) + h[1]) * np.uint64(5) + np.uint64(0x52DCE729)
        h[1] = (_rotl(h[1] ^ scramble(words[:, 2 * i + 1], False), 31) + h[0]) * np.uint64(5) + np.uint64(0x38495AB5)
    h[1] = h[1] ^ scramble(words[:, 2 * blocks + 1], False)  # the zero-padded tail
    h[0] = h[0] ^ scramble(words[:, 2 * blocks], True)
    h = [x ^ np.uint64(length) for x in h]
    h[0] = h[0] + h[1]
    h[1] = h[1] + h[0]
    return _final(h[0]) + _final(h[1])


def murmur_of(values: list[str | None], seed: int = 42) -> list[int | None]:
    """Signed 64-bit hashes of strings; None for None."""
    out: list[int | None] = [None] * len(values)
    by_length: dict[int, list[int]] = {}
    raw = [None if v is None else v.encode() for v in values]
    for i, v in enumerate(raw):
        if v is not None:
            by_length.setdefault(len(v), []).append(i)
    for length, which in by_length.items():
        matrix = np.frombuffer(b"".join(raw[i] for i in which), np.uint8).reshape(len(which), length)
        for i, x in zip(which, murmur64(matrix, seed).view(np.int64).tolist()):
            out[i] = x
    return out


@F.pandas_udf(LongType())
def _murmur(values: pd.Series) -> pd.Series:
    return pd.Series(murmur_of(values.tolist()), dtype="Int64")


def hashval(kmer: Column) -> Column:
    """The hash (seed 42) as BIGINT, the unsigned value's bits."""
    return _murmur(kmer)


def unsigned(h: Column) -> Column:
    """A BIGINT hash as the unsigned DECIMAL(20,0) that files show."""
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit(Decimal(1 << 64))).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")


def signed(u: Column) -> Column:
    """The inverse of unsigned."""
    return F.when(u >= F.lit(Decimal(1 << 63)), u - F.lit(Decimal(1 << 64))).otherwise(u).cast("long")


def sketch_md5(k: Column, mins: Column) -> Column:
    """md5 of a sketch: stored k (3 times the letters) and the ascending unsigned hashes."""
    return F.md5(F.concat(k.cast("string"), F.array_join(F.transform(F.array_sort(mins), lambda m: m.cast("string")), "")))
