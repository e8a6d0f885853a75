"""IEEE arithmetic where ANSI SQL has NULL or an error, and safe ranking keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_log10(c: Column) -> Column:
    """log10 with -inf for 0 and NaN below; NULL stays NULL."""
    c = c.cast("double")
    return F.when(c > 0, F.log10(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).when(F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is NULL or NaN."""
    return F.coalesce(F.nanvl(F.try_divide(a.cast("double"), b.cast("double")), F.lit(None).cast("double")), F.lit(0.0))


def reciprocal(c: Column) -> Column:
    """1 / c, infinite for 0."""
    return F.when(c == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), c.cast("double")))


def best_first(c: Column) -> Column:
    """Descending order in which NULL and NaN come last."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double")).desc_nulls_last()
