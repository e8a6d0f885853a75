"""Parsing of hierarchical names such as `d4j42a_ a.25.3.0 (A:) text`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitlens.schema import LEVELS

#: Fixed value: the label format. Groups 1 to 4 are family, superfamily, fold and class.
LINEAGE = r"(((([a-z])\.\d+)\.\d+)\.\d+)"


def token(c: Column, i: int) -> Column:
    """The i-th white-space token, NULL if there are fewer."""
    return F.get(F.split(F.trim(c), r"\s+"), F.lit(i))


def last_token(c: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(c, sep), -1)


def level(c: Column, name: str) -> Column:
    """One level of the lineage in c, NULL without a lineage."""
    return F.nullif(F.regexp_extract(c, LINEAGE, LEVELS.index(name) + 1), F.lit(""))


def levels(c: Column, prefix: str = "") -> list[Column]:
    return [level(c, v).alias(prefix + v) for v in LEVELS]
