"""Cleaning and annotation of all-versus-all hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from hitlens.functions.names import level, token
from hitlens.functions.numeric import ieee_log10, reciprocal
from hitlens.schema import COUNTS, LEVELS


def drop_spurious(hits: DataFrame, least: int = 2) -> DataFrame:
    """Without hits of a sequence with itself (by md5) and hits of fewer than `least` shared hashes."""
    return hits.filter((F.col("query_md5") != F.col("match_md5")) & (F.col("intersect_hashes") >= least))


def drop_self_by_name(hits: DataFrame) -> DataFrame:
    """Without hits of a name with itself; equal sequences of other names stay."""
    return hits.filter("query_name <> match_name")


def annotate(hits: DataFrame, query_metadata: DataFrame, match_metadata: DataFrame, how: str = "inner") -> DataFrame:
    """hits with both sides' metadata; how="left" keeps hits of unknown names.
    The metadata side is broadcast if Spark knows it to be small, else sort-merged."""
    return hits.join(query_metadata, "query_name", how).join(match_metadata, "match_name", how)


def annotate_by_name(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """annotate for names that carry their lineage: a hit's own row has its ids
    and families, and labels (lineage.label_table) the rest, so hits do not move.
    Labels are few; a staged table of them is broadcast by Spark."""
    out = hits.filter("query_name IS NOT NULL AND match_name IS NOT NULL")
    for side in ("query", "match"):
        name = F.col(f"{side}_name")
        out = out.withColumns({f"{side}_scop_id": token(name, 0), "own": level(name, "family")})
        of = labels.select(*(F.col(v).alias(f"{side}_{v}") for v in LEVELS), *(COUNTS if side == "query" else []))
        out = out.join(of, F.col("own").eqNullSafe(F.col(f"{side}_family")), "left").drop("own")
    return out


def with_same(hits: DataFrame, columns: list[str] = LEVELS, null_is_false: bool = False) -> DataFrame:
    """same_{c} = (query_{c} = match_{c}); with null_is_false a NULL side is a difference."""
    flags = {f"same_{c}": F.col(f"query_{c}") == F.col(f"match_{c}") for c in columns}
    return hits.withColumns({k: F.coalesce(v, F.lit(False)) if null_is_false else v for k, v in flags.items()})


def with_log10(hits: DataFrame, columns: list[str]) -> DataFrame:
    return hits.withColumns({f"log10_{c}": ieee_log10(F.col(c)) for c in columns})


def tagged(df: DataFrame, **values) -> DataFrame:
    """df with literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def clean_hits(hits: DataFrame, query_metadata: DataFrame, match_metadata: DataFrame, logged: list[str], moltype: str, ksize: int, how: str = "inner") -> DataFrame:
    """Filter, annotate, flag, log-scale and tag in one pass; the filter stands
    before the joins, so spurious hits never move."""
    out = annotate(drop_spurious(hits), query_metadata, match_metadata, how)
    return tagged(with_log10(with_same(out, null_is_false=how == "left"), logged), moltype=moltype, ksize=ksize)


def zero_self_scores(hits: DataFrame, scores: list[str], sides: tuple[str, str] = ("query_md5", "match_md5")) -> DataFrame:
    """Scores of a sequence with itself become 0; sides: the columns that tell sequences apart."""
    return hits.withColumns({c: F.when(F.col(sides[0]) == F.col(sides[1]), 0.0).otherwise(F.col(c).cast("double")) for c in scores})


def with_reciprocal(hits: DataFrame, column: str) -> DataFrame:
    return hits.withColumn(f"inverse_{column}", reciprocal(F.col(column)))


def within_query_levels(hits: DataFrame, query_metadata: DataFrame, column: str) -> DataFrame:
    """match_{column} becomes NULL where no query has that label."""
    known = query_metadata.select(F.col(f"query_{column}").alias("known")).distinct()
    joined = hits.join(known, F.col(f"match_{column}") == F.col("known"), "left")
    return joined.withColumn(f"match_{column}", F.col("known")).drop("known")


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of a type: "double" or "boolean"."""
    wanted = {"double": DoubleType(), "boolean": BooleanType()}[kind]
    return [f.name for f in df.schema if f.dataType == wanted]


def first_column(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(c for c in df.columns if c != key))


def only_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among keys' column of the same name."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def seeded_keys(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct values of a column, chosen by the md5 of seed and value."""
    return df.select(column).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column))), column).limit(n)


def page(df: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of equal keys the first in order, without a window's sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*").select(*df.columns)
