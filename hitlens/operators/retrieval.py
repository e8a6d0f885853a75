"""Ranked retrieval: sensitivity up to the first false positive, ranks and running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.functions.numeric import best_first, ratio
from hitlens.schema import LEVELS


def scores_long(hits: DataFrame, scores: list[str], keep: list[str]) -> DataFrame:
    """A row for each hit and score: keep, score_name, score_value. Row-local."""
    pairs = F.array(*(F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("score_value")) for s in scores))
    return hits.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def ranked(hits: DataFrame, keys: list[str], tiebreak: list[Column | str] = ("match_name",)) -> DataFrame:
    """hits with rn, the place in the group's order by score_value; ties by tiebreak, NULL and NaN last."""
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(best_first(F.col("score_value")), *tiebreak)))


def sensitivity_first_fp(
    hits: DataFrame, scores: list[str], key: str = "query_scop_id", levels: list[str] = LEVELS, mode: str = "intent", all_queries: DataFrame | None = None, optimistic: bool = False
) -> DataFrame:
    """For each query and score: sensitivity_{level}, the share of the level's
    other n_{level} - 1 members found before the first false positive.

    A query without any false positive counts all its hits (mode "intent") or
    none (mode "argmin"). optimistic: ties in favour of true positives.
    all_queries (key): queries without hits are in the result with 0.
    Scores are unpivoted first, so all of them share one shuffle on the query.
    """
    if mode not in ("intent", "argmin"):
        raise ValueError(f"mode {mode!r}: intent or argmin")
    same, counts = [f"same_{v}" for v in levels], [f"n_{v}" for v in levels]
    rows = scores_long(hits, scores, [key, "match_name", *same, *counts])
    ties = [F.col(s).desc_nulls_last() for s in reversed(same)] if optimistic else []
    rows = ranked(rows, [key, "score_name"], [*ties, F.col("match_name")])
    found = rows.groupBy(key, "score_name").agg(
        F.count("*").alias("hits"),
        *(F.min(F.when(~F.coalesce(F.col(s), F.lit(False)), F.col("rn"))).alias(f"fp_{v}") for v, s in zip(levels, same)),
        *(F.first(c, ignorenulls=True).alias(c) for c in counts),
    )
    none = F.col("hits") if mode == "intent" else F.lit(0)
    out = found.select(key, "score_name", *(ratio(F.coalesce(F.col(f"fp_{v}") - 1, none), F.col(f"n_{v}") - 1).alias(f"sensitivity_{v}") for v in levels))
    return out if all_queries is None else with_all_queries(out, all_queries, scores, key)


def with_all_queries(sensitivity: DataFrame, all_queries: DataFrame, scores: list[str], key: str = "query_scop_id") -> DataFrame:
    """A row for each of all_queries (key) and score: queries without hits have 0."""
    wanted = all_queries.select(key).distinct().withColumn("score_name", F.explode(F.array(*map(F.lit, scores))))
    return wanted.join(sensitivity, [key, "score_name"], "left").na.fill(0.0)


def tidy(sensitivity: DataFrame, key: str = "query_scop_id", levels: list[str] = LEVELS) -> DataFrame:
    """(key, score_name, lineage, sensitivity): one row a level."""
    return sensitivity.unpivot([key, "score_name"], [f"sensitivity_{v}" for v in levels], "lineage", "sensitivity").withColumn("lineage", F.replace("lineage", F.lit("sensitivity_"), F.lit("")))


def with_rank(tidied: DataFrame, key: str = "query_scop_id") -> DataFrame:
    """sensitivity_rank within score and level, the most sensitive first, ties by key."""
    window = Window.partitionBy("score_name", "lineage").orderBy(F.desc("sensitivity"), key)
    return tidied.withColumn("sensitivity_rank", F.row_number().over(window))


def with_fraction(tidied: DataFrame, key: str = "query_scop_id") -> DataFrame:
    """fraction_queries: 0 to 1 evenly over the queries of a score and level, the most sensitive first."""
    group = ["score_name", "lineage"]
    sizes = tidied.groupBy(*group).agg((F.count("*") - 1).alias("last"))
    return with_rank(tidied, key).join(sizes, group).withColumn("fraction_queries", ratio(F.col("sensitivity_rank") - 1, F.col("last"))).drop("last")


def extreme_rows(df: DataFrame, groups: list[str], by: str, ties: list[str], largest: bool = True) -> DataFrame:
    """The row of the largest (or smallest) value in each group, ties by the smallest of ties.
    An aggregation with map-side combine: no group is sorted or gathered."""
    value = F.col(by).cast("double")
    ordered = F.struct((-value if largest else value).alias("v"), *ties)
    rest = [c for c in df.columns if c not in groups]
    return df.filter(F.col(by).isNotNull()).groupBy(*groups).agg(F.min_by(F.struct(*rest), ordered).alias("row")).select(*groups, "row.*").select(*df.columns)


def running(hits: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Over each group's ranking (rn): tp, the running sum of flag, and clean, its running minimum."""
    window = Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce(F.col(flag), F.lit(False)).cast("long")
    return hits.withColumns({"tp": F.sum(value).over(window), "clean": F.min(value).over(window)})


def same_counts(hits: DataFrame, keys: list[str], levels: list[str] = LEVELS) -> DataFrame:
    """True positives of each level by group: same_{level} (count) and any_{level}."""
    sums = [F.coalesce(F.sum(F.col(f"same_{v}").cast("long")), F.lit(0)).alias(f"same_{v}") for v in levels]
    return hits.groupBy(*keys).agg(*sums).withColumns({f"any_{v}": F.col(f"same_{v}") > 0 for v in levels})


def sensitivity_of_counts(counts: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """recall_{level} = same_{level} / (n_{level} - 1), 0 for a level of one member."""
    return counts.withColumns({f"recall_{v}": F.when(F.col(f"n_{v}") > 1, F.col(f"same_{v}") / (F.col(f"n_{v}") - 1)).otherwise(0.0) for v in levels})
