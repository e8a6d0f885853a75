"""Long tables of scores by levels, counts, summaries and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.functions.names import last_token
from hitlens.operators.metrics import quantiles, running, times
from hitlens.operators.retrieval import scores_long
from hitlens.schema import LEVELS


def levels_long(hits: DataFrame, keep: list[str], levels: list[str] = LEVELS) -> DataFrame:
    """keep, scop_level, is_same: a row for each hit and level."""
    return hits.unpivot(keep, [f"same_{v}" for v in levels], "scop_level", "is_same").withColumn("scop_level", last_token(F.col("scop_level")))


def score_level_long(hits: DataFrame, scores: list[str], keep: list[str], levels: list[str] = LEVELS) -> DataFrame:
    """keep, score_name, score_value, scop_level, is_same: scores x levels of each
    hit, made from its own row instead of a join of two long tables."""
    return scores_long(levels_long(hits, [*keep, *scores], levels), scores, [*keep, "scop_level", "is_same"])


def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(columns, n) by n descending, then the values; top: only so many."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), *columns).limit(top)


def score_summary(long: DataFrame, groups: list[str], weight: str | None = None) -> DataFrame:
    """Mean, median, quartiles, spread and count of score_value; infinite and NaN
    values count as missing. weight: a column that says how often a row counts."""
    v = F.col("score_value")
    good = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    rows = long.select(*groups, good.alias("score_value"), times(weight).alias("times"))
    rows = rows.groupBy(*groups, "score_value").agg(F.sum("times").alias("times"))
    known = F.when(F.col("score_value").isNotNull(), F.col("times"))
    sums = rows.groupBy(*groups).agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), (F.sum(F.col("score_value") * known) / F.sum(known)).alias("mean"))
    off = F.col("score_value") - F.col("mean")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    spread = rows.alias("a").join(sums.alias("b"), same).groupBy(*(F.col(f"a.{g}").alias(g) for g in groups)).agg(F.sum(off * off * F.col("times")).alias("squares"))
    middle = quantiles(rows, groups, "score_value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, "times")
    out = sums.join(spread, groups, "left").withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))))
    return out.join(middle, groups, "left").select(*groups, "n", "mean", "median", "q1", "q3", "sd")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, sd, least, most) of each numeric column, NULLs left out."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column_name", "v")
    return long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


def mean_interval(df: DataFrame, groups: list[str], value: str, width: float = 1.96) -> DataFrame:
    """(groups, n, mean, low, high): the mean and width standard errors around it."""
    out = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    error = F.lit(width) * F.col("sd") / F.sqrt("n")
    return out.select(*groups, "n", "mean", (F.col("mean") - error).alias("low"), (F.col("mean") + error).alias("high"))


def cumulative_share(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n, share): the share of a group's rows up to each distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("all"))
    out = running(counts, groups, value, ["n"]).join(totals, groups)
    return out.select(*groups, value, "n", (F.col("upto_n") / F.col("all")).alias("share"))


def per_group(df: DataFrame, keys: list[str], function, schema) -> DataFrame:
    """A Python function of each group's pandas frame, for what column functions
    cannot say. A group is one task's memory: groups have to be small."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def histogram(df: DataFrame, groups: list[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """(groups, bin, n): counts of column in equal bins; 0 and bins + 1 are what is outside."""
    return df.filter(F.col(column).isNotNull()).groupBy(*groups, F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def pivot_max(hits: DataFrame, key: str, label: str, labels: list[str], value: str) -> DataFrame:
    """A column for each of labels: the key's largest value, 0 without a hit."""
    return hits.groupBy(key).pivot(label, labels).agg(F.max(value)).na.fill(0.0, labels)


def predicted_label(hits: DataFrame, key: str, label: str, labels: DataFrame, value: str) -> DataFrame:
    """(key, predicted, score): the label of the key's largest value, where a label
    without a hit has the value 0; ties go to the smaller label.

    labels: the labels as a table. Only the best label and, for negative values,
    the smallest label without a hit can win, so nothing is pivoted.
    """
    best = hits.groupBy(key, label).agg(F.max(value).alias("v"))
    top = best.groupBy(key).agg(F.min(F.struct((-F.col("v")).alias("m"), F.col(label).alias("l"))).alias("top"), F.collect_set(label).alias("seen"))
    every = labels.select(F.col(labels.columns[0]).alias("l")).distinct().agg(F.sort_array(F.collect_set("l")).alias("all"))
    rows = top.crossJoin(F.broadcast(every))  # one row: the few labels of a level
    missing = F.get(F.filter("all", lambda x: ~F.array_contains("seen", x)), F.lit(0))
    zero = F.when(missing.isNotNull(), F.struct(F.lit(0.0).alias("m"), missing.alias("l")))
    chosen = F.least(F.col("top"), F.coalesce(zero, F.col("top")))
    return rows.select(key, chosen["l"].alias("predicted"), (-chosen["m"] + 0.0).alias("score"))


def true_label_score(hits: DataFrame, key: str, value: str) -> DataFrame:
    """(key, score): the largest value of a hit of the key's own class, 0 without."""
    own = F.when(F.col("query_class") == F.col("match_class"), F.col(value))
    return hits.groupBy(key).agg(F.coalesce(F.max(own), F.lit(0.0)).alias("score"))
