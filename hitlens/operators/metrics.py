"""Classification metrics from grouped counts, without collecting scores.

Binary metrics start from the counts of positives and negatives at each
distinct score; the cumulative sums over these thresholds run in two levels
(within ranges of the score, then over the ranges), so that one group with very
many thresholds is not one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of thresholds into which a group's cumulative sums are split.
RANGES = 64


def running(counts: DataFrame, groups: list[str], value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """counts (a row for each group and distinct value) with upto_{s} for each of
    sums: the running sum over the values, made in two levels: within ranges of
    the value, then over the ranges."""
    cuts = counts.groupBy(*groups).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    before = F.filter("cuts", lambda c: c >= F.col(value) if descending else c < F.col(value))
    placed = _joined(counts, cuts, groups).withColumn("range", F.size(before)).drop("cuts")
    totals = placed.groupBy(*groups, "range").agg(*(F.sum(s).alias(f"of_{s}") for s in sums))
    earlier = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "range", *(F.coalesce(F.sum(f"of_{s}").over(earlier), F.lit(0)).alias(f"from_{s}") for s in sums))
    within = Window.partitionBy(*groups, "range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _joined(placed, starts, [*groups, "range"])
    return out.select(*counts.columns, *((F.col(f"from_{s}") + F.sum(s).over(within)).alias(f"upto_{s}") for s in sums))


def times(weight: str | None) -> Column:
    """How often a row counts: the column weight, once without one."""
    return F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")


def quantiles(df: DataFrame, groups: list[str], value: str, parts: dict[str, float], weight: str | None = None) -> DataFrame:
    """(groups, a column for each of parts): exact quantiles with interpolation
    between neighbours, from the counts of distinct values. Null values are left
    out. weight: a column that says how often a row counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.sum(times(weight)).alias("rows"))
    totals = counts.groupBy(*groups).agg(F.sum("rows").alias("all"))
    t = _joined(running(counts, groups, "v", ["rows"]), totals, groups)
    first, last = F.col("upto_rows") - F.col("rows"), F.col("upto_rows") - 1

    def at(place):
        return F.max(F.when((first <= place) & (place <= last), F.col("v")))

    columns = []
    for name, part in parts.items():
        place = (F.col("all") - 1) * F.lit(float(part))
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return t.groupBy(*groups).agg(*columns)


def thresholds(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(groups, threshold, tp, fp, p, n): cumulative counts at each distinct
    score, descending. Rows with a NULL label or a NULL or NaN score are left
    out; groups of one class only have no rows, as no curve is defined for them.
    weight, here and below: a column that says how often a row counts."""
    y = F.col(label).cast("int")
    rows = df.filter(y.isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = rows.groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(F.sum(y * times(weight)).alias("pos"), F.sum((1 - y) * times(weight)).alias("neg"))
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p > 0 AND n > 0")
    out = running(_joined(counts, totals, groups), groups, "threshold", ["pos", "neg"], descending=True)
    return out.select(*groups, "threshold", F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"), "p", "n", "pos", "neg")


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # without groups b is one row


#: Scorers over the rows of thresholds: a threshold adds pos/p of recall at its
#: precision, and a trapezoid of the ROC.
SCORERS: dict[str, Callable[[], Column]] = {
    "average_precision": lambda: F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))),
    "roc_auc": lambda: F.sum(F.col("neg") / F.col("n") * (F.col("tp") - F.col("pos") / 2) / F.col("p")),
    "prevalence": lambda: F.first("p") / (F.first("p") + F.first("n")),
}


def binary_scores(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(groups, average_precision, roc_auc, positives, negatives)."""
    scores = [SCORERS[s]().alias(s) for s in ("average_precision", "roc_auc")]
    return thresholds(df, groups, label, score, weight).groupBy(*groups).agg(*scores, F.first("p").alias("positives"), F.first("n").alias("negatives"))


def score_table(df: DataFrame, groups: list[str], label: str, score: str, scorers: dict[str, Callable[[], Column]] | None = None, weight: str | None = None) -> DataFrame:
    """(groups, metric, value): a row for each group and scorer (name -> aggregate over thresholds' rows)."""
    scorers = SCORERS if scorers is None else scorers
    wide = thresholds(df, groups, label, score, weight).groupBy(*groups).agg(*(make().cast("double").alias(name) for name, make in scorers.items()))
    return wide.unpivot(groups, list(scorers), "metric", "value")


def pr_curve(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(groups, precision, recall, threshold), and for each group the last point
    (1, 0) at its largest threshold."""
    t = thresholds(df, groups, label, score, weight)
    points = t.select(*groups, (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"), "threshold")
    last = t.groupBy(*groups).agg(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.max("threshold").alias("threshold"))
    return points.unionByName(last)


def roc_curve(df: DataFrame, groups: list[str], label: str, score: str, drop_intermediate: bool = True, weight: str | None = None) -> DataFrame:
    """(groups, fpr, tpr, threshold) with the point (0, 0) at an infinite
    threshold; drop_intermediate leaves out points between collinear neighbours."""
    t = thresholds(df, groups, label, score, weight)
    if drop_intermediate:
        order = Window.partitionBy(*groups).orderBy(F.desc("threshold"))
        after = t.withColumns({"pos1": F.lead("pos").over(order), "neg1": F.lead("neg").over(order)})
        t = after.filter("pos1 IS NULL OR pos * neg1 <> neg * pos1")
    points = t.select(*groups, (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), "threshold")
    start = t.groupBy(*groups).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(start)


def det_curve(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(groups, fpr, fnr, threshold) from the last point without false positives
    (or the first) to the first one with all true positives."""
    t = thresholds(df, groups, label, score, weight)
    ends = t.groupBy(*groups).agg(F.coalesce(F.min(F.when(F.col("fp") == 0, F.col("threshold"))), F.max("threshold")).alias("hi"), F.max(F.when(F.col("tp") == F.col("p"), F.col("threshold"))).alias("lo"))
    kept = _joined(t, ends, groups).filter("threshold <= hi AND threshold >= lo")
    return kept.select(*groups, (F.col("fp") / F.col("n")).alias("fpr"), (1 - F.col("tp") / F.col("p")).alias("fnr"), "threshold")


def confusion(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """(groups, y_true, y_pred, n), the non-zero cells."""
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*groups, F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, label, tp, support, predicted, precision, recall, f1) over the
    union of true and predicted labels; undefined values are 0."""
    cell = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    rows = cells.select(*groups, F.explode(cell).alias("x")).select(*groups, "x.*")
    sums = rows.groupBy(*groups, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))

    def part(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")

    return sums.withColumns({"precision": part(F.col("tp"), F.col("predicted")), "recall": part(F.col("tp"), F.col("support")), "f1": part(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def macro_scores(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1)."""
    return class_scores(cells, groups).groupBy(*groups).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
