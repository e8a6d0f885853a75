"""Names to hierarchical metadata, level sizes and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.functions.names import level, token
from hitlens.schema import LEVELS


def extract_metadata(names: DataFrame, prefix: str, fixes: DataFrame | None = None, column: str = "name") -> DataFrame:
    """One row for each distinct name: {prefix}_name, {prefix}_scop_id,
    {prefix}_lineage_original, {prefix}_lineage and {prefix}_{level}.

    fixes (scop_id, lineage): corrected lineages, which take precedence; of
    several for an id the smallest counts. A name without a lineage has NULLs.
    """
    out = names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct()
    out = out.withColumn("scop_id", token(F.col("name"), 0)).withColumn("lineage_original", level(F.col("name"), "family"))
    if fixes is None:
        out = out.withColumn("lineage", F.col("lineage_original"))
    else:
        one = fixes.groupBy("scop_id").agg(F.min("lineage").alias("fixed"))
        out = out.join(one, "scop_id", "left").withColumn("lineage", F.coalesce("fixed", "lineage_original")).drop("fixed")
    out = out.select("name", "scop_id", "lineage_original", "lineage", *(level(F.col("lineage"), v).alias(v) for v in LEVELS))
    return prefixed(out, prefix)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with prefix and _ before their names."""
    return df.toDF(*(f"{prefix}_{c}" for c in df.columns))


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns renamed by replacing a substring, as query metadata becomes match metadata."""
    return df.toDF(*(c.replace(old, new) for c in df.columns))


def changed_lineages(metadata: DataFrame, prefix: str) -> DataFrame:
    """The names whose corrected lineage differs from the one in the name."""
    a, b = f"{prefix}_lineage", f"{prefix}_lineage_original"
    return metadata.filter(F.col(a).isNotNull() & (F.col(a) != F.coalesce(F.col(b), F.lit(""))))


def with_level_sizes(metadata: DataFrame, prefix: str = "query") -> DataFrame:
    """metadata with n_{level}: how many entities share the row's label of each level."""
    return metadata.withColumns({f"n_{v}": F.count(F.lit(1)).over(Window.partitionBy(f"{prefix}_{v}")) for v in LEVELS})


def label_table(metadata: DataFrame, prefix: str = "query") -> DataFrame:
    """The distinct labels, a row for each family (NULL included), with n_{level}:
    how many entities of metadata share the label."""
    counts = metadata.groupBy(*(F.col(f"{prefix}_{v}").alias(v) for v in LEVELS)).agg(F.count("*").alias("rows"))
    return counts.withColumns({f"n_{v}": F.sum("rows").over(Window.partitionBy(v)) for v in LEVELS}).drop("rows")


def level_sizes(metadata: DataFrame, prefix: str = "query") -> DataFrame:
    """(level, label, n): entities of each label of each level, in one aggregation."""
    pairs = F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"{prefix}_{v}").alias("label")) for v in LEVELS))
    rows = metadata.select(F.explode(pairs).alias("x")).select("x.*").filter("label IS NOT NULL")
    return rows.groupBy("level", "label").agg(F.count("*").alias("n"))
