"""Registers move only for classes that are in a pair."""

from pyspark.sql import functions as F

from hitlens.llm import near_dup


def test_registers_of_classes_in_no_pair_stay(spark):
    classes = spark.range(20000).select(F.xxhash64("id").alias("node"), F.col("id").alias("n"), F.lit(b"r" * 40).alias("regs"), "id")
    few = near_dup._registers_of(classes.filter("id < 30").select("node").union(classes.filter("id < 10").select("node")), classes)
    assert few.columns == ["node", "n", "regs"]
    got = sorted(r.n for r in few.collect())
    assert got[:30] == list(range(30)) and len(got) < 300
    assert near_dup._registers_of(classes.filter("id < 0").select("node"), classes).count() == 0
