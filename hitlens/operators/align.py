"""Stitching of overlapping k-mers and text alignments, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stitch(kmer_list: Column, strict: bool = True) -> Column:
    """array<struct<start, kmer>> in order of start, to one string: the first k-mer
    and the last letter of each further one. A gap raises if strict, else is NULL.
    An empty array is an empty string."""
    xs = F.array_sort(kmer_list)
    gap = F.exists(F.transform(xs, lambda x, i: (i > 0) & (x["start"] - F.get(xs, i - 1)["start"] != 1)), lambda b: F.coalesce(b, F.lit(False)))
    text = F.concat(F.coalesce(F.get(xs, F.lit(0))["kmer"], F.lit("")), F.array_join(F.transform(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x: F.substr(x["kmer"], F.lit(-1))), ""))
    wrong = F.raise_error(F.lit("the k-mers are not consecutive")) if strict else F.lit(None)
    return F.when(gap, wrong.cast("string")).otherwise(text)


def overlap_of(island: DataFrame, k: int, sequence: str, encoded: str) -> DataFrame:
    """islands (first, last) with their texts: index, length, overlap,
    overlap_encoded, and matched: whether the k-mers' span has its full length."""
    length = F.col("last") - F.col("first") + k
    rows = island.withColumns({"index": F.col("first"), "length": length})
    texts = {"overlap": F.substr(F.col(sequence), F.col("index") + 1, F.col("length")), "overlap_encoded": F.substr(F.col(encoded), F.col("index") + 1, F.col("length"))}
    return rows.withColumns(texts).withColumn("matched", F.length("overlap") == F.col("length"))


def verified(df: DataFrame, overlap: str, sequence: str, index: str) -> DataFrame:
    """df, failing at run time if an overlap is not the sequence's text at its index."""
    right = F.substr(F.col(sequence), F.col(index) + 1, F.length(overlap)) == F.col(overlap)
    return df.filter(F.assert_true(right, F.lit("an overlap differs from its sequence")).isNull())


def padding(own: Column, other: Column) -> Column:
    """Blanks that line an overlap at index own up with one at index other."""
    return F.repeat(F.lit(" "), F.greatest(other - own, F.lit(0)).cast("int"))


def segments(sequence: Column, index: Column, length: Column) -> Column:
    """The sequence with its overlap in brackets: before[overlap]after."""
    return F.concat(F.substr(sequence, F.lit(1), index), F.lit("["), F.substr(sequence, index + 1, length), F.lit("]"), F.substr(sequence, index + length + 1, F.length(sequence)))


def match_position(index: Column, length: Column) -> Column:
    """1-based, both ends included."""
    return F.concat(F.lit("Match from "), (index + 1).cast("string"), F.lit("-"), (index + length).cast("string"))


def alignment_text(df: DataFrame) -> DataFrame:
    """df (query_sequence, query_encoded, query_index, match_..., length) with
    alignment: both sequences and encodings around a ruler, overlaps in one column."""
    def line(side, other, kind):
        return F.concat(padding(F.col(f"{side}_index"), F.col(f"{other}_index")), F.col(f"{side}_{kind}"))

    ruler = F.concat(F.repeat(F.lit(" "), F.greatest("query_index", "match_index").cast("int")), F.repeat(F.lit("|"), F.col("length").cast("int")))
    lines = [line("query", "match", "sequence"), line("query", "match", "encoded"), ruler, line("match", "query", "encoded"), line("match", "query", "sequence")]
    return df.withColumn("alignment", F.array_join(F.array(*lines), "\n"))
