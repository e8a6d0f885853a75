"""Reduced alphabets, k-mers and their positions, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters by class. hp: hydrophobic and polar; dayhoff: six classes.
HP = {"h": "AFGILMPVWY", "p": "NCSTDERHKQ"}
DAYHOFF = {"a": "C", "b": "AGPST", "c": "DENQ", "d": "HKR", "e": "ILMV", "f": "FWY"}
CLASSES = {"hp": HP, "dayhoff": DAYHOFF}


def encode(seq: Column, alphabet: str | None) -> Column:
    """seq in the reduced alphabet; protein, DNA and None leave it as it is."""
    if alphabet in (None, "protein", "dna", "DNA"):
        return seq
    if alphabet not in CLASSES:
        raise ValueError(f"no alphabet {alphabet!r}: hp, dayhoff, protein or dna")
    groups = CLASSES[alphabet]
    return F.translate(seq, "".join(groups.values()), "".join(k * len(v) for k, v in groups.items()))


def kmers(seq: Column, k: Column | int) -> Column:
    """All k-mers in order; an empty array for a sequence shorter than k."""
    k = F.lit(k) if isinstance(k, int) else k
    places = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)))
    return F.when(F.length(seq) >= k, F.transform(places, lambda i: seq.substr(i, k))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    """The smaller of a DNA k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def codon_ksize(k: int, translated: bool) -> int:
    """k in letters of the encoded alphabet: a third, if k counts nucleotides."""
    if translated and k % 3:
        raise ValueError("k must be a multiple of 3 for translated input")
    return k // 3 if translated else k


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
