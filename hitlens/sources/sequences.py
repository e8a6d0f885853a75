"""FASTA files and signature files as DataFrames."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.functions.murmur import signed
from hitlens.schema import SIGNATURE_JSON


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, description, sequence, filename, place): a row for each record, split
    at ">" line starts; the name is the first word of the header, the sequence
    upper-case; places grow along a file. Files are split between tasks like other text."""
    # a record begins with > after a line break; the file's first one is stripped below
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("filename", F.input_file_name())
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = records.filter(F.trim("value") != "").withColumn("body", body)
    head = F.trim(F.substring_index("body", "\n", 1))
    tail = F.when(F.instr("body", "\n") > 0, F.substr(F.col("body"), F.instr("body", "\n") + 1)).otherwise("")
    return rows.select(
        F.regexp_extract(head, r"^(\S+)", 1).alias("name"),
        F.regexp_replace(head, r"^\S+\s*", "").alias("description"),
        F.upper(F.regexp_replace(tail, r"\s+", "")).alias("sequence"),
        "filename",
        F.monotonically_increasing_id().alias("place"),
    )


def residues(sequences: DataFrame) -> DataFrame:
    """(filename, records, residues): what a scan of sequence files has read."""
    return sequences.groupBy("filename").agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("residues"))


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence))).write.mode("overwrite").text(path)


def match_headers(matches: DataFrame) -> DataFrame:
    """KMER_MATCHES with header: name|hashval:...|kmer:...|kmer_encoded:..."""
    parts = [F.col("read_name"), F.concat(F.lit("hashval:"), F.col("hashval").cast("string")), F.concat(F.lit("kmer:"), "kmer_in_sequence"), F.concat(F.lit("kmer_encoded:"), "kmer_in_alphabet")]
    return matches.withColumn("header", F.array_join(F.array(*parts), "|"))


def write_signatures(sketches: DataFrame, path: str, k: int, molecule: str, filename: str) -> None:
    """Sketches (name, mins, md5) as JSON signatures, one to a line; read_signatures
    with lines=True reads them. The stored ksize is 3 times the letters k."""
    full = F.lit(Decimal((1 << 64) - 1)).cast("decimal(20,0)")
    sketch = F.struct(F.lit(0).alias("num"), F.lit(3 * k).alias("ksize"), F.lit(42).alias("seed"), full.alias("max_hash"), "mins", F.col("md5").alias("md5sum"), F.lit(molecule).alias("molecule"))
    head = {"class": "sourmash_signature", "email": "", "hash_function": "0.murmur64", "filename": filename}
    signature = F.struct(*(F.lit(v).alias(n) for n, v in head.items()), "name", F.lit("CC0").alias("license"), F.array(sketch).alias("signatures"), F.lit(0.4).alias("version"))
    sketches.select(F.to_json(F.array(signature)).alias("value")).write.mode("overwrite").text(path)


def read_signatures(spark: SparkSession, path: str | list[str], ksize: int | None = None, molecule: str | None = None, lines: bool = False) -> DataFrame:
    """(name, filename, ksize, molecule, md5sum, mins): a row for each sketch of
    JSON signature files; ksize as stored. The name is its first word, or the file's.
    lines: every line is a JSON array of signatures, not the whole file."""
    raw = spark.read.option("wholetext", not lines).text(path)
    sigs = raw.select(F.explode(F.from_json("value", SIGNATURE_JSON)).alias("s")).select(F.coalesce("s.name", "s.filename").alias("full"), "s.filename", F.explode("s.signatures").alias("x"))
    out = sigs.select(F.regexp_extract("full", r"^(\S+)", 1).alias("name"), "filename", "x.ksize", "x.molecule", "x.md5sum", "x.mins")
    if ksize is not None:
        out = out.filter(F.col("ksize") == ksize)
    return out if molecule is None else out.filter(F.lower("molecule") == molecule.lower())


def signature_postings(signatures: DataFrame) -> DataFrame:
    """(name, hashval) with signed hashes, as the k-mer operators have them."""
    return signatures.select("name", F.explode("mins").alias("u")).select("name", signed(F.col("u")).alias("hashval"))
