"""k-mer tables of sequences: sets, overlaps, sketches and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.functions.alphabets import canonical, encode, kmers
from hitlens.functions.murmur import hashval, sketch_md5, unsigned
from hitlens.operators import overlaps


def kmer_rows(sequences: DataFrame, k: Column | int, alphabet: str | None = None, name: str = "name", sequence: str = "sequence", keep: list[str] | None = None) -> DataFrame:
    """(name, keep, start, kmer, encoded): every k-mer with its 0-based start,
    upper-cased; sequences shorter than k have none. DNA k-mers are canonical."""
    seq = F.upper(F.col(sequence))
    k = F.lit(k) if isinstance(k, int) else k
    keep = keep or []
    rows = sequences.select(F.col(name).alias("name"), *keep, seq.alias("seq"), k.cast("int").alias("k_"))
    rows = rows.select("name", *keep, "seq", "k_", F.posexplode(kmers(F.col("seq"), F.col("k_"))).alias("start", "kmer"))
    encoded = canonical(F.col("kmer")) if alphabet in ("dna", "DNA") else encode(F.col("kmer"), alphabet)
    return rows.select("name", *keep, "start", "kmer", encoded.alias("encoded"))


def kmer_counts(rows: DataFrame) -> DataFrame:
    """(encoded, n): how often each encoded k-mer occurs."""
    return rows.groupBy("encoded").agg(F.count("*").alias("n"))


def sequence_stats(sequences: DataFrame, ks: range, alphabet: str | None, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """(name, k, n_kmers, n_unique) for every k of ks: one row-local array per k, no shuffle."""
    by_k = sequences.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    found = kmers(encode(F.upper(F.col(sequence)), alphabet), F.col("k"))
    sets = by_k.select(F.col(name).alias("name"), "k", found.alias("found"))
    return sets.select("name", "k", F.size("found").alias("n_kmers"), F.size(F.array_distinct("found")).alias("n_unique"))


def jaccard_sweep(pairs: DataFrame, ks: range, alphabet: str | None) -> DataFrame:
    """pairs (query, match, query_sequence, match_sequence): for each k of ks the
    k-mer counts of both, their intersection, union, Jaccard similarity and the
    first positions of shared k-mers on both sides, in order of position."""
    rows = pairs.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    for side in ("query", "match"):
        rows = rows.withColumn(side[0], kmers(encode(F.upper(F.col(f"{side}_sequence")), alphabet), F.col("k")))
    rows = rows.withColumns({"qs": F.array_distinct("q"), "ms": F.array_distinct("m")}).withColumn("shared", F.array_intersect("qs", "ms"))

    def positions(side: str) -> Column:
        own = F.col(side)
        return F.array_sort(F.transform("shared", lambda x: F.struct((F.array_position(own, x) - 1).cast("int").alias("pos"), x.alias("kmer"))))

    union = F.size("qs") + F.size("ms") - F.size("shared")
    return rows.select(
        "query",
        "match",
        F.col("k").alias("ksize"),
        F.size("q").alias("query_n_kmers"),
        F.size("qs").alias("query_n_unique_kmers"),
        F.size("m").alias("match_n_kmers"),
        F.size("ms").alias("match_n_unique_kmers"),
        F.size("shared").alias("intersection"),
        union.alias("union"),
        F.when(union > 0, F.size("shared") / union).otherwise(0.0).alias("jaccard"),
        positions("q").alias("query_intersection_positions"),
        positions("m").alias("match_intersection_positions"),
    )


def any_position_within(positions: Column, first: int, last: int) -> Column:
    """Whether an array of (pos, kmer) has a position from first to last."""
    return F.exists(positions, lambda p: p["pos"].between(first, last))


def postings(sequences: DataFrame, k: int, alphabet: str | None, **columns) -> DataFrame:
    """(name, hashval): the distinct hashes of each sequence's encoded k-mers."""
    rows = kmer_rows(sequences, k, alphabet, **columns).select("name", "encoded").distinct()
    # a k-mer is hashed once, however many sequences have it
    hashed = rows.select("encoded").distinct().withColumn("hashval", hashval(F.col("encoded")))
    return rows.join(hashed, "encoded").select("name", "hashval")


def sketches(posts: DataFrame, k: int) -> DataFrame:
    """(name, mins, n, md5): ascending unsigned hashes; stored k is 3 times the letters."""
    out = posts.groupBy("name").agg(F.sort_array(F.collect_set(unsigned(F.col("hashval")))).alias("mins"))
    return out.select("name", "mins", F.size("mins").alias("n"), sketch_md5(F.lit(3 * k), F.col("mins")).alias("md5"))


def compare_sets(posts: DataFrame, key: str = "name", element: str = "hashval", least: int = 1) -> DataFrame:
    """All pairs of sets that share at least `least` elements: query, match,
    n_query, n_match, common, only_query, only_match, union, containment (of the
    query), max_containment, jaccard. A pair of a set with itself included.
    Repeated rows of posts count once. The postings are written at the call."""
    at = overlaps.store(posts.select(key, element))
    kind = posts.schema[key].dataType
    rows = overlaps.pairs(posts.sparkSession, at, least, not at.plain).withColumns({c: F.col(c).cast(kind) for c in ("query", "match")})
    union = F.col("n_query") + F.col("n_match") - F.col("common")
    return rows.select(
        "query",
        "match",
        "n_query",
        "n_match",
        "common",
        (F.col("n_query") - F.col("common")).alias("only_query"),
        (F.col("n_match") - F.col("common")).alias("only_match"),
        union.alias("union"),
        (F.col("common") / F.col("n_query")).alias("containment"),
        (F.col("common") / F.least("n_query", "n_match")).alias("max_containment"),
        (F.col("common") / union).alias("jaccard"),
    )


def matching_kmers(rows: DataFrame, signature: DataFrame, first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The k-mers (kmer_rows) whose hash is in signature (hashval): KMER_MATCHES
    rows with the unsigned hash, and the columns keep of rows. first: only the
    first one of each file, or without a kept column filename of each sequence;
    sequences are in the order of a kept column place, if there is one."""
    keep = keep or []
    hashed = rows.select("encoded").distinct().withColumn("hashval", hashval(F.col("encoded"))).join(signature.select("hashval").distinct(), "hashval", "left_semi")
    found = rows.join(hashed, "encoded").select(F.col("kmer").alias("kmer_in_sequence"), F.col("encoded").alias("kmer_in_alphabet"), unsigned(F.col("hashval")).alias("hashval"), "start", F.col("name").alias("read_name"), *keep)
    if not first:
        return found
    key = "filename" if "filename" in keep else "read_name"
    order = F.struct(*(["place"] if "place" in keep else []), "read_name", "start")
    return found.groupBy(F.col(key).alias("key")).agg(F.min_by(F.struct(*found.columns), order).alias("f")).select("f.*")


def merge_kmers(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """The inner join of two k-mer tables; of the other columns those that both
    have get the suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    sides = [df.select(*(F.col(c).alias(c + end if c in both else c) for c in df.columns)) for df, end in zip((a, b), suffixes)]
    return sides[0].join(sides[1], on)


def islands(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive starts in matches (keys, start): (keys, first, last, n)."""
    rows = matches.select(*keys, "start").distinct()
    run = F.col("start") - F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    return rows.withColumn("run", run).groupBy(*keys, "run").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("n")).drop("run")
