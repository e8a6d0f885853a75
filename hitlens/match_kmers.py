"""Command line: the k-mers of sequence files that are in a query signature.

    python -m hitlens.match_kmers QUERY.sig SEQ.fasta ... -k 8 --hp --output-kmers OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from hitlens.functions.alphabets import codon_ksize
from hitlens.operators.kmers import kmer_rows, matching_kmers
from hitlens.session import session
from hitlens.sources.sequences import match_headers, read_fasta, residues, read_signatures, signature_postings, write_fasta
from hitlens.sources.tables import save


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    p.add_argument("seqfiles", nargs="+")
    p.add_argument("--output-sequences")
    p.add_argument("--output-kmers")
    p.add_argument("--input-is-protein", action="store_true")
    p.add_argument("--first", action="store_true", help="only the first match of each file")
    p.add_argument("-k", "--ksize", type=int, required=True)
    kind = p.add_mutually_exclusive_group(required=True)
    for name in ("hp", "dayhoff", "protein", "dna"):
        kind.add_argument(f"--{name}", dest="moltype", action="store_const", const=name)
    return p


def main(argv: list[str] | None = None) -> int:
    """The number of matches; also written to the outputs that are named."""
    args = parser().parse_args(argv)
    spark = session()
    k = args.ksize if args.input_is_protein or args.moltype == "dna" else codon_ksize(args.ksize, True)
    if not args.input_is_protein and args.moltype != "dna":
        raise ValueError(f"--{args.moltype} needs protein sequences (--input-is-protein): nucleotides are not translated")
    stored = k if args.moltype == "dna" else 3 * k
    wanted = signature_postings(read_signatures(spark, args.query, stored, args.moltype))
    records = read_fasta(spark, args.seqfiles)
    keep = ["filename", "place", "sequence"]
    found = matching_kmers(kmer_rows(records, k, args.moltype, keep=keep), wanted, args.first, keep)
    if args.output_kmers:
        save(found.drop("place", "sequence"), args.output_kmers, "csv")
    if args.output_sequences:
        write_fasta(match_headers(found), args.output_sequences, "header")
    for r in residues(records).collect():  # a row a file
        print(f"{r.filename}: {r.records} records, {r.residues} residues")
    n = found.count()
    print(f"{n} matching k-mers")
    return n


if __name__ == "__main__":
    main()
