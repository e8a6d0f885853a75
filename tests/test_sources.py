"""Readers, writers, the command line and incremental cleaning."""

import pytest
from pyspark.sql import functions as F

from hitlens import match_kmers
from hitlens.functions.murmur import murmur_of
from hitlens.schema import HITS
from hitlens.sources import sequences, tables
from hitlens.streaming.incremental import clean_new_files


def signature(tmp_path, kmers, k=3):
    mins = ",".join(str(h % 2**64) for h in sorted(h % 2**64 for h in murmur_of(kmers)))
    path = tmp_path / "q.sig"
    path.write_text(f'[{{"class":"x","filename":"f.fa","name":"sig one","signatures":[{{"num":0,"ksize":{3 * k},"seed":42,"max_hash":18446744073709551615,"mins":[{mins}],"md5sum":"m","molecule":"hp"}}],"version":0.4}}]')
    return str(path)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first words\nMTRC\nmtrc\n>two\r\nAA\r\n>empty\n")
    out = {r.name: r for r in sequences.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert {k: r.sequence for k, r in out.items()} == {"one": "MTRCMTRC", "two": "AA", "empty": ""}
    assert out["one"].description == "first words"
    sequences.write_fasta(spark.createDataFrame([("n", "AC")], "name string, sequence string"), str(tmp_path / "out"))
    assert [r.sequence for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()] == ["AC"]


def test_signatures(spark, tmp_path):
    path = signature(tmp_path, ["hpp", "ppp"])
    sig = sequences.read_signatures(spark, path, 9, "hp").first()
    assert sig.name == "sig" and len(sig.mins) == 2
    assert sequences.read_signatures(spark, path, 12).count() == 0
    assert {r.hashval for r in sequences.signature_postings(sequences.read_signatures(spark, path)).collect()} == set(murmur_of(["hpp", "ppp"]))


def test_command_line(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one\nMTRCMTRC\n")
    n = match_kmers.main([signature(tmp_path, ["hpp"]), str(tmp_path / "a.fasta"), "-k", "3", "--input-is-protein", "--hp", "--output-kmers", str(tmp_path / "k"), "--output-sequences", str(tmp_path / "s")])
    assert n == 2 and spark.read.csv(str(tmp_path / "k"), header=True).count() == 2


def test_command_line_outputs(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one text\nMTRC\nMTRC\n>two\nMTRC\n")
    (tmp_path / "b.fasta").write_text(">three\nGGGG\n>four\nAMTR\n")
    sig, files = signature(tmp_path, ["hpp"]), [str(tmp_path / f) for f in ("a.fasta", "b.fasta")]
    rest = ["-k", "3", "--input-is-protein", "--hp", "--output-kmers", str(tmp_path / "k"), "--output-sequences", str(tmp_path / "s")]
    assert match_kmers.main([sig, *files, *rest]) == 4
    found = spark.read.csv(str(tmp_path / "k"), header=True)
    assert found.columns == ["kmer_in_sequence", "kmer_in_alphabet", "hashval", "start", "read_name", "filename"]
    assert {(r.read_name, r.start, r.filename.split("/")[-1]) for r in found.collect()} == {("one", "0", "a.fasta"), ("one", "4", "a.fasta"), ("two", "0", "a.fasta"), ("four", "1", "b.fasta")}
    # the whole record goes to the FASTA file, under the annotated name
    written = {r.name: r.sequence for r in sequences.read_fasta(spark, str(tmp_path / "s")).collect()}
    u = murmur_of(["hpp"])[0] % 2**64
    assert written == {f"{n}|hashval:{u}|kmer:MTR|kmer_encoded:hpp": t for n, t in (("one", "MTRCMTRC"), ("two", "MTRC"), ("four", "AMTR"))}
    assert match_kmers.main([sig, *files, *rest, "--first"]) == 2
    assert {(r.read_name, r.start) for r in spark.read.csv(str(tmp_path / "k"), header=True).collect()} == {("one", "0"), ("four", "1")}


def test_command_line_refuses_nucleotides(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one\nACGTACGTACGT\n")
    for k in ("9", "8"):
        with pytest.raises(ValueError):
            match_kmers.main([signature(tmp_path, ["hpp"]), str(tmp_path / "a.fasta"), "-k", k, "--hp"])


def test_shipped_layout_of_signatures(spark, tmp_path):
    # the fields and order of the files that the upstream tool writes, more than one sketch, no name in the second
    mins = sorted(h % 2**64 for h in murmur_of(["hhhhhhhh", "pppppppp", "hphphphph"]))
    sketch = '{"num":0,"ksize":%d,"seed":42,"max_hash":18446744073709551615,"mins":[%s],"md5sum":"x","molecule":"hp"}'
    head = '{"class":"sourmash_signature","email":"","hash_function":"0.murmur64","filename":"dir/f.fasta",%s"license":"CC0","signatures":[%s],"version":0.4}'
    two = ",".join(sketch % (k, ",".join(map(str, mins))) for k in (24, 27))
    (tmp_path / "q.sig").write_text("[" + head % ('"name":"bcl2 human",', two) + "," + head % ("", sketch % (24, "7")) + "]")
    out = {(r.name, r.ksize): [int(m) for m in r.mins] for r in sequences.read_signatures(spark, str(tmp_path / "q.sig")).collect()}
    assert out == {("bcl2", 24): mins, ("bcl2", 27): mins, ("dir/f.fasta", 24): [7]}
    assert mins == sorted([6405245933721206635, 2117825812541169435, 9056980627444632316])


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "query_name string, jaccard double")
    tables.save(df, str(tmp_path / "x.csv"), "csv")
    target = tables.transcode(spark, str(tmp_path / "x.csv"))
    assert target.endswith("x.pq") and tables.load(spark, target).count() == 1
    tables.save(df.limit(0), target, skip_existing=True)
    assert tables.load(spark, target).count() == 1 and "jaccard" in tables.schema_of(spark, target).names
    assert tables.load(spark, [target, target]).count() == 2 and tables.load(spark, [target, target], rows=1).count() == 1
    tables.save(df.withColumns({"moltype": F.lit("hp"), "ksize": F.lit(8)}), str(tmp_path / "sweep"), partition_by=["moltype", "ksize"])
    assert tables.sweep(spark, str(tmp_path / "sweep"), ["hp"], range(5, 9)).count() == 1
    assert tables.sweep(spark, str(tmp_path / "sweep"), ["hp"], range(9, 20)).count() == 0
    assert tables.as_text(df).first().line == "a\t1.0"


def test_incremental(spark, tmp_path):
    row = {f.name: ("x" if f.dataType.simpleString() == "string" else 2.0) for f in HITS}
    new = spark.createDataFrame([row | {"query_name": "a", "match_name": "b", "query_md5": "1", "match_md5": "2"}], HITS)
    q = spark.createDataFrame([("a", "f", "s", "o", "c")], "query_name string, query_family string, query_superfamily string, query_fold string, query_class string")
    m = q.toDF("match_name", "match_family", "match_superfamily", "match_fold", "match_class").withColumn("match_name", F.lit("b"))
    folder, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    for expected in (1, 2):
        new.write.mode("append").parquet(folder)
        clean_new_files(spark, folder, target, done, q, m, ["jaccard"], "hp", 8)
        assert spark.read.parquet(target).count() == expected
