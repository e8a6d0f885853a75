"""Edge cases of the operators on small hand-made tables."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitlens.functions.alphabets import canonical, codon_ksize, encode, kmers
from hitlens.functions.murmur import murmur_of, signed, sketch_md5, unsigned
from hitlens.functions.names import levels, token
from hitlens.functions.numeric import ieee_log10, ratio, reciprocal
from hitlens.operators import align, hits, kmers as K, lineage, longform, metrics, retrieval
from hitlens.schema import COUNTS, LEVELS, SAME

FLAGS = {
    "q1": [("m1", 0.9, "TTTT"), ("m2", 0.8, "FTTT"), ("m3", 0.7, "FFTT"), ("m4", 0.6, "FFFF")],
    "q2": [("m1", 0.5, "TTTT")],
    "q3": [("m1", 0.5, "FFFF")],
    "q4": [("ma", 0.5, "FFTT"), ("mb", 0.5, "TTTT")],
}
SIZES = {"q1": (3, 4, 5, 10), "q2": (2, 2, 2, 2), "q3": (1, 1, 1, 1), "q4": (3, 3, 3, 3)}


def ranked_hits(spark):
    rows = [(q, m, s, *(c == "T" for c in f), *SIZES[q]) for q, found in FLAGS.items() for m, s, f in found]
    return spark.createDataFrame(rows, ["query_scop_id", "match_name", "score", *SAME, *COUNTS])


def sensitivity(spark, **options):
    out = retrieval.sensitivity_first_fp(ranked_hits(spark), ["score"], **options).collect()
    return {r.query_scop_id: tuple(round(r[f"sensitivity_{v}"], 6) for v in LEVELS) for r in out}


def test_sensitivity_counts_all_hits_without_a_false_positive(spark):
    assert sensitivity(spark) == {"q1": (0.5, 0.666667, 0.75, 0.333333), "q2": (1, 1, 1, 1), "q3": (0, 0, 0, 0), "q4": (0, 0, 1, 1)}


def test_sensitivity_argmin_counts_none(spark):
    out = sensitivity(spark, mode="argmin")
    assert out["q2"] == out["q4"] == (0, 0, 0, 0) and out["q1"] == (0.5, 0.666667, 0.75, 0.333333)


def test_sensitivity_keeps_queries_without_hits(spark):
    every = spark.createDataFrame([("q1",), ("q9",)], ["query_scop_id"])
    assert set(sensitivity(spark, all_queries=every)) == {"q1", "q9"}
    assert sensitivity(spark, optimistic=True)["q4"] == (0.5, 0.5, 1, 1)
    with pytest.raises(ValueError):
        retrieval.sensitivity_first_fp(ranked_hits(spark), ["score"], mode="other")


def test_null_and_nan_scores_rank_last(spark):
    df = spark.createDataFrame([("q", "a", None), ("q", "b", float("nan")), ("q", "c", -1.0), ("q", "d", float("-inf"))], "q string, match_name string, score_value double")
    order = [r.match_name for r in retrieval.ranked(df, ["q"]).orderBy("rn").collect()]
    assert order == ["c", "d", "a", "b"]
    best = retrieval.extreme_rows(df.filter("NOT isnan(score_value)"), ["q"], "score_value", ["match_name"]).collect()
    assert [r.match_name for r in best] == ["c"]


def test_numeric(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,), (None,)], "x double")
    a, b, c, d = [r[0] for r in df.select(ieee_log10(F.col("x"))).collect()]
    assert (a, b, d) == (2.0, float("-inf"), None) and math.isnan(c)
    one = spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0)).alias("a"), reciprocal(F.lit(0.0)).alias("b")).first()
    assert (one.a, one.b) == (0.0, float("inf"))


def test_lineage(spark):
    names = spark.createDataFrame([("d4j42a_ a.25.3.0 (A:) automated matches",), ("x nolineage",), ("x nolineage",), (None,)], "name string")
    fixes = spark.createDataFrame([("d4j42a_", "a.26.1.1")], "scop_id string, lineage string")
    out = {r.query_scop_id: r for r in lineage.extract_metadata(names, "query", fixes).collect()}
    assert len(out) == 2 and out["d4j42a_"].query_fold == "a.26" and out["x"].query_family is None
    assert lineage.changed_lineages(lineage.extract_metadata(names, "query", fixes), "query").count() == 1
    plain = names.select(*levels(F.col("name")), token(F.col("name"), 9).alias("t")).first()
    assert plain[:4] == ("a.25.3.0", "a.25.3", "a.25", "a") and plain.t is None


def test_cleaning(spark):
    rows = [("a", "1", "b", "2", 3.0, 0.0), ("a", "1", "a2", "1", 9.0, 1.0), ("a", "1", "c", "3", 1.0, 0.1), ("a", "1", "z", "4", 2.0, 0.5)]
    h = spark.createDataFrame(rows, "query_name string, query_md5 string, match_name string, match_md5 string, intersect_hashes double, jaccard double")
    q = spark.createDataFrame([("a", "f", "s", "o", "k")], "query_name string, query_family string, query_superfamily string, query_fold string, query_class string")
    m = spark.createDataFrame([("b", "f", "s", "o", "x"), ("c", "f", "s", "o", "k")], "match_name string, match_family string, match_superfamily string, match_fold string, match_class string")
    inner = hits.clean_hits(h, q, m, ["jaccard"], "hp", 8).collect()
    assert [(r.match_name, r.same_family, r.same_class, r.log10_jaccard, r.moltype, r.ksize) for r in inner] == [("b", True, False, float("-inf"), "hp", 8)]
    left = {r.match_name: r for r in hits.clean_hits(h, q, m, ["jaccard"], "hp", 8, how="left").collect()}
    assert set(left) == {"b", "z"} and left["z"].same_family is False


def test_binary_metrics(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.8), ("g", 0, 0.1), ("one", 1, 0.5), ("g", None, 0.3), ("g", 1, float("nan"))], "k string, y int, s double")
    out = metrics.binary_scores(df, ["k"], "y", "s").collect()
    assert [(r.k, round(r.average_precision, 6), r.roc_auc) for r in out] == [("g", 0.833333, 0.875)]
    assert metrics.roc_curve(df, ["k"], "y", "s", drop_intermediate=False).count() == 4
    last = metrics.pr_curve(df, ["k"], "y", "s").filter("recall = 0").first()
    assert (last.precision, last.threshold) == (1.0, 0.9)


def test_multiclass_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    r = metrics.macro_scores(metrics.confusion(df, [], "t", "p"), []).first()
    assert (r.accuracy, r.macro_recall, r.balanced_accuracy, round(r.macro_f1, 6)) == (0.5, 0.5, 0.5, 0.388889)


def test_predicted_label_fills_zero(spark):
    df = spark.createDataFrame([("q", "a", -1.0), ("q", "b", -2.0), ("r", "a", 0.5)], "q string, c string, v double")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    out = {r.q: (r.predicted, r.score) for r in longform.predicted_label(df, "q", "c", labels, "v").collect()}
    assert out == {"q": ("c", 0.0), "r": ("a", 0.5)}


def test_kmers(spark):
    df = spark.createDataFrame([("MTRC",)], "s string")
    got = df.select(encode(F.col("s"), "hp").alias("e"), kmers(encode(F.col("s"), "hp"), 2).alias("k"), kmers(F.col("s"), 5).alias("none")).first()
    assert (got.e, got.k, got.none) == ("hppp", ["hp", "pp", "pp"], [])
    dna = spark.createDataFrame([("AACG",), ("TTTG",)], "s string").select(canonical(F.col("s"))).collect()
    assert [r[0] for r in dna] == ["AACG", "CAAA"]
    with pytest.raises(ValueError):
        encode(F.col("s"), "other")
    assert codon_ksize(9, True) == 3
    with pytest.raises(ValueError):
        codon_ksize(10, True)


def test_murmur_vectors():
    unsigned_ = [h % 2**64 for h in murmur_of(["hhhhhhhh", "pppppppp", "hphphphph", "MTRCTADN", "h" * 16, "hp" * 10])]
    assert unsigned_ == [6405245933721206635, 2117825812541169435, 9056980627444632316, 8575557853081447493, 5922925474667340214, 18239023104020397957]
    assert murmur_of(["The quick brown fox jumps over the lazy dog"], seed=0)[0] % 2**64 == 0xE34BBC7BBC071B6C
    assert murmur_of([None, "a"])[0] is None


def test_unsigned_round_trip(spark):
    df = spark.createDataFrame([(-1,), (5,), (-(2**63),)], "h long")
    out = df.select(unsigned(F.col("h")).alias("u"), signed(unsigned(F.col("h"))).alias("h")).collect()
    assert [int(r.u) for r in out] == [2**64 - 1, 5, 2**63] and [r.h for r in out] == [-1, 5, -(2**63)]
    got = df.select(sketch_md5(F.lit(24), F.array(F.lit(3), F.lit(1)))).first()[0]
    import hashlib

    assert got == hashlib.md5(b"2413").hexdigest()


def test_stitching(spark):
    df = spark.createDataFrame([([(3, "hpp"), (4, "ppp"), (5, "pph")],), ([(3, "hpp"), (5, "pph")],), ([],)], "x array<struct<start:int,kmer:string>>")
    assert [r[0] for r in df.select(align.stitch(F.col("x"), strict=False)).collect()] == ["hppph", None, ""]
    with pytest.raises(Exception, match="not consecutive"):
        df.select(align.stitch(F.col("x"))).collect()


def test_matching_kmers(spark):
    seqs = spark.createDataFrame([("s", "MTRCMTRC"), ("short", "MT")], "name string, sequence string")
    rows = K.kmer_rows(seqs, 4, "hp")
    sig = spark.createDataFrame([(murmur_of(["hppp"])[0],)], "hashval long")
    found = K.matching_kmers(rows, sig).orderBy("start").collect()
    assert [(r.kmer_in_sequence, r.start) for r in found] == [("MTRC", 0), ("MTRC", 4)]
    assert K.matching_kmers(rows, sig, first=True).count() == 1
    assert K.islands(rows.select("name", "start"), ["name"]).first().n == 5


def test_verified_fails_on_a_wrong_overlap(spark):
    df = spark.createDataFrame([("bcd", "abcdef", 1)], "o string, s string, i int")
    assert align.verified(df, "o", "s", "i").count() == 1
    with pytest.raises(Exception, match="differs"):
        align.verified(df.withColumn("i", F.lit(2)), "o", "s", "i").collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=30))
def test_auc_equals_rank_formula(spark, rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    out = metrics.binary_scores(spark.createDataFrame(rows, "y int, s int"), [], "y", "s").collect()
    if not pos or not neg:
        assert out == [] or out[0].roc_auc is None
    else:
        assert out[0].roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_quantiles_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, rng.random(), float(rng.randrange(5))])) for g in "ab" for _ in range(501)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.low, r.mid) for r in metrics.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.1, 0.5])))
    assert set(got) == set("abc")
    shares = longform.cumulative_share(df, ["g"], "v").filter("g = 'a'").orderBy("v").collect()
    assert shares[-1].share == 1.0 and all(a.share < b.share for a, b in zip(shares, shares[1:]))


def test_merged_kmers_get_suffixes(spark):
    a = spark.createDataFrame([("x", "hp", 0)], "name string, encoded string, start int")
    out = K.merge_kmers(a, a, ["encoded"])
    assert out.columns == ["encoded", "name_x", "start_x", "name_y", "start_y"] and out.count() == 1


def test_weights_count_like_repeated_rows(spark):
    draw = random.Random(5)
    kinds = [(g, draw.random() < 0.4, draw.choice([0.1, 0.2, 0.5, 0.9, float("-inf"), None]), draw.randrange(1, 6)) for g in "ab" for _ in range(12)]
    short = spark.createDataFrame(kinds, "g string, y boolean, score_value double, rows long")
    full = spark.createDataFrame([k[:3] for k in kinds for _ in range(k[3])], "g string, y boolean, score_value double")

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())

    for f in (metrics.binary_scores, metrics.score_table, metrics.pr_curve, metrics.roc_curve, metrics.det_curve):
        assert rows(f(short, ["g"], "y", "score_value", weight="rows")) == rows(f(full, ["g"], "y", "score_value"))
    out = {r.g: r for r in longform.score_summary(short, ["g"], "rows").collect()}
    for g in "ab":
        v = np.array([k[2] for k in kinds if k[0] == g and k[2] not in (None, float("-inf")) for _ in range(k[3])])
        want = [len(v), v.mean(), np.median(v), np.quantile(v, 0.25), np.quantile(v, 0.75), v.std(ddof=1)]
        assert np.allclose([out[g][c] for c in ("n", "mean", "median", "q1", "q3", "sd")], want)
