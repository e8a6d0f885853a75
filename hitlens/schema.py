"""Schemas and name lists of the hit tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: From the most to the least specific; each is a prefix of the one before.
LEVELS = ["family", "superfamily", "fold", "class"]
QUERY_LEVELS = [f"query_{v}" for v in LEVELS]
MATCH_LEVELS = [f"match_{v}" for v in LEVELS]
SAME = [f"same_{v}" for v in LEVELS]
COUNTS = [f"n_{v}" for v in LEVELS]
ALPHABETS = ["protein", "dayhoff", "hp"]
LOGGED = ["prob_overlap_adjusted", "containment", "max_containment", "tf_idf_score", "jaccard"]
SCORES = ["containment", "tf_idf_score", "containment_adjusted_log10", "log10_prob_overlap_adjusted", "log10_max_containment", "log10_jaccard", "log10_tf_idf_score", "intersect_hashes"]


def _fields(kind: T.DataType, names) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


HITS = T.StructType(
    _fields(T.StringType(), ["query_name", "query_md5", "match_name", "match_md5"])
    + _fields(
        T.DoubleType(),
        ["containment", "max_containment", "jaccard", "intersect_hashes", "prob_overlap", "prob_overlap_adjusted", "containment_adjusted", "containment_adjusted_log10", "tf_idf_score"],
    )
)
QUERY_METADATA = T.StructType(_fields(T.StringType(), ["query_scop_id", "query_name", *QUERY_LEVELS]) + _fields(T.LongType(), COUNTS))
MATCH_METADATA = T.StructType(_fields(T.StringType(), ["match_scop_id", "match_name", *MATCH_LEVELS]))
CLEAN_HITS = T.StructType(
    HITS.fields
    + [f for f in QUERY_METADATA.fields if f.name != "query_name"]
    + [f for f in MATCH_METADATA.fields if f.name != "match_name"]
    + _fields(T.BooleanType(), SAME)
    + [T.StructField("ksize", T.IntegerType()), T.StructField("moltype", T.StringType())]
    + _fields(T.DoubleType(), [f"log10_{c}" for c in LOGGED])
)
SIGNATURE_JSON = (
    "array<struct<class:string,email:string,hash_function:string,filename:string,name:string,license:string,version:double,"
    "signatures:array<struct<num:int,ksize:int,seed:int,max_hash:decimal(20,0),mins:array<decimal(20,0)>,md5sum:string,molecule:string>>>>"
)
