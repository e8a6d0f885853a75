"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitlens.llm.chat_format import preference_pairs, span_text, turns_of, weaker_reply
from hitlens.llm.common import shared_path, table
from hitlens.llm.mixing import mix
from hitlens.llm.near_dup import near_duplicates
from hitlens.llm.quality_model import quality_scores
from hitlens.llm.quality_rules import quality_rules
from hitlens.llm.sentencepieces import encode_documents
from hitlens.llm.tokenizers import model_file, word_pattern
from hitlens.llm.token_scan import document_lengths, write_token_files
from hitlens.llm.topk_search import top_k
from hitlens.llm.url_filter import judge_urls
from hitlens.llm.warc import archive_and_read

#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The list of the URL filter: all known URLs of these sites, and UNSEEN more that no page has.
UNSEEN = 100_000
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), model_file("piece_bpe_32k.model"))


def op3_warc(spark, sf_dir):
    return archive_and_read(table(spark, sf_dir, "pages"))


def op4_preference_format(spark, sf_dir):
    turns = turns_of(table(spark, sf_dir, "conversations"))
    pairs = turns.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), weaker_reply(F.col("turns")).alias("rejected"))
    return preference_pairs(pairs).withColumns({c: span_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_token_counts(spark, sf_dir):
    folder = shared_path(spark, "tokens")
    # id 50256 is free in this vocabulary and closes documents
    files, places = write_token_files(table(spark, sf_dir, "documents"), model_file("byte_bpe_50k.tiktoken"), word_pattern(), 50256, folder)
    lengths = document_lengths(files, folder, 50256)
    return places.join(lengths, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "closed")


def op7_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op8_topk_search(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = documents.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    return top_k(documents, queries, k=10)


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("url").rlike(r"^[^:]*://([^/?#]*\.)?(" + "|".join(LISTED_SITES) + r")\."))
    site = F.get(F.array(*map(F.lit, LISTED_SITES)), F.pmod("id", F.lit(len(LISTED_SITES))).cast("int"))
    unseen = spark.range(UNSEEN).select(F.concat(F.lit("http://"), site, F.lit(".invalid/unseen/"), F.col("id").cast("string")).alias("url"))
    return judge_urls(pages, URL_RULES, listed.select("url").unionByName(unseen))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_sentencepiece,
        op3_warc,
        op4_preference_format,
        op5_near_duplicates,
        op6_token_counts,
        op7_source_mixing,
        op8_topk_search,
        op9_quality_rules,
        op10_url_filter,
    )
}
