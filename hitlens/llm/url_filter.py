"""URL filters: longest host/path rule, then a blocked Bloom filter before an exact join.

DataFrame functions only. The list of canonical URLs is folded into a blocked
Bloom filter, which is broadcast up to a fixed size. Pages that miss the filter are certainly not listed and never leave their task; possible
hits go to an exact hash join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.llm.blocked_bloom import with_maybe
from hitlens.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEMP = "__url_"


def host_and_rest(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, and what follows it; empty without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(tail, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), tail.substr(F.length(raw) + 1, F.length(tail))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def canonical(host: Column, rest: Column) -> Column:
    """host without default port and one leading www. or m., path without closing
    slashes, query without utm_* and ref parameters, no scheme and fragment.
    Empty for a URL without host."""
    site = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    full = F.concat(site, F.regexp_replace(path_of(rest), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", full).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (as text) and its verdict; null without one.
    rules: (verdict, host, path); a rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def listed_rows(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with a boolean column TEMP + "listed": whether their TEMP + "key" is in listed (key)."""
    listed = stage(listed.filter("key <> ''").select("key").distinct(), "listed")
    # staged: URLs are parsed and probed once, not once for each of the two ways below
    probed = stage(with_maybe(rows, f"{TEMP}key", listed, f"{TEMP}maybe"), "probed")
    exact = listed.select(F.col("key").alias(f"{TEMP}key"), F.lit(True).alias(f"{TEMP}listed"))
    possible = probed.filter(f"{TEMP}maybe").join(exact, f"{TEMP}key", "left").withColumn(f"{TEMP}listed", F.coalesce(f"{TEMP}listed", F.lit(False)))
    missed = probed.filter(f"NOT {TEMP}maybe").withColumn(f"{TEMP}listed", F.lit(False))
    names = [*rows.columns, f"{TEMP}listed"]
    return possible.select(*names).unionByName(missed.select(*names))


def with_key(pages: DataFrame) -> DataFrame:
    """pages with TEMP + host, path and key (canonical URL)."""
    host, rest = host_and_rest(F.col("url"))
    out = pages.withColumns({f"{TEMP}host": host, f"{TEMP}rest": rest})
    return out.withColumns({f"{TEMP}path": path_of(F.col(f"{TEMP}rest")), f"{TEMP}key": canonical(F.col(f"{TEMP}host"), F.col(f"{TEMP}rest"))}).drop(f"{TEMP}rest")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    listed: a table with the column url; its URLs are compared by their
    canonical form. The verdict is that of the longest fitting rule, else
    "block" if the URL is listed, else "allow". A null URL or one without ://
    has empty host and path, fits no rule, is not listed and is allowed.
    Repeated rows are judged each; null page_ids stay null; other columns are
    ignored. With an empty list nothing is listed.
    """
    keys = with_key(listed.select("url")).select(F.col(f"{TEMP}key").alias("key"))
    rows = with_key(pages.select("page_id", "url")).drop("url")
    out = listed_rows(rows, keys)
    rule, verdict = matching_rule(F.col(f"{TEMP}host"), F.col(f"{TEMP}path"), rules)
    return out.select(
        "page_id",
        F.col(f"{TEMP}host").alias("host"),
        F.col(f"{TEMP}path").alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col(f"{TEMP}listed"), "block").otherwise("allow")).alias("verdict"),
        F.col(f"{TEMP}listed").alias("listed"),
    )
