"""Quality rules with distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 5-word
windows. The method's rule compares a text's character-class histogram and its
common-word histogram to language references, the medians over all documents
of each language; the Jensen-Shannon distance to the nearest reference decides,
with a guard for texts too short to compare.

Texts are measured once, in array functions on their own row, and the counts
staged; references and verdicts are made from the counts. Medians come from
integer histograms of (lang, feature, bin), summed within the map tasks, so
they are the same for every partitioning, and a hot language is no burden.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.llm.common import stage

#: White space of a word boundary, and the most common words of each language.
SPACES = r"[\x20\x09-\x0D]"
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are with as be by this".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour dans qui par sur au".split(),
    "es": "de la que el en y los se del las un por con no una su para es".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: So many common words are counted for a language that has no list here.
LEARNED_WORDS = 18
#: Character classes, removed one after the other from what is no ASCII lower-case letter.
CLASSES = {"upper": r"\p{Lu}", "accented": r"[\p{L}&&\P{Lu}]", "digit": r"\p{N}", "stop": r"[.,;:?'’-]", "shout": "!", "symbol": r"[#*$%&|<>]", "other": r"[^\p{L}\p{N}.,;:?'’!#*$%&|<>-]"}

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.22
#: A language's limit for the word distance, as a part of the distance that a
#: text without any common word has from its reference.
MAX_WORD_PART = 0.95
#: Shares are put into so many bins for the medians.
BINS = 1 << 16

#: Prefix of the columns that live only inside a plan. Each step is a column of
#: its own, and not a struct's field: Catalyst would evaluate the step anew for
#: every use of a field.
TEMP = "__rules_"
#: The column with a text's counts.
COUNTS = TEMP + "counts"


def _c(name: str) -> Column:
    return F.col(TEMP + name)


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({TEMP + k: v for k, v in columns.items()})


def _letters(spark: SparkSession, words: list[str]) -> tuple[list[int], dict[int, str]]:
    """The hashes of words, and a letter for each of them by its remainder modulo
    the number of remainders, which is the least that tells them apart."""
    hashes = list(spark.range(1).select(F.array(*(F.xxhash64(F.lit(w)) for w in words)).alias("h")).first().h)
    size = next(m for m in range(len(words), 1 << 20) if len({h % m for h in hashes}) == len(hashes))
    letter = {h % size: chr(0x100 + i) for i, h in enumerate(hashes)}
    return hashes, {r: letter.get(r, "") for r in range(size)}


def common_words(documents: DataFrame) -> list[str]:
    """The words of COMMON_WORDS and, for each other lang with a document of
    MIN_WORDS words, the LEARNED_WORDS words of the largest mean share of a
    document: each document counts alike, however long it is.

    The driver gets LEARNED_WORDS words for each of these languages.
    """
    others = documents.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    # reads the column lang alone
    if others.select("lang").isEmpty():
        return WORDS
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES + "+"), "")
    rows = others.select("lang", words.alias("words")).filter(F.size("words") >= MIN_WORDS)
    each = rows.select("lang", (1 / F.size("words")).alias("part"), F.explode("words").alias("word")).filter(F.col("word").rlike(r"^\p{L}+$"))
    shares = each.groupBy("lang", "word").agg(F.round(F.sum("part"), 6).alias("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "word"))
    best = shares.withColumn("place", place).filter(F.col("place") <= LEARNED_WORDS).select("word").distinct()
    return sorted({*WORDS, *(r.word for r in best.collect())})


def _measured(documents: DataFrame, common: list[str], kept: list[str]) -> DataFrame:
    """The columns kept of documents, staged, with the counts of COUNTS of their texts; classes has
    the characters of each class (ASCII lower-case last) and common the words of
    each common word (all other words last)."""
    out = _add(documents, text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = _add(
        out,
        words=F.array_remove(F.split(_c("text"), SPACES + "+"), ""),
        rest=F.regexp_replace(_c("text"), F.lit(r"[a-z\x20\x09-\x0D]+"), F.lit("")),
    )
    out = _add(out, n=F.size(_c("words")), word_chars=F.length(F.array_join(_c("words"), "")), hashes=F.transform(_c("words"), lambda w: F.xxhash64(w)))
    h = _c("hashes")
    # the common words of a text, a letter each: counted by removing one letter after the other
    hashes, letters = _letters(documents.sparkSession, common)
    table = F.array(*(F.lit(letters[r]) for r in range(len(letters))))
    found = F.transform(F.filter(h, lambda x: x.isin(hashes)), lambda x: F.get(table, F.pmod(x, F.lit(len(letters))).cast("int")))
    windows = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
    out = _add(out, found=F.array_join(found, ""), windows=F.when(_c("n") >= 5, F.slice(windows, F.lit(1), F.greatest(_c("n") - 4, F.lit(0)))))
    steps = ["rest"]
    for name, pattern in CLASSES.items():
        out = _add(out, **{f"no_{name}": F.regexp_replace(_c(steps[-1]), F.lit(f"(?:{pattern})+"), F.lit(""))})
        steps.append(f"no_{name}")
    counted = [F.length(_c(a)) - F.length(_c(b)) for a, b in zip(steps, steps[1:])]
    times = (F.length(_c("found")) - F.length(F.replace(_c("found"), F.lit(letters[x % len(letters)]), F.lit(""))) for x in hashes)
    out = _add(out, times=F.array(*times), counted=F.array(*counted))
    # a text that repeats a window (found by one hash set) is the only kind that pays for sorting them
    again = F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows"))
    out = _add(out, placed=F.when(again, F.sort_array(F.transform(_c("windows"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = _c("placed")
    twice = F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]))
    out = _add(out, places=F.sort_array(F.transform(twice, lambda e: e["i"])))
    at = _c("places")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5)))), F.lit(0), lambda x, y: x + y)
    out = _add(out, lines=F.filter(F.split(_c("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counts = {
        "n_words": _c("n").cast("long"),
        "word_chars": _c("word_chars").cast("long"),
        "n_symbols": F.get(_c("counted"), F.lit(list(CLASSES).index("symbol"))).cast("long"),
        "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "classes": F.concat(_c("counted"), F.array(_c("word_chars") - F.length(_c("rest")))),
        "common": F.concat(_c("times"), F.array(_c("n") - F.aggregate(_c("times"), F.lit(0), lambda x, y: x + y))),
    }
    return stage(out.select(*kept, F.struct(*(c.alias(k) for k, c in counts.items())).alias(COUNTS)), "measures")


def _shares(counts: str, total: str) -> Column:
    most = F.greatest(F.col(f"{COUNTS}.{total}"), F.lit(1))
    return F.transform(F.col(f"{COUNTS}.{counts}"), lambda c: c / most)


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each lang: the median shares of the character classes and of the
    common words over all its documents of MIN_WORDS words or more, in units of
    1 / BINS (of an even number of documents the lower middle one). Medians, so
    that the junk that the rules are to find does not shape the reference.

    The driver gets one number a feature and lang that is not 0.
    """
    rows = measured.filter(F.col("lang").isNotNull() & (F.col(f"{COUNTS}.n_words") >= MIN_WORDS))
    bins = F.transform(F.concat(_shares("classes", "word_chars"), _shares("common", "n_words")), lambda x: F.round(x * BINS).cast("int"))
    # a share of 0 is what is left of a language's documents
    histogram = rows.select("lang", F.posexplode(bins).alias("feature", "bin")).filter("bin > 0").groupBy("lang", "feature", "bin").agg(F.count("*").alias("n"))
    documents = rows.groupBy("lang").agg(F.count("*").alias("documents"), F.max(F.size(f"{COUNTS}.classes")).alias("classes"), F.max(F.size(f"{COUNTS}.common")).alias("common"))
    # at most BINS rows of a feature
    whole = Window.partitionBy("lang", "feature")
    sums = histogram.withColumns({"filled": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    place = F.floor((F.col("documents") - 1) / 2) + 1 - (F.col("documents") - F.col("filled"))
    middle = sums.join(documents, "lang").filter((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place))
    sizes = {r.lang: (r.classes, r.common) for r in documents.collect()}
    out = {lang: ([0.0] * a, [0.0] * b) for lang, (a, b) in sorted(sizes.items())}
    for r in middle.select("lang", "feature", "bin").collect():
        p, w = out[r.lang]
        if r.feature < len(p):
            p[r.feature] = r.bin / BINS
        else:
            w[r.feature - len(p)] = r.bin / BINS
    return {lang: ([x / sum(p) for x in p], [x / sum(w) for x in w]) for lang, (p, w) in out.items() if sum(p) > 0 < sum(w)}


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of the shares p and q."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def word_limit(q: list[float]) -> float:
    """The largest word distance from the reference q that still passes: less than
    that of a text with not one common word, whose shares are 0, ..., 0, 1."""
    rest = q[-1]
    without = math.sqrt(max((math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest > 0 else 0) + sum(q[:-1])) / 2, 0))
    # a reference without common words says nothing of words
    return MAX_WORD_PART * without if without > 1e-6 else 1.0


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def with_rules(measured: DataFrame, known: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """measured, judged by the references known, with a struct TEMP + "measures" of MEASURES."""
    n = F.col(f"{COUNTS}.n_words")
    far = {f"far_{k}": F.when(n >= MIN_WORDS, F.array(*(_distance(_c(k), q[k == "w"]) for q in known.values()))) for k in ("p", "w")}
    out = _add(_add(measured, p=_shares("classes", "word_chars"), w=_shares("common", "n_words")), **far)
    near = {k: F.when(n >= MIN_WORDS, F.array_min(_c("far_" + k)) if known else F.lit(0.0)) for k in ("p", "w")}
    # both distances must fit the same language
    limits = F.array(*(F.lit(word_limit(w)) for _, w in known.values()))
    word_fits = F.zip_with(_c("far_w"), limits, lambda d, most: d <= most)
    both = F.exists(F.zip_with(_c("far_p"), word_fits, lambda d, fit: (d <= MAX_CLASS_DISTANCE) & fit), lambda x: x)
    without = F.coalesce(~F.col("lang").isin(list(known)), F.lit(False))
    failed = (n < 10) | (100 * F.col(f"{COUNTS}.n_repeat_words") > 20 * n)
    out = _add(out, fits=(n < MIN_WORDS) | without | both if known else F.lit(True), base_failed=failed, class_distance=near["p"], word_distance=near["w"])
    out = _add(out, kept=~failed & _c("fits"))
    # the row number is a barrier: without it a later filter on a measure would be
    # pushed down through all steps, each written out anew for every use
    measures = F.struct(*(F.col(f"{COUNTS}.{k}") for k in MEASURES[:5]), *(_c(k).alias(k) for k in MEASURES[5:]))
    return _add(out, measures=F.when(F.monotonically_increasing_id() >= 0, measures))


def quality_rules(documents: DataFrame) -> DataFrame:
    """For each row of documents (doc_id, text, lang): doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance (null below MIN_WORDS words).

    A null or empty text has no words and fails the base rules. Every lang with
    a document of MIN_WORDS words has a reference, however few these are; its
    common words are counted in them if COMMON_WORDS has none, so a language
    without a list here is judged by its own texts. A null lang adds to no
    reference; texts are compared to every reference and one that fits is
    enough, so a wrong lang does no harm. With no reference at all the base
    rules decide. Repeated rows and null ids are kept as they are; other
    columns, whatever their names, are ignored; an empty table gives none.
    """
    rows = documents.select("doc_id", "text", "lang")
    measured = _measured(rows, common_words(rows), ["doc_id", "lang"])
    return with_rules(measured, references(measured)).select("doc_id", *(F.col(f"{TEMP}measures.{k}").alias(k) for k in MEASURES))


def keep_by_rules(documents: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep (see quality_rules, also for
    null, empty and repeated texts and empty tables), with all their columns.
    The measured rows are staged with their columns: texts are not shuffled."""
    # by position, whatever the columns are called; text and lang come last once more
    rows = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    rows = rows.withColumns({k: F.col(f"c{documents.columns.index(k)}") for k in ("text", "lang")})
    measured = _measured(rows, common_words(rows), [c for c in rows.columns if c != "text"])
    judged = with_rules(measured, references(measured))
    return judged.filter(f"{TEMP}measures.kept").select(*(f"c{i}" for i in range(len(documents.columns)))).toDF(*documents.columns)
