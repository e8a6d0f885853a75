"""The text operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import hitlens.llm.mixing as mixing
import hitlens.llm.near_dup as near_dup
import hitlens.llm.sentencepieces as sentencepieces
import hitlens.llm.skew as skew
from hitlens.llm.components import components
from hitlens.llm.mixing import min_cost_flow, mix, mix_documents, route, target_sizes
from hitlens.llm.near_dup import keep_one, likely_jaccard, minima, near_duplicates, registers
from hitlens.llm.quality_model import isotonic, keep_good, quality_scores
from hitlens.llm.quality_rules import WORDS, keep_by_rules, quality_rules
from hitlens.llm.sentencepieces import encode_documents, encoder
from hitlens.llm.textkit import U64, mix as mixed, unmix, utf8, word_hashes
from hitlens.llm.tokenizers import model_file

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b"), (None, "a b"), (7, "x" * 5000), (8, "wort " * 20000), (8, "wort " * 20000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") > 4, "s"), "n": F.lit(1), "score": F.lit("x"), "regs": F.lit(0), "kept": F.lit("k"), "size": F.lit(9), "hash": F.lit(2)})


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = Counter((min(a, b), max(a, b)) for v in held.values() for n, a in enumerate(v) for b in v[:n])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 4).collect()}
    assert out == brute_components(texts, 4)


@pytest.mark.parametrize("block", [16])
def test_near_duplicates_in_drifting_groups(spark, monkeypatch, block):
    rng, rows = random.Random(5), []
    for g in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for c in range(50):
            words = list(base)
            for _ in range(rng.choice([0, 2, 4, 6, 8, 9, 10, 11])):
                words[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows) * 7, " ".join(words)))
    monkeypatch.setattr(near_dup, "BLOCK", block)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert out == brute_components(dict(rows), 4)


def test_near_duplicates_odd_rows(spark):
    df = odd(spark)
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 4).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (None, 1, 4, False), (7, 1, 7, True), (8, 1, 8, True)} == out
    kept = keep_one(df, 4)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert near_duplicates(df.limit(0), 4).count() == 0


def varied(words, *places):
    return " ".join(f"v{i}" if i in places else w for i, w in enumerate(words))


def test_near_duplicates_link_through_rows_without_id(spark):
    # similarities: a, b 0.76; a, middle and middle, b 0.87: only the rows without an id join the ends
    words, lone = [f"w{i}" for i in range(300)], [f"u{i}" for i in range(300)]
    a, b, middle = varied(words), varied(words, 20, 60, 100, 140, 180, 220, 240, 260, 270, 280), varied(words, 20, 60, 100, 140, 180)
    rows = [(5, a), (9, b), (None, middle), (None, middle), (None, varied(lone)), (None, varied(lone, 50)), (7, "a b c d e")]
    out = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert out == {(5, 5, True): 1, (9, 5, False): 1, (None, 5, False): 2, (None, None, True): 2, (7, 7, True): 1}


def test_rows_that_share_an_id_are_judged_by_text(spark):
    def words(c):
        return [f"{c}{i}" for i in range(300)]

    # 3 and 8 have two unlike texts each, one of 8 like 1; the texts of 6 are near each other
    rows = [(1, varied(words("a"))), (8, varied(words("a"), 50)), (8, varied(words("b"))), (3, varied(words("c"))), (3, varied(words("d"))), (6, varied(words("e"))), (6, varied(words("e"), 9)), (4, varied(words("d"), 70)), (2, ""), (2, varied(words("f")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 4).collect())
    assert out == {(1, 297, 1): 1, (8, 297, 1): 1, (8, 297, 8): 1, (3, 297, 3): 2, (6, 297, 6): 2, (4, 297, 3): 1, (2, 0, 2): 1, (2, 297, 2): 1}
    got = Counter((r.doc_id, r.text) for r in keep_one(df, 4).collect())
    assert sum(got.values()) == 7 and got - Counter(rows[i] for i in (0, 2, 3, 4, 5, 6, 8, 9)) == Counter()
    assert sum(n for (i, _), n in got.items() if i == 6) == 1


def brute_rows(rows, k):
    """What near_duplicates gives for rows (doc_id, text) with null and shared ids."""
    texts = sorted({t for _, t in rows})
    groups = brute_components(dict(enumerate(texts)), k)
    least = {}
    for i, t in rows:
        group = groups[texts.index(t)][1]
        least[group] = min((x for x in (least.get(group), i) if x is not None), default=None)
    return Counter((i, groups[texts.index(t)][0], least[groups[texts.index(t)][1]]) for i, t in rows)


@pytest.mark.parametrize("least", [1, 256])
def test_near_duplicates_of_odd_ids_equal_brute_force(spark, monkeypatch, least):
    # with LEAST 1 and blocks of 3 every join takes its way for hot keys
    monkeypatch.setattr(skew, "LEAST", least)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    w = [[f"{c}{i}" for i in range(300)] for c in "abcdef"]
    x, y = varied(w[0]), varied(w[1])
    rows = [(13, x), (13, y), (15, varied(w[0], 9)), (11, varied(w[1], 9))]
    rows += [(1, varied(w[2])), (None, varied(w[2]) + " more"), (None, varied(w[2])), (1, varied(w[2]))]
    rows += [(1, varied(w[3])), (None, varied(w[3], 20, 60, 100, 140, 180)), (2, varied(w[3], 20, 60, 100, 140, 180, 220, 240, 260, 270, 280))]
    rows += [(None, varied(w[4], 3)), (None, varied(w[4], 200)), (30, "a b"), (31, "a b")] + [(40 + i, varied(w[5], *range(0, 11 * i, 11))) for i in range(24)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_rows(rows, 4)


def test_word_hashes_have_no_structural_collisions():
    def morse(bits, letters):
        return "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))

    words = [morse(b, letters) for b in (10, 11, 12, 16) for letters in ("ab", "ba")] + ["ab" * 600, "ba" * 600, "a" * 70000, "a" * 70001, "b" + "a" * 70000]
    hashes, offsets = word_hashes(*utf8(pa.array([" ".join(words)])))
    assert len(set(hashes.tolist())) == len(words) == offsets[1]
    again, _ = word_hashes(*utf8(pa.array([f" x {v.upper()}" for v in words])))
    assert again[1::2].tolist() == hashes.tolist()


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = base[:2400], base[600:]
    least = minima(np.concatenate((a, b, base)), np.array([2400, 2400, 3000]))
    assert np.array_equal(np.minimum(least[0], least[1]), least[2])
    regs = registers(least)
    assert np.array_equal(np.maximum(regs[0], regs[1]), regs[2])
    got = likely_jaccard(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([2400.0]), np.array([2400.0]))
    assert abs(got[0] - 0.6) < 0.15


def test_mix_is_one_to_one():
    x = np.array([0, 1, 2**63, 2**64 - 1, 12345], U64)
    assert np.array_equal(unmix(mixed(x)), x)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (60, 50)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {i: 0 for i in range(41)} | {99: 99, 100: 99, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    model = model_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = docs.select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text) for r in rows.collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = lib.encode(t or "") + [lib.eos_id()]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(rows, model).collect())
    assert got == want
    real = encode_documents(odd(spark), model, with_ids=True).filter("doc_id = 4").first()
    assert real.decoded == "a b" and real.ids[-1] == lib.eos_id()
    assert encode_documents(docs.limit(0), model).count() == 0


def test_sentencepiece_random_texts():
    encode, vocabulary = encoder(model_file("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = ["", " ", "▁", "a▁b", "\n\n a\n", "A" * 400, " " * 99, "日本語 🙂🙂", "<s></s><0x0A>"]
    texts += ["".join(rng.choice("abethionsr  \n\tAé中▁🙂.,!0123 　̀") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    assert [ids.tolist() for ids in encode(texts)] == vocabulary.library.encode(texts)


def test_sentencepiece_bounds_change_nothing(monkeypatch):
    # groups, runs, rows in step and the cache far below any text's size
    for name, value in (("GROUP", 60), ("RUN", 7), ("ROWS", 5), ("CACHE_BYTES", 3000)):
        monkeypatch.setattr(sentencepieces, name, value)
    encode, vocabulary = encoder(model_file("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = ["", "a", "x" * 300, "".join(rng.choice("abcdefgh") for _ in range(900))]
    texts += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [ids.tolist() for ids in encode(texts)] == vocabulary.library.encode(texts)


def auc(rows):
    ranks = sorted(rows)
    pos, total, n_pos = 0.0, 0, sum(y for _, y in rows)
    for i, (_, y) in enumerate(ranks, 1):
        pos += i * y
    return (pos - n_pos * (n_pos + 1) / 2) / (n_pos * (len(rows) - n_pos))


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert auc([(r.score, r.quality) for r in rows]) > 0.99
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)


def test_classifier_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_scores(odd(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = quality_scores(docs.limit(20), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    kept = keep_good(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "score"] and 0.7 * docs.count() < kept.count() < docs.count()


def test_isotonic():
    assert isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]


def test_rules_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text", "lang").union(odd(spark).select("doc_id", "text", "lang"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(rows).collect())
    want = Counter()
    for r in rows.collect():
        text = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[r.doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert got == want


def brute_distances(rows, common):
    """class_distance, word_distance and the method's verdict of each row (text, lang), by plain Python."""
    classes = [lambda c: c.isupper() and unicodedata.category(c) == "Lu", lambda c: c.isalpha() and unicodedata.category(c) != "Lu" and not "a" <= c <= "z", lambda c: unicodedata.category(c)[0] == "N", lambda c: c in ".,;:?'’-", lambda c: c == "!", lambda c: c in "#*$%&|<>"]

    def shares(text):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        chars = [c for x in w for c in x]
        kind = Counter("l" if "a" <= c <= "z" else next((i for i, f in enumerate(classes) if f(c)), 6) for c in chars)
        of = Counter(x for x in w if x in common)
        p = [kind[i] / max(len(chars), 1) for i in [*range(7), "l"]]
        return len(w), p, [of[x] / max(len(w), 1) for x in common] + [1 - sum(of.values()) / max(len(w), 1)]

    measured = [(lang, *shares(text)) for text, lang in rows]
    known = []
    for lang in sorted({r[0] for r in measured if r[0] and r[1] >= 50}):
        mine = [r for r in measured if r[0] == lang and r[1] >= 50]
        middle = [[sorted(round(r[part][i] * 65536) for r in mine)[(len(mine) - 1) // 2] for i in range(len(mine[0][part]))] for part in (2, 3)]
        known.append([[x / sum(m) for x in m] for m in middle])

    def distance(p, q):
        def half(a, b):
            return a * math.log2(2 * a / (a + b)) if a > 0 else 0

        return math.sqrt(max(sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2, 0))

    out = []
    for _, n, p, w in measured:
        far = [(distance(p, q[0]), distance(w, q[1]), distance([0] * len(common) + [1], q[1])) for q in known]
        fits = n < 50 or any(a <= 0.22 and b <= 0.95 * c for a, b, c in far)
        out.append((min(f[0] for f in far), min(f[1] for f in far), fits) if n >= 50 else (None, None, True))
    return out


def test_rules_distances_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text", "lang")
    found = rows.collect()
    want = {r.doc_id: d for r, d in zip(found, brute_distances([(r.text, r.lang) for r in found], WORDS))}
    out = quality_rules(rows).collect()
    for r in out:
        a, b, fits = want[r.doc_id]
        assert (r.class_distance, r.word_distance) == ((None, None) if a is None else (pytest.approx(a, abs=2e-4), pytest.approx(b, abs=2e-4)))
        assert r.kept == (fits and not r.base_failed)
    assert sorted(out) == sorted(quality_rules(rows.repartition(7)).collect())


def test_rules_of_a_language_with_one_document(spark, docs):
    text = " ".join(f"слово{i % 30} и не" for i in range(60))
    rows = spark.createDataFrame([(-1, text, "ru"), (-2, text, "uk"), (-3, "1234 " * 3 + text, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality_rules(docs.select("doc_id", "text", "lang").union(rows)).filter("doc_id < 0").collect()}
    assert all(r.class_distance < 0.22 and r.kept == (not r.base_failed) for r in out.values())


def test_rules_keep_the_good(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in out}
    assert share[1] > 0.98 and share[0] < 0.5


def test_rules_keep_all_columns(spark):
    df = odd(spark)
    assert keep_by_rules(df).columns == df.columns and keep_by_rules(df).count() == 0
    assert quality_rules(df.limit(0)).count() == 0


def test_rules_reject_clean_gibberish(spark, docs):
    rng = random.Random(11)
    rows = [(-i, " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) + ("." if j % 12 == 11 else "") for j in range(n)), "en") for i, n in enumerate((60, 200, 3000), 1)]
    out = quality_rules(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).filter("doc_id < 0").collect()
    assert len(out) == 3 and all(not r.base_failed and r.class_distance <= 0.22 and not r.kept for r in out)


def test_rules_learn_other_languages(spark, docs):
    rng = random.Random(12)
    common = "и в не на что с по как это он".split()

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))

    def prose(n, often):
        return " ".join(rng.choice(common) if rng.random() < often else word("абвгдежзиклмнопрстуя") for _ in range(n))

    # 1 to 20: prose; 21: prose without a lang; 22: none of its common words; 23: a rare lang, in Greek
    rows = [(-i, prose(150, 0.3), "ru") for i in range(1, 21)] + [(-21, prose(200, 0.3), None), (-22, prose(200, 0), "ru"), (-23, " ".join(word("αβγδεζηθικλμνο") for _ in range(99)), "el")]
    out = quality_rules(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).filter("doc_id < 0").collect()
    kept = {-r.doc_id for r in out if r.kept}
    assert len(out) == 23 and not any(r.base_failed for r in out) and kept == {*range(1, 22), 23}


def test_targets():
    assert target_sizes({"a": 60, "b": 60, None: 60}, [1, 2, 3], 3) == {"a": 30, "b": 60, None: 90}
    got = target_sizes({"a": 100, "b": 1}, [1, 3], 3)
    assert got == {"a": 98, "b": 3}


def test_flow_takes_cheap_repeats_first():
    # "both" may serve either source: nothing is repeated while first rounds are left
    taken = route({("a",): 10, ("b",): 10, ("a", "b"): 10}, {"a": 20, "b": 10}, 3)
    assert sum(taken.values()) == 30 and taken == {("a",): 10, ("b",): 10, ("a", "b"): 10}
    assert route({("a",): 10}, {"a": 25}, 3) == {("a",): 25}
    assert min_cost_flow([(0, 1, 5, 0), (1, 2, 3, 0)], 0, 2) == [3, 3]


@pytest.mark.parametrize("sf,near", [("sf0.001", 0.05), ("sf0.01", 0.005)])
def test_mix_reaches_targets(spark, sf, near):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    out = mix(docs)
    rows = out.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("known")).collect()
    assert all(abs(r.taken - r.target) <= near * r.target and r.size == r.known for r in rows)
    assert out.filter("taken > 3 * size OR taken < 0").count() == 0
    assert sum(r.target for r in rows) == pytest.approx(sum(r.size for r in rows))
    assert sorted(out.collect()) == sorted(mix(docs.repartition(5)).collect())
    words = mix_documents(docs).select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert words == sum(r.taken for r in rows)


def test_mix_odd_rows(spark):
    df = odd(spark)
    out = mix(df).collect()
    assert len(out) == len(ODD) and all(r.taken == 0 for r in out if r.size == 0)
    assert mix_documents(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a"]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mix(df, sources=F.col("source"))
    assert abs(out.agg(F.sum("taken")).first()[0] - 9000) <= 9000 and out.filter("taken > 3 * size").count() == 0


def brute_flow(sizes, quotas, repeats):
    """(words, cost) of the best flow from patterns a, b and ab to the quotas of a and b."""
    def cost(taken, size):
        return sum(r * r * min(max(taken - r * size, 0), size) for r in range(repeats))

    best = (0, 0)
    na, nb, both = (sizes.get(p, 0) for p in (("a",), ("b",), ("a", "b")))
    for a in range(min(repeats * na, quotas["a"]) + 1):
        for b in range(min(repeats * nb, quotas["b"]) + 1):
            for x in range(min(repeats * both, quotas["a"] + quotas["b"] - a - b) + 1):
                # of x words, as many as needed go to a
                if x <= quotas["a"] - a + quotas["b"] - b:
                    best = max(best, (a + b + x, -cost(a, na) - cost(b, nb) - cost(x, both)))
    return best[0], -best[1]


def test_flow_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        sizes = {p: rng.randint(1, 5) for p in (("a",), ("b",), ("a", "b")) if rng.random() < 0.9}
        quotas = {"a": rng.randint(0, 12), "b": rng.randint(0, 12)}
        taken = route(sizes, quotas, 3)
        cost = sum(sum(r * r * min(max(t - r * sizes[p], 0), sizes[p]) for r in range(3)) for p, t in taken.items())
        assert (sum(taken.values()), cost) == brute_flow(sizes, quotas, 3)


def test_mix_of_overlapping_sources_is_exact(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a"]) for i in range(900)]
    df = spark.createDataFrame(rows + [(-1, "x y", []), (-2, "x", None)], "doc_id long, text string, source array<string>")
    # 9000 words: 1500 for a, 7500 for b; b's own 3000 and the 3000 of both are repeated alike
    out = mix(df, weights=(1.0, 5.0), sources=F.col("source")).collect()
    of = Counter()
    for r in out:
        of["none" if r.doc_id < 0 else "a b both".split()[r.doc_id % 3]] += r.taken
    assert of["none"] == 0 and of["a"] == 1500 and abs(of["b"] - 3750) <= 750 and of["b"] + of["both"] == 7500
    assert {(r.source_size, r.target) for r in out if r.doc_id >= 0} == {(6000, 1500.0), (6000, 7500.0)}


def test_mix_chooses_alike_at_every_size(spark, monkeypatch):
    """The rule of the module's head, by plain Python, on a source above and one below the window."""
    monkeypatch.setattr(mixing, "WINDOW", 8)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 40), "big" if i < 600 else "small") for i in range(606)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix(df, weights=(1.0, 30.0)).collect()}
    hashes = {r.doc_id: r.h for r in df.select("doc_id", mixing._hash(mixing.SEED).alias("h")).collect()}
    for source in ("big", "small"):
        ids = sorted((i for i, _, s in rows if s == source), key=hashes.get)
        size = {i: got[i].size for i in ids}
        flow = round(got[ids[0]].target)
        full = min(3, flow // sum(size.values()))
        room, want, at = flow - full * sum(size.values()), dict.fromkeys(ids, full), 0
        if full < 3:
            while size[ids[at]] <= room:
                want[ids[at]], room, at = full + 1, room - size[ids[at]], at + 1
            tried = [ids[(at + s) % len(ids)] for s in range(8)]
            for i in tried:
                if size[i] <= room and want[i] < 3:
                    want[i], room = want[i] + 1, room - size[i]
            left = [i for i in tried if want[i] < 3]
            if left and min(abs(size[i] - room) for i in left) < room:
                want[min(left, key=lambda i: (abs(size[i] - room), hashes[i]))] += 1
        assert {i: got[i].taken for i in ids} == {i: size[i] * n for i, n in want.items()}
