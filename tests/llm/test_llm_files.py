"""Archives, token files, search, URLs, chats and the pipeline."""

import hashlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import difference  # noqa: E402

from hitlens.llm.blocked_bloom import only_listed, without_listed  # noqa: E402
from hitlens.llm.chat_format import preference_pairs, span_text, turns_of, weaker_reply  # noqa: E402
from hitlens.llm.common import shared_path  # noqa: E402
from hitlens.llm.oracles import ORACLES  # noqa: E402
from hitlens.llm.queries import QUERIES, URL_RULES  # noqa: E402
from hitlens.llm.textkit import utf8, word_hashes  # noqa: E402
from hitlens.llm.token_scan import document_lengths, write_token_files  # noqa: E402
from hitlens.llm.tokenizers import model_file, word_pattern  # noqa: E402
import hitlens.llm.blocked_bloom as blocked_bloom
import hitlens.llm.topk_search as topk_search
from hitlens.llm.topk_search import top_k  # noqa: E402
from hitlens.llm.url_filter import judge_urls  # noqa: E402
from hitlens.llm.warc import archive_and_read, build_index, capture_key, find, read_records, write_archives  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") is None


def pages(spark):
    html = lambda i: None if i % 10 == 0 else "é" * 600 + str(i % 20) if i % 5 == 0 else "x" * (2000 if i % 2 else 100)
    rows = [(i, f"http://A{i % 3}.b.com/x{i % 50}?q" if i % 7 else None, html(i)) for i in range(300)] + [(300, "no scheme", "y"), (None, "http://c.com", "z" * 1500), (301, "http://c.com\r\nX: y", "z" * 1500), (302, "http://c.com", "z" * 10**6)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "file": F.lit("f")})


def test_warc_round_trip(spark):
    rows = pages(spark).collect()
    held = defaultdict(list)
    for r in rows:
        held[(r.html or "").encode()].append(r.page_id or -1)
    want = Counter()
    for r in rows:
        payload = (r.html or "").encode()
        winner = max(held[payload])
        revisit = len(payload) >= 1000 and winner != r.page_id
        want[r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", winner if revisit else None] += 1
    got = archive_and_read(pages(spark))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    assert archive_and_read(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("block,shards", [(1000, 4), (3, 5), (1, 2)])
def test_warc_lookup(spark, block, shards):
    folder = shared_path(spark, "warc")
    index = build_index(write_archives(pages(spark), folder), folder, shards, block)
    asked = spark.createDataFrame([("http://a1.b.com/x1?q#f",), ("http://a1.b.com/x1?q",), ("http://nowhere.com/",), ("https://c.com",)], "url string")
    places = find(asked.select(capture_key(F.col("url")).alias("key")), index, folder)
    found = read_records(places, folder, payloads=True).collect()
    want = sorted(i for i in range(300) if i % 7 and i % 3 == 1 and i % 50 == 1)
    assert sorted(r.page_id for r in found if "b.com" in r.url) == want
    assert all(len(r.payload) == r.payload_bytes for r in found if r.record_type == "response")
    assert sum(r.url == "http://c.com" for r in found) == 2


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_token_files(spark, tmp_path, block):
    rng, want, files = random.Random(2), [], []
    for f in range(5):
        ids = [rng.choice([0, 1, 2, 9, 9]) if rng.random() < 0.3 else 5 for _ in range([0, 1, 50, 333, 64][f])]
        np.array(ids, "<u2").tofile(tmp_path / f"f{f}")
        files.append((f"f{f}", len(ids)))
        length = ordinal = 0
        for x in ids:
            length += 1
            if x == 9:
                want.append((f"f{f}", ordinal, length, True))
                length, ordinal = 0, ordinal + 1
        if length:
            want.append((f"f{f}", ordinal, length, False))
    got = document_lengths(spark.createDataFrame(files, "file string, tokens long"), f"file://{tmp_path}", 9, 2, block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_token_counts_of_documents(spark):
    import base64

    import tiktoken

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model_file("byte_bpe_50k.tiktoken").splitlines()) if a}
    encode = tiktoken.Encoding("t", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter(len(encode(r.text)) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = QUERIES["op6_token_counts"](spark, sf).collect()
    assert Counter(r.n_tokens for r in rows) == want and all(r.closed for r in rows)


def test_search_odd_rows(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "c d"), (3, "c d"), (4, None), (5, ""), (None, "a"), (6, "A  B\tc"), (7, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    out = [tuple(r)[:3] for r in top_k(docs, docs.withColumnRenamed("doc_id", "query_id"), 2).orderBy("query_id", "rank").collect()]
    assert [x for x in out if x[0] == 1] == [(1, 1, 2), (1, 2, 6)]
    assert {x[0] for x in out} == {1, 2, 3, 6} and all(q != d for q, _, d in out)
    assert top_k(docs.limit(0), docs.withColumnRenamed("doc_id", "query_id")).count() == 0


def test_search_equals_scoring_everything(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in top_k(docs, queries, 5).collect()}
    counts = {i: Counter(t.split()) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    mean = sum(sum(c.values()) for c in counts.values()) / len(rows)
    for q in range(0, 700, 10):
        scores = []
        for d, c in counts.items():
            size = sum(c.values())
            s = sum(n * np.log(1 + (700 - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in counts[q].items() if w in c)
            if d != q and s > 0:
                scores.append((-round(s, 6), d))
        for rank, (s, d) in enumerate(sorted(scores)[:5], 1):
            assert got[q, rank][1] == pytest.approx(-s, abs=2e-6)


def test_token_counts_by_document(spark, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model_file("byte_bpe_50k.tiktoken").splitlines()) if a}
    encode = tiktoken.Encoding("t", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x" * 3000), (5, "wort " * 9000), (6, "\n\n \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit(1), "ordinal": F.lit("x")})

    def counted(docs, name):
        folder = f"file://{tmp_path}/{name}"
        files, places = write_token_files(docs, model_file("byte_bpe_50k.tiktoken"), word_pattern(), 50256, folder)
        return Counter((r.doc_id, r.n_tokens, r.closed) for r in places.join(document_lengths(files, folder, 50256, block=1000), ["file", "ordinal"], "left").collect())

    want = Counter((i, len(encode(t or "")) + 1, True) for i, t in rows)
    assert counted(df.repartition(1), "a") == want == counted(df.repartition(3), "b")
    assert not counted(df.limit(0), "c")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter((r.doc_id, len(encode(r.text or "")) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in QUERIES["op6_token_counts"](spark, "/root/testdata/sf0.001").collect()) == want


def test_spans_of_long_conversations(spark):
    turns = [("user" if i % 2 else "assistant", f"text {i} <|") for i in range(2000)]
    pairs = spark.createDataFrame([(1, turns, turns[:-1]), (2, None, [])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r.pair_id: r for r in preference_pairs(pairs.withColumn("rejected", F.when(F.col("pair_id") == 1, F.array(F.struct(F.lit("user").alias("role"), F.lit("other").alias("text")))).otherwise(F.col("rejected")))).collect()}
    one = out[1]
    assert one.n_common == 0 and len(one.chosen_spans) == 1000
    assert all(one.chosen[s.start : s.end] == f"text {2 * i} < |<|im_end|>" for i, s in enumerate(one.chosen_spans))
    assert out[2].chosen == "" and out[2].chosen_spans == [] and not out[2].differs


def test_filter_false_positives_and_long_urls(spark, monkeypatch):
    # one block for all keys: nearly every URL passes the filter, and the exact join decides
    monkeypatch.setattr(blocked_bloom, "blocks_for", lambda n: 1)
    long = "http://site.org/" + "a/" * 50_000
    pages = spark.createDataFrame([(i, f"http://site{i}.org/p") for i in range(300)] + [(300, long), (301, long + "b")], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://site{i}.org/p",) for i in range(0, 600, 2)] + [(long,)], "url string")
    out = {r.page_id: r.listed for r in judge_urls(pages, [], listed).collect()}
    assert out == {i: i % 2 == 0 for i in range(300)} | {300: True, 301: False}


@pytest.mark.parametrize("sizes", [(1 << 23, 64), (900, 4)])
def test_search_ranks_and_rows(spark, monkeypatch, sizes):
    # with small shards and blocks most blocks are never opened
    monkeypatch.setattr(topk_search, "SHARD_WORDS", sizes[0])
    monkeypatch.setattr(topk_search, "BLOCK", sizes[1])
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 50)))) for i in range(500)]
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in top_k(docs, docs.filter("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id"), 4).collect())
    counts = {i: Counter(t.split()) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    size = {i: sum(c.values()) for i, c in counts.items()}
    mean, n, want = sum(size.values()) / len(rows), len(rows), []
    for q in range(0, n, 7):
        scores = []
        for d, c in counts.items():
            s = sum(m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w, m in counts[q].items() if w in c)
            if d != q and round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        want += [(q, rank, d) for rank, (_, d) in enumerate(sorted(scores)[:4], 1)]
    # two scores that differ by less than the rounding may change places
    assert len(got) == len(want) and len(set(got) ^ set(want)) <= 2


def _shard(rows):
    words, offsets = word_hashes(*utf8(pa.array([t for _, t in rows], pa.string())))
    arrays = topk_search.invert(words, offsets)
    assert sorted(arrays["order"].tolist()) == list(range(len(rows)))
    arrays["ids"] = np.array([i for i, _ in rows])[arrays.pop("order")]
    return topk_search.Shard(arrays, len(words) / len(rows))


@pytest.mark.parametrize("block, steps", [(64, (2, 8, 32)), (4, (1,)), (4, (2, 8, 32)), (7, ())])
def test_shard_prunes_whole_blocks_only(monkeypatch, block, steps):
    """Groups of like documents: the best of any steps equal the scores of all
    documents, above a floor too, for every query id, repeated and tied ones included."""
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "STEPS", steps)
    rng = random.Random(9)
    rows = []
    for g in range(12):
        own = [f"g{g}w{j}" for j in range(30)]
        for _ in range(25):
            rows.append((len(rows), " ".join(rng.choices(own, k=12) + rng.choices(["the", "of", "and", "to"], k=6))))
    rows += [(len(rows) + j, rows[3][1]) for j in range(15)] + [(5, rows[40][1]), (5, ""), (900, None)]
    rng.shuffle(rows)
    shard = _shard(rows)
    counts = [Counter((t or "").split()) for _, t in rows]
    mean = sum(sum(c.values()) for c in counts) / len(rows)
    for q, text in rows[::9]:
        terms = Counter((text or "").split())
        hashes = dict(zip(terms, word_hashes(*utf8(pa.array(list(terms), pa.string())))[0]))
        ordered = sorted(terms, key=hashes.get)
        query = {"ids": np.array([q]), "offsets": np.array([0, len(terms)]), "terms": np.array([hashes[w] for w in ordered], np.uint64), "weight": np.array([1.5 * terms[w] for w in ordered])}
        scores = []
        for (d, _), c in zip(rows, counts):
            size = sum(c.values())
            s = sum(1.5 * n * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in terms.items() if w in c)
            if d != q and s > 0:
                scores.append((-round(s, 6), d))
        want = sorted(scores)[:10]
        for floor in (0.0, -want[-1][0] if want else 0.0):
            ((ids, found),) = shard.best(query, 10, [floor])
            assert [d for _, d in want] == ids.tolist()
            assert np.allclose([-s for s, _ in want], found, atol=2e-6)


@pytest.mark.parametrize("way", [None, True, False])
def test_open_groups_are_read_once_and_others_in_steps(monkeypatch, way):
    """A query whose groups of blocks stay open has its postings read once, after
    the groups' maxima; both ways find the same."""
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rng = random.Random(4)
    rows = []
    for g in range(40):
        own = [f"g{g}w{j}" for j in range(15)]
        rows += [(len(rows) + j, " ".join(rng.choices(own, k=20) + [f"x{rng.randint(0, 600)}" for _ in range(16 * (g % 2))] + ["the", "of"])) for j in range(12)]
    shard = _shard(rows)
    plain = {}
    for q in range(0, len(rows), 7):
        words, weight = np.unique(word_hashes(*utf8(pa.array([rows[q][1]])))[0], return_counts=True)
        t = np.searchsorted(shard.terms, words)
        plain[q] = {"ids": np.array([q]), "offsets": np.array([0, len(words)]), "terms": words, "weight": weight * 1.5}, t[shard.row[t] < 0]
    want = {}
    for q, (query, t) in plain.items():
        sums = np.zeros(shard.blocks * 4)
        for w, x in zip(query["weight"], np.searchsorted(shard.terms, query["terms"])):
            part = slice(shard.starts[x], shard.starts[x + 1])
            sums[shard.docs[part]] += w * shard.impact[part]
        sums[shard.ids.ravel() == q] = 0
        best = np.lexsort((shard.ids.ravel(), -np.round(sums, 6)))[:5]
        want[q] = shard.ids.ravel()[best].tolist(), np.round(sums[best], 6)
    read, once, ranges = [], 0, topk_search._ranges
    monkeypatch.setattr(topk_search, "_ranges", lambda a, b: read.append(int((b - a).sum())) or ranges(a, b))
    if way is not None:
        monkeypatch.setattr(topk_search.Shard, "_mostly_open", lambda *_: way)
    for q, (query, t) in plain.items():
        for floor in (0.0, float(want[q][1][-1])):
            read.clear()
            ((ids, found),) = shard.best(query, 5, [floor])
            assert ids.tolist() == want[q][0] and np.allclose(found, want[q][1], atol=2e-6)
            once += len(read) == 2 and read[1] == (shard.starts[t + 1] - shard.starts[t]).sum()
    # with the groups' maxima some queries are read once and others are not
    assert way is not None or 0 < once < 2 * len(plain)


def test_like_documents_share_blocks():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"g{i % 10}w{j}" for j in range(20)], k=30))) for i in range(640)]
    shard = _shard(rows)
    # the given order has all ten groups in every block; a text lacks its group's
    # least term with a chance of 0.21, so a group is a few runs and not one
    groups = [len({int(i) % 10 for i in block}) for block in shard.ids]
    assert len(groups) == 10 and sum(groups) < 50


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x"),
        (2, "http://a.example.com/en/"),
        (3, "http://example.com"),
        (4, "ftp://q.net/es/1?x#y"),
        (5, None),
        (6, "nothing"),
        (7, "http://m.listed.org:80/p/?utm_source=f&ref=1&k=v#z"),
        (7, "http://m.listed.org:80/p/?utm_source=f&ref=1&k=v#z"),
        (8, "http://listed.org/p"),
        (9, "http://badexample.com/en/"),
        (None, "http://net/fr/"),
        (10, "://net"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "verdict": F.lit(0)})
    listed = spark.createDataFrame([("https://listed.org/p?k=v",), (None,), ("junk",)], "url string")
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, URL_RULES, listed).collect()]
    assert Counter(out) == Counter(
        [
            (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
            (2, "a.example.com", "/en/", "example.com/en/", "block"),
            (3, "example.com", "", None, "allow"),
            (4, "q.net", "/es/1", "net/es/", "block"),
            (5, "", "", None, "allow"),
            (6, "", "", None, "allow"),
            (7, "m.listed.org:80", "/p/", None, "block"),
            (7, "m.listed.org:80", "/p/", None, "block"),
            (8, "listed.org", "/p", None, "allow"),
            (9, "badexample.com", "/en/", "com/", "allow"),
            (None, "net", "/fr/", "net/fr/", "block"),
            (10, "net", "", None, "allow"),
        ]
    )
    assert judge_urls(df.limit(0), URL_RULES, listed).count() == 0
    assert judge_urls(df, URL_RULES, listed.limit(0)).filter("listed").count() == 0


def test_bloom_joins_are_exact(spark):
    rows = spark.range(3000).withColumn("key", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")))
    listed = spark.range(1500, 4000).select(F.col("id").cast("string").alias("k"))
    assert only_listed(rows, "key", listed).count() == 1350
    assert without_listed(rows, "key", listed).count() == 1650
    assert without_listed(rows, "key", listed.limit(0)).count() == 3000


def test_chats(spark):
    turns = [(1, 2, "assistant", "good"), (1, 1, "user", "hi <|im_end|>"), (2, 1, "user", "hi <|im_end|>"), (2, 2, "assistant", "bad"), (3, None, None, None), (None, 1, "user", "x")]
    chats = turns_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)))
    a, b = (chats.filter(f"conv_id = {i}").select(F.lit(9).alias("pair_id"), F.col("turns").alias(n)) for i, n in ((1, "chosen"), (2, "rejected")))
    r = preference_pairs(a.join(b, "pair_id")).first()
    assert r.n_common == 1 and r.prompt == "<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    assert r.chosen[r.chosen_spans[0].start : r.chosen_spans[0].end] == "good<|im_end|>"
    assert r.rejected[r.rejected_spans[0].start : r.rejected_spans[0].end] == "bad<|im_end|>"
    same = preference_pairs(chats.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected")))
    assert {(x.chosen, x.rejected, x.differs) for x in same.collect()} == {("", "", False)} and same.count() == 4
    weak = chats.select(weaker_reply(F.col("turns")).alias("t")).collect()
    assert ("assistant", "") in {(t.role, t.text) for x in weak for t in x.t}
    none = preference_pairs(spark.createDataFrame([(1, None, None)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")).first()
    assert (none.prompt, none.differs) == ("", False)
    assert preference_pairs(same.select("pair_id", *(F.lit(None).cast("array<struct<role:string,text:string>>").alias(c) for c in ("chosen", "rejected"))).limit(0)).select(span_text(F.col("chosen_spans"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    from hitlens.llm.common import stage

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    sizes = []
    for name, apply in pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, sf), name)
        assert docs.columns == columns and all(texts[r.doc_id] == r.text for r in docs.collect())
        sizes.append(docs.count())
    assert 200 > sizes[0] >= sizes[1] >= sizes[2] > 100
    out = pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
