"""Exact BM25 top-k by block-max pruned inverted indexes, a shard at a time.

Index: each task inverts the texts it reads into shards of at most SHARD_WORDS
words (a longer single text is a shard of its own): postings by term, each
cut at blocks of BLOCK documents whose largest impact is stored. Document
frequencies, the number of documents and their mean length are global, so
scores of different shards compare.

Documents of a shard are ordered by the least hashes of their
words, so that like texts share blocks and block maxima are near true scores.

Search: a task holds a few shards, one after the other, and a few files of
queries. Queries are whole texts, so most of their postings belong to a few
frequent terms: those are scored exactly for all documents of the shard, many
queries at once, by one matrix product. The other terms are pruned by blocks as
in block-max WAND, but a block at a time in place of its document-at-a-time
pivots: the block maxima, added to the best frequent score, make a bound for every
block; blocks are opened in steps in order of their bounds, the threshold rises
after each step, and blocks whose bound is below it are never opened. Maxima have
two levels: those of groups of blocks, which are fewer, are added up first, and
where the groups above the threshold hold most of a query's postings, as they do
for long queries, all its postings are read once, in their order, instead of
being picked out by block. The threshold starts with the frequent scores and is
carried on to the next shard of the task. Shards' lists merge exactly: ties are
broken by doc_id everywhere.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.llm.blocked_bloom import only_listed
from hitlens.llm.common import shared_path, sliced, stage
from hitlens.llm.textkit import mix, utf8, word_hashes
from hitlens.llm.warc import _open

SHARD_WORDS = 1 << 23
BLOCK = 64
#: Blocks of a group, whose maxima are looked at first.
GROUP = 8
K1, B = 1.2, 0.75
#: Scores are rounded to so many digits before they are compared.
DIGITS = 6
#: Queries in a file, and the files and the shards that are one piece of work.
QUERY_FILE, FILES, SHARDS = 256, 16, 4
#: A term of at least 1 / OFTEN of a shard's documents is frequent. (All rows of
#: frequent terms take at most OFTEN * 8 bytes for each posting of the shard.)
OFTEN = 16
#: Queries whose frequent terms are scored together.
TOGETHER = 64
#: Blocks opened in the first steps; the last step opens all others above the threshold.
STEPS = (2, 8, 32)


def _least_term(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents the least of its postings' hashes."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, docs, hashes)
    return least


def invert(words: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Postings of texts given by their words' hashes: terms (sorted), starts,
    docs and tf by posting, the texts' lengths, and order: the given place of
    each document.

    Documents are renumbered so that like ones share blocks, by the least hash of
    their frequent terms, then of all their terms. Block maxima are then close to
    the scores of the documents inside; results do not depend on the order.
    """
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    order = np.argsort(words, kind="stable")
    w, d = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(w))).astype(np.uint32)
    w, d = w[at], d[at]
    first = np.ones(len(w), bool)
    first[1:] = w[1:] != w[:-1]
    starts = np.append(np.flatnonzero(first), len(w))
    terms, size, n = w[starts[:-1]], np.diff(starts), len(offsets) - 1
    hashes, often = mix(w), np.repeat(size * OFTEN >= n, size)
    order = np.lexsort((_least_term(hashes, d, n), _least_term(hashes[often], d[often], n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    d = place[d]
    by = np.argsort(np.repeat(np.arange(len(terms)) * n, size) + d)
    lens = np.diff(offsets).astype(np.int64)
    return {"terms": terms, "starts": starts, "docs": d[by].astype(np.uint32), "tf": tf[by], "lens": lens[order], "order": order}


def _save(files, path: str, arrays: dict[str, np.ndarray]) -> None:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    with files.open_output_stream(path, compression=None) as out:
        out.write(raw.getbuffer())


def _load(files, path: str) -> dict[str, np.ndarray]:
    with files.open_input_file(path) as f:
        with np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in z.files}


def build_index(documents: DataFrame, folder: str) -> DataFrame:
    """Write the shards of documents (doc_id, text) to folder; staged
    (file, n_docs, n_words). Every row is indexed; one without words never matches."""

    def run(batches):
        files, folder_at = _open(folder)
        files.create_dir(folder_at, recursive=True)
        ids, words, counts, held = [], [], [], 0

        def flush():
            nonlocal ids, words, counts, held
            name = f"{uuid.uuid4().hex}.npz"
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            arrays = invert(np.concatenate(words), offsets)
            arrays["ids"] = np.concatenate(ids)[arrays.pop("order")]
            _save(files, f"{folder_at}/{name}", arrays)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(offsets) - 1]), pa.array([int(offsets[-1])])], names=["file", "n_docs", "n_words"])
            ids, words, counts, held = [], [], [], 0
            return out

        for batch in sliced(batches):
            found, offsets = word_hashes(*utf8(batch.column(1)))
            if held and held + len(found) > SHARD_WORDS:
                yield flush()
            ids.append(batch.column(0).to_numpy().astype(np.int64))
            words.append(found)
            counts.append(np.diff(offsets))
            held += len(found)
        if ids:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    return stage(rows.mapInArrow(run, "file string, n_docs long, n_words long"), "shards")


def document_frequencies(shards: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(term, df) over all shards, for the wanted terms."""

    def run(batches):
        files, folder_at = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                shard = _load(files, f"{folder_at}/{name}")
                df = np.diff(shard["starts"])
                terms = shard["terms"].view(np.int64)
                for at in range(0, len(terms), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 100_000]), pa.array(df[at : at + 100_000])], names=["term", "df"])

    tasks = shards.sparkSession.sparkContext.defaultParallelism
    local = shards.select("file").repartition(4 * tasks, "file").mapInArrow(run, "term long, df long")
    return only_listed(local, "term", wanted).groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf) of queries (query_id, text)."""

    def run(batches):
        for batch in sliced(batches):
            words, offsets = word_hashes(*utf8(batch.column(1)))
            ids = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                terms, tf = np.unique(words[offsets[i] : offsets[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), ids[i])), pa.array(terms.view(np.int64)), pa.array(tf)], names=["query_id", "term", "tf"])

    return queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "query_id long, term long, tf long")


def _query_files(weighted: DataFrame, folder: str) -> DataFrame:
    """Write (query_id, terms: array of (term, weight)) in files of QUERY_FILE queries; staged (file)."""

    def run(batches):
        files, folder_at = _open(folder)
        files.create_dir(folder_at, recursive=True)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_FILE):
                part = batch.slice(at, QUERY_FILE)
                lists = part.column(1)
                flat, offsets = lists.flatten(), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                terms, weight = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
                name = f"{uuid.uuid4().hex}.q.npz"
                _save(files, f"{folder_at}/{name}", {"ids": part.column(0).to_numpy(), "offsets": offsets, "terms": terms, "weight": weight})
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return stage(weighted.mapInArrow(run, "file string"), "queries")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after the other."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)


class Shard:
    """A loaded shard: impacts of postings, and maxima of blocks and of groups of blocks by term."""

    def __init__(self, arrays: dict[str, np.ndarray], mean: float):
        self.terms, self.starts, self.docs, self.ids = (arrays[k] for k in ("terms", "starts", "docs", "ids"))
        tf, lens = arrays["tf"].astype(float), arrays["lens"]
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.docs] / mean))
        del tf
        self.block, self.most, self.entries, at = self._maxima(BLOCK)
        self.entry = np.append(at, len(self.docs))
        self.sizes = np.diff(self.entry)
        self.group, self.group_most, self.group_entries, _ = self._maxima(BLOCK * GROUP)
        self.blocks = (len(self.ids) + BLOCK - 1) // BLOCK

        # terms of a large part of the shard's documents, as rows over all of them
        often = np.flatnonzero(np.diff(self.starts) * OFTEN >= len(self.ids))
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        for i, t in enumerate(often.tolist()):
            part = slice(self.starts[t], self.starts[t + 1])
            self.dense[i, self.docs[part]] = self.impact[part]
        # by block; the places after the last document have no score
        self.ids = np.append(self.ids, np.zeros(self.blocks * BLOCK - len(self.ids), np.int64)).reshape(-1, BLOCK)

    def _maxima(self, size: int) -> tuple[np.ndarray, ...]:
        """Of each term's postings by runs of `size` documents: the run, its largest
        impact (rounded up), the terms' first runs, and the runs' first postings."""
        run = self.docs // size
        cut = np.ones(len(run), bool)
        cut[1:] = run[1:] != run[:-1]
        cut[self.starts[:-1]] = True
        at = np.flatnonzero(cut)
        most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        return run[at].astype(np.int32), np.nextafter(most.astype(np.float32), np.float32(np.inf)), np.searchsorted(at, self.starts), at

    def best(self, queries: dict[str, np.ndarray], k: int, floors: list[float]):
        """For each of queries (ids, offsets, terms, weight): doc_ids and rounded
        scores of the k best documents (the query itself left out) with a score
        of at least its floor."""
        if "known" not in queries:  # kept for the next shard: distinct terms, sorted, are looked up faster
            queries["known"], queries["place"] = np.unique(queries["terms"], return_inverse=True)
        at_known = np.searchsorted(self.terms, queries["known"])
        if len(self.terms):
            at_known[self.terms[np.minimum(at_known, len(self.terms) - 1)] != queries["known"]] = -1
        else:
            at_known[:] = -1
        ids, offsets = queries["ids"].tolist(), queries["offsets"].tolist()
        for at in range(0, len(ids), TOGETHER):
            which = range(at, min(at + TOGETHER, len(ids)))
            rare, weights = [], np.zeros((len(which), len(self.dense)))
            for i in which:
                t, weight = at_known[queries["place"][offsets[i] : offsets[i + 1]]], queries["weight"][offsets[i] : offsets[i + 1]]
                good = t >= 0
                t, weight = t[good], weight[good]
                row = self.row[t]
                weights[i - at, row[row >= 0]] = weight[row >= 0]
                rare.append((t[row < 0], weight[row < 0]))
            base = (weights @ self.dense).reshape(len(which), self.blocks, BLOCK)
            for i in which:
                base[i - at][self.ids == ids[i]] = 0
            most = base.max(2)
            for i in which:
                yield self._best(ids[i], *rare[i - at], base[i - at], most[i - at], k, floors[i])

    def _best(self, query_id: int, t: np.ndarray, weight: np.ndarray, base: np.ndarray, most: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """base and most: the scores of the frequent terms by block and document,
        and their maxima by block; t and weight: the other terms."""
        slack = 10.0**-DIGITS
        if self.blocks >= k:  # so many blocks have a document of at least so much
            floor = max(floor, np.partition(most, self.blocks - k)[self.blocks - k])
        ids, scores = [np.zeros(0, np.int64)], [np.zeros(0)]

        def scored(mine: np.ndarray, sums: np.ndarray) -> None:
            nonlocal floor
            sums[mine == query_id] = 0
            good = np.flatnonzero(sums >= max(floor - 2 * slack, 1e-12))
            ids.append(mine[good])
            scores.append(sums[good])
            so_far = np.concatenate(scores)
            if len(so_far) >= k:
                floor = max(floor, np.partition(so_far, len(so_far) - k)[len(so_far) - k])

        # in order of the query's terms: equal texts get equal sums
        if self._mostly_open(t, weight, most, max(floor - 2 * slack, 1e-12)):
            starts, ends = self.starts[t], self.starts[t + 1]
            p = _ranges(starts, ends)
            scored(self.ids.ravel(), np.bincount(self.docs[p], np.repeat(weight, ends - starts) * self.impact[p], minlength=base.size) + base.ravel())
        else:
            lo, hi = self.entries[t], self.entries[t + 1]
            e = _ranges(lo, hi)
            w = np.repeat(weight, hi - lo)
            block = self.block[e]
            bound = np.bincount(block, w * self.most[e], minlength=self.blocks) + most
            best = np.argsort(-bound)
            for size in (*STEPS, self.blocks):
                left = np.searchsorted(-bound[best], -max(floor - 2 * slack, 1e-12), side="right")
                chosen, best = best[: min(size, left)], best[min(size, left) : left]
                if not len(chosen):
                    break
                slot = np.full(self.blocks, -1)
                slot[chosen] = np.arange(len(chosen)) * BLOCK
                at = slot[block]
                opened = np.flatnonzero(at >= 0)
                starts, size = self.entry[e[opened]], self.sizes[e[opened]]
                p = _ranges(starts, starts + size)
                sums = np.bincount(np.repeat(at[opened], size) + self.docs[p] % BLOCK, np.repeat(w[opened], size) * self.impact[p], minlength=len(chosen) * BLOCK)
                scored(self.ids[chosen].ravel(), sums + base[chosen].ravel())
        ids, rounded = np.concatenate(ids), np.round(np.concatenate(scores), DIGITS)
        found = np.flatnonzero(rounded >= max(round(floor - slack, DIGITS), slack))
        found = found[np.lexsort((ids[found], -rounded[found]))[:k]]
        return ids[found], rounded[found]

    def _mostly_open(self, t: np.ndarray, weight: np.ndarray, most: np.ndarray, least: float) -> bool:
        """Whether the groups of blocks that may have a score of `least` have most of the terms' postings, by runs."""
        lo, hi = self.group_entries[t], self.group_entries[t + 1]
        e = _ranges(lo, hi)
        group = self.group[e]
        frequent = np.maximum.reduceat(most, np.arange(0, self.blocks, GROUP))
        bound = np.bincount(group, np.repeat(weight, hi - lo) * self.group_most[e], minlength=len(frequent)) + frequent
        return 2 * np.count_nonzero((bound >= least)[group]) >= len(group)


def _lists(named: DataFrame, size: int, name: str) -> DataFrame:
    """The column file of named in lists of `size` (the last of about a thousand may be shorter)."""
    parts = max(1, named.count() // 1000)
    place = F.row_number().over(Window.partitionBy("part").orderBy("file"))
    dealt = named.select("file", F.pmod(F.xxhash64("file"), F.lit(parts)).alias("part")).withColumn("list", F.floor((place - 1) / size))
    return dealt.groupBy("part", "list").agg(F.sort_array(F.collect_list("file")).alias(name)).select(name)


def _merge(held, ids, scores, k):
    ids, scores = np.concatenate((held[0], ids)), np.concatenate((held[1], scores))
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): for each of queries (query_id, text) the k
    best of documents (doc_id, text) by BM25 over lower-cased (A-Z) words.

    A query's terms are all distinct words of its whole text, each weighing its
    number there times its inverse document frequency over all documents. A
    document with the query's own id is left out; documents without a common
    term have no score and no place, so a query may have fewer than k rows, and
    one without words has none. Scores are rounded to DIGITS digits, ties go to
    the smaller doc_id. Rows without an id are not searched; repeated rows of
    one doc_id are found each; other columns are ignored.
    """
    spark = documents.sparkSession
    folder = shared_path(spark, "bm25")
    shards = build_index(documents, folder)
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    n, mean = total.n, max(total.words / max(total.n, 1), 1e-9)
    terms = stage(query_terms(queries.filter("query_id IS NOT NULL")), "terms")
    wanted = stage(terms.select("term").distinct(), "wanted")
    frequencies = document_frequencies(shards, folder, wanted)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(frequencies, "term").select("query_id", "term", (F.col("tf") * idf).alias("weight"))
    per_query = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    blocks = _query_files(per_query, folder)
    # names only: each piece of work is a few shards and a few files of queries
    work = _lists(shards, SHARDS, "files").crossJoin(_lists(blocks, FILES, "queries"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        files, folder_at = _open(folder)
        for batch in sliced(batches, 1):
            for names, query_names in zip(batch.column("files").to_pylist(), batch.column("queries").to_pylist()):
                asked = [_load(files, f"{folder_at}/{q}") for q in query_names]
                held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                for name in names:
                    shard = Shard(_load(files, f"{folder_at}/{name}"), mean)
                    for a, q in enumerate(asked):
                        before = [held.get((a, i)) for i in range(len(q["ids"]))]
                        floors = [float(b[1][-1]) if b is not None and len(b[1]) == k else 0.0 for b in before]
                        for i, found in enumerate(shard.best(q, k, floors)):
                            held[a, i] = found if before[i] is None else _merge(before[i], *found, k)
                for (a, i), (ids, scores) in held.items():
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), asked[a]["ids"][i])), pa.array(ids), pa.array(scores)], names=["query_id", "doc_id", "score"])

    # dealt in turn, so that tasks have equal numbers of pieces
    found = work.repartition(tasks).mapInArrow(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


