"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. One pass over the whole texts turns each into STATS document statistics
   (staged: a few numbers a document).
2. Random Fourier features approximate a Gaussian kernel over the
   standardised statistics. Every partition of the labelled rows sums its part
   of the normal equations; the parts are added by row of the matrix, and only
   the summed matrix, whose size is fixed, reaches the driver.
3. Isotonic regression over binned scores of labelled rows that the ridge fit
   has not seen maps scores to probabilities.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.llm.blocked_bloom import maybe_listed
from hitlens.llm.common import sliced, stage
from hitlens.llm.textkit import utf8

STATS = 20
X = [f"x{i}" for i in range(STATS)]
FOURIER, WIDTH, RIDGE, SEED = 256, 4.5, 1e-3, 20260101
#: Bins of the raw score for the calibration: from LOW to HIGH, STEPS to a unit.
LOW, HIGH, STEPS = -1.0, 2.0, 1024
#: At most so many labelled rows (about; chosen by hash) enter the ridge fit.
MAX_FIT_ROWS = 2_000_000
#: The share of the uncalibrated score, which orders rows of equal probability.
ORDER = 1e-3

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _SHOUT, _SYMBOL, _OTHER, _LEAD, _TAIL = range(11)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.int64)
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[0x20, 9, 11, 12, 13]] = _BLANK
    out[10] = _LINE
    out[[ord(c) for c in ".,;:?"]] = _STOP
    out[ord("!")] = _SHOUT
    out[[ord(c) for c in "#*$%&|<>@^~_+=\\/{}[]"]] = _SYMBOL
    out[0x80:0xC0] = _TAIL
    out[0xC0:] = _LEAD
    return out


def statistics(column) -> np.ndarray:
    """(texts, STATS) numbers; a null or empty text has zeros."""
    offsets, data = utf8(column)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(owner * 11 + _classes()[data], minlength=n * 11).reshape(n, 11).astype(float)
    chars = np.maximum(count.sum(axis=1) - count[:, _TAIL], 1)
    own = np.zeros((n, 8))
    for i, text in enumerate(column.to_pylist()):
        words = (text or "").split()
        if not words:
            continue
        seen = Counter(words)
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        stems = [w for w in seen if w[-1:].isalnum()]
        own[i] = (
            len(words),
            len(seen),
            max(seen.values()),
            sum(a == b for a, b in zip(words, words[1:])),
            len(lines),
            len(set(lines)),
            sum(seen[w] for w in stems),
            sum(c for w, c in seen.items() if len(w) <= 3),
        )
    words, distinct, top, twice, lines, distinct_lines, plain, short = own.T
    w, ln = np.maximum(words, 1), np.maximum(lines, 1)
    columns = [
        np.log1p(words),
        np.log1p(count.sum(axis=1)),
        (chars - count[:, _BLANK] - count[:, _LINE]) / w / 10,
        *(np.sqrt(count[:, c] / chars) for c in (_UPPER, _DIGIT, _BLANK, _LINE, _STOP, _SHOUT, _SYMBOL, _OTHER, _LEAD)),
        np.log1p(distinct) / np.log(w + 2),
        top / w,
        np.sqrt(twice / w),
        np.log1p(words / ln),
        1 - distinct_lines / ln,
        plain / w,
        short / w,
        np.log1p(lines),
    ]
    return np.where(words[:, None] > 0, np.column_stack(columns), 0.0)


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Bias, standardised statistics and random Fourier features of x."""
    rng = np.random.default_rng(SEED)
    frequency, phase = rng.standard_normal((STATS, FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, FOURIER)
    z = np.clip((x - mean) / spread, -5, 5)
    return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ frequency + phase) * np.sqrt(2 / FOURIER)])


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of least squares, by pooling adjacent violators."""
    pooled: list[list[float]] = []
    for w, t in zip(weight, total):
        pooled.append([w, t, 1])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][0] >= pooled[-1][1] * pooled[-2][0]:
            w1, t1, n1 = pooled.pop()
            pooled[-1] = [pooled[-1][0] + w1, pooled[-1][1] + t1, pooled[-1][2] + n1]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in pooled]) if pooled else np.zeros(0)


def _stats(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            values = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values.T)], names=["doc_id", *X])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in X))


def _normal_equations(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The matrix [F'F, F'y] over rows (y, x0, x1, ...), summed by partition and then by its rows."""
    size = 1 + STATS + FOURIER

    def part(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            f = fourier(np.column_stack([batch.column(c).to_numpy() for c in X]), mean, spread)
            total += f.T @ np.column_stack([f, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])

    def add(batches):
        total: dict[int, list[bytes]] = {}
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(i, []).append(sums)
        # sorted: the sum does not depend on the order in which parts arrive
        rows = {i: np.sum([np.frombuffer(s) for s in sorted(parts)], axis=0) for i, parts in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], names=["i", "sums"])

    parts = rows.repartition(32, "doc_id").mapInArrow(part, "i int, sums binary")
    summed = parts.repartition(8, "i").mapInArrow(add, "i int, sums binary").collect()
    return np.array([np.frombuffer(r.sums) for r in sorted(summed, key=lambda r: r.i)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in X])


def fit(stats: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS):
    """A function from a matrix of statistics to scores, learned from stats
    (doc_id, x0, x1, ...) and labels (doc_id, quality); see quality_scores."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    learn = stage(stats.join(known.filter(fold != 2), "doc_id").select("doc_id", "y", *X), "learn")
    rows = learn.filter(fold < 2)
    totals = rows.agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m_{x}") for x in X), *(F.stddev_pop(x).alias(f"s_{x}") for x in X)).first()
    if not totals.n:
        return lambda x: np.full(len(x), 0.5)
    if totals.n > max_fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_fit_rows / totals.n)))
    mean, spread = (np.array([totals[f"{p}_{x}"] for x in X]) for p in "ms")
    spread = np.maximum(spread, 1e-3)
    system = _normal_equations(rows, mean, spread)
    gram, target = system[:, :-1], system[:, -1]
    penalty = np.full(len(gram), RIDGE * gram[0, 0])
    penalty[0] = 0
    beta = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(len(gram)), target)

    def binned(batches):
        for batch in batches:
            raw = np.clip(fourier(_matrix(batch), mean, spread) @ beta, LOW, HIGH)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.floor((raw - LOW) * STEPS).astype(np.int64))], names=["y", "bin"])

    calibrate = learn.filter(fold == 3)
    if calibrate.isEmpty():
        calibrate = rows
    bins = calibrate.mapInArrow(binned, "y double, bin long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    found = sorted((r.bin, r.n, r.total) for r in bins.collect())  # at most (HIGH - LOW) * STEPS + 1 rows
    at, n, total = (np.array(v, float) for v in zip(*found))
    # half a row of label 0 at the lower end and of label 1 at the upper keep probabilities off 0 and 1
    n, total = n + np.where((at == at[0]) | (at == at[-1]), 0.5, 0), total + np.where(at == at[-1], 0.5, 0)
    points, values = (at + 0.5) / STEPS + LOW, isotonic(n, total)

    def score(x: np.ndarray) -> np.ndarray:
        raw = np.clip(fourier(x, mean, spread) @ beta, LOW, HIGH)
        return np.clip((1 - ORDER) * np.interp(raw, points, values) + ORDER * (raw - LOW) / (HIGH - LOW), 0, 1)

    return score


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, held_out, score, predicted.

    labels: doc_id and quality 0/1; rows with a null in either are ignored and
    repeated labels of one doc_id are averaged. Rows with crc32(doc_id) mod 4 = 2
    are never learned from; of the others, remainders 0 and 1 fit the ridge (a
    sample of about max_fit_rows by hash, if there are more) and 3 calibrates.
    Without labels (or with labels of no document) every score is 0.5. A null,
    empty or blank text has the statistics zero and so some one score; repeated
    rows get equal scores each; a null doc_id is kept as null (and not held
    out). Columns other than those named are ignored.
    """
    stats = stage(_stats(documents), "stats")
    score = fit(stats, labels, max_fit_rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(_matrix(batch)))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of documents with a score of at least threshold, with all their
    columns: the scores are those of quality_scores, row by row, for null, empty
    and repeated texts, null ids and missing labels too (without any labels all
    scores are 0.5, so a threshold above that drops every row). An empty table
    gives an empty one.

    To fit, only texts that may have a label (Bloom filter) are measured; the
    others are measured once, where they stand, so that no text is shuffled.
    """
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = fit(stage(_stats(maybe_listed(texts, "doc_id", known)), "stats"), labels, max_fit_rows)

    def run(batches):
        for batch in sliced(batches):
            good = score(statistics(batch.column(batch.num_columns - 1))) >= threshold
            yield batch.filter(pa.array(good)).select(range(batch.num_columns - 1))

    # by position: the text as string comes last, whatever the columns are called
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    text = f"c{documents.columns.index('text')}"
    rows = plain.withColumn("last", F.col(text).cast("string"))
    return rows.mapInArrow(run, plain.schema).toDF(*documents.columns)
