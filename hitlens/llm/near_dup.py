"""Near-duplicate classes by SetSketch registers.

Each text's set of shingles is sketched into M registers. A register holds the
truncated, exponentially spaced level of the least of the set's random points:
K = floor(1 - log_b(min x)), clipped to 0..Q. Registers merge by maximum and
two sets agree in a register with a probability of about their Jaccard
similarity. Bands of registers propose candidates, the joint likelihood of the
register comparison (with the known set sizes) discards the far ones, and the
full shingle sets confirm every link.

The nodes of the graph are classes: the distinct sets, told apart by a 128-bit
fingerprint, whatever the ids of their rows are. Rows without an id, rows that
share an id and repeated rows are members of their text's class.

Skew. Texts with the same set collapse into a class by an aggregation with
map-side combine, so thousands of copies are one node. Nodes are numbered at
random. Within a band's bucket every member is tried against two hubs, the
smallest and the largest node, which a group of near copies shares in most of
its buckets: linear in the bucket, and few pairs. Buckets whose members are
then in different components are compared in blocks of about BLOCK members, by
registers alone and across components only, each pair in its first common
bucket; full sets are fetched for the members that the likelihood keeps. No
bucket is capped. Joins on keys that may be hot (buckets, hubs, components,
classes) deal a hot key over several tasks.

Recall. A pair at exactly the threshold of 0.8 meets in no band with a
probability of (1 - 0.8^5)^40 = 1.3e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.blocked_bloom import maybe_listed, only_listed, without_listed
from hitlens.llm.common import fresh, sliced, stage
from hitlens.llm.components import components
from hitlens.llm.skew import spread_join
from hitlens.llm.textkit import U64, mix, shingles, utf8, word_hashes

M, ROWS = 200, 5
BASE, RATE, Q = 1.001, 20.0, 65534
#: Members of a block, and the elements of all their sets.
BLOCK, BLOCK_WORDS = 512, 1 << 19
#: A similarity estimate from M registers has a standard error of at most
#: 0.0283 at 0.8: pairs 5 errors below the threshold are dropped (3e-7).
SLACK = 5 * 0.0283


def minima(elements: np.ndarray, counts: np.ndarray, m: int = M) -> np.ndarray:
    """For each set the least point in each of m registers, (sets, m) floats.

    Every element throws a Poisson stream of points at the registers (rate m
    in all, so 1 at each register). Points beyond reach/size cannot be minima
    unless a register stays empty; for those few sets the reach is doubled.
    """
    sets = len(counts)
    out = np.full(sets * m, np.inf)
    todo = np.flatnonzero(counts)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    reach = np.log(m) + 4.0
    while len(todo):
        size = counts[todo]
        owner = np.repeat(todo, size)
        which = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[todo], size)
        state, x = elements[which], np.zeros(len(owner))
        limit = np.repeat(reach / size, size)
        while len(owner):
            state = state + U64(0x9E3779B97F4A7C15)
            draw = mix(state)
            x = x - np.log(((draw >> U64(24)).astype(np.float64) + 0.5) * 2.0**-40) / m
            keep = x < limit
            if not keep.all():
                owner, state, x, limit, draw = owner[keep], state[keep], x[keep], limit[keep], draw[keep]
            slot = ((draw & U64(0xFFFFFF)) * U64(m)) >> U64(24)
            np.minimum.at(out, owner * m + slot.astype(np.int64), x)
        todo = todo[np.isinf(out.reshape(sets, m)[todo]).any(axis=1)]
        reach *= 2
    return out.reshape(sets, m)


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) from minima at rate 1; an empty set has zeros."""
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, level), 0, Q + 1).astype(np.uint16)


def likely_jaccard(greater, less, n_u, n_v, m: int = M) -> np.ndarray:
    """The similarity of greatest likelihood, given in how many registers U is
    greater or less than V, and both set sizes. All arguments are arrays."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal = m - greater - less

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        more, fewer = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((greater, more), (less, fewer), (equal, 1 - more - fewer))]
        return parts[0] + parts[1] + parts[2]

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(26):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = value(a) > value(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _sets_of(column, k: int):
    return shingles(*word_hashes(*utf8(column)), k)


def _prints(found: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 128-bit fingerprint of each set, in two halves; 0 for empty sets."""
    counts = np.diff(at)
    filled = np.flatnonzero(counts)
    prints = [np.zeros(len(counts), U64), np.zeros(len(counts), U64)]
    for out, salt in zip(prints, (0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(filled):
            out[filled] = mix(np.add.reduceat(mix(found ^ U64(salt)), at[:-1][filled]) + counts[filled].astype(U64))
    return [x.view(np.int64) for x in prints]


def _named(documents: DataFrame) -> DataFrame:
    """(doc_id, w1, w2, text): w1 and w2 are a 128-bit name of a row's id and text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("w1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("w2"), "text")


def sketch(documents: DataFrame, k: int) -> DataFrame:
    """For each row of documents: doc_id, w1, w2 (_named), n (set size), f1, f2
    (fingerprint of the set), regs (registers)."""

    def run(batches):
        for batch in sliced(batches):
            found, at = _sets_of(batch.column(3), k)
            counts = np.diff(at)
            regs = registers(minima(found, counts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(counts), *map(pa.array, _prints(found, at)), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "w1", "w2", "n", "f1", "f2", "regs"],
            )

    return _named(documents).mapInArrow(run, "doc_id long, w1 long, w2 long, n long, f1 long, f2 long, regs binary")


def _classes(sketches: DataFrame) -> DataFrame:
    """The distinct sets, staged: f1, f2, node (a random number, one to one), n,
    regs, copies (rows), id (least doc_id) and w1, w2 (names of one row with that id)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "w1", "w2")).alias("first")
    sets = sketches.filter("n > 0").groupBy("f1", "f2").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"), first)
    # xxhash64 of a long is one to one
    node = F.xxhash64(F.monotonically_increasing_id()).alias("node")
    return stage(sets.select("f1", "f2", node, "n", "regs", "copies", F.col("first.doc_id").alias("id"), "first.w1", "first.w2"), "classes")


def _bands(classes: DataFrame) -> DataFrame:
    """key, node: a row for each band of each class; the key ends in the band's number."""

    def run(batches):
        for batch in sliced(batches, 4000):
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, M // ROWS, ROWS).astype(U64)
            coefficient = mix(np.arange(11, 11 + ROWS, dtype=U64)) | U64(1)
            band = np.arange(M // ROWS, dtype=U64)
            key = mix((regs * coefficient).sum(axis=2, dtype=U64) ^ mix(band)) & ~U64(63) | band
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), M // ROWS))], names=["key", "node"])

    return classes.select("node", "regs").mapInArrow(run, "key long, node long")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, node, hub, far of the buckets of two nodes or more, staged; hub and
    far are a bucket's least and greatest node."""
    bands = _bands(classes)
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("rows")).filter("hub <> far")
    hubs = stage(hubs, "hubs")
    # a band that no other set has is not shuffled again
    shared = maybe_listed(bands, "key", hubs.select("key"))
    return stage(spread_join(shared, hubs.drop("rows"), ["key"], F.col("node"), hubs.select("key", "rows")), "buckets")


def _registers_of(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, regs) of nodes (node) and of few others, staged: most classes are
    in no pair, and registers are the widest column that a join would move."""
    return stage(maybe_listed(classes.select("node", "n", "regs"), "node", stage(nodes.distinct(), "nodes")), "few")


def _near(ra, rb, na, nb, least: float) -> np.ndarray:
    """Whether sets with registers ra, rb and sizes na, nb may reach the similarity least."""
    good = (ra == rb).sum(axis=1) >= least * M
    good &= np.minimum(na, nb) >= least * np.maximum(na, nb)
    which = np.flatnonzero(good)
    if len(which):
        ra, rb, na, nb = (x[which] if len(x) == len(good) else x for x in (ra, rb, na, nb))
        good[which] = likely_jaccard((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), na, nb) >= least
    return good


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes (a, b) that may reach the similarity `least` by their
    registers, staged. pairs is staged; a may be a hub of many."""

    def run(batches):
        for batch in sliced(batches, 4000):
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(_near(ra, rb, na, nb, least)))

    of = _registers_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes)
    joined = spread_join(pairs.join(of.toDF("b", "nb", "rb"), "b"), of.toDF("a", "na", "ra"), ["a"], F.col("b"), pairs.groupBy("a").agg(F.count("*").alias("rows")))
    return stage(joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long"), "near")


def _full_sets(nodes: DataFrame, classes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(node, elements: the sorted set as bytes) of each of nodes (node), staged.

    The set is made from one text of the class, where that stands: rows of other
    names are dropped by a filter before, copies of that row by an aggregation after."""

    def run(batches):
        for batch in sliced(batches):
            found, at = _sets_of(batch.column(1), k)
            elements = [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, _prints(found, at)), pa.array(elements, pa.binary())], names=["f1", "f2", "elements"])

    wanted = stage(classes.select("node", "f1", "f2", "w1").join(nodes.distinct(), "node", "left_semi"), "wanted")
    texts = maybe_listed(_named(documents), "w1", wanted.select("w1"))
    made = texts.select("w1", "text").mapInArrow(run, "f1 long, f2 long, elements binary")
    sets = made.groupBy("f1", "f2").agg(F.first("elements").alias("elements"))
    return stage(sets.join(wanted.drop("w1"), ["f1", "f2"]).select("node", "elements"), "sets")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose full shingle sets have
    100 * intersection >= percent * union, staged. pairs is staged."""

    def run(batches):
        for batch in sliced(batches):
            good = np.zeros(batch.num_rows, bool)
            before, x = None, None
            for i, (a, ea, eb) in enumerate(zip(*(batch.column(c) for c in ("a", "ea", "eb")))):
                if a != before:
                    before, x = a, np.frombuffer(ea.as_buffer(), U64)
                good[i] = _linked(x, np.frombuffer(eb.as_buffer(), U64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, documents, k)
    joined = spread_join(pairs.join(sets.toDF("b", "eb"), "b"), sets.toDF("a", "ea"), ["a"], F.col("b"), pairs.groupBy("a").agg(F.count("*").alias("rows")))
    return stage(joined.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long"), "links")


def _undecided(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """The buckets that lie in several components, staged: key, node, c (the
    component; a node without a label is one of its own), n (size of the node's
    set) and blocks (into which the bucket is cut). buckets is staged."""
    own = F.struct(F.coalesce("component", "node").alias("c"), F.col("component").isNull().alias("alone"))
    rows = stage(buckets.join(labels, "node", "left").select("key", "node", own.alias("c")), "labelled")
    several = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows")).filter("lo <> hi")
    several = stage(several.select("key", "rows"), "several")
    shared = maybe_listed(rows, "key", several.select("key")).join(classes.select("node", "n"), "node")
    rest = stage(spread_join(shared, several.select("key"), ["key"], F.col("node"), several), "rest")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int")
    return stage(spread_join(rest, rest.groupBy("key").agg(blocks.alias("blocks")), ["key"], F.col("node"), several), "rest")


def _across(rest: DataFrame, classes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes of a bucket and of different components: of those
    that exist as many as join the components, staged.

    Blocks of a bucket are compared with each other by their registers. What a
    pair of blocks leaves is one row: the pairs that may reach the threshold,
    each in its first common bucket, and the nodes in them. Only those nodes'
    full sets are fetched, and a pair that is in one component by then is not
    compared any more."""
    least = percent / 100 - SLACK
    members = (
        rest.join(_registers_of(rest.select("node"), classes).drop("n"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .groupBy("key", "block", "blocks")
        .agg(F.collect_list(F.struct("node", "c.c", "c.alone", "n", "regs")).alias("members"))
    )
    members = stage(members, "blocks")
    nothing = F.lit(None).cast(members.schema["members"].dataType)
    several = members.filter("blocks > 1")
    left = several.withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks")))).filter("other < blocks")
    both = left.join(several.select("key", F.col("block").alias("other"), F.col("members").alias("others")), ["key", "other"])
    work = members.select("key", "block", F.col("block").alias("other"), "members", nothing.alias("others")).unionByName(both.drop("blocks"))

    def read(value):
        flat = value.flatten()
        node, c, lone, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        # a lone node's number may be another component's: tell them apart
        return node, c.view(U64) * U64(2) + lone.astype(U64), n.astype(float), np.frombuffer(b"".join(flat.field(4).to_pylist()), np.uint16).reshape(-1, M)

    def compare(batches):
        for batch in sliced(batches):
            for i in range(batch.num_rows):
                x, cx, nx, rx = read(batch.column("members").slice(i, 1))
                same = not batch.column("others")[i].is_valid
                y, cy, ny, ry = (x, cx, nx, rx) if same else read(batch.column("others").slice(i, 1))
                band = batch.column("key")[i].as_py() & 63
                found = [np.zeros((0, 3), np.int64)]
                for j in range(len(x)):
                    other = np.flatnonzero((cy != cx[j]) & (ny >= least * nx[j]) & (nx[j] >= least * ny) & ((y > x[j]) if same else True))
                    if not len(other):
                        continue
                    equal = rx[j] == ry[other]
                    likely = equal.sum(axis=1)
                    keep = np.flatnonzero(likely >= least * M)
                    met = equal[keep, : band * ROWS].reshape(len(keep), band, ROWS).all(axis=2).any(axis=1)
                    keep = keep[~met]
                    found.append(np.column_stack((likely[keep], np.full(len(keep), j), other[keep])))
                pairs = np.concatenate(found)
                good = [_near(rx[p[:, 1]], ry[p[:, 2]], nx[p[:, 1]], ny[p[:, 2]], least) for p in np.split(pairs, range(4096, len(pairs), 4096))]
                pairs = pairs[np.concatenate(good)]
                if not len(pairs):
                    continue
                pairs = pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:]
                nodes, at = np.unique(np.concatenate((x[pairs[:, 0]], y[pairs[:, 1]])), return_index=True)
                owner = np.concatenate((cx[pairs[:, 0]], cy[pairs[:, 1]]))[at]
                ends = np.searchsorted(nodes, np.column_stack((x[pairs[:, 0]], y[pairs[:, 1]]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in ("key", "block", "other")), pa.array([nodes.tolist()], pa.list_(pa.int64())), pa.array([owner.tobytes()]), pa.array([ends.tobytes()])],
                    names=["key", "block", "other", "nodes", "owner", "pairs"],
                )

    def verify(batches):
        for batch in sliced(batches):
            links = []
            for i in range(batch.num_rows):
                flat = batch.column("sets").slice(i, 1).flatten()
                sets = {node: np.frombuffer(e.as_buffer(), U64) for node, e in zip(flat.field(0).to_pylist(), flat.field(1))}
                nodes = batch.column("nodes")[i].as_py()
                owner = np.frombuffer(batch.column("owner")[i].as_buffer(), U64).copy()
                for a, b in np.frombuffer(batch.column("pairs")[i].as_buffer(), np.int32).reshape(-1, 2).tolist():
                    if owner[a] != owner[b] and _linked(sets[nodes[a]], sets[nodes[b]], percent):
                        links.append((nodes[a], nodes[b]))
                        owner[owner == owner[b]] = owner[a]
            yield pa.RecordBatch.from_arrays([pa.array([x[e] for x in links], pa.int64()) for e in (0, 1)], names=["a", "b"])

    place = ["key", "block", "other"]
    near = stage(work.mapInArrow(compare, "key long, block int, other int, nodes array<long>, owner binary, pairs binary"), "near")
    needed = near.select(*place, F.explode("nodes").alias("node"))
    sets = _full_sets(needed.select("node"), classes, documents, k)
    gathered = needed.join(sets, "node").groupBy(*place).agg(F.collect_list(F.struct("node", "elements")).alias("sets"))
    return stage(near.join(gathered, place).select("nodes", "owner", "pairs", "sets").mapInArrow(verify, "a long, b long"), "links")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have 100 * |x & y| >= percent * |x | y|."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sparse(links: DataFrame) -> DataFrame:
    """Links (a: hub, b: member) with the same components and few more rows than
    members: a member keeps one hub, and its hubs are linked in a row. A member
    has at most two hubs a band."""
    hubs = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("hubs"))
    rows = F.zip_with(F.concat(F.array("b"), "hubs"), F.col("hubs"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return hubs.select(F.explode(rows).alias("x")).select("x.*").filter("b IS NOT NULL").distinct()


def _judged(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """For each row of documents: doc_id, w1, w2 (_named), n, component_id and
    stand (w1, w2 of the row that stands for its group; null without shingles)."""
    sketches = stage(sketch(documents, k), "sketches")
    classes = _classes(sketches)
    buckets = _buckets(classes)
    least = percent / 100 - SLACK
    tries = F.explode(F.array(*(F.struct(F.col(c).alias("a"), F.col("node").alias("b")) for c in ("hub", "far")))).alias("x")
    stars = stage(buckets.select(tries).select("x.*").filter("a <> b").distinct(), "stars")
    links = stage(_sparse(_verified(_likely(stars, classes, least), classes, documents, k, percent)), "links")
    labels = components(links)
    # the pairs of a bucket of up to three members were all tried
    rest = _undecided(buckets.filter("node <> hub AND node <> far").select("key", "node"), labels, classes)
    if not rest.isEmpty():
        more = _across(rest, classes, documents, k, percent)
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "w1", "w2")
    linked = stage(classes.select("node", first.alias("first")).join(labels, "node"), "linked")
    heads = stage(linked.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("rows")), "heads")
    of_node = spread_join(linked.select("node", "component"), heads.select("component", "head"), ["component"], F.col("node"), heads.select("component", "rows"))
    groups = classes.join(of_node, "node", "left").withColumn("head", F.coalesce("head", first))
    groups = groups.select("f1", "f2", F.col("head.id").alias("component_id"), F.struct("head.w1", "head.w2").alias("stand"))
    # only ids and fingerprints of the rows move, and none of a row without shingles
    rows = sketches.select("doc_id", "w1", "w2", "n", "f1", "f2", F.monotonically_increasing_id().alias("at"))
    full = spread_join(rows.filter("n > 0"), groups, ["f1", "f2"], F.col("at"), classes.select("f1", "copies"))
    blank = rows.filter("n = 0").select("doc_id", "w1", "w2", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("struct<w1:bigint,w2:bigint>").alias("stand"))
    return full.select(*blank.columns).unionByName(blank)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For each row of documents (doc_id, text; other columns are ignored):
    doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    k-word shingles; component_id is the smallest doc_id that is reachable.
    A null, empty or blank text has no shingles and no links. Repeated rows are
    in one component; rows that share an id but differ in text are judged each
    by its text. A row without doc_id is linked like any other but never is the
    smallest: its component_id is null if no linked row has an id. kept is
    doc_id <=> component_id, so of repeated rows each is kept (keep_one of the
    pipeline drops repeats). An empty table gives an empty result.
    """
    out = _judged(documents, k, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents of which one stands for each near-duplicate group,
    with all their columns: the one of the smallest doc_id, once if repeated.
    Rows that share an id but differ in text are judged each by its text. Texts
    without words and rows without an id are in no group and stay; a blank row
    is dropped only as a repeat of its id and text. An empty table gives an
    empty one. Rows are told apart by a 128-bit hash of id and text."""
    name = F.struct("w1", "w2")
    by_name = _judged(documents, k, percent).filter("doc_id IS NOT NULL").groupBy(name.alias("key")).agg(F.first("stand").alias("stand"), F.count("*").alias("rows"))
    by_name = stage(by_name, "verdicts")
    dropped = stage(by_name.filter("stand <> key").select("key"), "dropped")
    repeated = stage(by_name.filter("rows > 1 AND NOT coalesce(stand <> key, false)").select("key"), "repeated")
    # a row without an id has no key and is never listed
    key = fresh(documents, "near_key")
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = documents.withColumn(key, F.when(ident.isNotNull(), F.struct(F.xxhash64(ident, text).alias("w1"), F.xxhash64(F.lit(1), ident, text).alias("w2"))))
    out = without_listed(rows, key, dropped)
    if not repeated.isEmpty():
        out = without_listed(out, key, repeated).unionByName(only_listed(out, key, repeated).dropDuplicates([key]))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))
