"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern (the set of their sources); a flow from patterns to sources routes
words to the sources' targets, where the r-th repetition of a pattern's words
costs more than the one before it (convex costs, at most `repeats`). Every
pattern then takes whole documents, by one rule whatever its size: full rounds
of all its documents; of the last round the documents in order of a seeded
hash as long as they fit; from the first that does not fit on, WINDOW
documents one by one, each if it fits (after the last hash comes the first
again; no document is taken more than `repeats` times); at last the one of
these that brings the sum nearest to the flow. Histograms of the hash find, level by level, where
documents cease to fit. Only counts of patterns and of histogram bins move; a
hot source is summed within the map tasks like any other.

What the driver holds and what is broadcast grows with the number of membership
patterns (sources, if no document has several), not with the documents: more
than MAX_PATTERNS of them raise an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import fresh, stage

SEED = 20260207
#: Bits of the hash that one histogram resolves, and how many histograms follow each other.
BITS, LEVELS = 8, 7
#: Documents that are tried one by one where the hash order ceases to fit.
WINDOW = 256
#: The most membership patterns: a plan of 100,000 rows may be broadcast.
MAX_PATTERNS = 100_000


def words_of(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def target_sizes(sizes: dict[str | None, int], weights: list[float], repeats: int, total: int | None = None) -> dict[str | None, float]:
    """Each source's share of the total by weight, at most `repeats` times its
    size; what is over goes to the others by weight, until none is above.
    total: the words to share, by default the sum of sizes."""
    weight = dict(zip(sizes, weights))
    total = sum(sizes.values()) if total is None else total
    fixed: dict[str | None, float] = {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in open_)
        targets = fixed | {s: left * weight[s] / share for s in open_}
        above = [s for s in open_ if targets[s] > repeats * sizes[s]]
        if not above:
            return {s: float(targets[s]) for s in sizes}
        fixed |= {s: float(repeats * sizes[s]) for s in above}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The cheapest maximal flow over arcs (from, to, capacity, cost >= 0): the
    flow of each arc. Shortest augmenting paths with node potentials."""
    n = 1 + max((max(a, b) for a, b, _, _ in arcs), default=max(source, sink))
    out: list[list[int]] = [[] for _ in range(n)]
    head, room, cost = [], [], []
    for a, b, capacity, price in arcs:
        for tail, tip, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[tail].append(len(head))
            head.append(tip)
            room.append(c)
            cost.append(p)
    potential = [0] * n
    while True:
        far, via = {source: 0}, {}
        queue, done = [(0, source)], set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for e in out[a]:
                b = head[e]
                if room[e] and d + cost[e] + potential[a] - potential[b] < far.get(b, float("inf")):
                    far[b], via[b] = d + cost[e] + potential[a] - potential[b], e
                    heapq.heappush(queue, (far[b], b))
        if sink not in far:
            return [room[2 * i + 1] for i in range(len(arcs))]
        longest = max(far.values())
        for a in range(n):
            potential[a] += far.get(a, longest)
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = head[via[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int) -> dict[tuple, int]:
    """The words to take from each pattern, so that the sources reach their quotas."""
    names = {s: i for i, s in enumerate(quotas)}
    arcs, taken_by = [], []
    source, sink, base = 0, 1, 2 + len(names)
    for i, (pattern, size) in enumerate(patterns.items()):
        for r in range(repeats):
            taken_by.append((pattern, len(arcs)))
            arcs.append((source, base + i, size, r * r))
        arcs += [(base + i, 2 + names[s], repeats * size, 0) for s in pattern if s in names]
    arcs += [(2 + i, sink, quotas[s], 0) for s, i in names.items()]
    flow = min_cost_flow(arcs, source, sink)
    out = dict.fromkeys(patterns, 0)
    for pattern, arc in taken_by:
        out[pattern] += flow[arc]
    return out


def _bins(level: int) -> Column:
    """The first `level` groups of BITS of a row's hash (63 bits)."""
    return F.shiftright("hash", 63 - BITS * level)


def _fill(sizes: list[tuple[int, int]], start: int, room: int, full: int, repeats: int) -> list[int]:
    """Of documents (hash, size) those that are taken from the hash start on, by
    the rule of the module's head; a hash stands as often as it is taken.
    Documents before start have been taken in this round."""
    order = sorted((h < start, h, size) for h, size in sizes)
    count = {h: full + before for before, h, _ in order}
    taken: list[int] = []

    def take(h):
        taken.append(h)
        count[h] += 1

    at = 0
    while at < len(order) and order[at][2] <= room:
        room -= order[at][2]
        take(order[at][1])
        at += 1
    tried = [order[(at + i) % len(order)][1:] for i in range(WINDOW)]
    for h, size in tried:
        if size <= room and count[h] < repeats:
            room -= size
            take(h)
    near = min(((abs(size - room), h) for h, size in tried if count[h] < repeats), default=None)
    if near and near[0] < room:
        take(near[1])
    return taken


def _choose(rows: DataFrame, totals: dict[int, tuple[int, int]], flows: dict[int, int], repeats: int) -> dict[int, tuple[int, int, list[int]]]:
    """A seeded choice of about flows[pattern] words of each pattern's rows
    (pattern, hash, size); totals: pattern -> (size, rows with words).

    Result: (full, limit, more): every row is taken `full` times, those with a
    hash below limit once again, and those in more as often as they stand there. A histogram
    of the hash's next bits finds, level by level, the bin in which the running
    sum passes the wanted words, until it has WINDOW rows at most; from its
    start on about 4 * WINDOW rows are read and settled by _fill. What reaches
    the driver is patterns x 2^BITS sums a level and patterns x 4 * WINDOW rows.
    """
    spark = rows.sparkSession
    out, open_, settle = {}, {}, {}
    for p, (size, n) in totals.items():
        full = min(repeats, flows[p] // size) if size else 0
        out[p] = (full, 0, [])
        if size and full < repeats and flows[p] > full * size:
            open_[p] = (0, flows[p] - full * size)
    for level in range(LEVELS):
        if not open_:
            break
        places = spark.createDataFrame([(p, at) for p, (at, _) in open_.items()], "pattern int, at long")
        inside = rows.join(F.broadcast(places), "pattern").filter(_bins(level) == F.col("at"))
        found: dict[int, list] = {}
        for r in inside.groupBy("pattern", _bins(level + 1).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            found.setdefault(r.pattern, []).append((r.bin, r.size, r.n))
        narrowed = {}
        for p, (_, room) in open_.items():
            for b, size, n in sorted(found[p]):
                if size > room:
                    start = b << (63 - BITS * (level + 1))
                    out[p] = (out[p][0], start, [])
                    if n > WINDOW and level + 1 < LEVELS:
                        narrowed[p] = (b, room)
                    else:
                        settle[p] = (start, room)
                    break
                room -= size
        open_ = narrowed
    if settle:
        ends = {p: start + 2**63 * min(4 * WINDOW, n := totals[p][1]) // n - 1 for p, (start, _) in settle.items()}
        # beyond the last hash the range goes on at the first
        places = [(p, start, min(ends[p], 2**63 - 1), ends[p] - 2**63) for p, (start, _) in settle.items()]
        places = spark.createDataFrame(places, "pattern int, low long, high long, wrapped long")
        inside = rows.join(F.broadcast(places), "pattern").filter(F.col("hash").between(F.col("low"), F.col("high")) | (F.col("hash") <= F.col("wrapped")))
        docs: dict[int, list] = {}
        for r in inside.groupBy("pattern", "hash").agg(F.sum("size").alias("size")).collect():
            docs.setdefault(r.pattern, []).append((r.hash, r.size))
        for p, (start, room) in settle.items():
            out[p] = (out[p][0], start, _fill(docs[p], start, room, out[p][0], repeats))
    return out


def _pattern(documents: DataFrame, sources: Column | None) -> Column:
    """The sorted array of a row's sources."""
    if sources is None:
        return F.array(F.col("source").cast("string"))
    return F.coalesce(F.array_sort(F.array_distinct(sources.cast("array<string>"))), F.array().cast("array<string>"))


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def _by_point(s: str | None):
    return s is None, s or ""


def plan_mix(sized: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3) -> DataFrame:
    """For rows (sources, hash, size), a row for each membership pattern: known
    (the pattern), full (rounds of all its documents), limit and more (hashes
    taken once again), source_size and target of its first source."""
    # one row for each membership pattern: as many as sets of sources, not as documents
    found = sized.groupBy("sources").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"))
    few = found.limit(MAX_PATTERNS + 1).collect()
    if len(few) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources: join small sources before mixing")
    totals = sorted(((tuple(r.sources), r.size, r.n) for r in few), key=lambda t: [_by_point(s) for s in t[0]])
    sizes = {s: sum(size for p, size, _ in totals if s in p) for s in sorted({s for p, _, _ in totals for s in p}, key=_by_point)}
    # a document of several sources counts once
    total = sum(size for p, size, _ in totals if p)
    targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats, total)
    flows = route({p: size for p, size, _ in totals}, {s: round(t) for s, t in targets.items()}, repeats)
    spark = sized.sparkSession
    numbered = spark.createDataFrame([(list(p), i) for i, (p, _, _) in enumerate(totals)], "sources array<string>, pattern int")
    rows = sized.filter("size > 0").join(F.broadcast(numbered), "sources").select("pattern", "hash", "size")
    chosen = _choose(rows, {i: t[1:] for i, t in enumerate(totals)}, {i: flows[t[0]] for i, t in enumerate(totals)}, repeats)
    plan = [(list(p), *chosen[i], sizes.get(p[0], 0) if p else 0, targets.get(p[0], 0.0) if p else 0.0) for i, (p, _, _) in enumerate(totals)]
    return spark.createDataFrame(plan, "known array<string>, full long, limit long, more array<long>, source_size long, target double")


def _times(hash_: Column, plan: str) -> Column:
    """How often the row of a hash is taken by the plan in the column `plan`."""
    again = F.size(F.filter(F.col(f"{plan}.more"), lambda h: h == hash_))
    return F.col(f"{plan}.full") + (hash_ < F.col(f"{plan}.limit")).cast("long") + again


def mix(documents: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3, seed: int = SEED, sources: Column | None = None) -> DataFrame:
    """For each row of documents (doc_id, text, source): doc_id, size (words),
    source_size, target, taken (words, repeats counted).

    Sources in order of code points, null last, have the weights in turn. The
    targets share all words; none is above `repeats` times its source's size.
    sources: an array column of each row's sources, for overlapping ones; the
    default is the one in `source`, null counting as a source. A document of
    several sources counts once in the total, adds to each source's size and
    serves any of their targets; its source_size and target are those of its
    first source. One without sources is not taken and has 0 in both. A document is
    taken whole, at most `repeats` times. A null or empty text has the size 0
    and takes 0. Equal rows are told apart by nothing and so are taken alike;
    reruns agree, as the choice is by a seeded hash of doc_id and text. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _pattern(documents, sources).alias("sources"), _hash(seed).alias("hash"), words_of(F.col("text")).alias("size"))
    sized = stage(rows, "sizes")
    plan = plan_mix(sized, weights, repeats)
    plan = plan.select("known", F.struct(*plan.columns).alias("plan"))
    joined = sized.join(F.broadcast(plan), F.col("sources") == F.col("known"))
    taken = F.when(F.col("size") > 0, F.col("size") * _times(F.col("hash"), "plan")).otherwise(0)
    return joined.select("doc_id", "size", "plan.source_size", "plan.target", taken.cast("long").alias("taken"))


def mix_documents(documents: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3, seed: int = SEED, sources: Column | None = None) -> DataFrame:
    """The rows of documents that the mix takes (see mix), each as often as it is
    taken, with all their columns; rows without words, null or empty, are never
    taken. The rows are not shuffled: the plan comes to them."""
    sized = stage(documents.select(_pattern(documents, sources).alias("sources"), _hash(seed).alias("hash"), words_of(F.col("text")).alias("size")), "sizes")
    plan = plan_mix(sized, weights, repeats)
    pattern, hash_, known, mine, copy = (fresh(documents, f"mix_{c}") for c in ("pattern", "hash", "known", "plan", "copy"))
    plan = plan.select(F.col("known").alias(known), F.struct(*plan.columns).alias(mine))
    rows = documents.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumns({pattern: _pattern(documents, sources), hash_: _hash(seed)})
    joined = rows.join(F.broadcast(plan), F.col(pattern) == F.col(known))
    copies = F.explode(F.array_repeat(F.lit(1), _times(F.col(hash_), mine).cast("int")))
    return joined.withColumn(copy, copies).select(*(F.col(f"`{c}`") for c in documents.columns))
