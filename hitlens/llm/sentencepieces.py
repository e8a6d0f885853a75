"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is our own: a score-ordered agenda of adjacent symbol pairs. While
a pair of neighbouring symbols forms a piece, the pair of the best score is
merged, the leftmost first among equals; symbols that are no piece become byte
pieces. No piece has a blank after another character, so a text falls apart
into segments that never merge with each other. Segments repeat: each batch
encodes its new distinct segments together, one merge of every segment's agenda
at a time in NumPy; long segments have a heap of their own.

Check: each distinct segment of an Arrow batch is also encoded by the
sentencepiece library, and any difference raises (check=False skips it).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import sliced

SPACE = "▁"
#: Segments go in step with those of about their length; longer ones have a heap.
WIDTHS = (0, 1, 4, 6, 8, 10, 12, 16, 24, 48)
#: Bytes of cached segments (as _cost counts them); half of them may be in recent use.
CACHE_BYTES = 24 << 20
#: Characters of texts, or segments of one longer text, that are split at a time.
GROUP, RUN = 1 << 20, 200_000
#: Rows of segments that are merged in step at a time, and new segments encoded at a time.
ROWS, NEW = 4096, 1 << 15
#: The symbol of a character that is no piece is OTHER and its code point.
OTHER = 1 << 21
NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces, merge table and byte pieces of a model file's content."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        n = lib.get_piece_size()
        pieces = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        bytes_of = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.byte_ids = [bytes_of.get(f"<0x{b:02X}>", -1) for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a blank after another character: segments would not be independent")
        if lib.encode("a  b") == lib.encode("a b") or lib.encode("ﬁ") == lib.encode("fi"):
            raise ValueError("only the identity normaliser is supported")
        # symbols: pieces by id, and OTHER + code point for the characters that are no piece
        self.size = n
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(OTHER)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = sorted({lib.get_score(i) for i in pieces.values()}, reverse=True)
        rank_of_score = {s: r for r, s in enumerate(order)}
        merges = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = (int(self.of_char[ord(x)]) if len(x) == 1 else pieces.get(x, -1) for x in (piece[:cut], piece[cut:]))
                if left >= 0 and right >= 0:
                    merges[left, right] = (rank_of_score[lib.get_score(i)], i)
        bits = max(12, int(np.ceil(np.log2(4 * len(merges) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        self.probes = 1
        keys = np.array([(a << 32) | b for a, b in merges], np.int64)
        for key, slot, (rank, i) in zip(keys.tolist(), self._slot(keys).tolist(), merges.values()):
            probe = 1
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, i
            self.probes = max(self.probes, probe)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(0x21)) if c not in joined and c != " ")
        # a run of blanks belongs to what follows; characters that never merge stand alone
        self.alone = frozenset(alone)
        self.segment = re.compile(rf"[ {SPACE}]*[^ {SPACE}{re.escape(alone)}]+|[{re.escape(alone)}]|[ {SPACE}]+")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no piece) and piece of each pair of symbols; right < 0: no pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[right < 0] = -2
        slot = self._slot(keys)
        rank, piece = np.full(len(keys), NEVER), np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            at = slot[open_]
            found = self.keys[at]
            hit = found == keys[open_]
            rank[open_[hit]], piece[open_[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
        return rank, piece

    def _merge_of(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and piece of one pair of symbols; None: no piece."""
        rank, piece = self.lookup(np.array([left]), np.array([right]))
        return None if rank[0] == NEVER else (int(rank[0]), int(piece[0]))

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _ids(self, symbols) -> list[int]:
        out = []
        for s in symbols:
            if s < OTHER:
                out.append(s)
            else:
                out += [self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown for b in chr(s - OTHER).encode()]
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment (blanks already written as SPACE)."""
        out: list[list[int]] = [[]] * len(segments)
        length = np.array([len(s) for s in segments], np.int64)
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            all_of_width = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(all_of_width), ROWS):
                which = all_of_width[at : at + ROWS]
                flat = self._symbols("".join([segments[i] for i in which.tolist()]))
                there = np.arange(high) < length[which][:, None]
                sym = np.full(there.shape, -1, np.int32)
                sym[there] = flat
                alive = self._lockstep(sym, there)
                flat, ends = sym[alive], np.cumsum(alive.sum(axis=1)).tolist()
                odd = set(which[((sym >= OTHER) & alive).any(axis=1)].tolist())
                flat, start = flat.tolist(), 0
                for i, end in zip(which.tolist(), ends):
                    out[i] = self._ids(flat[start:end]) if i in odd else flat[start:end]
                    start = end
        for i in np.flatnonzero(length > WIDTHS[-1]).tolist():
            out[i] = self._by_heap(segments[i])
        return out

    def _lockstep(self, sym: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Merge in every row until no pair is left; sym (-1: no symbol) and the
        mask alive of its symbols are changed in place."""
        rows, width = sym.shape
        if width == 1:
            return alive
        nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
        prv = np.tile(np.arange(-1, width - 1, dtype=np.int32), (rows, 1))
        rank = np.full((rows, width), NEVER, np.int32)
        into = np.zeros((rows, width), np.int32)
        r, p = self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank[:, :-1], into[:, :-1] = r.reshape(rows, -1), p.reshape(rows, -1)
        row = np.arange(rows)
        while len(row):
            at = rank[row].argmin(axis=1)  # the first of the least
            more = rank[row, at] != NEVER
            row, at = row[more], at[more]
            if not len(row):
                break
            gone = nxt[row, at]
            after = nxt[row, gone]
            sym[row, at] = into[row, at]
            alive[row, gone] = False
            rank[row, gone] = NEVER
            nxt[row, at] = after
            inside = after < width
            prv[row[inside], after[inside]] = at[inside]
            right = np.where(inside, sym[row, np.minimum(after, width - 1)], -1)
            rank[row, at], into[row, at] = self.lookup(sym[row, at], right)
            before = prv[row, at]
            first = before >= 0
            rr, bb = row[first], before[first]
            rank[rr, bb], into[rr, bb] = self.lookup(sym[rr, bb], sym[rr, at[first]])
        return alive

    def _by_heap(self, segment: str) -> list[int]:
        sym = self._symbols(segment).tolist()
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int] | None] = {}
        agenda: list[tuple[int, int, int, int, int, int]] = []

        def offer(i, j):
            pair = sym[i], sym[j]
            if pair not in known:
                known[pair] = self._merge_of(*pair)
            if found := known[pair]:
                heapq.heappush(agenda, (found[0], i, j, *pair, found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, left, right, piece = heapq.heappop(agenda)
            if sym[i] != left or sym[j] != right or nxt[i] != j:
                continue
            sym[i], sym[j] = piece, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                offer(i, nxt[i])
            if prv[i] >= 0:
                offer(prv[i], i)
        return self._ids([s for s in sym if s >= 0])


def _cost(segment: str, ids: bytes) -> int:
    """About the bytes that a cached segment takes: two objects and their place."""
    return 200 + len(segment) + len(ids)


def encoder(model: bytes, check: bool = True):
    """A function: texts -> the ids of each, int32 arrays without an end id.

    Beyond its results it holds the vocabulary, CACHE_BYTES of segments and the
    segments of GROUP characters or RUN segments of text, however many texts
    there are and however long one is.
    """
    vocabulary = Vocabulary(model)
    # used since the last turn, and before it: a turn drops what was not used again
    cache: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    cached = 0

    def compare(segments: list[str], ids: list[list[int]]) -> None:
        """The library encodes the segments as one text; a newline, which never
        merges, stands where a segment would join its neighbour."""
        newline = vocabulary.library.encode("\n")
        byte = newline[-1:]
        text, ours = ["\n"], [newline]
        for s, i in zip(segments, ids):
            head, tail = s[0] in (" ", SPACE) or s in vocabulary.alone, s[-1] in (" ", SPACE)
            text += [s] if head else ["\n", s]
            ours += [i] if head else [byte, i]
            if tail:
                text.append("\n")
                ours.append(byte)
        if vocabulary.library.encode("".join(text), num_threads=1) != list(chain.from_iterable(ours)):
            for s, i in zip(segments, ids):
                if len(segments) > 1:
                    compare([s], [i])
            raise AssertionError(f"the sentencepiece library encodes otherwise: {segments[:3]!r}")

    def of_segments(split: list[list[str]]) -> list[bytes]:
        nonlocal cache, older, cached
        if cached > CACHE_BYTES // 2:
            cache, older, cached = {}, cache, 0
        new = []
        for s in set(chain.from_iterable(split)) - cache.keys():
            if s in older:
                cache[s] = packed = older.pop(s)
                cached += _cost(s, packed)
            else:
                new.append(s)
        for at in range(0, len(new), NEW):
            part = new[at : at + NEW]
            ids = vocabulary.encode_segments([s.replace(" ", SPACE) for s in part])
            if check:
                for i in range(0, len(part), 2000):
                    compare(part[i : i + 2000], ids[i : i + 2000])
            for s, i in zip(part, ids):
                cache[s] = packed = np.array(i, np.int32).tobytes()
                cached += _cost(s, packed)
        return [b"".join([cache[s] for s in found]) for found in split]

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            if len(texts[at]) > GROUP:
                segments = (m.group() for m in vocabulary.segment.finditer(" " + texts[at]))
                runs = iter(lambda: list(islice(segments, RUN)), [])
                out.append(b"".join([of_segments([run])[0] for run in runs]))
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= GROUP:
                size, end = size + len(texts[end]), end + 1
            out += of_segments([vocabulary.segment.findall(" " + t) if t else [] for t in texts[at:end]])
            at = end
        return [np.frombuffer(ids, np.int32) for ids in out]

    return encode, vocabulary


def encode_documents(documents: DataFrame, model: bytes, check: bool = True, with_ids: bool = False) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, n_tokens, ids_sha256,
    decoded_sha256, and with_ids also ids (array<int>) and decoded (string).

    The ids are those of the library with an end id and without sampling;
    decoded is the library's decode(ids). A null text is encoded like an empty
    one: the end id alone, decoded to an empty text. Repeated rows and null
    ids of documents are kept; other columns are ignored, and an empty table
    gives none. Memory is bounded by a few MB of whole texts (or one longer
    text) and their ids, and the segment cache.
    """

    def run(batches):
        encode, vocabulary = encoder(model, check)
        end, decode = np.array([vocabulary.end], np.int32), vocabulary.library.decode
        decimal = [str(i) for i in range(vocabulary.size)]
        for batch in sliced(batches, 1000, 1 << 20):
            all_ids = [np.concatenate((ids, end)) for ids in encode([t or "" for t in batch.column(1).to_pylist()])]
            hashes, digests, decoded = [], [], []
            for ids in map(np.ndarray.tolist, all_ids):
                hashes.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                text = decode(ids)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    decoded.append(text)
            counts = np.array([len(ids) for ids in all_ids], np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            more = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(all_ids))), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(hashes, pa.string()), pa.array(digests, pa.string()), *more],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + len(more)],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
