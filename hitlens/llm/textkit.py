"""Vectorised words, word hashes and shingles over Arrow string columns.

Words are the runs of bytes other than 0x20 and 0x09-0x0D in UTF-8. All
functions take whole texts; memory beyond the result is bounded by CHUNK and
the longest single word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, text after text, and the n + 1 offsets of the texts' words.

    Every letter is mixed with its place before the sum: a fold that is linear
    in the letters (a polynomial modulo 2^64) has colliding words for any base.
    """
    sep, values = separators(), byte_values()
    hashes, starts_of, at = [], [], 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not (sep[data[end]] or edge[end]):
            step = min(end + CHUNK, len(data))
            stop = np.flatnonzero(sep[data[end:step]] | edge[end:step])
            end = end + int(stop[0]) if len(stop) else step
        part = data[at:end]
        word = ~sep[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[at + 1 : end]
        starts = np.flatnonzero(begin)
        if len(starts):
            place = np.arange(len(part)) - starts[np.maximum(np.cumsum(begin) - 1, 0)]
            letters = mix(values[part] + place.astype(U64) * U64(0xD1342543DE82EF95))
            letters[~word] = 0
            hashes.append(mix(np.add.reduceat(letters, starts)))
            starts_of.append(starts + at)
        at = end
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    starts = np.concatenate(starts_of) if starts_of else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingles of each text, and their offsets.

    A text of fewer than k words has its whole sequence as one shingle; a text
    without words has none.
    """
    coefficient = mix(np.arange(101, 101 + k, dtype=U64)) | U64(1)
    rolled = np.zeros(max(len(words) - k + 1, 0), U64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * coefficient[j]
    rolled = mix(rolled)
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a >= k:
            found = np.sort(rolled[a : b - k + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            found = mix((words[a:b] * coefficient[: b - a]).sum(keepdims=True, dtype=U64) + U64((b - a) * 0x632BE59BD9B4E019 % 2**64))
        else:
            continue
        out.append(found)
        counts[i] = len(found)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(counts)))
