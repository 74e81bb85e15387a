"""Array kernels over whole Arrow batches: UTF-8 views, word spans, word hashes and shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer document is handled alone.
CHUNK = 2 << 20
_ROOT = 0x9E3779B97F4A7C15
_R = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte; A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(_ROOT))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to words: all but those in the given inclusive ranges."""
    inside = np.ones(256, bool)
    for low, high in outside:
        inside[low : high + 1] = False
    return inside


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z; bytes from 0x80 are parts of letters.
BLANK_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
PLAIN_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_VALUES = byte_values()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        for i, base in enumerate((_R, _RINV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
            _powers[i : i + 1] = [table]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    member = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = member.copy(), member.copy()
    if n:
        start[1:] &= ~member[:-1] | edge[1:n]
        stop[:-1] &= ~member[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words up to the case of A-Z."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_ROOT))


def hash_text(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words, in order."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * U64(_R) + hashes[j : j + n])
    return out


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a shingle."""
    out = hashes[:1] ^ U64(len(hashes))
    for j in range(1, len(hashes)):
        out = mix(out * U64(_R) + hashes[j : j + 1])
    return mix(out)


def shingle_sets(column: pa.Array, k: int, inside: np.ndarray = BLANK_WORDS) -> Iterator[np.ndarray]:
    """For each document its sorted distinct shingles; shorter texts are one shingle, texts without words none."""
    data, offsets = utf8(column)
    for a, b in doc_chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at, inside)
        hashes = word_hashes(part, starts, ends)
        runs = windows(hashes, k)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            else:
                yield whole(hashes[lo:hi])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s : s + n]`` for all pairs."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - begin, lengths) + np.arange(total)]
