"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.kernels import BLANK_WORDS, U64, doc_chunks, gather, utf8, word_hashes, words

#: Words of the shortest tile.
TILE = 5
#: Words of the shortest item that is matched; items under TILE words match as a whole.
SHORT = 2
#: Share of a test item's words that tiles must cover.
COVERED = 0.5
#: Bytes of test items that travel to the executors at once; a larger benchmark is searched in several passes.
PASS_BYTES = 32 << 20

_BASE = 0x9E6C63D0876A9A35
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words: each follows from prefix sums of the one before it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up = np.full(len(hashes), _BASE, U64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, _INVERSE, U64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up, out=sums[1:])
    return (sums[size:] - sums[:n]) * down


def tiles(text: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text start, item start, length), the longest unmarked common runs first.

    Ties go to the earliest place in the item, then in the text.  An item that stands in the text as a whole is one tile; else all maximal
    runs are found at once from the equal hashes and taken from a heap until too few words of the item are free.
    """
    size = len(item)
    whole = np.flatnonzero(rolling(text, size) == rolling(item, size)) if size >= least else np.zeros(0, np.int64)
    if len(whole):
        return [(int(whole[0]), 0, size)]
    mine, theirs = rolling(text, least), rolling(item, least)
    order = np.argsort(theirs, kind="stable")
    lo, hi = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
    i = np.repeat(np.arange(len(mine)), hi - lo)
    j = gather(order, lo, hi - lo)
    # maximal runs: seeds of one diagonal that follow each other
    place = np.lexsort((i, i - j))
    i, j = i[place], j[place]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), (np.diff(i - j) != 0) | (np.diff(i) != 1)]))
    length = np.diff(np.append(first, len(i))) + least - 1
    heap = list(zip((-length).tolist(), j[first].tolist(), i[first].tolist(), strict=True))
    heapq.heapify(heap)
    used_text, used_item = np.zeros(len(text), bool), np.zeros(size, bool)
    out: list[tuple[int, int, int]] = []
    left = size
    while heap and left >= least:
        n, j0, i0 = heapq.heappop(heap)
        n = -n
        free = ~(used_text[i0 : i0 + n] | used_item[j0 : j0 + n])
        if free.all():
            used_text[i0 : i0 + n] = used_item[j0 : j0 + n] = True
            left -= n
            out.append((i0, j0, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, j0 + a, i0 + a))
    return out


class Items:
    """Word hashes of the test items and the sorted hashes of their runs of TILE words; by length, hashes of shorter items and their places."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.words = [], []
        brief: dict[int, list[tuple[int, object]]] = {}
        for key, text in rows:
            data, offsets = utf8(pa.array([text], pa.large_string()))
            starts, ends, _ = words(data, offsets, BLANK_WORDS)
            if len(starts) >= TILE:
                self.ids.append(key)
                self.words.append(word_hashes(data, starts, ends))
            elif len(starts) >= SHORT:
                brief.setdefault(len(starts), []).append((int(rolling(word_hashes(data, starts, ends), len(starts))[0]), key))
        self.brief = {}  # length: sorted hashes, and the place in ids of each
        for n, found in brief.items():
            found.sort(key=lambda f: f[0])
            self.brief[n] = np.array([h for h, _ in found], U64), len(self.ids) + np.arange(len(found))
            self.ids.extend(key for _, key in found)
        seeds = [rolling(w, TILE) for w in self.words]
        value = np.concatenate(seeds) if seeds else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.seeds, self.owner = value[order], owner[order]

    def whole(self, text: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, 1.0, 1) of the items under TILE words that stand in the text as a whole."""
        out = []
        for n, (values, at) in self.brief.items():
            runs = rolling(text, n)
            out += [(i, 1.0, 1) for i in at[np.isin(values, runs)].tolist()]
        return out

    def search(self, text: np.ndarray, runs: np.ndarray, least: float) -> list[tuple[int, float, int]]:
        """(item, coverage, tiles) of the items whose words the text's tiles cover far enough."""
        if not len(self.seeds) or not len(runs):
            return []
        lo = np.searchsorted(self.seeds, runs, "left")
        near = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == runs)
        if not len(near):
            return []
        hi = np.searchsorted(self.seeds, runs[near], "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[near], hi, strict=True)])
        place = np.repeat(near, hi - lo[near])
        out = []
        for n in np.unique(self.owner[at]).tolist():
            # only the words that seeds of this item cover can be tiles
            keep = np.zeros(len(text) + 1, bool)
            for p in np.unique(place[self.owner[at] == n]):
                keep[p : p + TILE + 1] = True
            kept = np.flatnonzero(keep[: len(text)])
            # a gap in what is kept must not join words that do not stand together
            short = text[kept].copy()
            gap = np.flatnonzero(np.diff(kept) > 1)
            short = np.insert(short, gap + 1, np.zeros(len(gap), U64))
            got = tiles(short, self.words[n])
            share = sum(t[2] for t in got) / len(self.words[n])
            if share >= least:
                out.append((n, share, len(got)))
        return out


def _search(items: Items, least: float, column: pa.Array) -> Iterator[list[tuple[int, float, int]]]:
    data, offsets = utf8(column)
    for a, b in doc_chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at, BLANK_WORDS)
        hashes = word_hashes(part, starts, ends)
        runs = rolling(hashes, TILE)
        hit = np.concatenate([[0], np.cumsum(np.isin(runs, items.seeds))]) if len(items.seeds) else np.zeros(len(runs) + 1)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            last = max(lo, hi - TILE + 1)
            found = items.search(hashes[lo:hi], runs[lo:last], least) if hi - lo >= TILE and hit[last] > hit[lo] else []
            yield found + items.whole(hashes[lo:hi]) if items.brief else found


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    passes = 1 + size // PASS_BYTES
    for i in range(passes):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == i) if passes > 1 else rows
        yield Items([(r.k, r.t) for r in part.collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = COVERED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Pairs (doc_id, item_id, coverage, tiles): documents whose tiles cover at least ``least`` of a test item's words.

    Words are lowered runs of non-blank bytes.  Tiles may stand in any order in the document.  Items of SHORT to TILE - 1
    words match where they stand as a whole; items of one word, null or empty ones match nothing; null ids are kept in the pairs; repeated documents are reported each; other columns
    are not read.  The items travel in passes of PASS_BYTES, so what is broadcast is bounded whatever the benchmark's size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "item_id", "coverage", "tiles"]

    def one(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch[0].to_pylist()
                got = [(keys[i], shared.value.ids[n], c, t) for i, found in enumerate(_search(shared.value, least, batch[1])) for n, c, t in found]
                columns = list(zip(*got, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=names)

        return rows.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles int")

    return reduce(DataFrame.union, [one(items) for items in _passes(benchmark, item_col, "text")])


def reject_leaks(docs: DataFrame, benchmark: DataFrame, least: float = COVERED, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows, all columns, that leak no test item."""
    at = docs.columns.index(text_col)
    for items in _passes(benchmark, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _search(shared.value, least, batch[at])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
