"""N-gram Jaccard join: a blocked product of the document by n-gram incidence matrix with its transpose.

Rows are distinct shingle sets, columns shingles.  Columns are ordered by document frequency (those seen more than once
in one block of the input are counted; all others count as rare), then by hash.  A pair at or above the threshold must share a column among
the first ``n - ceil(t n) + 1`` of both rows, so only those entries are multiplied to find pairs.  The greatest possible overlap of a pair, which sizes
and positions bound, is compared with the overlap that the sizes demand, and pairs below it are discarded.  So are pairs whose parities
(columns folded to as many bits as the row has entries) differ in more bits than the sizes allow, and pairs whose rows, folded to counted
buckets, have too small a sum of bucket minima, which no overlap exceeds.  The overlaps of what is left are accumulated in blocks of rows and
columns; after each block of columns, pairs that the rest of the rows can no longer lift to their bound are discarded.

Dense groups of near copies would give a square of pairs.  So the product begins with rounds in which each row of a column is multiplied with one
pivot row only; rows that this links become one component, and the next round draws other pivots in columns that still hold several components, until
a round adds few links.  Then rows of different components are multiplied.  Columns of many rows are cut into tiles there, and a task gets a pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import partitions, release, stash
from tabulith.llm.components import components
from tabulith.llm.kernels import shingle_sets

#: Entries of the table of frequent columns at most: 32 MB on each executor.
FREQUENT = 2_000_000
LEAST_FREQUENT = 48
#: Rows of a frequent column that are dealt to one task when columns are gathered, and rows of a tile.
SHARE, TILE = 100_000, 1024
#: Columns of more rows carry the rows' parities, so that most pairs go before they are written.
WATCHED = 32
#: Entries of a block of the product, pairs of a block of the overlaps, and pairs in it that share a first row.
ENTRIES_A_BLOCK, PAIRS_A_BLOCK, PAIRS_A_ROW = 100_000, 10_000, 250
#: Columns of more rows take part in further rounds with pivots, of which there are so many at most.
CROWD, ROUNDS = 16, 6
#: Columns of a row that are multiplied between two looks at the bounds.
COLUMNS = 4096


def _signed(x: int) -> int:
    return int(np.uint64(x & (1 << 64) - 1).astype(np.int64))


def _profile(sets: np.ndarray) -> tuple[int, int, int]:
    """Size and two independent 64-bit sums that stand for the set."""
    with np.errstate(over="ignore"):
        first = int(sets.sum(dtype=np.uint64))
        x = (sets ^ (sets >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        second = int((x ^ (x >> np.uint64(32))).sum(dtype=np.uint64))
    return len(sets), _signed(first), _signed(second)


def _sketch(sets: np.ndarray) -> bytes | None:
    """Counts of the set's members in 16 to 4096 buckets, about two to four in each; null where a count needs more than a byte."""
    n = len(sets)
    buckets = 1 << min(12, max(4, n.bit_length() - 2))
    counts = np.bincount((sets & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if n and counts.max() < 256 else None


def _bits(n: int) -> int:
    """Bits of the parity of a row of n entries."""
    return max(256, 1 << (n - 1).bit_length())


def _parity(sets: np.ndarray) -> bytes | None:
    """Whether an odd number of members falls on each of the bits: two sets differ in as many members as bits at least."""
    n = len(sets)
    if not n:
        return None
    m = _bits(n)
    counts = np.bincount(((sets >> np.uint64(24)) & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _profiles(k: int):
    """Rows (doc_id, n, s1, s2, sketch, parity) for documents and (column, count) for columns seen more than once in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def repeated() -> pa.RecordBatch:
            nonlocal held, size
            seen = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held, size = [], 0
            seen.sort()
            cut = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(seen) else np.zeros(0, np.int64)
            counts = np.diff(np.append(cut, len(seen)))
            more = counts > 1
            column = seen[cut[more]].view(np.int64)
            none = pa.nulls(len(column), pa.int64())
            blank = pa.nulls(len(column), pa.binary())
            return pa.RecordBatch.from_arrays([none, none, none, none, blank, blank, pa.array(column), pa.array(counts[more])], names=names)

        names = ["doc_id", "n", "s1", "s2", "sketch", "parity", "column", "count"]
        known: set[tuple[int, int, int]] = set()
        for batch in batches:
            rows, sketches, parities = [], [], []
            for shingles in shingle_sets(batch[1], k):
                rows.append(_profile(shingles))
                sketches.append(_sketch(shingles))
                parities.append(_parity(shingles))
                if rows[-1] not in known:
                    known.add(rows[-1])
                    held.append(shingles)
                    size += len(shingles)
                if size > 3_000_000:
                    yield repeated()
                    known.clear()
            n, s1, s2 = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0].cast(pa.int64()), n, s1, s2, pa.array(sketches, pa.binary()), pa.array(parities, pa.binary()), none, none], names=names)
        yield repeated()

    return run


def _prefixes(k: int, percent: int, frequent):
    """The first columns of each row in the order of frequency: (column, part, n, s1, s2, position).

    ``part`` deals the rows of a frequent column to as many tasks as its count asks for; it is -1 for all other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = frequent.value
        names = ["column", "part", "n", "s1", "s2", "position"]
        known: set[tuple[int, int, int]] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int, int]] = []
            for shingles in shingle_sets(batch[1], k):
                profile = n, s1, s2 = _profile(shingles)
                if not n or profile in known:
                    continue
                known.add(profile)
                take = n - (-(-percent * n // 100)) + 1
                if len(columns):
                    at = np.minimum(np.searchsorted(columns, shingles), len(columns) - 1)
                    rank = np.where(columns[at] == shingles, counts[at], 0)
                    order = np.lexsort((shingles, rank))[:take]
                    parts = 1 + rank[order] // SHARE
                    out.append((shingles[order], np.where(parts > 1, abs(s1) % parts, -1), n, s1, s2))
                else:
                    out.append((shingles[:take], np.full(min(take, n), -1), n, s1, s2))
            if len(known) > 200_000:
                known.clear()
            sizes = np.array([len(o[0]) for o in out], np.int64)
            each = [np.repeat(np.array([o[i] for o in out], np.int64), sizes) for i in (2, 3, 4)]
            column = np.concatenate([o[0] for o in out]).view(np.int64) if out else np.zeros(0, np.int64)
            part = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
            position = np.concatenate([np.arange(s) for s in sizes]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (column, part, *each, position)], names=names)

    return run


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes: 100 o >= p (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def _possible_by_size(percent: int, a: str, b: str) -> Column:
    """Whether sizes and positions of two entries of a column allow the least overlap."""
    n, m, i, j = (F.col(f"{x}.{f}") for f in ("n", "position") for x in (a, b))
    return F.least(n, m, n - i, m - j) >= F.ceil(percent * (n + m) / (100 + percent))


def _pivot_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row of a column with one pivot, the row of least ``rank`` among those of about its size, and of neighbouring pivots, of other roots.

    Pivots are found by map-side minima, so a column may hold any share of the rows.
    """
    band = F.floor(F.log("n") / log(100 / percent)).cast("int")
    rows = shared.select("column", band.alias("band"), F.struct("rank", "node", "n", "position", "root").alias("r"))
    pivots = rows.groupBy("column", "band").agg(F.min("r").alias("p"))
    ahead = F.lead(F.struct("band", "p")).over(Window.partitionBy("column").orderBy("band"))
    beside = pivots.withColumn("_next", ahead).where("_next.band = band + 1").select(F.col("p"), F.col("_next.p").alias("r"))
    both = rows.join(pivots, ["column", "band"]).select("p", "r").union(beside)
    both = both.where((F.col("p.root") != F.col("r.root")) & _possible_by_size(percent, "p", "r"))
    return both.select(F.least("p.node", "r.node").alias("a"), F.greatest("p.node", "r.node").alias("b")).distinct()


def _other_pairs(percent: int):
    """The product of each column, or pair of tiles of it, with itself: pairs (a, b) of rows of different roots that no bound rules out."""

    def pairs(n: np.ndarray, position: np.ndarray, root: np.ndarray, tile: np.ndarray, diagonal: bool, parity) -> Iterator[tuple[int, np.ndarray]]:
        limit = np.searchsorted(n, n * 100 // percent, "right")
        levels: dict[int, tuple[int, np.ndarray]] = {}
        if parity is not None:
            bits = np.array([len(p) * 8 for p in parity])
            for m in np.unique(bits).tolist():
                lo, mid, hi = np.searchsorted(bits, [m, m + 1, 2 * m + 1])
                own = np.frombuffer(b"".join(parity[lo:mid]), np.uint64).reshape(mid - lo, -1)
                twice = np.frombuffer(b"".join(parity[mid:hi]), np.uint64).reshape(hi - mid, 2, -1) if hi > mid else np.zeros((0, 2, own.shape[1]), np.uint64)
                levels[m] = lo, np.concatenate([own, twice[:, 0] ^ twice[:, 1]])
        for i in range(len(n) - 1):
            other = np.arange(i + 1, limit[i])
            if not len(other):
                continue
            need = _needed(n[i], n[other], percent)
            best = np.minimum(np.minimum(n[i], n[other]), np.minimum(n[i] - position[i], n[other] - position[other]))
            ok = (best >= need) & (root[other] != root[i])
            if not diagonal:
                ok &= tile[other] != tile[i]
            other, need = other[ok], need[ok]
            if len(other) and parity is not None:
                lo, level = levels[len(parity[i]) * 8]
                apart = np.bitwise_count(level[other - lo] ^ level[i - lo]).sum(1, dtype=np.int64)
                other = other[apart <= n[i] + n[other] - 2 * need]
            if len(other):
                yield i, other

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["column", "tiles", "n", "node"], kind="stable")
        column, tiles, tile, n, node, position, root = (block[c].to_numpy() for c in ("column", "tiles", "tile", "n", "node", "position", "root"))
        parity = block["parity"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (column[1:] != column[:-1]) | (tiles[1:] != tiles[:-1])])) if len(column) else np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cut, np.append(cut[1:], len(column)), strict=True):
            if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
                continue
            here = slice(lo, hi)
            own = node[here]
            sides = None if parity[lo] is None else list(parity[here])
            for i, other in pairs(n[here], position[here], root[here], tile[here], tiles[lo] % (1 << 32) == tiles[lo] >> 32, sides):
                found.append((np.minimum(own[i], own[other]), np.maximum(own[i], own[other])))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return run


def _mixed(marked: DataFrame) -> DataFrame:
    """The entries of columns that hold several roots, with the column's count in _c."""
    mixed = marked.groupBy("column").agg(F.count(F.lit(1)).alias("_c"), F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x <> _y").drop("_x", "_y")
    return marked.join(mixed, "column")


def _tiled_pairs(marked: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs of rows of different roots.  A column of more than TILE rows is cut into tiles, each pair of which is a group of its own."""
    rows = _mixed(marked)
    cut = F.ceil(F.col("_c") / TILE)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), cut))
    rows = rows.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    tiles = F.least("tile", "_u") * (1 << 32) + F.greatest("tile", "_u")
    rows = stash(rows.select("column", tiles.alias("tiles"), "tile", "n", "node", "position", "root", "parity"), "tiles")
    blocks = max(parts, 1 + rows.count() // ENTRIES_A_BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("column", "tiles"), F.lit(blocks)))
    found = stash(dealt.groupBy("block").applyInPandas(_other_pairs(percent), "a long, b long").distinct(), "other-pairs", collect=True)
    release(rows)
    return found


def _possible(percent: int):
    """The pairs whose sketches allow the least overlap; a pair without both sketches stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = _needed(batch["na"].to_numpy(), batch["nb"].to_numpy(), percent)
            ok = np.ones(len(need), bool)
            for i, (x, y) in enumerate(zip(batch["ha"].to_pylist(), batch["hb"].to_pylist(), strict=True)):
                if x is not None and y is not None:
                    small, large = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                    if len(small) < len(large):
                        large = large.reshape(-1, len(small)).sum(0)
                    ok[i] = np.minimum(small, large).sum() >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _accumulate(mine: np.ndarray, others: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which of the rows reach their least overlap with one row: its product with theirs, summed over blocks of columns.

    After each block a row goes if what is left of it, or of the one row, is too little.
    """
    alive = np.arange(len(others))
    overlap = np.zeros(len(others), np.int64)
    edges = np.append(mine[::COLUMNS], np.uint64(0xFFFFFFFFFFFFFFFF))
    edges[0] = 0
    done = np.zeros(len(others), np.int64)
    for c in range(len(edges) - 1):
        block = mine[c * COLUMNS : (c + 1) * COLUMNS]
        last = c == len(edges) - 2
        upto = np.array([len(others[k]) if last else int(np.searchsorted(others[k], edges[c + 1])) for k in alive])
        entries = np.concatenate([others[k][done[k] : u] for k, u in zip(alive, upto, strict=True)]) if len(alive) else mine[:0]
        at = np.minimum(np.searchsorted(block, entries), len(block) - 1)
        total = np.concatenate([[0], np.cumsum(block[at] == entries)])
        size = upto - done[alive]
        end = np.cumsum(size)
        overlap[alive] += total[end] - total[end - size]
        done[alive] = upto
        rest = np.minimum(len(mine) - (c + 1) * COLUMNS, np.array([len(others[k]) for k in alive], np.int64) - upto)
        alive = alive[overlap[alive] + np.maximum(rest, 0) >= need[alive]]
        if not len(alive):
            break
    reached = np.zeros(len(others), bool)
    reached[alive] = overlap[alive] >= need[alive]
    return reached


def _overlaps(k: int, percent: int):
    """The pairs of a block of rows whose accumulated overlap reaches the threshold."""

    def run(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        for node, s1, s2, shingles in zip(rows["node"], rows["s1"], rows["s2"], shingle_sets(pa.array(rows["text"], pa.large_string(), from_pandas=True), k), strict=True):
            if node not in sets and _profile(shingles)[1:] == (s1, s2):  # an id may stand for several texts
                sets[node] = shingles
        good = []
        for a, group in pairs.groupby("a")["b"]:
            mine, other = sets[a], group.to_numpy()
            theirs = [sets[b] for b in other.tolist()]
            size = np.array([len(x) for x in theirs], np.int64)
            need = _needed(np.int64(len(mine)), size, percent)
            fits = np.minimum(len(mine), size) >= need
            for x in np.flatnonzero(fits)[_accumulate(mine, [t for t, f in zip(theirs, fits, strict=True) if f], need[fits])].tolist():
                good.append((a, int(other[x])))
        return pd.DataFrame(good, columns=["a", "b"], dtype=np.int64)

    return run


def _verified(pairs: DataFrame, source: DataFrame, classes: DataFrame, sketches: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """The pairs (a, b) whose exact overlap reaches the threshold, in row blocks that hold only the rows their pairs need."""
    sides = [sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"h{x}")).hint("merge") for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "ha", "hb")
    possible = stash(both.mapInArrow(_possible(percent), "a long, b long"), "possible", collect=True)
    blocks = max(parts, 1 + possible.count() // PAIRS_A_BLOCK)
    per = possible.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    cut = F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / PAIRS_A_ROW))
    dealt = stash(possible.join(per, "a").select("a", "b", F.pmod(F.xxhash64("a", cut), F.lit(blocks)).cast("int").alias("block")), "pairs")
    release(possible)
    wanted = dealt.select("block", F.col("a").alias("node")).union(dealt.select("block", F.col("b").alias("node"))).distinct()
    # what is wanted grows with the input, so it is never broadcast
    named = wanted.join(classes.select("node", "first_id", "s1", "s2").hint("merge"), "node")
    rows = source.join(named.hint("merge"), F.col("doc_id") == F.col("first_id")).select(F.col("block").alias("at"), "node", "s1", "s2", "text")
    links = stash(dealt.groupBy("block").cogroup(rows.groupBy("at")).applyInPandas(_overlaps(k, percent), "a long, b long"), "links", collect=True)
    release(dealt)
    return links


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Link documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns (members, links).  members: doc_id, n_shingles, component_id, one row for each row of ``docs``; links: the verified
    pairs (a, b) of class representatives that join the components (no pair inside a component that other links
    already join).  Equal sets are one class, its representative the smallest id.  Words are runs of non-blank bytes
    with A-Z lowered; a text with fewer than k words is one shingle; one without words, or null, has none and links with nothing.
    Rows with a null id get a null component.  Repeated rows stay.  An id with several texts has the links of all of them, so each of its rows
    with words has the same component.  No pair or candidate is capped.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stash(source.mapInArrow(_profiles(k), "doc_id long, n long, s1 long, s2 long, sketch binary, parity binary, column long, count long"), "profiles")
    profiles = found.where(F.col("n").isNotNull()).select("doc_id", "n", "s1", "s2")
    stats = profiles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    least = max(LEAST_FREQUENT, stats.t // FREQUENT)
    often = found.where(F.col("column").isNotNull()).groupBy("column").agg(F.sum("count").alias("count")).where(F.col("count") >= least).toPandas()
    often["column"] = often["column"].to_numpy(np.int64).view(np.uint64)
    often = often.sort_values("column")
    frequent = spark.sparkContext.broadcast((often["column"].to_numpy(np.uint64), often["count"].to_numpy(np.int64)))

    named = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    shape = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max(F.struct("sketch", "parity")).alias("folded"))
    wide = stash(shape.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "first_id", "copies", "folded.sketch", "folded.parity"), "classes")
    classes = wide.select("node", "n", "s1", "s2", "first_id", "copies")
    sketches = wide.select("node", "n", "sketch")

    entries = source.where(F.col("doc_id").isNotNull()).mapInArrow(_prefixes(k, percent, frequent), "column long, part long, n long, s1 long, s2 long, position long")
    # dealt by column once; copies were folded where they were read, and what is left of them meets here
    entries = entries.repartition(parts, "column", "part").dropDuplicates(["column", "part", "n", "s1", "s2"])
    held = F.count(F.lit(1)).over(Window.partitionBy("column", "part"))
    # only columns that two rows share can give pairs
    shared = entries.withColumn("_held", held).where((F.col("_held") > 1) | (F.col("part") >= 0))
    watched = (F.col("_held") > WATCHED) | (F.col("part") >= 0)
    shared = shared.join(wide.select("node", "n", "s1", "s2", "first_id", "parity"), ["n", "s1", "s2"])
    shared = stash(shared.select("column", "n", "node", "first_id", "position", F.when(watched, F.col("parity")).alias("parity")), "product", collect=True)
    # an id that stands in several classes joins them
    several = named.groupBy("doc_id").agg(*(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("n", "s1", "s2")))
    several = several.where("minn <> maxn or mins1 <> maxs1 or mins2 <> maxs2").select("doc_id")
    ids = named.join(several, "doc_id").join(classes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    ids = stash(ids.where("a <> b").distinct(), "ids")

    def by_id(pairs: DataFrame) -> DataFrame:
        ends = [classes.select(F.col("node").alias(x), F.col("first_id").alias(f"i{x}")) for x in "ab"]
        both = pairs.join(ends[0], "a").join(ends[1], "b")
        return both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))

    def marked() -> DataFrame:
        return shared.join(roots.withColumnRenamed("node", "first_id"), "first_id", "left").withColumn("root", F.coalesce("root", "first_id"))

    near = stash(_pivot_pairs(shared.withColumn("rank", F.col("first_id")).withColumn("root", F.col("node")), percent), "pivot-pairs", collect=True)
    joined = stash(by_id(_verified(near, source, classes, sketches, k, percent, parts)).union(ids), "joined")
    roots = stash(components(joined), "roots")
    total = joined.count()
    for turn in range(1, ROUNDS):
        rows = _mixed(marked()).where(F.col("_c") > CROWD).withColumn("rank", F.xxhash64("node", F.lit(turn)))
        pairs = stash(_pivot_pairs(rows, percent).join(near, ["a", "b"], "left_anti"), "pivot-pairs", collect=True)
        links = _verified(pairs, source, classes, sketches, k, percent, parts)
        near = near.union(pairs)
        got = links.count()
        if got:
            joined = stash(joined.union(by_id(links)), "joined")
            roots = stash(components(joined), "roots")
        if 16 * got <= total:
            break
        total += got
    far = _tiled_pairs(marked(), percent, parts)
    rest = stash(far.join(near, ["a", "b"], "left_anti"), "far")
    release(far, shared)
    links = _verified(rest, source, classes, sketches, k, percent, parts)
    release(rest)
    joined = stash(joined.union(by_id(links)), "joined")
    roots = stash(components(joined), "roots")

    at_root = classes.join(roots.withColumnRenamed("node", "first_id"), "first_id", "left").withColumn("component_id", F.coalesce("root", "first_id"))
    # a class may hold any share of the rows: the hot ones travel by broadcast
    rows = profiles.withColumn("class", F.sha2(F.concat_ws(",", "n", "s1", "s2"), 256))
    grouped = at_root.select(F.sha2(F.concat_ws(",", "n", "s1", "s2"), 256).alias("class"), "copies", "component_id")
    hot = max(4096, stats.n // 1000)
    return _members(rows, grouped, hot), joined


def _members(rows: DataFrame, named: DataFrame, hot: int) -> DataFrame:
    big = F.broadcast(named.where(F.col("copies") >= hot).select(F.col("class").alias("_h"), F.col("component_id").alias("_hot")))
    rest = named.where(F.col("copies") < hot).select(F.col("class").alias("_c"), F.col("component_id").alias("_cold"))
    near = rows.join(big, F.col("class") == F.col("_h"), "left")
    key = F.when(F.col("_h").isNull() & (F.col("n") > 0), F.col("class")).otherwise(F.concat(F.lit("~"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")))
    both = near.withColumn("_k", key).join(rest, F.col("_k") == F.col("_c"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_hot", "_cold", "doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_ngram_join(docs: DataFrame) -> DataFrame:
    return ngram_join(docs, 3, 90)[0]
