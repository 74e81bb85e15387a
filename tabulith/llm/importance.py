"""Importance resampling towards a target: documents weighed by hashed word features, drawn by the Gumbel top-k trick.

Two passes over the texts in Arrow batches.  The first turns each partition into one vector of bucket counts, which ``treeReduce`` adds up;
the second looks up the gains of all buckets, a vector of fixed length that is broadcast, and adds them up for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import partitions, stash
from tabulith.llm.kernels import PLAIN_WORDS, doc_chunks, utf8

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Words whose buckets a worker remembers.
REMEMBERED = 500_000

#: A-Z become a-z, bytes outside words become blanks.
_FOLD = bytes(0x20 if not (PLAIN_WORDS[b] or 65 <= b <= 90) else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Buckets(dict[bytes, int]):
    """The bucket of each word asked for: its crc32 modulo ``n``."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word) % self.n
        return at


def _runs(words: list[bytes], most: int) -> list[bytes]:
    """All runs of one to ``most`` words, joined by one space."""
    out = list(words)
    for k in range(2, most + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _features(texts: pa.Array, buckets: _Buckets, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of consecutive documents: the buckets of all features in a row, features of each document, words of each document."""
    data, offsets = utf8(texts)
    for a, b in doc_chunks(offsets):
        raw = data[offsets[a] : offsets[b]].tobytes().translate(_FOLD)
        found: list[bytes] = []
        sizes, words = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        for i in range(b - a):
            own = raw[offsets[a + i] - offsets[a] : offsets[a + i + 1] - offsets[a]].split()
            words[i] = len(own)
            if most > 1:
                own = _runs(own, most)
            sizes[i] = len(own)
            found += own
        yield np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), sizes, words


def bucket_counts(table: DataFrame, text_col: str = "text", n: int = BUCKETS, most: int = MOST_WORDS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a vector of ``n`` for each partition, merged by ``treeReduce``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = _Buckets(n), np.zeros(n, np.int64)
        for batch in batches:
            for ids, _, _ in _features(batch[0], buckets, most):
                counts += np.bincount(ids, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    vectors = table.select(F.col(text_col).alias("text")).mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(row.counts, np.int64))
    none = table.sparkSession.sparkContext.parallelize([np.zeros(n, np.int64)], 1)  # a table may have no partitions
    return none.union(vectors).treeReduce(np.add, depth=2 if vectors.getNumPartitions() < 4096 else 3)


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, every count raised by one."""
    n = len(source)
    total_s, total_t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * total_s / ((s + 1.0) * total_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document; null and empty texts have no features and weight 0."""
    n = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, gain = _Buckets(n), shared.value.astype(np.float64)
        for batch in batches:
            parts = [(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=gain[ids], minlength=len(sizes)), sizes, words) for ids, sizes, words in _features(batch[1], buckets, most)]
            if parts:
                weights, sizes, words = (np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch[0], pa.array(words), pa.array(sizes), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256(seed:id); a null id counts as empty."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to the ``percent`` best scores of documents with ``least`` words or more; ties go to smaller ids, null ids first.

    Rows are dealt by ranges of their order and written; a row's rank is its place in its part plus the sizes of the parts before it, of
    which there are as many as partitions.  No window holds all rows, and rows that are equal in everything are told apart by their place
    in the files, so no range is unsplittable.
    """
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= least).withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("_row")]
    dealt = able.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = stash(dealt.select(*scored.columns, F.spark_partition_id().alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    before, shifts = 0, []
    for row in placed.groupBy("_part").count().orderBy("_part").toLocalIterator():  # a row for each partition
        shifts.append((row["_part"], before))
        before += row["count"]
    keep = before * percent // 100
    shift = spark.createDataFrame(shifts, "_part int, _shift long")
    ranked = placed.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_at") + F.col("_shift") + 1)
    ranked = ranked.select(*scored.columns, F.when(F.col("rank") <= keep, F.col("rank")).alias("rank"))
    return ranked.union(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def op11_importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, n: int = BUCKETS, most: int = MOST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` is null for those not drawn.

    Null and empty texts have no features and weight 0 and are never drawn; rows that share an id share its random part and are rows of
    their own; ties go to smaller ids.  An empty target gives every bucket one count, an empty table no rows.  Other columns are not read.
    """
    gains = gains_of(bucket_counts(docs, n=n, most=most), bucket_counts(target, n=n, most=most))
    scored = stash(weigh(docs, gains, most=most).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    return draw(scored, percent, least).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    picked = op11_importance(docs, target, percent).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(picked, docs["doc_id"].eqNullSafe(F.col("_drawn")), "left_semi")
