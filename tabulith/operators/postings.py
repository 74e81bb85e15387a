"""Which texts have which phrases: one pass of a multi-pattern automaton over each text, and top-k by postings with block-max bounds.

A question meets a text only where a phrase, a term, a family or a month leads from one to the other, so no set of questions meets all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tabulith.sources.scratch import stash

#: Phrases that one automaton holds; more are dealt to several, each of which passes over the texts.
MOST_PHRASES = 100_000
#: Texts of a block, about; blocks are of so many months, cut further by a hash where there are more texts.
BLOCK, BLOCK_MONTHS = 16, 16


def automaton(phrases: list[str]) -> ahocorasick.Automaton | None:
    """The automaton of the phrases, each of which leads to (number, length); none without phrases."""
    found = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        if phrase:
            found.add_word(phrase, (i, len(phrase)))
    if not len(found):
        return None
    found.make_automaton()
    return found


def counts(text: str, machine: ahocorasick.Automaton) -> dict[int, int]:
    """How often each phrase stands in the text, places of one phrase without overlap, from the left."""
    ends: dict[int, int] = {}
    out: dict[int, int] = {}
    for last, (i, size) in machine.iter(text):
        if last - size >= ends.get(i, -1):
            ends[i] = last
            out[i] = out.get(i, 0) + 1
    return out


def phrase_hits(texts: DataFrame, phrases: DataFrame, named: dict[str, str], most: int = MOST_PHRASES) -> DataFrame:
    """Replace text columns by the phrases (column ``phrase``, distinct) that each has, as map<phrase, count>; null texts have none.

    ``named`` gives each text column the name of its map.  The driver takes at most about ``most`` phrases at a time; where there are more,
    each share of them passes over the texts by itself.
    """
    spark = texts.sparkSession
    shares = max(1, -(-phrases.count() // most))
    out = texts
    for share in range(shares):
        mine = phrases if shares == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(shares)) == share)
        words = spark.sparkContext.broadcast(sorted(r.phrase for r in mine.select("phrase").collect()))
        out = _hits_of_share(out, words, {text: f"{name}{share}" for text, name in named.items()}, share == shares - 1)
    for name in named.values():
        out = out.withColumn(name, F.map_concat(*(f"{name}{i}" for i in range(shares)))).drop(*(f"{name}{i}" for i in range(shares)))
    return out


def _hits_of_share(texts: DataFrame, words: Broadcast, named: dict[str, str], last: bool) -> DataFrame:
    """Add the maps of one share of the phrases; the last share drops the texts."""
    kept = [(i, c) for i, c in enumerate(texts.columns) if not (last and c in named)]
    at = [texts.columns.index(c) for c in named]
    names_out, kind = [*(c for _, c in kept), *named.values()], pa.map_(pa.string(), pa.int32())
    schema = StructType([*(texts.schema[c] for _, c in kept), *(StructField(n, MapType(StringType(), IntegerType())) for n in named.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = words.value
        machine = automaton(names)
        hits = lambda t: [] if t is None or machine is None else [(names[i], n) for i, n in counts(t, machine).items()]
        for batch in batches:
            found = [pa.array([hits(t) for t in batch.column(i).to_pylist()], kind) for i in at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in kept), *found], names=names_out)

    return texts.mapInArrow(run, schema)


def _scored(met: DataFrame, key: str) -> DataFrame:
    """(q_id, key, score) of joined postings and askings: counts capped and weighed (kind 0), features of kind 1 counted, capped together and weighed."""
    part = met.groupBy("q_id", key).agg(
        F.sum(F.when(F.col("kind") == 0, F.least("n", "cap") * F.col("weight")).otherwise(0)).alias("_a"), F.count(F.when(F.col("kind") == 1, 1)).alias("_n"), F.max(F.when(F.col("kind") == 1, F.struct("cap", "weight"))).alias("_t")
    )
    return part.select("q_id", key, (F.col("_a") + F.coalesce(F.least(F.col("_n"), F.col("_t.cap")) * F.col("_t.weight"), F.lit(0))).cast("int").alias("score"))


def scores(postings: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(q_id, key, score) of all texts that a posting (feature, key, n) leads to from an asking (q_id, feature, kind, cap, weight); others score 0."""
    return _scored(postings.join(asked, "feature"), key)


def blocks(texts: DataFrame, key: str, month: Column) -> DataFrame:
    """(key, block) of texts that lie near each other in time, about BLOCK together."""
    when = F.coalesce(F.floor(month / BLOCK_MONTHS), F.lit(-1))
    n = texts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(when).alias("groups")).first()
    shares = max(1, round(n.n / (max(1, n.groups) * BLOCK)))
    return texts.select(key, F.concat_ws("/", when, F.pmod(F.xxhash64(key), F.lit(shares))).alias("block"))


def block_max_topk(postings: DataFrame, asked: DataFrame, questions: DataFrame, names: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """(q_id, key, name, score, rank): each question's ``k`` best of all texts of ``names`` (key, name, block), by score, then name.

    No score is negative.  The bound of a block is the score that a text would have with the greatest count in the block of each feature.
    The blocks of the greatest bounds are scored first; the ``k``-th score found there is a threshold, and only blocks whose bounds reach it
    are scored at all.  Texts without any hit score 0; a question that hits fewer than ``k`` takes the first names of all.
    """
    rows = stash(postings.join(names.select(key, "block"), key), "postings")
    bounds = stash(_scored(rows.groupBy("feature", "block").agg(F.max("n").alias("n")).join(asked, "feature"), "block"), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        return _scored(rows.join(asked.join(pairs, "q_id"), ["feature", "block"]), key)

    best = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "block"))
    seeds = bounds.withColumn("_r", best).where(F.col("_r") <= -(-2 * k // BLOCK)).select("q_id", "block")
    kth = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score")))
    threshold = scored(seeds).withColumn("_r", kth).where(F.col("_r") == k).select("q_id", F.col("score").alias("_least"))
    wanted = bounds.join(threshold, "q_id", "left").where(F.col("score") >= F.greatest(F.lit(1), F.coalesce("_least", F.lit(1)))).select("q_id", "block")
    hits = stash(scored(wanted).where("score > 0"), "hits")
    few = questions.select("q_id").join(hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("_n")), "q_id", "left").where(F.coalesce("_n", F.lit(0)) < k).select("q_id")
    first = [r[0] for r in names.orderBy(name).limit(k).select(key).collect()]
    rest = few.select("q_id", F.explode(F.array(*map(F.lit, first))).alias(key)) if first else few.select("q_id", F.lit(None).cast(names.schema[key].dataType).alias(key)).limit(0)
    every = hits.union(rest.join(hits.select("q_id", key), ["q_id", key], "left_anti").select("q_id", key, F.lit(0).alias("score")))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), name))
    return every.join(names.select(key, name), key).withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", key, name, "score", "rank")
