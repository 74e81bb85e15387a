"""Lexical ranking, top-k selection and packing into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import text as T
from tabulith.sources.scratch import spread

#: Pairs of a question and a document that one task scores at most, about.
PAIRS = 1 << 20


def words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) for each word of three or more characters that is no stop word."""
    word = F.explode(T.find_all(F.lower(F.col(text)), r"[a-z][a-z0-9]{2,}"))
    return rows.select(key, word.alias("term")).where(~F.col("term").isin(*L.STOPWORDS))


def keyword_scores(questions: DataFrame, docs: DataFrame, q_key: str = "q_id", d_key: str = "doc_id", text: str = "text", cap: int = 4, weight: int = 2) -> DataFrame:
    """(question, document, score): capped counts of the question's words, by an equi join on words, never by all pairs.

    Words that no question has leave before anything is counted or shuffled.  The others are dealt by document alone, so that both counts are
    made where they arrive, to as many tasks as leave each at most about ``PAIRS`` pairs: a task's memory does not grow with the tables.
    """
    asked = words(questions, q_key, "question").distinct()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * questions.count() // PAIRS))
    held = words(spread(docs.select(d_key, text)), d_key, text).join(asked.select("term").distinct(), "term", "left_semi").repartition(tasks, d_key)
    counts = held.groupBy(d_key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.join(asked, "term").groupBy(q_key, d_key).agg(F.sum(F.least(F.col("tf"), F.lit(cap)) * weight).alias("score"))


def top_k(scores: DataFrame, key: str, k: int, *order: Column, more: list[str] | None = None) -> DataFrame:
    """The first k rows of each key (with ``more``, of each key and these columns) with their rank; Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key, *(more or [])).orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def diversified(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k evenly spaced rows of each key, ends included, rounded half to even; the middle one for k = 1."""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    if k <= 1:
        return numbered.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return numbered.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def pinned_first(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows (pinned, score, idx): up to k rows as they are, pinned first; else by score, pinned ones before all others; by idx if none scores.

    No key's rows are gathered: the first k + 1 by score, pinned and not, tell whether there are more than k and which score is the best.
    Rows that do not score stand there a second time (``_flat``), by idx, for keys that have no others.
    """
    none = F.when(F.col("score") <= 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("_flat", F.explode(none)).withColumn("_v", F.when(F.col("_flat"), 0).otherwise(F.col("score")))
    near = top_k(rows, key, k + 1, F.desc("_v"), F.col("idx"), more=["pinned", "_flat"]).drop("rank")
    w = Window.partitionBy(key)
    near = near.withColumns({"_few": F.count(F.when(~F.col("_flat"), 1)).over(w) <= k, "_none": F.coalesce(F.max("score").over(w) <= 0, F.lit(False))})
    near = near.where(F.col("_flat") == (~F.col("_few") & F.col("_none"))).withColumn("_v", F.when(F.col("_few"), 0).otherwise(F.col("_v")))
    rank = F.row_number().over(w.orderBy(F.desc("pinned"), F.desc("_v"), "idx"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("_flat", "_few", "_none", "_v")


def pack(blocks: DataFrame, key: str, order: str, size: Column, budget: Column, joint: int = 2) -> DataFrame:
    """Blocks from the front while they fit: a prefix sum instead of a loop.

    If a block does not fit, the sum up to the next is larger still, so all later ones fail the same test;
    the first block always stays.  ``joint`` characters stand between blocks.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(size + joint).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumns({"_before": before, "_rn": F.row_number().over(w)})
    return rows.where((F.col("_rn") == 1) | (F.col("_before") + size <= budget)).drop("_before", "_rn")


def file_budget(rank: Column, files: Column, chars: Column) -> Column:
    """Shares of the budget by rank: all; 55 and 45 percent; 40, 25 and equal parts of the rest."""
    part = lambda percent, among=F.lit(1): F.floor(chars * percent / (among * 100))
    rest = part(35, F.greatest(F.lit(1), files - 2))
    return F.when(files == 1, chars).when((files == 2) & (rank == 1), part(55)).when(files == 2, part(45)).when(rank == 1, part(40)).when(rank == 2, part(25)).otherwise(rest).cast("long")
