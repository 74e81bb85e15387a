"""Telling tasks apart by weighted word sets, and drawing samples of questions that do not depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import text as T
from tabulith.operators import postings as N


def set_scores(texts: DataFrame, sets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, set, score): the summed weights of each set's entries that a text has; pairs without any have no row.

    ``sets`` has rows (set, entry, whole, weight).  A whole entry counts if it is one of the text's distinct words, others if they stand
    anywhere in it.  Words meet by an equi join and phrases by one pass of an automaton, so the sets may be tables of any size.
    """
    low = texts.select(key, F.lower(F.col(text)).alias("_low"))
    words = low.select(key, F.explode(F.array_distinct(T.find_all(F.col("_low"), r"[\p{L}\p{N}_]+"))).alias("entry"))
    phrases = sets.where("not whole").select(F.col("entry").alias("phrase")).distinct()
    parts = N.phrase_hits(low, phrases, {"_low": "_h"}).select(key, F.explode(F.map_keys("_h")).alias("entry"))
    met = words.join(sets.where("whole"), "entry").union(parts.join(sets.where("not whole"), "entry"))
    return met.groupBy(key, "set").agg(F.sum("weight").alias("score"))


def lexicon_sets(texts: DataFrame) -> DataFrame:
    """The lexicon's word sets and phrases as a table, each entry of weight 1."""
    rows = [(name, entry, whole, 1) for whole, given in ((True, L.ROUTE_WORDS), (False, L.ROUTE_PHRASES)) for name, entries in given.items() for entry in entries]
    return texts.sparkSession.createDataFrame(rows, "set string, entry string, whole boolean, weight int")


def routed(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, task): the first task of the lexicon whose condition on the sets' scores holds, or else general.  Keys must not repeat."""
    names = [*L.ROUTE_PHRASES, *L.ROUTE_WORDS]
    found = set_scores(texts, lexicon_sets(texts), key, text).groupBy(key).agg(*(F.sum(F.when(F.col("set") == n, F.col("score"))).alias(n) for n in names))
    every = texts.select(key).join(found, key, "left").fillna(0, names)
    task: Column = F.coalesce(*(F.when(F.expr(when), F.lit(name)) for when, name in L.ROUTES), F.lit("general"))
    return every.select(key, task.alias("task"))


def bottom_k(rows: DataFrame, key: str, k: int, stratum: str | None = None, seed: str = "0") -> DataFrame:
    """The ``k`` rows (of each stratum) whose keys have the least digests: the same sample however rows are dealt, and mergeable.

    The sample of a union is the sample of the samples of its parts.  Rows with the same key are kept or left in the order of their key only.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    group = Window.partitionBy(*([stratum] if stratum else [F.lit(0)])).orderBy("_digest", key)
    return rows.withColumn("_digest", digest).withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= k).drop("_digest", "_r")
