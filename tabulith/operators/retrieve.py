"""The files that a batch of questions is to be answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import profile as P
from tabulith.operators import candidates as C
from tabulith.operators import scoring as O
from tabulith.sources.scratch import stash


def limits(asks: DataFrame, files: int = 2, chars: int = 12000) -> DataFrame:
    """K4: (q_id, max_files, max_chars); ``files`` and ``chars`` are the least of both."""
    most, size = P.context_limits(F.col("families"), files, chars)
    return asks.select("q_id", most.alias("max_files"), size.alias("max_chars"))


def scored_candidates(asks: DataFrame, docs: DataFrame, files: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text", first: int = 30, following: int = 6, least: int = 2, preview: int | None = 8000) -> DataFrame:
    """(q_id, key, file_name, place, pinned, score): files by date, then, for questions that ask for it (K3), the best of all files.

    A question without any candidate has all files.  Files by date, those of the first stage of the search and those of questions without
    candidates are scored by SC4 once, together; the search then takes its best from these scores.  Sections are those of previews of so many
    characters, or of whole texts without ``preview``.
    """
    named = files.select(key, "file_name", "pub_date")
    dated = stash(C.dated_candidates(asks, files, years=following).join(named, "pub_date").select("q_id", key, "file_name", "source_rank", "pos", "pinned"), "dated")
    wide = asks.where(P.needs_global_search(F.col("families")))
    near = stash(O.cheap_best(wide, files, first, key).select("q_id", key), "near")
    without = asks.select("q_id").join(dated.select("q_id").union(near.select("q_id")).distinct(), "q_id", "left_anti")
    every = stash(without.crossJoin(named), "every")  # the few questions that name no date and ask for no search
    pairs = stash(dated.select("q_id", key).union(near).union(every.select("q_id", key)).distinct(), "pairs")
    scores = stash(O.full_scores(pairs, asks, docs, files, tables, key, text, preview).select("q_id", key, "file_name", "score"), "scores")
    keep = wide.select("q_id", F.greatest(F.lit(18), P.context_limits(F.col("families"), least)[0] * 4).alias("_keep"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "file_name"))
    best = scores.join(near, ["q_id", key], "left_semi").withColumn("rank", rank).join(keep, "q_id").where(F.col("rank") <= F.col("_keep"))
    searched = best.select("q_id", key, "file_name", F.lit(6).alias("source_rank"), F.col("rank").cast("long").alias("pos"), F.lit(False).alias("pinned"))
    last = every.select("q_id", key, "file_name", F.lit(7).alias("source_rank"), F.datediff("pub_date", F.lit("1900-01-01").cast("date")).cast("long").alias("pos"), F.lit(False).alias("pinned"))
    found = dated.union(searched).union(last).groupBy("q_id", key, "file_name").agg(F.min(F.struct("source_rank", "pos")).alias("place"), F.max("pinned").alias("pinned"))
    return found.join(scores.drop("file_name"), ["q_id", key])


def find_sources(asks: DataFrame, docs: DataFrame, files: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2, following: int = 6) -> DataFrame:
    """(q_id, key, file_name, pinned, rank): the files of each question, as many as its limits allow.

    ``most`` is the least limit of files, ``following`` the years after a named one whose issues are candidates.
    """
    found = scored_candidates(asks, docs, files, tables, key, text, following=following, least=most)
    return C.best_files(found, limits(asks, most).select("q_id", "max_files")).select("q_id", key, "file_name", "pinned", "rank")
