"""Reconciling several answers to a question."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from tabulith.functions import answers as A
from tabulith.functions import text as T


@F.pandas_udf(ArrayType(IntegerType()))
def _clusters(values: pd.Series) -> pd.Series:
    """The cluster of each of some rising values: within two percent of its first member, or within 0.5 of zero."""

    def one(rising: list[float]) -> list[int]:
        out, centre, number = [], None, 0
        for v in rising:
            if centre is None or abs(v - centre) > (abs(centre) * 0.02 if centre else 0.5):
                centre, number = v, number + 1
            out.append(number)
        return out

    return values.map(one)


def vote(answers: DataFrame, key: str = "q_id", order: str = "pos", answer: str = "answer") -> DataFrame:
    """One winner for each question (key, winner).

    If half the answers or more are numbers, these are sorted and cut into clusters within two percent of their first member
    (within 0.5 of zero); the middle of the largest, of the first on a tie, wins.  Else the most frequent text wins,
    in its first spelling.  Only a question's distinct numbers are gathered; its answers stay rows.  Blank answers and those of no question are left out.
    """
    t = T.strip(F.col(answer))
    rows = answers.where((t != "") & F.col(key).isNotNull()).select(key, F.col(order).alias("_pos"), t.alias("_a"), A.vote_number(t).alias("_v"))
    values = rows.where("_v is not null").groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_n"))
    listed = values.groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    clusters = listed.select(key, F.explode(F.arrays_zip(F.col("_vs").alias("v"), _clusters("_vs").alias("k"))).alias("_c")).select(key, F.col("_c.v").alias("_v"), F.col("_c.k").alias("_k"))
    sizes = values.join(clusters, [key, "_v"]).groupBy(key, "_k").agg(F.sum("_n").alias("_size"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_size"), "_k"))
    largest = sizes.withColumn("_r", first).where("_r = 1").drop("_r")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_v", "_pos"))
    members = rows.join(clusters.join(largest, [key, "_k"]), [key, "_v"]).withColumn("_r", place)
    number = members.where(F.col("_r") == F.expr("_size div 2") + 1).select(key, F.col("_a").alias("_number"))
    shares = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), F.count("_v").alias("_numbers"))
    text = modal(rows, key, "_pos", "_a").select(key, F.col("winner").alias("_text"))
    both = shares.join(text, key).join(number, key, "left")
    return both.select(key, F.when((F.col("_all") > 1) & (F.col("_numbers") >= F.col("_all") * 0.5), F.col("_number")).otherwise(F.col("_text")).alias("winner"))


def modal(answers: DataFrame, key: str = "q_id", order: str = "pos", answer: str = "answer") -> DataFrame:
    """The text branch of the vote on rows alone, for groups of any size."""
    low = answers.groupBy(key, F.lower(answer).alias("_l")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, answer)).alias("_f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.col(f"_f.{order}")))
    return low.withColumn("_r", rank).where("_r = 1").select(key, F.col(f"_f.{answer}").alias("winner"), "n")
