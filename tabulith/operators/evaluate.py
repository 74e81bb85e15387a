"""Evaluation of predicted against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, group: str = "difficulty", correct: str = "correct") -> DataFrame:
    """Correct, total and accuracy overall (group 'all') and for each group in one pass; an empty group is 'unknown'."""
    named = rows.select(F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown")).alias("grp"), F.col(correct).cast("int").alias("ok"))
    out = named.rollup("grp").agg(F.sum("ok").alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.select(F.coalesce("grp", F.lit("all")).alias("grp"), "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"))
