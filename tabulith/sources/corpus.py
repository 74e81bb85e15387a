"""Readers and writers: bulletin text files, question tables, message parts, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern of a bulletin file's name.
FILE_NAME = r"^treasury_bulletin_([0-9]{4})_([0-9]{2})\.txt$"


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pub_date, text) of the bulletin files in a folder; other files are not read."""
    files = spark.read.option("pathGlobFilter", "treasury_bulletin_*.txt").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(name.alias("file_name"), publication_date(name).alias("pub_date"), F.col("value").alias("text"))


def publication_date(name):
    """First day of the month in a file's name; null if there is none."""
    year, month = (F.regexp_extract(name, FILE_NAME, i).try_cast("int") for i in (1, 2))
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="uid string, question string, answer string, difficulty string")


def merge_parts(parts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """All parts of a message in order, joined by line feeds."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))).alias("_p")).select(key, F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("message"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
