"""A store of features of files: tables bucketed by file, with fingerprints, in which only new and changed files are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabulith.sources.corpus import publication_date

#: Buckets of a store's table.
BUCKETS = 16


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, print) of the bulletin files in a folder, from their sizes and times of change: no text is read.  Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "treasury_bulletin_*.txt").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(name.alias("file_name"), F.concat_ws("/", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("print"))


def texts(spark: SparkSession, folder: str, names: list[Row]) -> DataFrame:
    """(file_name, pub_date, text) of the named files (file_name, print) only; no other file is opened."""
    if not names:
        return spark.createDataFrame([], "file_name string, pub_date date, text string")
    name = F.col("_metadata.file_name")
    read = spark.read.text([f"{folder}/{r.file_name}" for r in names], wholetext=True)
    return read.select(name.alias("file_name"), publication_date(name).alias("pub_date"), F.col("value").alias("text"))


class FeatureStore:
    """Features of the files of a folder, in a table at ``path`` that is bucketed by file name.

    ``compute`` makes the features (file_name and others) of files (file_name, pub_date, text).  ``version`` names the way in which it does; another
    version sees none of the rows of this one.  Rows of files that changed or went stay in the table but are not read: prints decide.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, compute: Callable[[DataFrame], DataFrame], version: str = "1"):
        self.spark, self.name, self.path, self.compute, self.version = spark, name, path, compute, version

    def stored(self) -> DataFrame | None:
        return self.spark.table(self.name).where(F.col("version") == self.version) if self.spark.catalog.tableExists(self.name) else None

    def missing(self, now: DataFrame) -> DataFrame:
        """Of files (file_name, print), those without features: both sides meet by their buckets."""
        held = self.stored()
        return now if held is None else now.join(held.select("file_name", "print").distinct(), ["file_name", "print"], "left_anti")

    def update(self, folder: str) -> int:
        """Compute what is missing and append it; returns how many files that were."""
        changed = self.missing(fingerprints(self.spark, folder)).collect()
        if changed:
            prints = self.spark.createDataFrame(changed, "file_name string, print string").withColumn("version", F.lit(self.version))
            # a file without any features is remembered by a row of nulls
            rows = prints.join(self.compute(texts(self.spark, folder, changed)), "file_name", "left")
            rows.write.bucketBy(BUCKETS, "file_name").sortBy("file_name").mode("append").option("path", self.path).saveAsTable(self.name)
        return len(changed)

    def read(self, folder: str) -> DataFrame:
        """The features of the folder's present files, after ``update``."""
        self.update(folder)
        now = fingerprints(self.spark, folder)
        held = self.stored()
        if held is None:
            return self.compute(texts(self.spark, folder, now.collect()))
        return held.join(now, ["file_name", "print"], "left_semi").drop("print", "version")
