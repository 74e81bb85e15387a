"""Helpers shared by the operators: shared storage, gapless numbering, skew-proof group lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.sources.scratch import release, shared_dir, stash

__all__ = ["file_order", "load", "lookup_groups", "number_in_order", "number_rows", "partitions", "release", "shared_dir", "slice_of", "slices_for", "stash"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slice_of(cols: Sequence[str], slices: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slices)).cast("int")


def slices_for(rows: int) -> int:
    """How many slices keep each at about 200,000 of so many rows, 64 at least."""
    return max(64, rows // 200_000)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, slices: int = 64) -> DataFrame:
    """Gapless numbers from 0 inside each group, without ever sorting a whole group in one task.

    A group is cut into ``slices`` by a hash of its order columns; rows are numbered inside a slice and
    shifted by the sizes of the slices before it.  The size table has groups x slices rows.  Group columns must
    not be null (callers coalesce); equal rows get different numbers in an arbitrary order.
    """
    cut = df.withColumn("_slice", slice_of(order, slices))
    keys = [*group, "_slice"]
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    shift = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return inside.join(shift, keys).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_slice", "_at", "_shift", "_size")


def file_order(df: DataFrame) -> Column:
    """(file, row) of each row of a table just read from Parquet, which sorts as the rows were ordered when Spark wrote it.

    Spark names files by the number of the partition, then of the file in it, and writes a partition's rows in their order; how files are
    packed into tasks when they are read does not matter.  A table that is not read from files is taken in the order of its partitions.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return F.struct(F.shiftright(at, 33).alias("file"), F.lit("").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-([0-9]+)", 1)
    return F.struct(F.coalesce(number.try_cast("bigint"), F.lit(-1)).alias("file"), name.alias("part"), F.col("_metadata.row_index").alias("row"))


def number_in_order(df: DataFrame, group: Sequence[str], order: str, out: str, chunk: int = 1 << 14) -> DataFrame:
    """Gapless numbers from 0 inside each group in the order of a ``file_order`` column, without sorting a whole group in one task.

    Slices are runs of ``chunk`` rows of a file; rows are numbered inside a slice and shifted by the slices before it.
    """
    cut = df.withColumn("_slice", F.struct(F.col(order)["file"].alias("file"), F.col(order)["part"].alias("part"), F.floor(F.col(order)["row"] / chunk).alias("run")))
    keys = [*group, "_slice"]
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    shift = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return inside.join(shift, keys).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_slice", "_at", "_shift", order)


def lookup_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, hot: int) -> DataFrame:
    """Inner join of rows with their group's row, where one group may hold any share of the rows.

    ``groups`` has one row for each ``key`` with its number of rows in ``count``.  Groups with at least ``hot``
    rows number at most rows/hot, so they are broadcast; all others are joined by a shuffle in which a hot
    row travels under a key of its own.  ``hot`` must be large enough to bound that quotient.
    """
    fields = [c for c in groups.columns if c not in (key, count)]
    big = groups.where(F.col(count) >= hot).select(F.col(key).alias("_hk"), F.struct(*fields).alias("_hot"))
    rest = groups.where(F.col(count) < hot).select(F.hex(key).alias("_ck"), F.struct(*fields).alias("_cold"))
    near = rows.join(F.broadcast(big), F.col(key) == F.col("_hk"), "left")
    near = near.withColumn("_jk", F.when(F.col("_hk").isNull(), F.hex(key)).otherwise(F.concat(F.lit("~"), F.xxhash64(*rows.columns).cast("string"))))
    both = near.join(rest, F.col("_jk") == F.col("_ck"), "left").withColumn("_g", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *[F.col("_g")[f].alias(f) for f in fields])
