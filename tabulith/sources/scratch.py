"""Tables written to the folder that all executors share, which cut the lineage of what is read many times."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    A local session that names neither (a test) gets one for the life of its context; on a cluster that is an error, as no folder of one machine would do.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabulith-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: Folders written by ``stash`` that ``release`` has not removed yet, by the frame that reads them.
_stashed: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stash(df: DataFrame, label: str, collect: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    With ``collect``, for steps that shuffle much, shuffle files that are not needed again go at once: Spark deletes them once the objects
    that stand for them are collected as garbage, which a driver with free memory may put off for half an hour.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _stashed[back] = path
    if collect:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return back


def spread(df: DataFrame, times: int = 1) -> DataFrame:
    """Rows dealt out over all cores, for heavy work on each row of a table that has fewer partitions than there are cores; others stay as they are.

    With ``times``, that many partitions a core, so that no core waits for one that took a second of as few.  Counting the partitions of a
    frame runs the shuffles that lead to it: ``df`` should be read from files, or come from them by little.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * times
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def release(*frames: DataFrame) -> None:
    """Remove the folders of stashed frames that nothing reads any more: every frame made from them has itself been stashed."""
    for frame in frames:
        path = _stashed.pop(frame, None)
        if path:
            jvm = frame.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
