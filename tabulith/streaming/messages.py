"""Messages that arrive in parts: merged in order by a stream with keyed state, written so that a batch that runs twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def merged(parts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", time: str | None = None, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """SRC10 on a stream: (key, n_parts, message) of each message so far; equal parts that come twice count once.

    State is one entry a message.  With a ``time`` column, messages are those of a key within a ``span`` of it, parts later than ``late``
    behind the watermark are dropped, and state before it goes; without one, state stays, and a part may come at any time.
    """
    part = F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = parts if time is None else parts.withWatermark(time, late)
    keys = [F.col(key)] if time is None else [F.window(time, span), F.col(key)]
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(part)).alias("_p"))
    given = [] if time is None else ["window"]
    return found.select(*given, key, F.size("_p").cast("long").alias("n_parts"), F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("message"))


def write_messages(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """SRC12 on a stream: each batch's messages go to a folder of the batch's number, which a second run of the batch replaces.

    A stream that fails goes on from its checkpoint; the batch that it had begun is written again in place of the first attempt.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, folder: str, key: str = "conv_id") -> DataFrame:
    """The last state of each message that the batches of a folder hold."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))
    return rows.withColumn("_r", last).where(F.col("_r") == 1).drop("_r", "batch")
