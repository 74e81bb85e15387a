"""Sharding by longest processing time: groups that stay together go, by falling size, to the least loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import file_order, lookup_groups, number_in_order, number_rows, slices_for, stash

#: Group sizes below this are classes of their own; above, a class spans 1/512 of its size.
EXACT = 1024


def size_class(size: Column) -> Column:
    """Sizes below EXACT as they are; larger ones as their exponent and first ten bits: under 600 classes an octave x 64."""
    bits = F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") - 9)
    return F.when(size < EXACT, size).otherwise(bits.cast("long") * EXACT + F.floor(size / F.pow(F.lit(2.0), bits)).cast("long"))


def longest_first(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """LPT over (class, groups, bytes) rows: for each class, how many of its groups each shard gets.

    The heap holds (load, shard).  Groups of a class count as equally large, so a shard takes as many in one go
    as it would take before another becomes the least loaded, and full rounds over all shards are taken at once.
    """
    heap = [(0.0, s) for s in range(shards)]
    plan = []
    for key, left, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        each, got = total / left, [0] * shards
        while left:
            load, s = heap[0]
            if left >= shards and max(heap)[0] - load < each:
                rounds = left // shards
                heap = [(x + rounds * each, i) for x, i in heap]
                got = [g + rounds for g in got]
                left -= rounds * shards
                continue
            following = min(heap[1:3], default=(load, s))[0]
            n = min(left, max(1, -int(-(following - load) // each)))
            heapq.heapreplace(heap, (load + n * each, s))
            got[s] += n
            left -= n
        plan.append((key, got))
    return plan


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None, keep_order: bool = False) -> DataFrame:
    """Put every row into a shard; equal texts stay together; loads are as equal as LPT makes them.

    A row's size is the UTF-8 length of its text plus 16.  Rows with equal texts (a null text counts as empty) form
    a group.  What the driver sees is bounded: one row for each size class (EXACT + 512 an octave), whatever the
    number of groups.  Returns id, size, text_crc32, shard, slot (gapless from 0 in each shard).  A null id is
    kept as a row with a null id, repeated rows are separate rows of one group, an empty table gives no rows; other columns are not
    read.  Groups of EXACT bytes or more count as large as the mean of their class, from which each differs by less than 1/512, so a load differs
    from that of exact LPT by less than 1/512 of itself plus one group.  A group larger than the mean load fills its shard alone and stays whole.  With ``keep_order`` the slots of a
    shard follow the order in which the rows of ``docs`` were written, else a hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *([file_order(docs).alias("_order")] if keep_order else []),
    )
    rows = stash(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    groups = stash(groups.withColumn("cls", size_class(F.col("bytes"))), "shard-groups")
    classes = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("copies").alias("r")).collect()
    slices = slices or slices_for(sum(c.r for c in classes))
    plan = longest_first([(c.cls, c.n, c.b) for c in classes], shards)
    spark = docs.sparkSession
    until = []
    for key, got in plan:
        ends, total = [], 0
        for g in got:
            total += g
            ends.append(total)
        until.append((key, ends))
    # one row of `shards` numbers for each size class: under 3 MB for 40 shards at any input size
    quota = F.broadcast(spark.createDataFrame(until, "cls long, ends array<long>"))
    ranked = number_rows(groups, ["cls"], ["digest"], "rank", slices).join(quota, "cls")
    placed = ranked.select("digest", "copies", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    hot = max(4096, sum(c.r for c in classes) // 1000)
    dealt = lookup_groups(rows, placed, "digest", "copies", hot).drop("digest")
    if keep_order:
        return number_in_order(dealt, ["shard"], "_order", "slot")
    return number_rows(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot", slices)


def op10_sharding(docs: DataFrame, keep_order: bool = False) -> DataFrame:
    out = shard_documents(docs, keep_order=keep_order)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
