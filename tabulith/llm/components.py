"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import release, stash


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node that edges lead to.

    Each round replaces the edges by at most as many stars and is written to the shared folder, so nothing is gathered on the driver
    but two sums.  A hub's edges are reduced by map-side minima.  Nulls and loops are dropped.
    """
    now = edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"))
    now = stash(now.where((F.col("u") != F.col("v")) & F.col("u").isNotNull()).distinct(), "edges")
    print_ = _print(now)
    for _ in range(most_rounds):
        if not print_[0]:
            break
        both = now.union(now.select("u", "v"))  # (node, neighbour)
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # each node and its smaller neighbours hang on the smallest of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        after = stash(small.where(F.col("u") != F.col("v")).distinct(), "edges", collect=True)
        release(now)
        was, now, print_ = print_, after, _print(after)
        if was == print_:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(now.select(F.col("u"), F.col("u"))).distinct()
