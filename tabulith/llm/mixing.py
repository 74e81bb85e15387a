"""Mixing sources to target weights by Pfair scheduling.

Time is a row of slots, one block of a source each.  Block j of a source with share w is released at slot floor(j / w)
and due at ceil((j + 1) / w); of the released blocks the one with the earliest deadline gets the slot.  So at
every slot each source has had its share to within one block.  Weights are whole numbers, so the schedule repeats after as many
slots as their sum; only one such period is simulated, and a block's slot follows from it by arithmetic.  When a source has no
blocks left, a new phase begins with the weights of the others.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import ceil, floor, gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import number_rows, slices_for, stash

#: Production weights: the web crawl and four further sources by name; all others share a weight equally.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 3, "src4": 3}
OTHERS_WEIGHT = 18
BLOCK = 32


def period(weights: dict[str, int], blocks: dict[str, int] | None = None) -> list[str]:
    """One period of the schedule: which source has each slot, by earliest deadline first among released blocks.

    It is cut short where a source has had all of its ``blocks``.
    """
    total = sum(weights.values())
    waiting = [(0, s) for s in sorted(weights)]  # (release, source)
    done = dict.fromkeys(weights, 0)
    ready: list[tuple[int, str]] = []
    heapq.heapify(waiting)
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (ceil(Fraction((done[s] + 1) * total, weights[s])), s))
        _, s = heapq.heappop(ready)
        slots.append(s)
        done[s] += 1
        if blocks and done[s] == blocks[s]:
            break
        if done[s] < weights[s]:
            heapq.heappush(waiting, (floor(Fraction(done[s] * total, weights[s])), s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, first block, blocks, first slot, period, blocks a period, slots in a period) for each phase and source."""
    left = {s: n for s, n in blocks.items() if n > 0}
    begun = dict.fromkeys(left, 0)
    out, slot = [], 0
    while left:
        divisor = gcd(*(weights[s] for s in left))
        own = {s: weights[s] // divisor for s in left}
        plan = period(own, left)
        at: dict[str, list[int]] = {s: [] for s in own}
        for i, s in enumerate(plan):
            at[s].append(i)
        # the slot of a source's last block; the first source to end, ends the phase
        last = [(left[s] - 1) // own[s] * len(plan) + at[s][(left[s] - 1) % own[s]] for s in own if len(at[s]) == own[s]]
        end = min(last) + 1 if len(plan) == sum(own.values()) else len(plan)
        for s in sorted(own):
            whole, part = divmod(end, len(plan))
            n = whole * len(at[s]) + bisect_left(at[s], part)
            if n:
                out.append((s, begun[s], n, slot, len(plan), len(at[s]), at[s]))
                begun[s] += n
                left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += end
    return out


def mix_sources(docs: DataFrame, weights: dict[str, int], others_weight: int, block: int = BLOCK, slices: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, stream, block, slot, position of every row: rows in order of position follow the target weights.

    Each source is a stream of its own, null one too (its stream is null).  Sources without a weight in ``weights`` share
    ``others_weight`` equally.  A stream's order is by a hash of the id; ``block`` rows of a stream make a block (its last may be
    smaller).  No row is dropped or repeated: weights hold while all streams last, later phases share out the weights of those left.  A
    source may hold any share of the rows: its order is built in slices.  The driver holds one row for each source and simulates
    at most one period for each source that ends, in all no more slots than there are blocks.  Rows with null or equal ids get different
    positions, an empty table gives no rows, other columns are not read.
    """
    if others_weight <= 0 or any(w <= 0 for w in weights.values()) or block <= 0:
        raise ValueError("weights and the block must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source has a key that no name has
    rows = rows.withColumn("stream", key).withColumn("draw", F.xxhash64("doc_id", F.lit(5)))
    rows = stash(rows, "mix")
    counts = {r.stream: r.n for r in rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    slices = slices or slices_for(sum(counts.values()))
    others = max(1, sum(s[1:] not in weights or not s for s in counts))
    shares = {s: weights[s[1:]] * others if s and s[1:] in weights else others_weight for s in counts}
    plan = phases({s: -(-n // block) for s, n in counts.items()}, shares)
    schema = "stream string, from long, n long, slot0 long, span long, own long, at array<int>"
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, schema))  # a row for each phase and source that has blocks in it
    ranked = number_rows(rows, ["stream"], ["draw", "doc_id"], "rank", slices).withColumn("block", F.expr(f"rank div {block}"))
    placed = ranked.join(table, (ranked.stream == table.stream) & (F.col("block") >= F.col("from")) & (F.col("block") < F.col("from") + F.col("n")))
    turn = F.col("block") - F.col("from")
    slot = F.col("slot0") + F.expr("(block - from) div own") * F.col("span") + F.element_at("at", (F.pmod(turn, F.col("own")) + 1).cast("int"))
    placed = placed.withColumn("slot", slot)
    return placed.select("doc_id", "source", F.col("source").alias("stream"), "block", "slot", (F.col("slot") * block + F.pmod("rank", F.lit(block))).alias("position"))


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix_sources(docs, WEIGHTS, OTHERS_WEIGHT)
