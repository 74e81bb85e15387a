"""Windows of lines around signals, scored by prefix sums of line features, and the best of them merged and packed into a budget."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import text as T
from tabulith.operators import ranking as R
from tabulith.sources.scratch import spread, stash

#: Lines on each side of an anchor: for questions that need a whole column of figures, for sums, for others.
RADII = (18, 14, 10)
#: Lines of a text whose features are held at once.
CHUNK = 4096
#: Bits of a line: not blank, a row of a table, an anchor, totals, a month; then one for each cue of the lexicon.
FILLED, TABLE, ANCHOR, TOTALS, MONTH, CUE = 1, 2, 4, 8, 16, 32
#: Bits of a question: what besides the cues it asks for; the cues' bits are those of lines.
REGRESSION, LIST = 1, 2


def radius(flags: Column) -> Column:
    """Lines on each side of an anchor."""
    wide = F.arrays_overlap(flags, T.strings(["expects_list", "expects_regression", "expects_series_math"]))
    return F.when(wide, RADII[0]).when(F.array_contains(flags, "expects_sum"), RADII[1]).otherwise(RADII[2])


def _line_features(line: Column) -> Column:
    """Of a line: its normalised text, bits without cues, heading signal, and counts of years and of numbers."""
    low, table, heading = T.normalize(line), T.table_signal(line), T.heading_signal(line)
    bits = F.when(table >= 2, TABLE).otherwise(0) + F.when(table + heading > 0, ANCHOR).otherwise(0)
    return F.struct(low.alias("low"), bits.alias("bits"), heading.alias("heading"))


def _more_features(x: Column) -> Column:
    low = x["low"]
    bit = lambda pattern, value: F.when(low.rlike(pattern), value).otherwise(0)
    bits = x["bits"] + FILLED + bit(L.WINDOW_TOTALS, TOTALS) + bit(L.MONTH_WORD, MONTH)
    for i, (_, pattern, _) in enumerate(L.WINDOW_CUES):
        bits += bit(pattern, CUE << i)
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    blank = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("heading"), F.lit(0).alias("years"), F.lit(0).alias("numbers"))
    return F.when(low == "", blank).otherwise(F.struct(bits.alias("bits"), x["heading"].alias("heading"), count(r"\b(?:19|20)[0-9]{2}\b").alias("years"), count(r"-?[0-9][0-9,]*\.?[0-9]*").alias("numbers")))


def _places(body: str, keyword: str) -> list[int]:
    """Where the keyword stands in a text, places without overlap, from the left."""
    out, at = [], body.find(keyword) if keyword else -1
    while at >= 0:
        out.append(at)
        at = body.find(keyword, at + len(keyword))
    return out


def _hits(low: list[str], keywords: list[str], years: list[int]) -> np.ndarray:
    """How often each line has each keyword, then whether it has each year outside longer numbers."""
    body = "\n".join(low)
    ends = np.cumsum([len(x) + 1 for x in low])
    out = np.zeros((len(low), len(keywords) + len(years)), np.int64)
    for j, keyword in enumerate(keywords):
        np.add.at(out[:, j], np.searchsorted(ends, _places(body, keyword), "right"), 1)
    for j, year in enumerate(years, len(keywords)):
        at = [m.start() for m in re.finditer(rf"(?<![0-9]){year}(?![0-9])", body)]
        out[np.searchsorted(ends, at, "right"), j] = 1
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums along the first axis, with a row of zeros before."""
    return np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])


def _score(bits: np.ndarray, heading: np.ndarray, dates: np.ndarray, numbers: np.ndarray, low: list[str], keywords: list[str], years: list[int], radius: int, asked: int, skip: int, own: int, offset: int) -> list[dict]:
    """The windows of a piece's own lines with a positive score.  Each is a difference of prefix sums: its cost is the number of features, not its text."""
    at = np.flatnonzero(bits[skip : skip + own] & ANCHOR) + skip
    if not len(at):
        return []
    n = len(bits)
    first, last = np.maximum(at - radius, 0), np.minimum(at + radius + 1, n)
    within = lambda values: (s := _sums(values))[last] - s[first]
    any_of = lambda bit: within((bits & bit) > 0) > 0
    # a keyword weighs 3 or 10 and counts four times at most, a year weighs 10 and counts once
    caps = np.array([4] * len(keywords) + [1] * len(years), np.int64)
    points = np.array([10 if " " in k else 3 for k in keywords] + [10] * len(years), np.int64)
    score = np.minimum(within(_hits(low, keywords, years)), caps) @ points
    score = score + np.minimum(within((bits & TABLE) > 0), 12)
    filled = (bits & FILLED) > 0
    rank, heads = _sums(filled), _sums(heading[filled])
    score += heads[np.minimum(rank[first] + 4, rank[last])] - heads[rank[first]]
    for i, (_, _, gain) in enumerate(L.WINDOW_CUES):
        if asked & CUE << i:
            score += gain * any_of(CUE << i)
    if asked & TOTALS:
        score += 12 * any_of(TOTALS)
    if asked & REGRESSION:
        score += 14 * (within(dates) >= 4)
    if asked & LIST:
        score += 10 * (within(numbers) >= 6)
    if asked & MONTH:
        score += 6 * any_of(MONTH)
    move = offset - skip
    return [{"first": a + move, "last": b + move, "score": s} for a, b, s in zip(first.tolist(), last.tolist(), score.tolist(), strict=True) if s > 0]


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("first", "last", "score")])))
def _window_scores(bits: pd.Series, heading: pd.Series, dates: pd.Series, numbers: pd.Series, low: pd.Series, keywords: pd.Series, years: pd.Series, radius: pd.Series, asked: pd.Series, skip: pd.Series, own: pd.Series, offset: pd.Series) -> pd.Series:
    arrays = [[np.asarray(x, np.int64) for x in c] for c in (bits, heading, dates, numbers)]
    lists = [[list(x) for x in c] for c in (low, keywords, years)]
    return pd.Series([_score(*a) for a in zip(*arrays, *lists, radius, asked, skip, own, offset, strict=True)])


def distinct_texts(pairs: DataFrame, d_key: str, text: str) -> DataFrame:
    return pairs.select(d_key, text).where(F.col(text).isNotNull()).dropDuplicates([d_key])


def scored_windows(pairs: DataFrame, q_key: str = "q_id", d_key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(question, document, first, last, score): the window of each line with a table or heading signal, ``last`` exclusive, if its score is positive.

    ``pairs`` holds text, keywords, years and flags.  A window scores for capped keyword hits, years, table lines, headings at its top, and cues
    that the flags ask for.  Features are computed once a line of each text; a long text is taken in pieces that overlap by the radius.  A null
    text has no windows.  Pairs with the same document must hold the same text.
    """
    asks = lambda names, bit: F.when(F.arrays_overlap(F.col("flags"), T.strings(names)), bit).otherwise(0)
    asked = asks(["expects_sum", "expects_difference"], TOTALS) + asks(["expects_date"], MONTH) + asks(["expects_regression"], REGRESSION) + asks(["expects_list"], LIST)
    for i, (flag, _, _) in enumerate(L.WINDOW_CUES):
        asked += asks([flag], CUE << i)
    # each text is looked at once, for all questions that it is paired with
    texts = spread(distinct_texts(pairs, d_key, text)).select(d_key, T.lines(F.col(text)).alias("_all"))
    pieces = texts.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / chunk).cast("int")))).withColumn("_offset", F.col("_offset") * chunk)
    skip = F.least(F.lit(RADII[0]), F.col("_offset"))
    pieces = pieces.withColumns({"_skip": skip, "_own": F.least(F.lit(chunk), F.size("_all") - F.col("_offset")), "_lines": F.slice("_all", F.col("_offset") - skip + 1, skip + chunk + RADII[0])}).drop("_all")
    pieces = pieces.withColumn("_a", F.transform("_lines", lambda x: _line_features(T.rstrip(x)))).drop("_lines").withColumn("_b", F.transform("_a", _more_features))
    pieces = stash(pieces.select(d_key, "_offset", "_skip", "_own", F.col("_a.low").alias("_low"), "_b.bits", "_b.heading", F.col("_b.years").alias("_dates"), "_b.numbers"), "lines")
    q = pairs.select(q_key, d_key, F.transform("keywords", T.normalize).alias("_words"), "years", radius(F.col("flags")).alias("_radius"), asked.alias("_asked"))
    rows = spread(q).join(pieces, d_key)
    found = _window_scores("bits", "heading", "_dates", "numbers", "_low", "_words", "years", "_radius", "_asked", "_skip", "_own", "_offset")
    return rows.select(q_key, d_key, F.explode(found).alias("_w")).select(q_key, d_key, "_w.*")


def merge_windows(found: DataFrame, *keys: str, most: int = 4) -> DataFrame:
    """(keys, place, first, last): the windows (keys, first, last, score) of a pair, best first, merged into at most ``most`` intervals.

    A window that begins at or before the end of the interval made last extends that one; others begin a new interval, and the ``most``-th
    ends the merging.  As a new interval begins beyond the end of the last, that end is the greatest so far: a running maximum, no fold.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "first", "last")
    end = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.col("first") > F.coalesce(end, F.lit(-1)))
    rows = rows.withColumn("_no", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("_no") < most) | ((F.col("_no") == most) & F.col("_new")))
    merged = rows.groupBy(*keys, "_no").agg(F.max(F.when(F.col("_new"), F.col("first"))).alias("first"), F.max("last").alias("last"))
    return merged.select(*keys, (F.col("_no") - 1).cast("int").alias("place"), "first", "last")


def window_snippets(pairs: DataFrame, budget: int | Column = 12000, q_key: str = "q_id", d_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(question, document, place, first_line, end_line, snippet) of the merged windows that fit the budget; the first is cut to it.

    ``pairs`` has one row for each question and document with keywords, years and flags.  The budget may be a column of ``pairs``.
    """
    room = F.lit(budget) if isinstance(budget, int) else budget
    pairs = pairs.withColumn("_room", room)
    # what is known of pairs and the texts are each read several times
    texts = stash(distinct_texts(pairs, d_key, text), "texts")
    asked = stash(pairs.select(q_key, d_key, "keywords", "years", "flags", "_room"), "asked")
    at = merge_windows(scored_windows(asked.join(texts, d_key), q_key, d_key, text), q_key, d_key)
    both = at.join(asked.select(q_key, d_key, "_room"), [q_key, d_key]).join(texts, d_key)
    lines = F.transform(F.slice(T.lines(F.col(text)), F.col("first") + 1, F.col("last") - F.col("first")), T.rstrip)
    cut = both.select(q_key, d_key, "_room", "place", F.col("first").alias("first_line"), F.col("last").alias("end_line"), T.strip(F.array_join(lines, "\n")).alias("snippet"))
    keyed = cut.where("snippet <> ''").withColumn("_pair", F.struct(q_key, d_key))
    kept = R.pack(keyed, "_pair", "place", F.length("snippet"), F.col("_room"))
    return kept.withColumn("snippet", F.left("snippet", F.col("_room"))).drop("_pair", "_room")
