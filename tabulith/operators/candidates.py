"""Candidate issues of a monthly series by the dates that a question names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import rules as R
from tabulith.functions import text as T


def lagged(mentions: DataFrame, issues: DataFrame, months: int = 3) -> DataFrame:
    """Issues of a mentioned month and of the ``months`` after it: an equi join on shifted dates."""
    shifted = mentions.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(months)))).withColumn("pub_date", F.expr("add_months(mentioned, lag)"))
    return shifted.join(issues, "pub_date", "left_semi").select("q_id", "mentioned", "lag", "pub_date")


def fiscal_year(asked: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues from October before a fiscal year to its September."""
    months = asked.withColumn("pub_date", F.explode(F.expr("sequence(make_date(year - 1, 10, 1), make_date(year, 9, 1), interval 1 month)")))
    return months.join(issues, "pub_date", "left_semi")


def following_years(asked: DataFrame, issues: DataFrame, years: int = 6, last: int = 2026) -> DataFrame:
    """Issues of a year and of the ``years`` after it, before the year ``last``."""
    span = asked.withColumn("pub_year", F.explode(F.sequence("year", F.least(F.col("year") + years, F.lit(last - 1)))))
    return span.join(issues.withColumn("pub_year", F.year("pub_date")), "pub_year").select("q_id", "year", "pub_date")


def anchors(asked: DataFrame, rules: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues that rules (family, shift of years, month) name for a question's families and years."""
    named = asked.join(rules, "family").withColumn("pub_date", F.expr("make_date(year + shift, month, 1)"))
    return named.select("q_id", "pub_date").distinct().join(issues, "pub_date", "left_semi")


def ordered_union(*ranked: DataFrame) -> DataFrame:
    """Union of (q_id, pub_date, source_rank, pos) without repeats: each date keeps its first source."""
    every = reduce(DataFrame.unionByName, ranked)
    return every.groupBy("q_id", "pub_date").agg(F.min(F.struct("source_rank", "pos")).alias("_m")).select("q_id", "pub_date", F.col("_m.source_rank").alias("source_rank"), F.col("_m.pos").alias("pos"))


# --- all candidates of a question (conditions of ``scoring.with_conditions``) -------------------------------------------

#: Fixed patterns: how a question names an issue; month name and year are the groups.
REFERENCES = [r"treasury\s+bulletin\s+(?:from|of|in)\s+(\w+)\s+([0-9]{4})", r"(\w+)\s+([0-9]{4})\s+treasury\s+bulletin", r"the\s+(\w+)\s+([0-9]{4})\s+bulletin"]


def _dates(text: Column, pattern: str) -> Column:
    """First days of the months that a pattern with a month's name and a year finds, in order; nulls for other words."""
    month = lambda w: F.array_position(T.strings(L.MONTHS), w).cast("int")
    names, years = T.find_all(text, pattern, 1), T.find_all(text, pattern, 2)
    return F.zip_with(names, years, lambda w, y: F.when((month(w) > 0) & (y.cast("int") > 0), F.make_date(y.cast("int"), month(w), F.lit(1))))


def _listed(asks: DataFrame, dates: Column, source: int, pinned: bool) -> DataFrame:
    rows = asks.select("q_id", F.posexplode(dates).alias("pos", "pub_date")).where(F.col("pub_date").isNotNull())
    return rows.select("q_id", "pub_date", F.lit(source).alias("source_rank"), F.col("pos").cast("long").alias("pos"), F.lit(pinned).alias("pinned"))


def references(asks: DataFrame, text: str = "question") -> DataFrame:
    """Issues that the question names as such."""
    low = F.lower(F.col(text))
    return _listed(asks, F.flatten(F.array(*(_dates(low, p) for p in REFERENCES))), 1, True)


def mentions(asks: DataFrame, months: int = 3, text: str = "question") -> DataFrame:
    """The issue of each month that the question names with a year, and of the months after it."""
    low = F.lower(F.col(text))
    named = F.flatten(F.array(*(_dates(low, rf"({m})\s+([0-9]{{4}})") for m in L.MONTHS)))
    return _listed(asks, F.flatten(F.transform(named, lambda d: F.transform(F.sequence(F.lit(0), F.lit(months)), lambda i: F.add_months(d, i)))), 2, True)


def _years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(T.find_all(text, r"\b(19[3-9][0-9]|20[0-2][0-9])\b").cast("array<int>")))


def _fiscal_years(text: Column) -> Column:
    return F.filter(T.find_all(text, r"fiscal\s+year\s+([0-9]{4})", 1).cast("array<int>"), lambda y: y > 1)


def anchor_issues(asks: DataFrame, text: str = "question") -> DataFrame:
    """Issues that families and years point to, those of notes by their maturity, those of auctions after the month."""
    low = F.lower(F.col(text))
    by_rule = [F.when(F.expr(when), F.array(*(F.struct(F.lit(after).alias("after"), F.lit(month).alias("month")) for after, month in places))) for when, places in R.ANCHORS]
    places = F.flatten(F.array_compact(F.array(*by_rule)))
    dated = F.flatten(F.transform(_years(low), lambda y: F.transform(places, lambda p: F.make_date(y + p["after"], p["month"], F.lit(1)))))
    issue = F.when(F.col("is_auction") & F.col("issue_month").isNotNull(), F.make_date(F.floor((F.col("issue_month") - 1) / 12).cast("int"), (F.pmod(F.col("issue_month") - 1, F.lit(12)) + 1).cast("int"), F.lit(1)))
    auction = F.when(F.col("is_auction") & F.col("expects_date") & (F.col("first_month") > 0), F.transform(_years(low), lambda y: F.add_months(F.make_date(y, F.col("first_month"), F.lit(1)), 1)))
    none = F.array().cast("array<date>")
    return _listed(asks, F.concat(dated, F.when(issue.isNotNull(), F.array(issue, F.add_months(issue, 1))).otherwise(none), F.coalesce(auction, none)), 3, True)


def fiscal_issues(asks: DataFrame, text: str = "question") -> DataFrame:
    """The issues from October before a fiscal year to its September."""
    low = F.lower(F.col(text))
    months = F.transform(_fiscal_years(low), lambda y: F.transform(F.sequence(F.lit(-3), F.lit(8)), lambda i: F.add_months(F.make_date(y, F.lit(1), F.lit(1)), i)))
    return _listed(asks, F.flatten(months), 4, False)


def following_issues(asks: DataFrame, text: str = "question", last: int = 2026, years: int = 6) -> DataFrame:
    """All issues of each year and of the years after it, ``years`` or as many as the families ask for, before the year ``last``."""
    low = F.lower(F.col(text))
    rows = asks.withColumns({"_years": _years(low), "base": F.expr(R.following_base(years))}).withColumn("earliest", F.array_min("_years"))
    rows = rows.withColumn("_n", F.expr(R.FOLLOWING))
    rows = rows.withColumn("_n", F.when(F.col("expects_regression") | F.col("expects_list") | F.col("expects_series_math"), F.greatest(F.col("_n"), F.lit(10))).otherwise(F.col("_n")))
    every = F.array_sort(F.array_distinct(F.concat("_years", _fiscal_years(low))))
    months = lambda y: F.transform(F.sequence(F.lit(0), (F.least(y + F.col("_n") + 1, F.lit(last)) - y) * 12 - 1), lambda i: F.add_months(F.make_date(y, F.lit(1), F.lit(1)), i))
    return _listed(rows, F.flatten(F.transform(F.filter(every, lambda y: y < last), months)), 5, False)


def dated_candidates(asks: DataFrame, issues: DataFrame, text: str = "question", years: int = 6) -> DataFrame:
    """(q_id, pub_date, source_rank, pos, pinned): the issues that exist of all dates that a question points to, each with its first source.

    An issue is pinned if any of the first three sources names it.
    """
    rows = reduce(DataFrame.union, [*(f(asks, text=text) for f in (references, mentions, anchor_issues, fiscal_issues)), following_issues(asks, text, years=years)])
    rows = rows.join(issues.select("pub_date").distinct(), "pub_date", "left_semi")
    first = rows.groupBy("q_id", "pub_date").agg(F.min(F.struct("source_rank", "pos")).alias("_f"), F.max("pinned").alias("pinned"))
    return first.select("q_id", "pub_date", "_f.source_rank", "_f.pos", "pinned")


def best_files(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """K2 over (q_id, file_name, place, pinned, score): the files that ``limits`` (q_id, max_files) allows, with their rank.

    Up to that many candidates stay as they are, pinned ones first.  Else pinned ones come first and all are ordered by score, or, if none
    scores, by place with evenly spaced ones after the pinned.
    """
    w = Window.partitionBy("q_id")
    rows = candidates.join(limits, "q_id").withColumns({"_n": F.count(F.lit(1)).over(w), "_best": F.max("score").over(w), "_i": F.row_number().over(w.orderBy("place")) - 1})
    few = F.col("_n") <= F.col("max_files")
    flat = ~few & (F.col("_best") <= 0)
    picks = F.transform(F.sequence(F.lit(0), F.col("max_files") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.col("max_files") - 1, F.lit(1))).cast("int"))
    spaced = F.when(F.col("max_files") <= 1, F.col("_i") == F.floor(F.col("_n") / 2)).otherwise(F.array_contains(picks, F.col("_i")))
    rows = rows.where(~flat | F.col("pinned") | spaced)
    value = F.when(few | flat, 0).otherwise(F.col("score"))
    rank = F.row_number().over(w.orderBy(F.desc("pinned"), F.desc("_v"), "place"))
    return rows.withColumn("_v", value).withColumn("rank", rank).where(F.col("rank") <= F.col("max_files")).drop("_n", "_best", "_i", "_v", "max_files")
