"""Cells of pipe tables as rows, and statistics of the series that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L
from tabulith.functions import text as T

#: A row of dashes between header and body.
SEPARATOR = r"^[\s|:-]+$"
#: What a figure may be: signs, digits with commas, a point, a percent sign; in round brackets it is negative.
FIGURE = r"^\(?[-+]?\$? ?[0-9][0-9,]*(\.[0-9]+)?%?\)?$"
POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}


def split_row(line: Column) -> Column:
    """The stripped cells of a line between its bars; bars at its ends bound no cells."""
    inner = F.regexp_replace(T.strip(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), T.strip)


def figure(cell: Column) -> Column:
    """The value of a cell that is a figure; null for others."""
    bare = F.regexp_replace(cell, r"[$,%() ]", "").try_cast("double")
    return F.when(cell.rlike(FIGURE), F.when(cell.startswith("("), -bare).otherwise(bare))


def unit_power(unit: Column) -> Column:
    """The power of ten that a unit line names, 0 for none."""
    low = F.lower(unit)
    return F.coalesce(*(F.when(low.contains(word), power) for word, power in POWERS.items()), F.lit(0))


def period(label: Column) -> Column:
    """The first day of the month, or of the year, that a row's label names; null for other labels."""
    low = F.lower(label)
    named = r"\b(" + "|".join(L.MONTHS) + r")\s+((?:19|20)[0-9]{2})\b"
    month = F.array_position(T.strings(L.MONTHS), F.regexp_extract(low, named, 1)).cast("int")
    year = F.regexp_extract(low, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    return F.when(month > 0, F.make_date(F.regexp_extract(low, named, 2).try_cast("int"), month, F.lit(1))).when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1)))


def cells(tables: DataFrame, keys: list[str], body: str = "body", unit: str = "unit_hint") -> DataFrame:
    """(keys, row_no, col_no, row_label, column, cell, value, power) of each cell below the header and right of the labels of pipe tables.

    The header is all rows above the first separator, joined column by column; without a separator, the first row if none of its cells
    but years is a figure, or else there is none and columns have empty names.  The first cell of a row is its label.  Rows shorter than
    the header have fewer cells, longer ones columns without a name.  ``value`` is null for words, ``power`` the unit's power of ten.
    A table is parsed in its own row: nothing is shuffled.
    """
    lines = F.filter(T.lines(F.col(body)), lambda x: T.strip(x) != "")
    rows = tables.select(*keys, unit_power(F.col(unit)).alias("power"), F.transform(lines, lambda x: F.struct(x.rlike(SEPARATOR).alias("bar"), split_row(x).alias("c"))).alias("_rows"))
    bar = F.array_position(F.transform("_rows", lambda r: r["bar"]), F.lit(True)).cast("int")
    first = F.get("_rows", F.lit(0))["c"]
    named = ~F.exists(first, lambda c: figure(c).isNotNull() & ~c.rlike(r"^(19|20)[0-9]{2}$"))
    n_head = F.when(bar > 0, bar - 1).when(named, 1).otherwise(0)
    rows = rows.withColumn("_n", n_head).withColumn("_head", F.transform(F.slice("_rows", F.lit(1), F.col("_n")), lambda r: r["c"]))
    width = F.coalesce(F.array_max(F.transform("_head", F.size)), F.lit(0))
    column = lambda j: T.strip(F.array_join(F.filter(F.transform("_head", lambda h: F.coalesce(F.get(h, j), F.lit(""))), lambda c: c != ""), " "))
    names = F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), column)
    body_rows = F.filter(F.slice("_rows", F.col("_n") + 1, F.size("_rows")), lambda r: ~r["bar"])
    out = rows.select(*keys, "power", names.alias("_names"), F.posexplode(body_rows).alias("row_no", "_r"))
    out = out.select(*keys, "power", "_names", "row_no", F.get("_r.c", F.lit(0)).alias("row_label"), F.posexplode("_r.c").alias("col_no", "cell")).where("col_no > 0")
    return out.select(*keys, "row_no", "col_no", "row_label", F.coalesce(F.get("_names", F.col("col_no")), F.lit("")).alias("column"), "cell", figure(F.col("cell")).alias("value"), "power")


def series(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column, period, value): the figures of rows whose labels name a month or year."""
    return found.select(*keys, "column", period(F.col("row_label")).alias("period"), "value").where("period is not null and value is not null")


def statistics(rows: DataFrame, keys: list[str], x: str, y: str, digits: int = 2) -> DataFrame:
    """Count, mean, geometric mean, median, deviation, slope, intercept, correlation and weighted mean of ``y`` over ``x`` for each key.

    The geometric mean is that of the positive values; it is null if there are none, and so are figures that need two values from one, or two
    different ones.  Whether values differ is seen from the least and the greatest: sums of squares that tasks merge leave traces where all are equal.
    """
    cell = lambda c, name, d=digits: (F.round(c * 10**d) / 10**d).alias(name)
    v, m = F.col(y), F.col(x)
    differ = lambda c, other: F.min(F.when(other.isNotNull(), c)) < F.max(F.when(other.isNotNull(), c))
    sloped, both = differ(m, v), differ(m, v) & differ(v, m)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), cell(F.avg(v), "mean"), cell(F.exp(F.avg(F.when(v > 0, F.ln(v)))), "geometric_mean"), cell(F.median(v), "med"), cell(F.stddev_samp(v), "sd"),
        cell(F.when(sloped, F.regr_slope(v, m)), "slope"), cell(F.when(sloped, F.regr_intercept(v, m)), "intercept"), cell(F.when(both, F.try_divide(F.covar_samp(v, m), F.stddev_samp(v) * F.stddev_samp(m))), "r", 6), cell(F.try_divide(F.sum(v * m), F.sum(m)), "weighted"),
    )
