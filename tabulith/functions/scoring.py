"""Scores of sections, tables and files for questions, as Column expressions.

What depends on a text alone is computed once for each text (features), what depends on a question alone once for each question (conditions,
points); a pair only adds up points of rules that hit and counts the question's keywords.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L
from tabulith.functions import profile as P
from tabulith.functions import rules as R
from tabulith.functions import text as T

FAMILY_NAMES = list(R.FAMILIES)
#: All words that can be dimension terms.
TERMS = list(dict.fromkeys([*L.DIMENSIONS, *(t for _, terms in L.IMPLIED_DIMENSIONS for t in terms)]))


def total(terms: list[Column]) -> Column:
    return reduce(add, terms, F.lit(0))


def literals(pattern: str) -> list[str]:
    """Words of which every text with the pattern has one, the longest of each alternative; none if there is no telling."""

    def words(parts) -> list[str]:
        found, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind is sre.LITERAL and value < 128:
                run += chr(value)
                continue
            found, run = [*found, [run]] if run else found, ""
            if kind is sre.SUBPATTERN and not value[1]:
                found.append(words(value[3]))
            elif kind is sre.BRANCH:
                each = [words(p) for p in value[1]]
                found.append([w for e in each for w in e] if all(each) else [])
        return max(found, key=lambda f: min(map(len, f), default=0), default=[])

    parsed = sre.parse(pattern)
    return [] if parsed.state.flags & re.IGNORECASE else list(dict.fromkeys(words(parsed)))


def has_pattern(text: Column, pattern: str) -> Column:
    """Whether the text has the pattern, which is tried only where one of its words stands: looking for a word takes a small part of the time."""
    needed = literals(pattern)
    return F.when(T.any_of(text, needed), text.rlike(pattern)).otherwise(F.when(text.isNotNull(), False)) if needed else text.rlike(pattern)


#: Characters of a text's head; most texts that have a pattern often enough have it so often there.
HEAD = 4000


def has_often(text: Column, pattern: str, least: int) -> Column:
    """Whether the text has the pattern so often.  All places in the head but the last, which the cut may have made, are places in the text."""
    return F.when(F.regexp_count(F.substring(text, 1, HEAD), F.lit(pattern)) > least, True).otherwise(F.regexp_count(text, F.lit(pattern)) >= least)


def points_of(rules: list[R.Rule]) -> Column:
    """For a question: the points of each rule, 0 where its condition fails."""
    return F.array(*(F.when(F.expr(r.when), r.points).otherwise(0) for r in rules))


def hits_of(rules: list[R.Rule], fields: dict[str, Column]) -> Column:
    """For a text: the numbers of the rules whose pattern it has."""

    def hit(r: R.Rule) -> Column:
        text = fields[r.field]
        found = has_pattern(text, r.pattern) if r.least == 1 else has_often(text, r.pattern, r.least)
        return found & ~text.rlike(r.unless) if r.unless else found

    return F.array_compact(F.array(*(F.when(hit(r), i) for i, r in enumerate(rules)))).cast("array<int>")


def dot(points: Column, hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, i: s + F.get(points, i))


def with_conditions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add the profile and everything that rules ask of a question."""
    low = F.lower(F.col(text))
    out = P.with_profile(questions, text).withColumn("families", P.families(text))
    out = out.withColumns({f"is_{f}": F.array_contains("families", f) for f in FAMILY_NAMES})
    out = out.withColumns({f"says_{w}": low.contains(w) for w in ("notes", "exclud", "million", "billion", "trillion", "thousand")})
    out = out.withColumns(
        {
            "has_family": F.size("families") > 0,
            "says_fiscal": low.contains("fiscal") | low.contains("fy"),
            "keywords": F.transform(T.keywords(F.col(text)), T.normalize),
            "years": T.years(F.col(text)),
            "codes": T.table_codes(F.col(text)),
            "terms": P.dimension_terms(text),
            "maturity": P.maturity(text),
            "month_numbers": F.filter(F.transform("months", lambda m: F.array_position(T.strings(L.MONTHS), m).cast("int")), lambda m: m > 0),
        }
    )
    issue = F.year("maturity") * 12 + F.month("maturity") - 12 * F.col("note_term_years") + 1
    return out.withColumns(
        {
            "n_years": F.size("years"),
            "first_year": F.array_min("years"),
            "last_year": F.array_max("years"),
            "first_month": F.coalesce(F.get("month_numbers", F.lit(0)), F.lit(0)),
            "issue_month": F.when(F.col("note_term_years") > 0, issue),
            "table_points": points_of(R.TABLE_RULES),
            "file_points": points_of(R.FILE_RULES),
        }
    )


def keyword_points(keywords: Column, hits: Column, most: int, phrase: int, word: int) -> Column:
    """Capped counts of the keywords from a text's hits (map<phrase, count>), weighted by whether they are phrases."""
    count = lambda k: F.coalesce(F.try_element_at(hits, k), F.lit(0))
    return F.aggregate(keywords, F.lit(0), lambda s, k: s + F.least(count(k), F.lit(most)) * F.when(k.contains(" "), phrase).otherwise(word))


def known_years(text: Column) -> Column:
    """Four-digit numbers that stand in no longer number, repeated as they stand."""
    return F.filter(T.find_all(text, "[0-9]+"), lambda n: F.length(n) == 4).cast("array<int>")


def sorted_years(text: Column) -> Column:
    """``known_years`` that can be years of a table, in order."""
    return F.sort_array(F.filter(known_years(text), lambda y: y.between(1900, 2099)))


def at_most(ordered: str, n: int) -> Column:
    """The first ``n`` of each run of equal values in an ordered array, a column of its own."""
    return F.filter(ordered, lambda y, i: F.when(i < n, True).otherwise(F.get(F.col(ordered), i - n) != y))


def times(values: Column, value: Column) -> Column:
    """How often an array has the value."""
    return F.size(values) - F.size(F.array_remove(values, value))


def family_hits(text: Column) -> Column:
    """For each family in order, how many of its keywords the text has."""
    return F.array(*(total([text.contains(k).cast("int") for k in R.FAMILIES[f][1]]) for f in FAMILY_NAMES))


def present(text: Column, words: list[str]) -> Column:
    return F.filter(T.strings(words), lambda w: F.contains(text, w))


# --- sections ---------------------------------------------------------------------------------------------------------


def _mask(low: Column) -> Column:
    """One bit for each month whose name the lower-cased line has."""
    return total([F.when(low.contains(m), 1 << i).otherwise(0) for i, m in enumerate(L.MONTHS)])


#: Bits of a section's line: signs of a table, several years, a month, several numbers, a date, a percentage, totals.
_TABLE, _DENSE, _MONTHLY, _NUMERIC, _DATED, _PERCENT, _TOTAL = (1 << i for i in range(7))


#: Lines at the top of a section that are asked whether they are headings.
_TOP = 6


def _looked(lines: Column) -> Column:
    """What scores read of each line, each pattern tried once; patterns of figures only where there is a digit.

    In steps, as nothing is kept between the uses of a value inside one.  A line has a month as ``R.MONTH`` has it where it has one as
    ``L.MONTH_WORD`` has it: a point that belongs to the first ends the second.
    """
    bit = lambda test, value: F.when(test, value).otherwise(0)
    none = F.array().cast("array<int>")
    lows = F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low"), F.when(x.rlike("[0-9]"), F.regexp_count(x, F.lit(R.NUMBERS))).otherwise(0).alias("numbers")))
    seen = F.transform(lows, lambda r: F.struct(*(r[c].alias(c) for c in ("x", "low", "numbers")), r["low"].rlike(L.MONTH_WORD).alias("month"), F.when(r["numbers"] > 0, known_years(r["x"])).otherwise(none).alias("years")))

    def line(r: Column, i: Column) -> Column:
        x, low, month = r["x"], r["low"], r["month"]
        signal = T.table_points(r["numbers"], month, x)
        # several years are several four-digit numbers, unless letters stand at their side
        bits = bit(signal >= 2, _TABLE) + F.when(F.size(r["years"]) >= 2, bit(F.regexp_count(x, F.lit(R.YEAR)) >= 2, _DENSE)).otherwise(0) + bit(r["numbers"] >= 4, _NUMERIC) + bit(month, _MONTHLY)
        bits += bit(month | low.rlike(r"\b(?:date|issue)\b"), _DATED) + bit(x.contains("%") | low.contains("percent"), _PERCENT) + bit(low.rlike(L.WINDOW_TOTALS), _TOTAL)
        return F.struct(x.alias("x"), bits.alias("bits"), F.when(i < _TOP, T.heading_signal(x)).otherwise(0).alias("heading"), _mask(low).alias("months"), F.array_distinct(r["years"]).alias("years"))

    return F.transform(seen, line)


def with_section_features(rows: DataFrame, section: str, out: str = "section") -> DataFrame:
    """Add ``out``, the features of a section's text; its lines are looked at once, in a column of their own."""
    rows = rows.withColumn("_looked", _looked(F.filter(T.lines(F.col(section)), lambda x: T.strip(x) != "")))
    count = lambda bit: F.size(F.filter("_looked", lambda x: x["bits"].bitwiseAND(F.lit(bit)) != 0))
    top = F.slice("_looked", 1, _TOP)
    years = lambda lines: F.flatten(F.transform(lines, lambda x: x["years"]))
    features = F.struct(
        F.size("_looked").alias("n"),
        T.normalize(F.array_join(F.transform(top, lambda x: x["x"]), " ")).alias("title"),
        T.normalize(F.col(section)).alias("body"),
        count(_TABLE).alias("table"),
        F.aggregate(F.slice("_looked", 1, 4), F.lit(0), lambda s, x: s + x["heading"]).alias("heading"),
        F.exists(top, lambda x: x["heading"] > 0).alias("headed"),
        count(_DENSE).alias("dense"),
        count(_MONTHLY).alias("monthly"),
        count(_NUMERIC).alias("numeric"),
        count(_DATED).alias("dates"),
        count(_PERCENT).alias("percents"),
        count(_TOTAL).alias("totals"),
        F.filter(F.transform("_looked", lambda x: x["months"]), lambda m: m > 0).alias("months"),
        years(F.col("_looked")).alias("line_years"),
        F.array_distinct(years(F.filter("_looked", lambda x: x["bits"].bitwiseAND(F.lit(_TABLE)) != 0))).alias("table_years"),
    )
    return rows.withColumn("_features", features).drop("_looked", *([out] if out in rows.columns else [])).withColumnRenamed("_features", out)


def section_score(f: str = "section") -> Column:
    """SC1 of a section's features and hits and a question's columns."""
    s, q = lambda name: F.col(f"{f}.{name}"), F.col
    capped = lambda name, most, weight: F.least(s(name), F.lit(most)) * weight
    when = lambda flag, points: F.when(flag, points).otherwise(0)
    asked = F.aggregate("month_numbers", F.lit(0), lambda a, m: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), m - 1)))
    score = keyword_points(q("keywords"), s("title_hits"), 2, 36, 10) + keyword_points(q("keywords"), s("body_hits"), 4, 8, 2)
    score += capped("table", 12, 1) + s("heading")
    score += when(q("expects_regression"), capped("dense", 8, 4)) + when(q("expects_series_math"), capped("dense", 6, 3) + capped("monthly", 8, 2))
    score += when(q("expects_list"), capped("numeric", 8, 3)) + when(q("expects_date"), capped("dates", 8, 3)) + when(q("expects_percent"), capped("percents", 8, 2))
    score += when(q("expects_sum") | q("expects_difference"), capped("totals", 10, 2))
    score += when(F.size("month_numbers") > 0, F.least(F.size(F.filter(s("months"), lambda m: m.bitwiseAND(asked) != 0)), F.lit(6)) * 2)

    def year(y: Column) -> Column:
        return F.least(times(s("line_years"), y), F.lit(4)) * 6 + F.when(F.array_contains(s("table_years"), y), 8).otherwise(0)

    score += F.aggregate("years", F.lit(0), lambda a, y: a + year(y))
    score += when((s("table") >= 3) & s("headed"), 10)
    return F.when(s("n") > 0, score).otherwise(0)


# --- tables -----------------------------------------------------------------------------------------------------------


#: Places of a year in a table that count.
YEAR_CAP = 6


def table_features(title: Column, text: Column, unit: Column, both: Column, whole: Column, code: Column, pipe_lines: Column, years: str) -> Column:
    """Features of a table from its normalised title, text and unit, the first two and all three as one text, and the column of ``sorted_years`` of its text."""
    fields = {"title": title, "text": text, "unit": unit, "both": both, "all": whole, "marks": F.concat(F.replace(title, F.lit("%")), F.when(text.contains("%"), "%").otherwise(""))}
    prefix = [F.coalesce(total([code.startswith(p).cast("int") for p in R.FAMILIES[f][0]]) > 0, F.lit(False)) for f in FAMILY_NAMES]
    return F.struct(
        title.alias("title"),
        text.alias("text"),
        code.alias("code"),
        pipe_lines.alias("pipe_lines"),
        title.contains("contents").alias("is_contents"),
        hits_of(R.TABLE_RULES, fields).alias("hits"),
        family_hits(whole).alias("families"),
        F.array(*prefix).alias("prefixes"),
        present(whole, TERMS).alias("terms"),
        present(both, L.MONTHS).alias("months"),
        F.array_distinct(known_years(title)).alias("title_years"),
        # no more of a year than count, so that a pair's cost does not grow with the table
        at_most(years, YEAR_CAP).alias("text_years"),
    )


def table_score(f: str = "features", title: str = "title_hits", text: str = "text_hits") -> Column:
    """SC2 of a table's features and hits and a question's columns."""
    t, q = lambda name: F.col(f"{f}.{name}"), F.col
    coded = t("code") != ""
    score = keyword_points(q("keywords"), q(title), 2, 42, 12) + keyword_points(q("keywords"), q(text), 6, 10, 3)
    score += F.when(coded, 22 + F.when(F.array_contains(q("codes"), t("code")), 55).otherwise(0)).otherwise(0)
    score += F.least(t("pipe_lines"), F.lit(14))
    year = lambda y: F.when(F.array_contains(t("title_years"), y), 15).otherwise(0) + F.least(times(t("text_years"), y), F.lit(YEAR_CAP)) * 4
    score += F.aggregate("years", F.lit(0), lambda a, y: a + year(y))
    score += F.size(F.array_intersect(q("months"), t("months"))) * 8
    score += F.least(F.size(F.array_intersect(q("terms"), t("terms"))), F.lit(5)) * 9
    score += dot(q("table_points"), t("hits"))
    asked = [q(f"is_{name}") for name in FAMILY_NAMES]
    codes = [F.when(a & t("prefixes")[i], 40).otherwise(0) for i, a in enumerate(asked)]
    words = [F.when(a, F.least(t("families")[i], F.lit(4)) * 12).otherwise(0) for i, a in enumerate(asked)]
    matched = total(codes) + total(words)
    score += matched
    score += F.when((t("title").startswith("[") | t("title").startswith("in ")) & ~coded, -12).otherwise(0)
    score += F.when(t("title").startswith("table block near line"), -25).otherwise(0)
    known = F.exists(t("prefixes"), lambda p: p)
    score += F.when(q("has_family") & (matched == 0) & coded & known, -10).otherwise(0)
    return F.when(t("is_contents"), -50).otherwise(score)


# --- files ------------------------------------------------------------------------------------------------------------


def file_features(heading: Column, content: Column) -> Column:
    """Features of a file from its normalised heading summary and text."""
    return F.struct(
        heading.alias("heading"),
        family_hits(heading).alias("families"),
        present(heading, TERMS).alias("terms"),
        hits_of(R.FILE_RULES, {"heading": heading, "content": content}).alias("hits"),
        F.array_distinct(F.filter(known_years(content), lambda y: y.between(1900, 2099))).alias("years"),
    )


#: The months for which a publication counts, from the first issue that may print the last year's figures.
PUBLICATION_SPAN = (min(low for low, *_ in R.PUBLICATION), max(high for _, high, *_ in R.PUBLICATION))


def publication_points(m: Column) -> Column:
    """Points for an issue so many months after the first that may print a year's figures."""
    return F.coalesce(*(F.when(m.between(low, high), F.greatest(F.lit(least), top - F.floor((m - low0) / step))) for low, high, top, low0, step, least in R.PUBLICATION), F.lit(0)).cast("int")


def publication() -> Column:
    """Points for the months between the first issue that may print the last year's figures and a file's issue (fy, fm)."""
    return publication_points(F.expr("(fy - last_year + CASE WHEN says_fiscal THEN 1 ELSE 0 END) * 12 + fm - CASE WHEN says_fiscal THEN 10 ELSE 1 END"))


def file_score(f: str = "features", name: str = "file_name") -> Column:
    """SC4 without sections and tables: file name, headings, whole text, date rules and heading rules; hits of keywords and codes in both texts are given."""
    h, q = lambda field: F.col(f"{f}.{field}"), F.col
    low = F.lower(F.col(name))

    def word(k: Column) -> Column:
        phrase = k.contains(" ")
        in_name = F.when(low.contains(k), F.when(phrase, 2).otherwise(1)).otherwise(0)
        held = F.coalesce(F.try_element_at("content_hits", k), F.lit(0))
        in_text = F.when(phrase, F.least(held, F.lit(3)) * 6).when((F.length(k) >= 6) & (held > 0), 2).otherwise(0)
        return in_name + in_text

    score = F.aggregate(q("keywords"), F.lit(0), lambda s, k: s + word(k)) + publication()
    score += keyword_points(q("keywords"), q("heading_hits"), 3, 8, 3) + F.least(F.size(F.array_intersect(q("terms"), h("terms"))), F.lit(5)) * 8
    dated = total([F.expr(r) for r in R.DATE_RULES])
    score += F.when(q("fy").isNotNull() & (q("n_years") > 0), dated).otherwise(0)
    score += total([F.coalesce(F.expr(r), F.lit(0)) for r in R.OTHER_DATE_RULES])
    families = total([F.when(q(f"is_{n}"), h("families")[i]).otherwise(0) for i, n in enumerate(FAMILY_NAMES)])
    score += F.least(families, F.lit(4)) * 10 + dot(q("file_points"), h("hits"))
    years = F.size(F.array_intersect(q("years"), h("years")))
    enough = F.when(years >= F.greatest(F.lit(4), F.floor(q("n_years") / 2)), 26).otherwise(0)
    score += F.when((q("expects_regression") | q("expects_list")) & (q("n_years") >= 2) & (years > 0), years * 8 + enough).otherwise(0)
    return score + F.size(F.filter(q("codes"), lambda c: F.try_element_at("content_hits", c).isNotNull())) * 30
