"""What a question asks for, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L
from tabulith.functions import text as T


def with_profile(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add the question's features: flags by phrases first, then those that combine them."""
    low = F.lower(F.col(text))
    out = questions.withColumns({name: T.any_of(low, phrases) for name, phrases in L.FEATURES.items()})
    month = F.filter(T.strings(L.MONTHS), lambda m: F.contains(low, m))
    out = out.withColumns({"months": month, "year_count": F.size(T.years(F.col(text))), "has_maturing": low.contains("maturing")})
    c = F.col
    out = out.withColumns(
        {
            "expects_date": c("asks_date") | c("expects_series_math"),
            "expects_scalar_lookup": ~c("no_lookup"),
            "prefers_country_claims": low.contains("claims") & low.contains("country") & c("claims_words"),
            "note_term_years": F.coalesce(F.expr(f"try_cast(regexp_extract(lower({text}), '\\\\b([0-9]+)-year\\\\s+u\\\\.?s\\\\.?\\\\s+treasury\\\\s+notes?\\\\b', 1) as int)"), F.lit(0)),
            "wants_tax_regression": low.contains("individual income tax receipts") & c("regression_words"),
            "wants_january_debt_series": low.contains("january") & low.contains("debt") & c("series_words"),
            "wants_monthly_series": c("asks_monthly") | (c("expects_series_math") & (F.size("months") > 0) & (c("year_count") >= 2)),
            "wants_bill_rate_data": (c("bill_term") & c("bill_word")) | c("bill_phrase"),
        }
    )
    held = c("has_maturing") & ~c("wants_bill_rate_data") & ~c("wants_auction_bid_data")
    return out.withColumn("wants_maturity_schedule", held | c("schedule_phrase"))


def maturity(text: str = "question") -> Column:
    """First day of the month in which the notes of a question mature; null if it names none."""
    low = F.lower(F.col(text))
    pattern = r"\bmaturing(?:\s+at\s+the\s+end\s+of|\s+end\s+of)?\s+(" + "|".join(L.MONTHS) + r")\s+(19[3-9][0-9]|20[0-2][0-9])\b"
    month = F.array_position(T.strings(L.MONTHS), F.regexp_extract(low, pattern, 1)).cast("int")
    return F.when(month > 0, F.make_date(F.regexp_extract(low, pattern, 2).try_cast("int"), month, F.lit(1)))


def families(text: str = "question") -> Column:
    """Table families in rule order; needs the profile's columns."""
    low, c = F.lower(F.col(text)), F.col
    hit = {name: low.rlike(pattern) for name, pattern in L.FAMILY_PATTERNS.items()}
    hit["bill_rates"], hit["auction_results"], hit["maturity_schedule"] = c("wants_bill_rate_data"), c("wants_auction_bid_data"), c("wants_maturity_schedule")
    hit["calendar_defense"] = (c("wants_calendar_year") | c("wants_monthly_series")) & hit["national_defense"]
    taxed = c("expects_regression") & low.contains("receipts")
    late = [F.when(taxed, F.lit("ffo")), F.when(taxed, F.lit("tax_receipts")), F.when(c("expects_list") & low.contains("debt"), F.lit("fd"))]
    return F.array_distinct(F.array_compact(F.array(*(F.when(hit[name], F.lit(name)) for name in L.FAMILY_ORDER), *late)))


def dimension_terms(text: str = "question") -> Column:
    low = F.lower(F.col(text))
    direct = F.filter(T.strings(L.DIMENSIONS), lambda t: F.contains(low, t))
    more = []
    for flags, terms in L.IMPLIED_DIMENSIONS:
        on = F.lit(False)
        for flag in flags:
            on = on | F.col(flag)
        more.append(F.when(on, T.strings(terms)).otherwise(T.strings([])))
    return F.array_distinct(F.concat(direct, *more))


#: Fixed weights of a question's difficulty.
DIFFICULTY = {"expects_regression": 6, "expects_list": 5, "expects_series_math": 5, "wants_monthly_series": 5, "prefers_country_claims": 4, "expects_sum": 3, "expects_percent": 3, "expects_difference": 3, "precision": 1}


def difficulty_score(text: str = "question") -> Column:
    score = F.lit(0)
    for flag, weight in DIFFICULTY.items():
        score += F.when(F.col(flag), weight).otherwise(0)
    score += F.when(F.col("year_count") >= 3, 2).otherwise(0) + F.when(F.col("year_count") >= 5, 1).otherwise(0)
    return score + F.when(F.length(text) >= 280, 2).when(F.length(text) >= 200, 1).otherwise(0)


def difficulty(text: str = "question") -> Column:
    score = difficulty_score(text)
    return F.when(score >= 6, "hard").when(score >= 3, "medium").otherwise("easy")


def needs_global_search(found: Column) -> Column:
    c = F.col
    return c("mentions_veterans_admin") | c("prefers_country_claims") | c("expects_regression") | c("expects_series_math") | c("expects_list") | (c("note_term_years") > 0) | (c("wants_monthly_series") & (c("year_count") >= 3)) | (F.array_contains(found, "auction") & c("expects_date"))


def context_limits(found: Column, files: int = 2, chars: int = 12000) -> tuple[Column, Column]:
    """How many files and characters a question's context may have."""
    c = F.col
    wide = c("expects_regression") | c("expects_list") | c("expects_series_math")
    some = c("wants_monthly_series") | c("expects_sum") | c("expects_percent") | F.array_contains(found, "calendar_defense")
    most = F.greatest(F.lit(files), F.when(wide, 4), F.when(some, 3), F.when(c("prefers_country_claims") | (c("year_count") >= 5), 4))
    return most, F.greatest(F.lit(chars), F.when(wide, 22000), F.when(some, 18000))


def output_format(text: Column, task: Column | None = None) -> Column:
    """The key of the first format whose pattern the text has; a bulletin question (``task`` officeqa) can have the first only."""
    low = F.lower(text)
    rules = [(low.rlike("(?s)" + pattern), key) for pattern, key, _ in L.FORMATS]
    every = F.coalesce(*(F.when(found, F.lit(key)) for found, key in rules))
    return every if task is None else F.when(task == "officeqa", F.when(rules[0][0], F.lit(rules[0][1]))).otherwise(every)


def directive(format_: Column) -> Column:
    """What an answerer is told about a format; empty for none."""
    return F.coalesce(*(F.when(format_ == key, F.lit(said)) for _, key, said in L.FORMATS), F.lit(""))


def strategy() -> Column:
    """Hints for solving a question of its shape, one bullet a line."""
    first = F.array(*map(F.lit, L.HINTS_FIRST))
    shape = F.array(*map(F.lit, L.HINTS_OTHERWISE))
    for flag, hints in reversed(list(L.HINTS_BY_SHAPE.items())):
        shape = F.when(F.col(flag), F.array(*map(F.lit, hints))).otherwise(shape)
    more = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(hint)) for when, hint in L.HINTS_MORE)))
    return F.array_join(F.transform(F.concat(first, shape, more), lambda h: F.concat(F.lit("- "), h)), "\n")
