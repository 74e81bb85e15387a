"""Text operators as Column expressions that stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the text contains one of the phrases."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\r\f\x0b"))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def unique(values: Column) -> Column:
    """Drop empty and repeated values, the first of each stays."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def normalize(text: Column) -> Column:
    return F.translate(F.lower(text), "'`’", "")


def occurrences(text: Column, phrase: Column) -> Column:
    """How often the phrase stands in the text without overlap."""
    return F.when(F.length(phrase) > 0, (F.length(text) - F.length(F.replace(text, phrase))) / F.length(phrase)).otherwise(0).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def preview(text: Column, most: int = 8000) -> Column:
    """The whole text up to ``most`` characters, else slices of its head, middle and tail."""
    size = max(2000, most // 3)
    middle = F.greatest(F.lit(0), F.expr("1") * (F.floor(F.length(text) / 2) - size // 2)).cast("int")
    cut = F.concat_ws("\n", F.substring(text, F.lit(1), F.lit(size)), F.substring(text, middle + 1, F.lit(size)), F.right(text, F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def table_codes(text: Column) -> Column:
    return F.array_distinct(F.transform(find_all(text, r"[A-Z]{1,6}-[A-Z]?-?[0-9]+[A-Z]?"), F.lower))


#: A capitalised word after white space (that of the SQL's engine), and a linking word.
_CAPITAL, _LINK = r"[ \t\n\r\f]++[A-Z][a-z]++", r"[ \t\n\r\f]++(?:and|of|the|for|in|to)"
#: Two or more capitalised words; such words with linking words between them, at least one of either after the first.  Both are the greedy
#: patterns ``A(?:\s+A)+`` and ``A(?:\s+(?:A|link))+\s+A`` without a way back, whose cost in stack would grow with the run of words.
ENTITY = rf"[A-Z][a-z]++(?:{_CAPITAL})++"
LINKED_ENTITY = rf"[A-Z][a-z]++(?:(?:(?:{_LINK})*+{_CAPITAL}){{2,}}+|(?:{_LINK})++{_CAPITAL})"


def named_entities(text: Column) -> Column:
    found = F.concat(find_all(text, ENTITY), find_all(text, LINKED_ENTITY))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: F.length(e) >= 6))


def quoted_phrases(text: Column) -> Column:
    hits = find_all(text, "['‘’]([^'‘’]{3,})['‘’]|\"([^\"]{3,})\"")
    return unique(F.transform(hits, lambda h: strip(F.lower(F.substring(h, F.lit(2), F.length(h) - 2)))))


def focus_phrases(text: Column) -> Column:
    low = F.lower(text)
    return unique(F.array(*(F.regexp_extract(low, p, 0) for p in L.FOCUS)))


def keywords(text: Column, most: int = 28) -> Column:
    """Focus phrases, entities, quotations, codes, words that are no stop words and expansions, without negative terms."""
    low = F.lower(text)
    words = F.filter(find_all(low, r"[a-z][a-z0-9$%.-]{2,}"), lambda w: ~w.isin(*L.STOPWORDS))
    more = [F.when(matches(low, p), strings(found)).otherwise(strings([])) for p, found in L.EXPANSIONS]
    negative = F.concat(*(F.when(any_of(low, phrases), strings(found)).otherwise(strings([])) for phrases, found in L.NEGATIVE))
    found = unique(F.concat(focus_phrases(text), named_entities(text), quoted_phrases(text), table_codes(text), words, *more))
    return F.slice(F.filter(found, lambda w: ~F.array_contains(negative, w)), 1, most)


def years(text: Column) -> Column:
    """Years 1920-2029 and those of ranges up to twenty years, in order."""
    year = r"(19[2-9][0-9]|20[0-2][0-9])"
    single = find_all(text, rf"\b{year}\b")
    spans = [rf"(?i)\bfrom\s+{year}\s+to\s+{year}\b", rf"(?i)\bbetween\s+{year}\s+and\s+{year}\b", rf"\b{year}\s*[-–—]\s*{year}\b"]

    def between(pattern: str) -> Column:
        pairs = F.arrays_zip(find_all(text, pattern, 1).alias("a"), find_all(text, pattern, 2).alias("b"))
        low = lambda p: F.least(p["a"].cast("int"), p["b"].cast("int"))
        high = lambda p: F.greatest(p["a"].cast("int"), p["b"].cast("int"))
        kept = F.filter(pairs, lambda p: (high(p) - low(p)).between(1, 20))
        return F.flatten(F.transform(kept, lambda p: F.sequence(low(p), high(p))))

    return F.array_sort(F.array_distinct(F.concat(F.transform(single, lambda y: y.cast("int")), *map(between, spans))))


def table_signal(line: Column) -> Column:
    """0 to 6: a digit, two numbers, a month, a percent or currency sign, a run of blanks.  Lines without a digit skip the count of numbers."""
    numbers = F.when(line.rlike("[0-9]"), F.least(F.regexp_count(line, F.lit(L.NUMBER)), F.lit(2))).otherwise(0)
    return table_points(numbers, F.lower(line).rlike(L.MONTH_WORD), line)


def table_points(numbers: Column, month: Column, line: Column) -> Column:
    """``table_signal`` of a line whose numbers have been counted and whose month been looked for."""
    score = F.when(numbers >= 2, 3).when(numbers == 1, 1).otherwise(0) + F.when(month, 1).otherwise(0)
    score += F.when(line.rlike("[%$¥£]"), 1).otherwise(0)
    return score + F.when(line.rlike(r"[ \t\n\r\f]{2,}|\t"), 1).otherwise(0)


def heading_signal(line: Column) -> Column:
    low = strip(F.lower(line))
    score = F.when(low.rlike(L.HEADING_START), 2).otherwise(0)
    score += F.when(low.rlike(L.HEADING_WORD), 1).otherwise(0)
    return score + F.when(low.endswith(":"), 1).otherwise(0)


def upper_ratio(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def question_uid(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(text), r"\bUID[0-9]{4}\b", 0), F.lit("")), F.lit("unknown"))


def shift_month(year: Column, month: Column, by: Column) -> Column:
    return F.add_months(F.make_date(year, month, F.lit(1)), by)
