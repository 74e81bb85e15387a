"""Cleaning, parsing, converting and comparing answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L
from tabulith.functions import text as T

UNIT_POWER = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}


def asks_percent(question: Column) -> Column:
    return T.any_of(F.lower(question), ["percent", "percentage", "%"])


def verify(question: Column, answer: Column) -> Column:
    """Put a percent or dollar sign to a bare number if the question asks for it."""
    low = F.lower(question)
    bare = F.regexp_replace(T.strip(answer), r"\.+$", "")
    full = f"^{L.NUMBER}$"
    first = F.when(asks_percent(question) & ~answer.contains("%") & ~F.lower(answer).contains("percent") & bare.rlike(full), F.concat(bare, F.lit("%"))).otherwise(answer)
    money = T.any_of(low, ["in dollars", "dollar amount", "how much money"])
    return F.when(money & ~first.contains("$") & ~F.lower(first).contains("dollar") & T.strip(first).rlike(full), F.concat(F.lit("$"), T.strip(first))).otherwise(first)


def hedged(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(L.HEDGES))


def several_numbers(answer: Column) -> Column:
    """Whether there is more than one distinct number that is no year."""
    bare = F.transform(T.find_all(answer, L.NUMBER), lambda n: F.replace(n, F.lit(",")))
    value = F.filter(bare, lambda n: ~(n.try_cast("double").between(1900, 2100) & ~n.contains(".")))
    return F.size(F.array_distinct(F.transform(value, lambda n: n.try_cast("double")))) > 1


def without_preamble(answer: Column) -> Column:
    out = answer
    for pattern in L.PREAMBLES:
        out = T.strip(F.regexp_replace(out, "(?i)" + pattern, ""))
    return F.when(out == "", answer).otherwise(out)


def bare_value(text: Column) -> Column:
    t = T.strip(text)
    words = r"\b(the|answer|based on|according|because|from|table|therefore)\b"
    shape = F.lower(t).rlike(f"^(?:{L.SCALAR})$") | t.rlike(r"^[A-Za-z][A-Za-z0-9 ,.&()/-]{0,80}$")
    return (t != "") & ~t.contains("\n") & (F.length(t) <= 120) & ~F.lower(t).rlike(words) & shape


def pipe_row(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\|")) >= 2


def echo(text: Column) -> Column:
    return T.any_of(F.lower(text), L.ECHOES)


def final_text(answer: Column) -> Column:
    t = F.btrim(T.strip(F.btrim(T.strip(answer), F.lit("`"))), F.lit("\"' "))
    short = t.endswith(".") & (F.size(F.split(t, r"\s+")) <= 6)
    t = F.when(short, F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    return F.when(echo(t) | pipe_row(t), "").otherwise(t)


def placeholder(answer: Column) -> Column:
    low = F.lower(T.strip(answer))
    return low.isin(*L.PLACEHOLDER_VALUES) | low.rlike("|".join(L.PLACEHOLDERS))


def list_answer(answer: Column) -> Column:
    t = T.strip(answer)
    parts = F.transform(F.split(t, ","), lambda p: F.btrim(T.strip(p), F.lit("[]() ")))
    numeric = F.size(F.filter(parts, lambda p: p.rlike(r"^[-+]?\$?[0-9][0-9,]*\.?[0-9]*%?$")))
    return t.rlike(r"^\[[^\]]+\]$") | ((F.size(parts) >= 2) & (numeric >= 2))


def expected_length(question: Column) -> Column:
    low = F.lower(question)
    said = F.regexp_extract(low, r"\bcontaining\s+([0-9]+)\s+numbers?\b", 1).try_cast("int")
    nth = F.lit(None).cast("int")
    for i, word in reversed(list(enumerate(["first", "second", "third", "fourth"], 1))):
        nth = F.coalesce(nth, F.when(T.any_of(low, [f"{word} value", f"{word} number"]), i))
    two = F.when(T.any_of(low, ["slope and intercept", "inside square brackets", "enclosed brackets"]), 2)
    return F.coalesce(said, nth, two)


def question_unit(question: Column) -> Column:
    low, out = F.lower(question), F.lit(None).cast("string")
    for unit in reversed(L.UNIT_WORDS):
        out = F.when(low.contains(f"in {unit}"), unit).otherwise(out)
    return out


def scalar_unit(token: Column) -> Column:
    low, out = F.lower(token), F.lit(None).cast("string")
    for unit in reversed(L.UNIT_WORDS):
        out = F.when(low.contains(unit), unit).otherwise(out)
    return out


#: A number of plain digits.
PLAIN_NUMBER = r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def bare_number(token: Column) -> Column:
    """A token without its marks and unit."""
    bare = F.regexp_replace(F.btrim(T.strip(token), F.lit("[]() ")), r"(?i)trillion|billion|million|thousand", "")
    bare = F.regexp_replace(bare, r"\$|,|percent|%|dollars", "")
    return T.strip(bare)


def scalar_value(token: Column) -> Column:
    """The number in a token without its marks and unit, as a decimal of eight places, for comparing."""
    return bare_number(token).try_cast("decimal(28,8)")


def shifted(number: Column, by: Column) -> Column:
    """A number of plain digits times a power of ten, as text with every digit: its point is moved."""
    part = F.struct(number.startswith("-").alias("neg"), F.regexp_replace(number, "[-+.]", "").alias("g"), (F.length(F.regexp_extract(number, "^[-+]?([0-9]*)", 1)) + by).cast("int").alias("p"))
    padded = lambda s: F.struct(s["neg"].alias("neg"), F.greatest(s["p"], F.lit(1)).alias("p"), F.when(s["p"] <= 0, F.concat(F.repeat(F.lit("0"), 1 - s["p"]), s["g"])).otherwise(F.rpad(s["g"], F.greatest(s["p"], F.length(s["g"])), F.lit("0"))).alias("g"))

    def text(s: Column) -> Column:
        whole, rest = F.regexp_replace(F.left(s["g"], s["p"]), "^0+([0-9])", "$1"), F.regexp_replace(F.substring(s["g"], s["p"] + 1, F.length(s["g"])), "0+$", "")
        return F.struct(s["neg"].alias("neg"), F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest)).alias("t"))

    signed = lambda s: F.when(s["neg"] & s["t"].rlike("[1-9]"), F.concat(F.lit("-"), s["t"])).otherwise(s["t"])
    return F.get(F.transform(F.transform(F.transform(F.array(part), padded), text), signed), F.lit(0))


def exact_text(token: Column, by: Column, otherwise: Column) -> Column:
    """A token's number times a power of ten with every digit; ``otherwise`` for numbers that are written in other ways."""
    bare = bare_number(token)
    return F.when(bare.rlike(PLAIN_NUMBER), shifted(bare, by)).otherwise(otherwise)


def decimal_text(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def convert(question: Column, answer: Column) -> Column:
    """Change an answer with an explicit unit to the unit the question asks for; bare numbers keep their scale."""
    target, source, value = question_unit(question), scalar_unit(answer), scalar_value(answer)
    plain = T.strip(F.replace(answer, F.lit("$")))
    power = lambda unit: F.coalesce(*(F.when(unit == name, p) for name, p in UNIT_POWER.items()))
    scaled = F.round(value.cast("double") * F.pow(F.lit(10.0), power(source) - power(target)), 8).cast("decimal(28,8)")
    number = exact_text(answer, F.coalesce(power(source) - power(target), F.lit(0)), F.when(source.isNull(), decimal_text(value)).otherwise(decimal_text(scaled)))
    return F.when(target.isNull() | number.isNull(), plain).otherwise(number)


def year_like(token: Column) -> Column:
    return T.strip(F.regexp_replace(F.btrim(T.strip(token), F.lit("[]() ")), r"\$|%|percent|,", "")).rlike(r"^(?:19|20)[0-9]{2}$")


def table_label(token: Column) -> Column:
    return T.strip(token).rlike(r"^[A-Za-z]{1,3}-[0-9]{1,3}[A-Za-z]?$")


def last_tag(response: Column) -> Column:
    """The text of the last final-answer tag, else the last line that is not blank."""
    tags = T.find_all(response, r"(?is)<final_answer>(.*?)</final_answer>", 1)
    rows = F.filter(F.transform(T.lines(response), T.strip), lambda x: x != "")
    return F.coalesce(T.strip(F.try_element_at(tags, F.lit(-1))), F.try_element_at(rows, F.lit(-1)), F.lit(""))


def vote_number(text: Column) -> Column:
    """An answer as a number: marks dropped, parentheses negative, unit words multiplied."""
    bare = T.strip(F.regexp_replace(text, r"[$,]", ""))
    bare = F.regexp_replace(bare, r"^\((.+)\)$", "-$1")
    value = F.regexp_extract(bare, r"[-+]?[0-9]+\.?[0-9]*", 0).try_cast("double")
    unit = scalar_unit(text)
    return value * F.coalesce(*(F.when(unit == u, F.lit(10.0**p)) for u, p in UNIT_POWER.items()), F.lit(1.0))


def comparable(answer: Column) -> Column:
    a = F.regexp_replace(F.lower(T.strip(answer)), r"[$,]", "")
    a = T.strip(F.regexp_replace(F.regexp_replace(a, r"\s+", " "), "%+$", ""))
    return F.when(a.rlike(r"^-?[0-9]+\.0+$"), F.regexp_extract(a, r"^(-?[0-9]+)", 1)).otherwise(a)


def same_answer(predicted: Column, expected: Column) -> Column:
    """Equal after normalisation, or numbers within one percent of the larger of the expected one and 1."""
    p, e = comparable(predicted), comparable(expected)
    x, y = p.try_cast("double"), e.try_cast("double")
    return (p == e) | F.coalesce(F.abs(x - y) < 0.01 * F.greatest(F.abs(y), F.lit(1.0)), F.lit(False))


# --- salvaging answers ------------------------------------------------------------------------------------------------


def wants_percent_sign(question: Column) -> Column:
    return question.contains("%") | T.any_of(F.lower(question), L.PERCENT_SIGN)


def expects_date(question: Column) -> Column:
    return T.any_of(F.lower(question), L.DATE_ASKED)


def compact_last_line(answer: Column) -> Column:
    """The last of several lines if it is a bare value."""
    lines = F.filter(F.transform(T.lines(answer), T.strip), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    return F.when((F.size(lines) >= 2) & bare_value(last), last).otherwise(answer)


def best_compact_line(answer: Column) -> Column:
    """The last line that is a bare value without its list marks."""
    lines = F.transform(F.filter(T.lines(answer), lambda x: T.strip(x) != ""), lambda x: F.btrim(x, F.lit(" -*:\t")))
    return F.coalesce(F.try_element_at(F.filter(lines, bare_value), F.lit(-1)), answer)


def clean_scalar(token: Column) -> Column:
    return T.strip(F.replace(F.replace(F.replace(token, F.lit("$")), F.lit("percent"), F.lit("%")), F.lit(" ")))


def negative_context(line: Column) -> Column:
    return T.any_of(F.lower(line), L.NEGATIVE_CONTEXT)


def _tokens(text: Column) -> Column:
    """Scalars of the lines that do not deny an answer, last line first: struct of line, place, token, value, unit."""
    lines = F.reverse(F.filter(F.transform(T.lines(text), T.strip), lambda x: x != ""))
    kept = F.filter(lines, lambda x: ~negative_context(x))
    each = F.transform(kept, lambda x, i: F.transform(T.find_all(x, "(?i)" + L.SCALAR), lambda t, j: F.struct(F.lower(x).alias("line"), i.alias("i"), j.alias("j"), T.strip(t).alias("t"), scalar_value(t).alias("v"), scalar_unit(t).alias("u"))))
    return F.filter(F.flatten(each), lambda x: x["v"].isNotNull() & ~table_label(x["t"]))


def _first_best(scored: Column) -> Column:
    """The text of the struct (s, i, j, a) of the greatest score, the first of equals."""
    ordered = F.array_sort(F.transform(scored, lambda x: F.struct((-x["s"]).alias("s"), x["i"].alias("i"), x["j"].alias("j"), x["a"].alias("a"))))
    return F.get(ordered, F.lit(0))["a"]


def percent_answer(question: Column, text: Column) -> Column:
    """The best percentage of a text; explicit ones first, fractions times 100."""
    sign = wants_percent_sign(question)
    tokens = F.filter(_tokens(text), lambda x: ~year_like(x["t"]))
    cue = lambda x: F.when(T.any_of(x["line"], L.PERCENT_CUES), 2).otherwise(0)
    small = lambda v: (F.abs(v) > 0) & (F.abs(v) < 1)
    explicit = lambda x: clean_scalar(x["t"]).contains("%")
    said = F.transform(F.filter(tokens, explicit), lambda x: F.struct((cue(x) + 6).alias("s"), x["i"], x["j"], clean_scalar(x["t"]).alias("a")))
    points = lambda x: cue(x) + F.when(small(x["v"]), 4).when(F.abs(x["v"]) <= 1000, 2).otherwise(-10)
    value = lambda x: exact_text(x["t"], F.when(small(x["v"]), 2).otherwise(0), decimal_text(F.when(small(x["v"]), x["v"] * 100).otherwise(x["v"]).cast("decimal(28,8)")))
    plain = F.transform(F.filter(tokens, lambda x: ~explicit(x)), lambda x: F.struct(points(x).alias("s"), x["i"], x["j"], value(x).alias("a")))
    best, other = _first_best(said), _first_best(plain)
    return F.coalesce(F.when(sign, best).otherwise(F.replace(best, F.lit("%"))), F.when(sign, F.concat(other, F.lit("%"))).otherwise(other))


def normal_list(answer: Column) -> Column:
    """The parts between the first and the last character, cleaned, in brackets."""
    bare = T.strip(answer)
    inner = F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))
    parts = F.filter(F.transform(F.split(inner, ","), T.strip), lambda p: p != "")
    return F.concat(F.lit("["), F.array_join(F.transform(parts, clean_scalar), ", "), F.lit("]"))


def bracketed_list(text: Column, length: Column) -> Column:
    """The last bracketed list of numbers, of the given length if there is one."""

    def listed(body: Column) -> Column:
        parts = F.filter(F.transform(F.split(body, ","), T.strip), lambda p: p != "")
        cells = F.transform(parts, lambda p: F.btrim(p, F.lit("[]() ")))
        ok = (F.size(parts) > 0) & (length.isNull() | (F.size(parts) == length)) & F.forall(cells, lambda c: c.rlike(f"(?i)^(?:{L.SCALAR})$"))
        return F.when(ok, F.concat(F.lit("["), F.array_join(F.transform(cells, clean_scalar), ", "), F.lit("]")))

    return F.try_element_at(F.array_compact(F.transform(T.find_all(text, r"\[([^\]]+)\]", 1), listed)), F.lit(-1))


def scalar_candidate(question: Column, text: Column) -> Column:
    """The best number of a text for a question, in its unit."""
    low, target = F.lower(question), question_unit(question)
    tokens = F.filter(_tokens(text), lambda x: ~year_like(x["t"]) | expects_date(question))

    def score(x: Column) -> Column:
        points = F.when(T.any_of(x["line"], L.SCALAR_CUES), 3).otherwise(0) - F.when(T.any_of(x["line"], L.MONTHS), 1).otherwise(0)
        points += F.when(target.isNotNull() & (x["u"] == target), 8).when(x["u"].isNotNull(), 3).otherwise(0)
        points -= F.when(x["u"].isNull() & ~asks_percent(question) & (F.abs(x["v"]) > 0) & (F.abs(x["v"]) < 1), 6).otherwise(0)
        return points + F.when(low.contains("full number") & x["u"].isNotNull(), 2).otherwise(0)

    given = lambda x: F.when(target.isNotNull(), convert(question, x["t"])).otherwise(clean_scalar(x["t"]))
    return _first_best(F.transform(tokens, lambda x: F.struct(score(x).alias("s"), x["i"], x["j"], given(x).alias("a"))))


def suspicious(question: Column, answer: Column) -> Column:
    """An answer that cannot be what the question asks for."""
    t = T.strip(answer)
    value, unit = scalar_value(t), scalar_unit(t)
    small = unit.isNull() & (F.abs(value) > 0) & (F.abs(value) < 1)
    length = F.coalesce(expected_length(question), F.lit(0))
    return (
        F.when((t == "") | ((length > 0) & ~list_answer(t)) | table_label(t), True)
        .when(year_like(t) & ~expects_date(question), True)
        .when(value.isNull(), False)
        .when(asks_percent(question), year_like(t) | (F.abs(value) > 1000))
        .otherwise((question_unit(question).isNotNull() | F.lower(question).contains("full number")) & small)
    )


def salvaged(question: Column, answer: Column, response: Column) -> Column:
    """List, percentage, number, unit, dollar sign: the first that applies to a poor answer, from the answer and the whole response."""
    low, length = F.lower(question), F.coalesce(expected_length(question), F.lit(0))
    text = F.concat_ws("\n", F.nullif(answer, F.lit("")), F.nullif(response, F.lit("")))
    poor = placeholder(answer) | suspicious(question, answer)
    percent = F.when(asks_percent(question) & poor, F.nullif(percent_answer(question, text), F.lit("")))
    number = F.when(poor | list_answer(answer), F.nullif(scalar_candidate(question, text), F.lit("")))
    unit = F.when(question_unit(question).isNotNull(), convert(question, answer))
    dollars = F.when(answer.contains("$") & ~low.contains("dollar") & ~low.contains("money"), T.strip(F.replace(answer, F.lit("$"))))
    listed = F.when(list_answer(answer), normal_list(answer)).otherwise(F.coalesce(bracketed_list(text, expected_length(question)), answer))
    return F.when(length > 0, listed).otherwise(F.coalesce(percent, number, unit, dollars, answer))


def without_thoughts(response: Column) -> Column:
    """A response without what stands between think tags; an open tag ends at the next closing tag of the answer or the reasoning, or at the end."""
    closed = F.regexp_replace(response, r"(?s)<think>.*?</think>\s*", "")
    open_ = F.regexp_replace(closed, r"(?is)<think>.*?(?=</(?:final_answer|reasoning)>)", "")
    return F.when(closed.contains("<think>"), F.when(open_ != closed, open_).otherwise(T.strip(F.substring_index(closed, "<think>", 1)))).otherwise(closed)


def error_like(answer: Column) -> Column:
    """No answer, or the text of an error."""
    low = F.lower(T.strip(answer))
    return low.isin("", "no answer found", "unable to determine", "unable to determine from available data") | low.contains("error:")


def for_compare(answer: Column) -> Column:
    """SC8: an answer without marks, commas and repeated blanks, in small letters."""
    bare = F.lower(F.btrim(F.btrim(T.strip(answer), F.lit("`")), F.lit("\"' ")))
    return F.regexp_replace(F.replace(bare, F.lit(",")), r"[ \t\n\r\f\x0B]+", " ")


def supported(answer: Column, context: Column) -> Column:
    """SC7: whether a short answer stands in the context."""
    a = for_compare(answer)
    return F.coalesce((answer != "") & (context != "") & (a != "") & (F.length(a) <= 120) & F.contains(for_compare(context), a), F.lit(False))


def winner(question_flags: Column, context: Column, primary: Column, cross: Column) -> Column:
    """Which of two answers counts: by errors, agreement, support in the context, or the question's shape."""
    first, second = supported(primary, context), supported(cross, context)
    return (
        F.when(error_like(primary) & ~error_like(cross), "cross_check")
        .when(error_like(cross), "primary")
        .when(for_compare(primary) == for_compare(cross), "agree")
        .when(first & ~second, "primary")
        .when(second & ~first, "cross_check")
        .when(question_flags, "primary")
        .otherwise("cross_check")
    )


def needs_audit(question: Column, answer: Column) -> Column:
    """Whether a number was computed and is worth a second look."""
    return answer.rlike("[0-9]") & F.lower(question).rlike(L.AUDITED)
