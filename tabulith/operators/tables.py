"""Lines, table blocks, sections and rows of semi-structured documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import text as T
from tabulith.sources.scratch import spread, stash


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def table_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of two or more adjacent lines with two or more bars each: gaps and islands over line numbers."""
    bars = F.regexp_count("line", F.lit(r"\|"))
    rows = explode_lines(docs.where(F.col(text).contains("|")), key, text).where(bars >= 2)
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    blocks = rows.withColumn("_i", island).groupBy(key, "_i").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("pipe_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l")
    )
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1
    return blocks.where("pipe_lines >= 2").select(key, number.alias("block_no"), "start_line", "end_line", "pipe_lines", body.alias("body"))


def block_titles(blocks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 16) -> DataFrame:
    """Unit line and titles of each block from the ``reach`` lines above it: an equi join on their numbers, so that no other line is looked at.

    ``title`` is one line: the last exact title, or else the last section header.  ``full_title`` also has the section header directly
    above the exact title, or else the last two headers, joined by a bar; ``table_code`` and ``is_contents`` are taken from it.
    """
    line = T.strip(F.col("line"))
    wanted = blocks.where("start_line > 0").select(key, "block_no", "start_line", F.explode(F.sequence(F.greatest(F.col("start_line") - reach, F.lit(0)), F.col("start_line") - 1)).alias("line_no"))
    above = explode_lines(docs, key, text).join(wanted, [key, "line_no"]).select(key, "block_no", "start_line", "line_no", line.alias("line")).where("line <> ''")
    low = F.lower("line")
    section = low.rlike(r"^section\s+[ivxlcdm0-9]+")
    exact = F.col("line").rlike(r"^(TABLE|Table)\s+[A-Z0-9]{1,6}([-.][A-Z0-9]+)*(\s*[—-]|\.\s*-|\.)")
    wordy = (F.size(F.split("line", r"\s+")) > 18) & ~low.rlike(r"^(table|chart|statement)\b")
    prose = ~exact & ~section & ((F.length("line") > 140) | low.rlike(r"\b(shows?|lists?|reports?|contains?|presents?|summarizes?|describes?)\b") | (F.regexp_count("line", F.lit(r"\.")) >= 2) | wordy)
    header = section | ((T.upper_ratio(F.col("line")) >= 0.7) & (F.length("line") <= 100)) | ((T.heading_signal(F.col("line")) >= 2) & (F.length("line") <= 120))
    above = above.withColumns(
        {
            "is_unit": low.rlike(r"\b(in|amounts in)\s+(millions?|billions?|trillions?|thousands?)\b"),
            "is_exact": F.col("line").rlike(r"^(TABLE|Table)\s+[A-Z]{1,6}-[A-Z0-9-]+"),
            "is_header": header,
            "_exact": exact,
            "_header": header & ~prose,
        }
    )
    before = Window.partitionBy(key, "block_no").orderBy("line_no")
    above = above.withColumn("_before", F.lag(F.when(F.col("_header"), F.struct("line_no", "line"))).over(before)).where("is_unit or is_exact or is_header or _exact")
    last = lambda flag, value="line": F.max_by(value, F.when(F.col(flag), F.col("line_no")))
    headers = F.transform(F.array_sort(F.collect_list(F.when(F.col("_header"), F.struct("line_no", "line")))), lambda h: h["line"])
    found = above.groupBy(key, "block_no").agg(
        last("is_unit").alias("unit_hint"), F.coalesce(last("is_exact"), last("is_header")).alias("_t"), last("_exact").alias("_e"), last("_exact", "_before").alias("_b"), headers.alias("_h")
    )
    found = blocks.select(key, "block_no", "start_line").join(found, [key, "block_no"], "left").withColumn("_h", F.coalesce("_h", F.array().cast("array<string>")))
    known = lambda title: F.when(F.coalesce(T.normalize(title) == T.normalize(F.col("unit_hint")), F.lit(False)) | (title == ""), None).otherwise(title)
    parts = F.when(F.col("_e").isNotNull(), F.array_compact(F.array(F.col("_b.line"), F.col("_e")))).otherwise(F.slice("_h", F.greatest(F.size("_h") - 1, F.lit(1)), 2))
    full = F.coalesce(known(F.array_join(F.array_distinct(parts), " | ")), F.concat(F.lit("Table block near line "), (F.col("start_line") + 1).cast("string")))
    title = F.coalesce(known(F.col("_t")), F.concat(F.lit("Table block near line "), F.col("start_line").cast("string")))
    out = found.select(key, "block_no", F.coalesce("unit_hint", F.lit("")).alias("unit_hint"), title.alias("title"), full.alias("full_title"))
    code = F.lower(F.regexp_extract("full_title", r"\b([A-Z]{1,6}-[A-Z]?-?[0-9]+[A-Z]?)\b", 1))
    return out.withColumns({"table_code": code, "is_contents": T.normalize(F.col("full_title")).contains("contents")})


#: What the section rule asks of a line, as bits: it is not blank, has three bars or more, has one at all, looks like a heading, like a row of a table, or has no table signal.
FILLED, OPENS, BARRED, HEADING, ROW, QUIET = 1, 2, 4, 8, 16, 32
#: A text of at most so many characters is cut in one piece; a longer one in chunks of so many lines, which tasks share.
WHOLE, CHUNK = 1 << 20, 4096


def line_codes(lines: Column) -> Column:
    """The bits of each line, its signals computed once."""
    gaps = lambda x: x.rlike(r"[ \t\n\r\f]{2,}|\t")

    def look(bare: Column, x: Column) -> Column:
        return F.struct(x.alias("x"), bare.alias("bare"), (F.length(x) - F.length(F.replace(x, F.lit("|")))).alias("bars"), T.table_signal(bare).alias("signal"))

    def code(r: Column) -> Column:
        bit = lambda test, value: F.when(test, value).otherwise(0)
        # a stripped line lacks no signal of the line's but that of blanks at its start
        quiet = F.when(r["signal"] != 0, 0).otherwise(F.when(gaps(r["x"]), 0).otherwise(QUIET))
        return bit(r["bare"] != "", FILLED) + F.when(r["bars"] >= 3, OPENS + BARRED).when(r["bars"] >= 1, BARRED).otherwise(0) + bit(T.heading_signal(r["bare"]) >= 2, HEADING) + bit(r["signal"] >= 3, ROW) + quiet

    # two steps, as nothing is kept between the uses of a value inside one
    return F.transform(F.zip_with(F.transform(lines, T.strip), lines, look), code)


def _begins(codes: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are not blank, and which of these begin a section whatever its length; ``before`` is the code of the line before the first, -1 if none."""
    last = np.concatenate([[before], codes[:-1]])
    filled = codes & FILLED > 0
    opens = (codes & OPENS > 0) & (last & BARRED == 0)
    row = (codes & ROW > 0) & (last & QUIET > 0)
    return filled, filled & (last >= 0) & (opens | (codes & HEADING > 0) | row)


def _starts(codes: np.ndarray, before: int, state: int, most: int) -> tuple[list[int], int]:
    """The lines that begin sections, and the count of lines after the last, from the count before the first: 0 before any section, at most ``most``."""
    filled, hard = _begins(codes, before)
    n = len(codes)
    at = np.flatnonzero(filled)
    cuts = np.flatnonzero(hard)
    # the first filled line from each line on, and the first cut after it
    following = np.append(at, n)[np.searchsorted(at, np.arange(n + 1))]
    next_cut = np.append(cuts, n)
    starts: list[int] = []
    i = int(following[0]) if state == 0 else min(int(following[min(max(most - state, 0), n)]), int(next_cut[0]))
    while i < n:
        starts.append(i)
        i = min(int(following[min(i + most, n)]), int(next_cut[np.searchsorted(cuts, i, "right")]))
    if starts:
        return starts, min(n - starts[-1], most)
    return starts, min(state + n, most) if state else 0


@F.pandas_udf(ArrayType(IntegerType()))
def _fold(codes: pd.Series, before: pd.Series, state: pd.Series, most: pd.Series) -> pd.Series:
    """The starts of each piece, whose count of lines before it is known."""
    return pd.Series([_starts(np.asarray(c, np.int64), b, s, m)[0] for c, b, s, m in zip(codes, before, state, most, strict=True)])


@F.pandas_udf(StructType([StructField(c, ArrayType(IntegerType())) for c in ("after", "begun", "last")]))
def _effect(codes: pd.Series, before: pd.Series, most: pd.Series) -> pd.DataFrame:
    """A chunk as a function of the count of lines before it: for each of the counts 0 to ``most``, the count after, the sections begun and the last start.

    Such functions compose, and composition is associative, so that chunks can be summed up apart.
    """
    rows = []
    for c, b, m in zip(codes, before, most, strict=True):
        made = [_starts(np.asarray(c, np.int64), b, s, m) for s in range(m + 1)]
        rows.append(([n for _, n in made], [len(x) for x, _ in made], [x[-1] if x else -1 for x, _ in made]))
    return pd.DataFrame(rows, columns=["after", "begun", "last"])


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("chunk", "state", "begun", "first_line")])))
def _prefixes(chunks: pd.Series) -> pd.Series:
    """The counts, the sections begun and the start of the open one before each chunk of a document, by composing the chunks' functions in order."""

    def one(effects: np.ndarray) -> list[dict]:
        out, state, begun, line = [], 0, 0, -1
        for e in effects:
            out.append({"chunk": e["chunk"], "state": state, "begun": begun, "first_line": line})
            last = int(e["last"][state])
            begun += int(e["begun"][state])
            line = e["at"] + last if last >= 0 else line
            state = int(e["after"][state])
        return out

    return pd.Series([one(x) for x in chunks])


def _pieces(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Of rows with ``_lines``, ``_codes`` and ``_starts`` (lines in a piece that begin sections): each section's part of the piece, ``_no`` counting from -1 for lines before the first start."""
    ends = F.concat("_starts", F.array(F.size("_lines")))
    los = F.concat(F.array(F.lit(0)), F.col("_starts"))
    out = rows.select(*keep, "_lines", "_codes", F.posexplode(F.arrays_zip(los.alias("lo"), ends.alias("hi"))).alias("_no", "_p")).where("_p.lo < _p.hi")
    part = lambda c: F.slice(c, F.col("_p.lo") + 1, F.col("_p.hi") - F.col("_p.lo"))
    count = F.size(F.filter(part("_codes"), lambda c: c.bitwiseAND(F.lit(FILLED)) != 0))
    return out.select(*keep, (F.col("_no") - 1).alias("_no"), F.col("_p.lo").alias("_lo"), count.alias("n_lines"), part("_lines").alias("_part"))


def section_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 120, whole: int = WHOLE, chunk: int = CHUNK) -> DataFrame:
    """Heading- and table-aware chunks of consecutive lines (key, section_no, first_line, n_lines, section).

    A line that is not blank begins a section if it opens a bar table, looks like a heading, follows prose as a table line, or if the
    section has ``most`` lines.  Blank lines inside count; ``n_lines`` counts the others.  A null text has no sections.

    A text of at most ``whole`` characters is cut where it is read, without a shuffle.  A longer one is dealt out in chunks of lines: each chunk
    is summed up as a function of the count of lines before it, a document's functions are composed in order, and then each chunk is cut
    by itself, so that no task holds a long document's lines.  Documents with the same key must not both be longer than ``whole``.
    """
    trimmed = T.rstrip
    given = docs.select(key, text)
    short = spread(given.where(F.length(text) <= whole), 4).select(key, F.transform(T.lines(F.col(text)), trimmed).alias("_lines"))
    short = short.withColumn("_codes", line_codes(F.col("_lines")))
    short = short.withColumn("_starts", _fold("_codes", F.lit(-1), F.lit(0), F.lit(most)))
    joined = lambda part: T.strip(F.array_join(part, "\n"))
    small = _pieces(short, [key]).where("_no >= 0").select(key, F.col("_no").cast("int").alias("section_no"), F.col("_lo").alias("first_line"), "n_lines", joined("_part").alias("section"))

    long = given.where(F.length(text) > whole).withColumn("_all", T.lines(F.col(text)))
    cut = long.select(key, "_all", F.explode(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / chunk).cast("int"))).alias("chunk"))
    # the last line of the chunk before comes along, as a line's rule looks at the one before it
    at = F.greatest(F.col("chunk") * chunk - 1, F.lit(0))
    cut = cut.select(key, "chunk", F.slice("_all", at + 1, F.lit(chunk) + F.least(F.col("chunk"), F.lit(1))).alias("_with")).repartition(key, "chunk")
    coded = cut.withColumn("_with", F.transform("_with", trimmed)).withColumn("_all_codes", line_codes(F.col("_with")))
    own = lambda c: F.when(F.col("chunk") == 0, F.col(c)).otherwise(F.slice(c, F.lit(2), F.lit(chunk)))
    before = F.when(F.col("chunk") == 0, -1).otherwise(F.get("_all_codes", F.lit(0)))
    # kept, as both the functions and the cutting read the codes
    chunks = stash(coded.select(key, "chunk", own("_with").alias("_lines"), own("_all_codes").alias("_codes"), before.alias("_before")), "chunks")
    effects = chunks.select(key, "chunk", _effect("_codes", "_before", F.lit(most)).alias("e"))
    listed = effects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", (F.col("chunk") * chunk).alias("at"), "e.after", "e.begun", "e.last"))).alias("_e"))
    states = listed.select(key, F.explode(_prefixes("_e")).alias("_s")).select(key, F.col("_s.chunk").alias("chunk"), F.col("_s.state").alias("_state"), F.col("_s.begun").alias("_begun"), F.col("_s.first_line").alias("_open"))
    folded = chunks.join(states, [key, "chunk"]).withColumn("_starts", _fold("_codes", "_before", "_state", F.lit(most)))
    parts = _pieces(folded, [key, "chunk", "_begun", "_open"]).where("_no >= 0 or _begun > 0")
    parts = parts.select(key, "chunk", (F.col("_begun") + F.col("_no")).cast("int").alias("section_no"), F.when(F.col("_no") < 0, F.col("_open")).otherwise(F.col("chunk") * chunk + F.col("_lo")).alias("first_line"), "n_lines", F.array_join("_part", "\n").alias("_part"))
    sewn = parts.groupBy(key, "section_no", "first_line").agg(F.sum("n_lines").cast("int").alias("n_lines"), F.array_sort(F.collect_list(F.struct("chunk", "_part"))).alias("_p"))
    big = sewn.select(key, "section_no", "first_line", "n_lines", joined(F.transform("_p", lambda p: p["_part"])).alias("section"))
    return small.union(big)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 120, whole: int = WHOLE, chunk: int = CHUNK) -> DataFrame:
    """``section_texts`` without the texts."""
    return section_texts(docs, key, text, most, whole, chunk).drop("section")


def scored_lines(body: Column, years: Column, months: Column, terms: Column) -> Column:
    """The filled lines of a table: (s, i, x), the points less than 0 that its question gives, null for heads, the place and the line."""
    lines = F.transform(F.filter(T.lines(body), lambda x: T.strip(x) != ""), lambda x: F.struct(x.alias("x"), T.strip(x).alias("bare")))
    # each line is stripped and lowered once, not for each word that is looked for
    lines = F.transform(lines, lambda r: F.struct(r["x"].alias("x"), r["bare"].alias("bare"), F.lower(r["bare"]).alias("low")))
    held = lambda words, line: F.size(F.filter(words, lambda w: line.contains(w)))

    def row(r: Column, i: Column) -> Column:
        points = held(years, r["bare"]) * 10 + held(months, r["low"]) * 5 + held(terms, r["low"]) * 8 + F.when(r["low"].rlike(r"\btotal\b"), 3).otherwise(0)
        head = (i < 2) | F.regexp_replace(r["bare"], "-", "").rlike(r"^[\s|:]+$")
        return F.struct(F.when(head, None).otherwise(-points).alias("s"), i.alias("i"), r["x"].alias("x"))

    return F.transform(lines, row)


def kept_lines(rows: Column, most: int = 40) -> Column:
    """The heads and the ``most`` best of ``scored_lines``, in their order, as one text."""
    data = F.array_sort(F.filter(rows, lambda r: r["s"].isNotNull()))
    # the best come first, so that those that score are a prefix
    best = F.slice(data, 1, most)
    good = F.filter(best, lambda r: r["s"] < 0)
    kept = F.array_sort(F.transform(F.concat(F.filter(rows, lambda r: r["s"].isNull()), F.when(F.size(good) > 0, good).otherwise(best)), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return F.array_join(F.transform(kept, lambda r: r["x"]), "\n")


def narrowed(body: Column, years: Column, months: Column, terms: Column, whole: Column, most: int = 40) -> Column:
    """The lines of a table that its question needs, as one text: ``narrow_for_question`` on a row's own lines."""
    rows = scored_lines(body, years.cast("array<string>"), months, terms)
    return F.when(whole | (F.size(rows) <= most + 2), body).otherwise(kept_lines(rows, most))


def with_narrowed(rows: DataFrame, body: str, years: str, months: str, terms: str, whole: str, most: int = 40) -> DataFrame:
    """Replace the column ``body`` by ``narrowed``; lines are scored once, in a column of their own, and those of whole tables not at all."""
    held = rows.withColumn("_size", F.size(F.filter(T.lines(F.col(body)), lambda x: T.strip(x) != "")))
    held = held.withColumn("_lines", F.when(F.coalesce(F.col(whole), F.lit(False)) | (F.col("_size") <= most + 2), None).otherwise(scored_lines(F.col(body), F.col(years), F.col(months), F.col(terms))))
    return held.withColumn(body, F.when(F.col("_lines").isNull(), F.col(body)).otherwise(kept_lines(F.col("_lines"), most))).drop("_size", "_lines")


def narrow_rows(rows: DataFrame, key: str, score: str, most: int = 40) -> DataFrame:
    """Header rows (the first two) and the ``most`` best rows with a positive score, in their order; the first rows if none scores."""
    order = Window.partitionBy(key).orderBy(F.desc(score), "line_no")
    place = Window.partitionBy(key).orderBy("line_no")
    best = F.max(score).over(Window.partitionBy(key))
    ranked = rows.withColumns({"_r": F.row_number().over(order), "_at": F.row_number().over(place), "_best": best})
    keep = (F.col("_at") <= 2) | ((F.col("_best") > 0) & (F.col(score) > 0) & (F.col("_r") <= most)) | ((F.col("_best") <= 0) & (F.col("_at") <= most))
    return ranked.where(keep).drop("_r", "_at", "_best")


def with_narrowing(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add what ``narrow_for_question`` asks of a question with its profile, so that it is found once a question and not for each of its tables."""
    low = F.lower(question)
    years = F.array_distinct(T.find_all(F.col(question), r"\b(19[2-9][0-9]|20[0-2][0-9])\b"))
    months = F.filter(T.strings(L.MONTHS), lambda m: low.contains(m))
    terms = F.concat(T.focus_phrases(F.col(question)), T.named_entities(F.col(question)))
    whole = F.coalesce(F.col("expects_series_math") | F.col("expects_regression") | F.col("expects_list") | F.col("wants_monthly_series"), F.lit(False))
    return questions.withColumns({"_y": years, "_m": months, "_t": terms, "_whole": whole})


def narrow_for_question(tables: DataFrame, keys: list[str], text: str = "text", question: str = "question", most: int = 40) -> DataFrame:
    """Lines (keys, line_no, line, score) of each table that its question needs, in their order.

    ``tables`` has a question profile, or the columns of ``with_narrowing``.  A table stays whole if it has at most ``most`` + 2 filled lines, or for a list, regression,
    series or monthly question.  Else its first two filled lines, its separator rows and the ``most`` best other rows with a positive
    score stay, or the first ``most`` others if none scores.  A row scores 10 for each year of the question, 5 for each month, 8 for each focus
    phrase and entity, 3 for the word total.
    """
    given = tables if "_whole" in tables.columns else with_narrowing(tables, question)
    rows = given.select(*keys, "_y", "_m", "_t", "_whole", F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))
    # columns of their own, as each word that is looked for would strip and lower the line again
    rows = rows.withColumn("_b", T.strip(F.col("line"))).withColumn("_low", F.lower("_b"))
    held = lambda words, line: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(F.col(line), w)))).otherwise(0)
    score = 10 * held(F.col("_y"), "_b") + 5 * held(F.col("_m"), "_low") + 8 * held(F.col("_t"), "_low") + F.when(F.col("_low").rlike(r"\btotal\b"), 3).otherwise(0)
    rows = rows.withColumns({"_filled": (F.col("_b") != "").cast("int"), "_bar": F.regexp_replace("_b", "-", "").rlike(r"^[\s|:]+$"), "score": score})
    place = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumns({"_n": F.sum("_filled").over(Window.partitionBy(*keys)), "_at": F.sum("_filled").over(place)})
    rows = rows.withColumn("_data", (F.col("_filled") == 1) & ~F.col("_bar") & (F.col("_at") > 2))
    # data rows come first in each rank, so that the others take no place among them
    ranked = rows.withColumns(
        {
            "_r": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_data"), F.desc("score"), "line_no")),
            "_best": F.max(F.when(F.col("_data"), F.col("score"))).over(Window.partitionBy(*keys)),
        }
    )
    good = F.col("_data") & (F.col("_r") <= most) & ((F.col("score") > 0) | (F.col("_best") <= 0))
    kept = F.col("_whole") | (F.col("_n") <= most + 2) | ((F.col("_filled") == 1) & ~F.col("_data")) | good
    return ranked.where(kept).select(*keys, "line_no", "line", "score")
