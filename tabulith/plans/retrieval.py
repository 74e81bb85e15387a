"""Queries that score, rank and read bulletins, with DuckDB SQL that computes each pair from the texts themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import profile as P
from tabulith.functions import rules as R
from tabulith.functions import scoring as S
from tabulith.functions import text as T
from tabulith.operators import candidates as K
from tabulith.operators import cells as Y
from tabulith.operators import context as X
from tabulith.operators import ranking as A
from tabulith.operators import retrieve as V
from tabulith.operators import scoring as O
from tabulith.operators import snippets as N
from tabulith.operators import tables as B
from tabulith.plans import bulletins as C
from tabulith.plans.catalogue import FAMILY_SQL, PROFILE_SQL, SCORES_SQL, _DIMS, _keywords_sql, query, questions, scores, sql_list, sql_unique, table
from tabulith.sources import bulletin_files as D
from tabulith.sources import features as G
from tabulith.sources.scratch import shared_dir, spread, stash

# --- SQL of lines, blocks, titles and sections ------------------------------------------------------------------------------

BREAKS = r"'\r\n|\n|\r'"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """A pattern for an engine without look-around, whose word bounds are those of ASCII: months beside other letters are no words."""
    return quoted(pattern)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


_EDGE = r"(^|[^\p{{L}}\p{{N}}_])({0})($|[^\p{{L}}\p{{N}}_])"
MONTH_WORD = _EDGE.format("(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*")


def signal(x: str) -> str:
    return rf"""(CASE WHEN regexp_matches({x}, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all({x}, '{L.NUMBER}', 0)) >= 2 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower({x}), '{MONTH_WORD}') THEN 1 ELSE 0 END
        + CASE WHEN regexp_matches({x}, '[%$¥£]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({x}, '[ \t\n\r\f]{{2,}}|\t') THEN 1 ELSE 0 END)"""


def heading(x: str) -> str:
    low = strip(f"lower({x})")
    return f"(CASE WHEN regexp_matches({low}, '{L.HEADING_START}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({low}, '{L.HEADING_WORD}') THEN 1 ELSE 0 END + CASE WHEN ends_with({low}, ':') THEN 1 ELSE 0 END)"


def norm(x: str) -> str:
    return f"translate(lower({x}), '''`’', '')"


def titles_sql(docs: str) -> str:
    """CTEs blocks (doc_id, block_no, start_line, end_line, pipe_lines, body) and titled (doc_id, block_no, unit_hint, title, code)."""
    return rf"""t_l AS (SELECT doc_id, unnest(list_zip(range(len(a)), a)) AS z FROM (SELECT doc_id, regexp_split_to_array(text, {BREAKS}) AS a FROM {docs})),
    t_r AS (SELECT doc_id, z[1] AS line_no, z[2] AS line FROM t_l),
    t_g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM t_r WHERE len(regexp_extract_all(line, '\|', 0)) >= 2),
    t_b AS (SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS pipe_lines, string_agg(line, chr(10) ORDER BY line_no) AS body FROM t_g GROUP BY doc_id, i HAVING count(*) >= 2),
    blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS block_no, start_line, end_line, pipe_lines, body FROM t_b),
    t_a AS (SELECT doc_id, line_no, {strip("line")} AS line FROM t_r),
    t_k AS (SELECT doc_id, line_no, line, lower(line) AS low, regexp_matches(line, '^(TABLE|Table)\s+[A-Z0-9]{{1,6}}([-.][A-Z0-9]+)*(\s*[—-]|\.\s*-|\.)') AS exact, regexp_matches(lower(line), '^section\s+[ivxlcdm0-9]+') AS sec,
        regexp_matches(lower(line), '\b(in|amounts in)\s+(millions?|billions?|trillions?|thousands?)\b') AS unit, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(line, '[^\p{{L}}]', '', 'g')), 0) AS ratio FROM t_a WHERE line <> ''),
    t_h AS (SELECT *, (sec OR (coalesce(ratio, 0) >= 0.7 AND length(line) <= 100) OR ({heading("line")} >= 2 AND length(line) <= 120)) AND NOT (NOT exact AND NOT sec AND (length(line) > 140 OR regexp_matches(low, '\b(shows?|lists?|reports?|contains?|presents?|summarizes?|describes?)\b')
        OR len(regexp_extract_all(line, '\.', 0)) >= 2 OR (len(regexp_split_to_array(line, '\s+')) > 18 AND NOT regexp_matches(low, '^(table|chart|statement)\b')))) AS header FROM t_k),
    t_n AS (SELECT b.doc_id, b.block_no, b.start_line, h.line_no, h.line, h.exact, h.unit, h.header, lag(CASE WHEN h.header THEN h.line ELSE '' END) OVER (PARTITION BY b.doc_id, b.block_no ORDER BY h.line_no) AS over
        FROM blocks b JOIN t_h h ON h.doc_id = b.doc_id AND h.line_no BETWEEN b.start_line - 16 AND b.start_line - 1),
    t_m AS (SELECT doc_id, block_no, arg_max(line, line_no) FILTER (unit) AS unit_hint, arg_max(line, line_no) FILTER (exact) AS e, arg_max(coalesce(over, ''), line_no) FILTER (exact) AS o, list(line ORDER BY line_no) FILTER (header) AS h FROM t_n GROUP BY doc_id, block_no),
    t_t AS (SELECT doc_id, block_no, coalesce(unit_hint, '') AS unit_hint, CASE WHEN e IS NOT NULL AND o NOT IN ('', e) THEN o || ' | ' || e WHEN e IS NOT NULL THEN e WHEN len(h) >= 2 AND h[-2] <> h[-1] THEN h[-2] || ' | ' || h[-1] WHEN len(h) >= 1 THEN h[-1] ELSE '' END AS t FROM t_m),
    titled AS (SELECT b.doc_id, b.block_no, coalesce(unit_hint, '') AS unit_hint, CASE WHEN coalesce(t, '') = '' OR {norm("t")} = {norm("unit_hint")} THEN 'Table block near line ' || (b.start_line + 1) ELSE t END AS title,
        lower(regexp_extract(CASE WHEN coalesce(t, '') = '' OR {norm("t")} = {norm("unit_hint")} THEN '' ELSE t END, '\b([A-Z]{{1,6}}-[A-Z]?-?[0-9]+[A-Z]?)\b', 1)) AS code, b.start_line, b.pipe_lines, b.body FROM blocks b LEFT JOIN t_t USING (doc_id, block_no))"""


def sections_sql(docs: str, text: str = "text") -> str:
    """CTE sections (doc_id, section_no, first_line, lines): a fold over each document's lines."""
    return rf"""s_l AS (SELECT doc_id, list_transform(regexp_split_to_array({text}, {BREAKS}), lambda x: regexp_replace(x, '[ \t\n\r\f\v]+$', '')) AS a FROM {docs}),
    s_f AS (SELECT doc_id, a, list_transform(a, lambda x, i: {{'s': []::INT[], 'n': 0, 'i': (i - 1)::INT, 'filled': {strip("x")} <> '', 'cut': i > 1 AND ((len(regexp_extract_all(x, '\|', 0)) >= 3 AND NOT contains(a[i - 1], '|'))
        OR {heading("x")} >= 2 OR ({signal(strip("x"))} >= 3 AND {signal("a[i - 1]")} = 0))}}) AS f FROM s_l),
    s_r AS (SELECT doc_id, a, list_reduce(f, lambda z, x: CASE WHEN x.filled AND (z.n = 0 OR x.cut OR z.n >= 120) THEN {{'s': list_append(z.s, x.i), 'n': 1, 'i': x.i, 'filled': true, 'cut': false}}
        WHEN z.n = 0 AND NOT x.filled THEN z ELSE {{'s': z.s, 'n': z.n + 1, 'i': x.i, 'filled': true, 'cut': false}} END, {{'s': []::INT[], 'n': 0, 'i': 0, 'filled': false, 'cut': false}}).s AS s FROM s_f),
    s_p AS (SELECT doc_id, a, s, unnest(range(1, len(s) + 1)) AS k FROM s_r),
    sections AS (SELECT doc_id, k - 1 AS section_no, s[k] AS first_line, a[s[k] + 1 : coalesce(s[k + 1], len(a))] AS lines FROM s_p)"""


# --- sections and titles of all documents -----------------------------------------------------------------------------------


@query(f"WITH {sections_sql('documents')} SELECT doc_id, section_no, first_line, len(list_filter(lines, lambda x: {strip('x')} <> '')) AS n_lines FROM sections")
def section_split(spark, sf_dir):
    return B.sections(table(spark, sf_dir, "documents"))


@query(f"WITH {C.SQL}, {titles_sql('bulletins')} SELECT doc_id, block_no, unit_hint, title AS full_title, code AS table_code, contains(lower(title), 'contents') AS is_contents, md5(body) AS digest FROM titled")
def table_titles(spark, sf_dir):
    """G1 and G2 on the bulletins: title, unit, code and body of each block."""
    docs = C.bulletins(spark, sf_dir)
    blocks = B.table_blocks(docs)
    titles = B.block_titles(blocks, docs).join(blocks.select("doc_id", "block_no", F.md5("body").alias("digest")), ["doc_id", "block_no"])
    return titles.select("doc_id", "block_no", "unit_hint", "full_title", "table_code", "is_contents", "digest")


@query(f"WITH {C.SQL}, {titles_sql('bulletins')}, h AS (SELECT doc_id, title, min(block_no) AS place FROM titled GROUP BY ALL) SELECT doc_id, string_agg(title, chr(10) ORDER BY place) AS heading_summary FROM h GROUP BY doc_id")
def heading_summary(spark, sf_dir):
    """SRC6: the distinct titles of a file's tables."""
    docs = C.bulletins(spark, sf_dir)
    return O.heading_summaries(O.scored_tables(docs)).select("doc_id", F.col("heading").alias("heading_summary"))


# --- SQL of questions' conditions --------------------------------------------------------------------------------------------

_FLAGS = ", ".join([f"list_contains(families, '{f}') AS is_{f}" for f in S.FAMILY_NAMES] + [f"contains(low, '{w}') AS says_{w}" for w in ("notes", "exclud", "million", "billion", "trillion", "thousand")])
_MATURING = r"\bmaturing(?:\s+at\s+the\s+end\s+of|\s+end\s+of)?\s+(" + "|".join(L.MONTHS) + r")\s+(19[3-9][0-9]|20[0-2][0-9])\b"
CODES = f"list_transform(regexp_extract_all(question, '[A-Z]{{1,6}}-[A-Z]?-?[0-9]+[A-Z]?', 0), lambda x: lower(x))"
ASKS_SQL = f"""{FAMILY_SQL}, k AS ({_keywords_sql()}), d AS (SELECT q_id, {sql_unique("x")} AS terms FROM (SELECT q_id, {_DIMS} AS x FROM p)), ys AS (SELECT q_id, list(y ORDER BY y) AS years FROM y GROUP BY q_id),
    c0 AS (SELECT f.*, {_FLAGS}, len(families) > 0 AS has_family, contains(low, 'fiscal') OR contains(low, 'fy') AS says_fiscal, list_transform(list_filter(string_split(k.keywords, '|'), lambda x: x <> ''), lambda x: {norm("x")}) AS keywords,
        coalesce(ys.years, []) AS years, list_distinct({CODES}) AS codes, d.terms, list_transform(months, lambda m: list_position({sql_list(L.MONTHS)}, m)) AS month_numbers,
        TRY_CAST(nullif(regexp_extract(low, '{_MATURING}', 2), '') AS INT) AS due_year, list_position({sql_list(L.MONTHS)}, regexp_extract(low, '{_MATURING}', 1)) AS due_month FROM f JOIN k USING (q_id) JOIN d USING (q_id) LEFT JOIN ys USING (q_id)),
    asks AS (SELECT *, len(years) AS n_years, list_min(years) AS first_year, list_max(years) AS last_year, coalesce(month_numbers[1], 0) AS first_month,
        CASE WHEN note_term_years > 0 AND due_month > 0 THEN due_year * 12 + due_month - 12 * note_term_years + 1 END AS issue_month FROM c0)"""


def asks(spark, sf_dir):
    return stash(S.with_conditions(spread(questions(spark, sf_dir))), "asks")


def corpus(spark, sf_dir):
    """(docs, files, tables) of the bulletins; features are computed once and written to the shared folder."""
    docs = stash(C.bulletins(spark, sf_dir), "docs")
    tables = stash(O.scored_tables(docs), "tables")
    return docs, stash(O.files(docs, tables), "files"), tables


# --- SQL of scores -----------------------------------------------------------------------------------------------------------


def total(values: str) -> str:
    return f"coalesce(list_sum({values}), 0)::BIGINT"


def words_sql(text: str, most: int, phrase: int, word: int) -> str:
    return total(f"list_transform(keywords, lambda k: least((length({text}) - length(replace({text}, k, ''))) // length(k), {most}) * CASE WHEN contains(k, ' ') THEN {phrase} ELSE {word} END)")


def when(flag: str, points: str) -> str:
    return f"CASE WHEN {flag} THEN {points} ELSE 0 END"


def rules_sql(rules: list[R.Rule], fields: dict[str, str]) -> str:
    out = []
    for r in rules:
        text = fields[r.field]
        found = f"regexp_matches({text}, {quoted(r.pattern)})" if r.least == 1 else f"len(regexp_extract_all({text}, {quoted(r.pattern)}, 0)) >= {r.least}"
        unless = f" AND NOT regexp_matches({text}, {quoted(r.unless)})" if r.unless else ""
        out.append(when(f"({r.when}) AND {found}{unless}", str(r.points)))
    return " + ".join(out)


def family_count(text: str, family: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{k}')::INT" for k in R.FAMILIES[family][1]) + ")"


def number_in(text: str, y: str) -> str:
    return f"list_contains(regexp_extract_all({text}, '[0-9]+', 0), {y}::VARCHAR)"


_FILLED = f"list_filter(lines, lambda x: {strip('x')} <> '')"
_COUNT = lambda test: f"len(list_filter(ls, lambda x: {test}))"
_YEAR_LINES = lambda y: f"list_filter(ls, lambda x: {number_in('x', y)})"
SECTION_SQL = " + ".join(
    [
        words_sql("title", 2, 36, 10),
        words_sql("body", 4, 8, 2),
        f"least({_COUNT(signal('x') + ' >= 2')}, 12)",
        total(f"list_transform(ls[1:4], lambda x: {heading('x')})"),
        when("expects_regression", f"least({_COUNT(f'len(regexp_extract_all(x, {quoted(R.YEAR)}, 0)) >= 2')}, 8) * 4"),
        when("expects_series_math", f"least({_COUNT(f'len(regexp_extract_all(x, {quoted(R.YEAR)}, 0)) >= 2')}, 6) * 3 + least({_COUNT(f'regexp_matches(lower(x), {quoted(R.MONTH)})')}, 8) * 2"),
        when("expects_list", f"least({_COUNT(f'len(regexp_extract_all(x, {quoted(R.NUMBERS)}, 0)) >= 4')}, 8) * 3"),
        when("expects_date", f"least({_COUNT(f'''regexp_matches(lower(x), {quoted(MONTH_WORD)}) OR regexp_matches(lower(x), '{_EDGE.format('date|issue')}')''')}, 8) * 3"),
        when("expects_percent", f"least({_COUNT('''contains(x, '%') OR contains(lower(x), 'percent')''')}, 8) * 2"),
        when("expects_sum OR expects_difference", f"least({_COUNT(f'regexp_matches(lower(x), {quoted(L.WINDOW_TOTALS)})')}, 10) * 2"),
        f"least({_COUNT('len(list_filter(months, lambda m: contains(lower(x), m))) > 0')}, 6) * 2",
        total(f"list_transform(years, lambda y: least(len({_YEAR_LINES('y')}), 4) * 6 + CASE WHEN len(list_filter({_YEAR_LINES('y')}, lambda z: {signal('z')} >= 2)) > 0 THEN 8 ELSE 0 END)"),
        when(f"{_COUNT(signal('x') + ' >= 2')} >= 3 AND len(list_filter(ls[1:6], lambda x: {heading('x')} > 0)) > 0", "10"),
    ]
)
_SECTION_ROWS = f"(SELECT doc_id, section_no, {_FILLED} AS ls, {norm('array_to_string(' + _FILLED + '[1:6], chr(32))')} AS title, {norm(strip('array_to_string(lines, chr(10))'))} AS body FROM sections)"

_FIELDS = {"title": "title", "text": "txt", "unit": "unit", "both": "(title || chr(10) || txt)", "all": "whole", "marks": "(replace(title, '%', '') || CASE WHEN contains(txt, '%') THEN '%' ELSE '' END)"}
_PREFIXED = {f: "(" + " OR ".join([f"starts_with(code, '{p}')" for p in R.FAMILIES[f][0]] or ["false"]) + ")" for f in S.FAMILY_NAMES}
_MATCHED = " + ".join([when(f"is_{f} AND code <> '' AND {_PREFIXED[f]}", "40") for f in S.FAMILY_NAMES] + [when(f"is_{f}", f"least({family_count('whole', f)}, 4) * 12") for f in S.FAMILY_NAMES])
TABLE_SQL = f"""CASE WHEN contains(title, 'contents') THEN -50 ELSE {words_sql("title", 2, 42, 12)} + {words_sql("txt", 6, 10, 3)} + {when("code <> ''", "22")} + {when("code <> '' AND list_contains(codes, code)", "55")} + least(pipe_lines, 14)
    + {total(f"list_transform(years, lambda y: CASE WHEN {number_in('title', 'y')} THEN 15 ELSE 0 END + least(len(list_filter(regexp_extract_all(txt, '[0-9]+', 0), lambda n: n = y::VARCHAR)), 6) * 4)")}
    + len(list_filter(months, lambda m: contains(title, m) OR contains(txt, m))) * 8 + least(len(list_filter(terms, lambda t: contains(whole, t))), 5) * 9 + {rules_sql(R.TABLE_RULES, _FIELDS)} + {_MATCHED}
    + {when("(starts_with(title, '[') OR starts_with(title, 'in ')) AND code = ''", "-12")} + {when("starts_with(title, 'table block near line')", "-25")}
    + {when(f"has_family AND ({_MATCHED}) = 0 AND code <> '' AND ({' OR '.join(_PREFIXED.values())})", "-10")} END"""
_TABLE_ROWS = f"(SELECT doc_id, block_no, code, pipe_lines, {norm('title')} AS title, {norm('body')} AS txt, {norm('unit_hint')} AS unit, {norm('title')} || chr(10) || {norm('body')} || chr(10) || {norm('unit_hint')} AS whole FROM titled)"

_M = "((fy - last_year + CASE WHEN says_fiscal THEN 1 ELSE 0 END) * 12 + fm - CASE WHEN says_fiscal THEN 10 ELSE 1 END)"
PUBLICATION_SQL = "coalesce(CASE " + " ".join(f"WHEN {_M} BETWEEN {a} AND {b} THEN greatest({least}, {top} - ({_M} - ({at})) // {step})" for a, b, top, at, step, least in R.PUBLICATION) + " ELSE 0 END, 0)"
_HEADS = f"{words_sql('heading', 3, 8, 3)} + least(len(list_filter(terms, lambda t: contains(heading, t))), 5) * 8 + {PUBLICATION_SQL}"
CHEAP_SQL = _HEADS + " + " + " + ".join(when(f"is_{f}", f"least({family_count('heading', f)}, 4) * 6") for f in S.FAMILY_NAMES)
_HELD = f"len(list_filter(years, lambda y: {number_in('content', 'y')}))"
FILE_SQL = f"""{total("list_transform(keywords, lambda k: CASE WHEN contains(file_name, k) THEN CASE WHEN contains(k, ' ') THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN contains(k, ' ') THEN least((length(content) - length(replace(content, k, ''))) // length(k), 3) * 6 WHEN length(k) >= 6 AND contains(content, k) THEN 2 ELSE 0 END)")}
    + {_HEADS} + CASE WHEN fy IS NOT NULL AND n_years > 0 THEN {" + ".join(R.DATE_RULES)} ELSE 0 END + {" + ".join(f"coalesce({r}, 0)" for r in R.OTHER_DATE_RULES)}
    + least({" + ".join(when(f"is_{f}", family_count("heading", f)) for f in S.FAMILY_NAMES)}, 4) * 10 + {rules_sql(R.FILE_RULES, {"heading": "heading", "content": "content"})}
    + CASE WHEN (expects_regression OR expects_list) AND n_years >= 2 AND {_HELD} > 0 THEN {_HELD} * 8 + CASE WHEN {_HELD} >= greatest(4, n_years // 2) THEN 26 ELSE 0 END ELSE 0 END
    + len(list_filter(codes, lambda c: contains(content, c))) * 30"""
PREVIEW = """CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 2666) || chr(10) || substr(text, greatest(0, length(text) // 2 - 1333) + 1, 2666) || chr(10) || right(text, 2666) END"""
FILES_SQL = f"""{C.SQL}, {titles_sql("bulletins")}, h AS (SELECT doc_id, string_agg(title, chr(10) ORDER BY place) AS heading FROM (SELECT doc_id, title, min(block_no) AS place FROM titled GROUP BY ALL) GROUP BY doc_id),
    files AS (SELECT b.doc_id, file_name, pub_date, year(pub_date) AS fy, month(pub_date) AS fm, {norm("coalesce(heading, '')")} AS heading, {norm("text")} AS content FROM bulletins b LEFT JOIN h USING (doc_id))"""
CHEAP_CTE = f"""{ASKS_SQL}, {FILES_SQL}, cheap AS (SELECT q_id, doc_id, file_name, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, file_name) AS rank FROM (SELECT q_id, doc_id, file_name, {CHEAP_SQL} AS score FROM asks, files) QUALIFY rank <= 30)"""


def full_cte(pairs: str, text: str = PREVIEW) -> str:
    """CTE full (q_id, doc_id, file_name, section, table_points, score) of the given pairs; sections are those of ``text``."""
    return f"""previews AS (SELECT doc_id, {text} AS text FROM bulletins WHERE doc_id IN (SELECT doc_id FROM {pairs})), {sections_sql("previews")},
    bs AS (SELECT q_id, doc_id, max(s) AS section FROM (SELECT q_id, doc_id, {SECTION_SQL} AS s FROM {pairs} JOIN asks USING (q_id) JOIN {_SECTION_ROWS} r USING (doc_id) WHERE len(ls) > 0) GROUP BY ALL),
    bt AS (SELECT q_id, doc_id, max(s) AS tab FROM (SELECT q_id, doc_id, {TABLE_SQL} AS s FROM {pairs} JOIN asks USING (q_id) JOIN {_TABLE_ROWS} r USING (doc_id)) GROUP BY ALL),
    o AS (SELECT q_id, doc_id, file_name, {FILE_SQL} AS own FROM (SELECT *, coalesce(list_contains(month_numbers, fm), false) AS month_asked FROM (SELECT q_id, doc_id FROM {pairs}) JOIN asks USING (q_id) JOIN files USING (doc_id))),
    full_ AS (SELECT q_id, doc_id, file_name, coalesce(section, 0) AS section, least(greatest(coalesce(tab, 0), 0), 260) AS "table", own + coalesce(section, 0) + least(greatest(coalesce(tab, 0), 0), 260) AS score FROM o LEFT JOIN bs USING (q_id, doc_id) LEFT JOIN bt USING (q_id, doc_id))"""


# --- scores ------------------------------------------------------------------------------------------------------------------


@query(f"{CHEAP_CTE}, {sections_sql('bulletins')} SELECT q_id, doc_id, section_no, CASE WHEN len(ls) > 0 THEN {SECTION_SQL} ELSE 0 END AS score FROM (SELECT q_id, doc_id FROM cheap) JOIN asks USING (q_id) JOIN {_SECTION_ROWS} r USING (doc_id)")
def section_scores(spark, sf_dir):
    """SC1 of every section of the 30 files that SC3 puts first for a question."""
    q = asks(spark, sf_dir)
    docs, files, _ = corpus(spark, sf_dir)
    best = stash(O.cheap_best(q, files), "pairs").select("q_id", "doc_id")
    parts = B.section_texts(docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi"))
    parts = stash(O.section_hits(parts, q).select("doc_id", "section_no", "section"), "sections")
    return spread(best).join(q, "q_id").join(parts, "doc_id").select("q_id", "doc_id", "section_no", S.section_score().alias("score"))


@query(f"{CHEAP_CTE} SELECT q_id, doc_id, block_no, {TABLE_SQL} AS score FROM (SELECT q_id, doc_id FROM cheap) JOIN asks USING (q_id) JOIN {_TABLE_ROWS} r USING (doc_id)")
def table_scores(spark, sf_dir):
    """SC2 of every table of the 30 files that SC3 puts first for a question."""
    q = asks(spark, sf_dir)
    _, files, tables = corpus(spark, sf_dir)
    best = stash(O.cheap_best(q, files).select("q_id", "doc_id"), "pairs")
    near = tables.join(best.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "block_no", "features")
    near = stash(O.table_hits(near, q), "table_hits")
    return spread(best).join(q, "q_id").join(near, "doc_id").select("q_id", "doc_id", "block_no", S.table_score().alias("score"))


@query(f"{CHEAP_CTE} SELECT q_id, doc_id, file_name, score FROM (SELECT q_id, doc_id, file_name, {CHEAP_SQL} AS score FROM asks, files) WHERE score > 0")
def cheap_file_scores(spark, sf_dir):
    """SC3 of every file that a question has anything in common with."""
    docs = C.bulletins(spark, sf_dir)
    return O.cheap_scores(asks(spark, sf_dir), O.files(docs, O.scored_tables(docs)))


@query(f"{CHEAP_CTE}, {full_cte('cheap', 'text')} SELECT q_id, doc_id, file_name, section, \"table\", score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, file_name) AS rank FROM full_ QUALIFY rank <= 18")
def two_stage_topk(spark, sf_dir):
    """K1: 30 files by the cheap score, 18 of them by the full one, which reads every section of them."""
    return O.two_stage(asks(spark, sf_dir), *corpus(spark, sf_dir))


# --- candidates, sources and context -----------------------------------------------------------------------------------------

_YEARS_OF = r"list_sort(list_distinct(list_transform(regexp_extract_all(low, '\b(19[3-9][0-9]|20[0-2][0-9])\b', 0), lambda y: y::INT)))"
_FISCAL = r"list_filter(list_transform(regexp_extract_all(low, 'fiscal\s+year\s+([0-9]{4})', 1), lambda y: y::INT), lambda y: y > 1)"


def _dates_sql(pattern: str) -> str:
    names, years = (f"regexp_extract_all(low, {quoted(pattern)}, {g})" for g in (1, 2))
    return f"list_transform(list_zip({names}, {years}), lambda z: CASE WHEN list_position({sql_list(L.MONTHS)}, z[1]) > 0 THEN make_date(z[2]::INT, list_position({sql_list(L.MONTHS)}, z[1])::INT, 1) END)"


def _listed_sql(dates: str, source: int, pinned: bool, rows: str = "asks") -> str:
    return f"SELECT q_id, {source} AS source_rank, unnest(range(len(d))) AS pos, unnest(d) AS pub_date, {pinned} AS pinned FROM (SELECT q_id, {dates} AS d FROM {rows})"


def _flat(lists: list[str]) -> str:
    return f"flatten([{', '.join(lists)}])"


def _later(d: str, months: str) -> str:
    return f"({d} + to_months(({months})::INT))::DATE"


_PLACES = _flat([f"CASE WHEN {w} THEN [{', '.join(f'[{a}, {m}]' for a, m in places)}] ELSE [] END" for w, places in R.ANCHORS])
_ISSUE = "make_date(((issue_month - 1) // 12)::INT, ((issue_month - 1) % 12 + 1)::INT, 1)"
_ANCHOR_DATES = _flat(
    [
        f"flatten(list_transform({_YEARS_OF}, lambda y: list_transform({_PLACES}, lambda p: make_date((y + p[1])::INT, p[2]::INT, 1))))",
        f"CASE WHEN is_auction AND issue_month IS NOT NULL THEN [{_ISSUE}, {_later(_ISSUE, '1')}] ELSE [] END",
        f"CASE WHEN is_auction AND expects_date AND first_month > 0 THEN list_transform({_YEARS_OF}, lambda y: {_later('make_date(y, first_month::INT, 1)', '1')}) ELSE [] END",
    ]
)
DATED_SQL = f"""years_of AS (SELECT *, {_YEARS_OF} AS ys, {R.following_base()} AS base FROM asks), reach AS (SELECT *, list_min(ys) AS earliest FROM years_of),
    far AS (SELECT *, CASE WHEN expects_regression OR expects_list OR expects_series_math THEN greatest({R.FOLLOWING}, 10) ELSE {R.FOLLOWING} END AS n FROM reach),
    listed AS ({_listed_sql(_flat([_dates_sql(p) for p in K.REFERENCES]), 1, True)}
        UNION ALL {_listed_sql(f"flatten(list_transform({_flat([_dates_sql(f'({m})' + chr(92) + 's+([0-9]{4})') for m in L.MONTHS])}, lambda d: list_transform(range(4), lambda i: {_later('d', 'i')})))", 2, True)}
        UNION ALL {_listed_sql(_ANCHOR_DATES, 3, True)}
        UNION ALL {_listed_sql(f"flatten(list_transform({_FISCAL}, lambda y: list_transform(range(-3, 9), lambda i: {_later('make_date(y, 1, 1)', 'i')})))", 4, False)}
        UNION ALL {_listed_sql(f"flatten(list_transform(list_filter(list_sort(list_distinct(list_concat(ys, {_FISCAL}))), lambda y: y < 2026), lambda y: list_transform(range((least(y + n + 1, 2026) - y) * 12), lambda i: {_later('make_date(y, 1, 1)', 'i')})))", 5, False, "far")}),
    dated AS (SELECT q_id, pub_date, arg_min(source_rank, source_rank * 1000000 + pos) AS source_rank, arg_min(pos, source_rank * 1000000 + pos) AS pos, bool_or(pinned) AS pinned FROM listed WHERE pub_date IN (SELECT pub_date FROM bulletins) GROUP BY ALL)"""
_LIMITS = """greatest(2, CASE WHEN expects_regression OR expects_list OR expects_series_math THEN 4 ELSE 0 END, CASE WHEN wants_monthly_series OR expects_sum OR expects_percent OR is_calendar_defense THEN 3 ELSE 0 END, CASE WHEN prefers_country_claims OR year_count >= 5 THEN 4 ELSE 0 END)"""
_CHARS = "greatest(12000, CASE WHEN expects_regression OR expects_list OR expects_series_math THEN 22000 ELSE 0 END, CASE WHEN wants_monthly_series OR expects_sum OR expects_percent OR is_calendar_defense THEN 18000 ELSE 0 END)"
_WIDE_SEARCH = "(mentions_veterans_admin OR prefers_country_claims OR expects_regression OR expects_series_math OR expects_list OR note_term_years > 0 OR (wants_monthly_series AND year_count >= 3) OR (is_auction AND expects_date))"


def renamed(sql: str, tail: str) -> str:
    """The CTEs of ``full_cte`` under names of their own, to stand beside those of another use."""
    for name in ("previews", "s_l", "s_f", "s_r", "s_p", "sections", "bs", "bt", "o", "full_"):
        for before, after in ((" ", " "), (" ", "."), (" ", ")"), (" ", ","), ("(", " ")):
            sql = sql.replace(f"{before}{name}{after}", f"{before}{name}{tail}{after}")
    return sql


_FULL_ALL = renamed(" " + full_cte("cand"), "x")
SOURCES_CTE = f"""{CHEAP_CTE}, {full_cte("cheap")}, {DATED_SQL},
    best AS (SELECT q_id, doc_id, file_name, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, file_name) AS rank FROM full_),
    both_ AS (SELECT q_id, doc_id, file_name, source_rank, pos, pinned FROM dated JOIN files USING (pub_date) UNION ALL SELECT q_id, doc_id, file_name, 6, rank, false FROM best JOIN asks USING (q_id) WHERE {_WIDE_SEARCH} AND rank <= greatest(18, {_LIMITS} * 4)),
    first_ AS (SELECT q_id, doc_id, file_name, min(source_rank * 1000000 + pos) AS place, bool_or(pinned) AS pinned FROM both_ GROUP BY ALL),
    cand AS (SELECT * FROM first_ UNION ALL SELECT q_id, doc_id, file_name, 7000000 + date_diff('day', DATE '1900-01-01', pub_date), false FROM asks, files WHERE q_id NOT IN (SELECT q_id FROM first_)), {_FULL_ALL},
    rated AS (SELECT c.*, f.score, {_LIMITS} AS max_files, {_CHARS} AS max_chars, count(*) OVER (PARTITION BY q_id) AS n, max(f.score) OVER (PARTITION BY q_id) AS best_score FROM cand c JOIN full_x f USING (q_id, doc_id) JOIN asks USING (q_id)),
    sources AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY pinned DESC, CASE WHEN n <= max_files THEN 0 ELSE score END DESC, place) AS rank FROM rated QUALIFY rank <= max_files)"""


@query(f"{ASKS_SQL}, {C.SQL}, {DATED_SQL} SELECT q_id, pub_date, source_rank, pos, pinned FROM dated")
def dated_candidates(spark, sf_dir):
    """The issues that a question's dates, families and features point to."""
    return K.dated_candidates(asks(spark, sf_dir), C.bulletins(spark, sf_dir))


@query(f"{SOURCES_CTE} SELECT q_id, doc_id, file_name, pinned, rank FROM sources")
def find_sources(spark, sf_dir):
    """The files of each question."""
    return V.find_sources(asks(spark, sf_dir), *corpus(spark, sf_dir))


_SPLIT = f"list_filter(regexp_split_to_array(b, {BREAKS}), lambda x: {strip('x')} <> '')"
_ASKED_YEARS = r"list_distinct(regexp_extract_all(question, '\b(19[2-9][0-9]|20[0-2][0-9])\b', 0))"
_FOCUS = "list_filter([" + ", ".join(f"regexp_extract(low, '{p}', 0)" for p in L.FOCUS) + "], lambda v: v <> '')"
_ENTITIES = r"list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(question, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+', 0), regexp_extract_all(question, '[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|and|of|the|for|in|to))+\s+[A-Z][a-z]+', 0)), lambda x: lower(x)), lambda x: length(x) >= 6))"
NARROW_SQL = rf"""ln AS (SELECT q_id, doc_id, block_no, unnest(range(len(ls))) AS i, unnest(ls) AS x, len(ls) AS n, ys, ms, ts FROM (SELECT q_id, doc_id, block_no, {_SPLIT} AS ls, {_ASKED_YEARS} AS ys, months AS ms, list_concat(list_distinct({_FOCUS}), {_ENTITIES}) AS ts FROM picked)),
    ls AS (SELECT *, i < 2 OR regexp_matches(replace({strip("x")}, '-', ''), '^[\s|:]+$') AS head, len(list_filter(ys, lambda y: contains(x, y))) * 10 + len(list_filter(ms, lambda m: contains(lower(x), m))) * 5 + len(list_filter(ts, lambda t: contains(lower(x), t))) * 8
        + CASE WHEN regexp_matches(lower(x), '\btotal\b') THEN 3 ELSE 0 END AS s FROM ln),
    lr AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id, block_no, head ORDER BY s DESC, i) AS r, max(CASE WHEN head THEN 0 ELSE s END) OVER (PARTITION BY q_id, doc_id, block_no) AS best_s FROM ls),
    nb AS (SELECT q_id, doc_id, block_no, string_agg(x, chr(10) ORDER BY i) AS body FROM lr WHERE head OR (r <= 40 AND (s > 0 OR best_s <= 0)) GROUP BY ALL),
    sn AS (SELECT p.q_id, p.doc_id, p.block_no, p.s AS score, budget, 'TABLE TITLE: ' || title || CASE WHEN unit_hint <> '' AND NOT contains(title, unit_hint) THEN chr(10) || 'UNIT: ' || unit_hint ELSE '' END || chr(10) ||
        CASE WHEN expects_series_math OR expects_regression OR expects_list OR wants_monthly_series OR len({_SPLIT}) <= 42 THEN b ELSE {strip("nb.body")} END AS snippet FROM picked p LEFT JOIN nb USING (q_id, doc_id, block_no)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY score DESC, block_no) AS place FROM sn QUALIFY place <= 3),
    pk AS (SELECT *, coalesce(sum(length(snippet) + 2) OVER (PARTITION BY q_id, doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pl),
    snippets AS (SELECT q_id, doc_id, block_no, place, left(snippet, budget) AS snippet FROM pk WHERE place = 1 OR before + length(snippet) <= budget)"""
CHOSEN_CTE = f"""{SOURCES_CTE}, cn AS (SELECT *, count(*) OVER (PARTITION BY q_id) AS k FROM sources),
    chosen AS (SELECT q_id, doc_id, file_name, rank, max_chars, CASE WHEN k = 1 THEN max_chars WHEN k = 2 AND rank = 1 THEN max_chars * 55 // 100 WHEN k = 2 THEN max_chars * 45 // 100 WHEN rank = 1 THEN max_chars * 40 // 100 WHEN rank = 2 THEN max_chars * 25 // 100 ELSE max_chars * 35 // (100 * (k - 2)) END AS budget FROM cn),
    tt AS (SELECT q_id, doc_id, block_no, {TABLE_SQL} AS s FROM chosen JOIN asks USING (q_id) JOIN {_TABLE_ROWS} r USING (doc_id)),
    picked AS (SELECT tt.q_id, tt.doc_id, tt.block_no, tt.s, title, unit_hint, {strip("body")} AS b, budget, asks.* EXCLUDE (q_id) FROM tt JOIN titled USING (doc_id, block_no) JOIN chosen USING (q_id, doc_id) JOIN asks ON asks.q_id = tt.q_id WHERE tt.s > 0), {NARROW_SQL}"""


def chosen(spark, sf_dir):
    q = asks(spark, sf_dir)
    docs, files, tables = corpus(spark, sf_dir)
    limits = V.limits(q)
    ranked = stash(V.find_sources(q, docs, files, tables), "sources")
    share = F.count(F.lit(1)).over(Window.partitionBy("q_id"))
    budget = ranked.join(limits, "q_id").withColumn("budget", A.file_budget(F.col("rank"), share, F.col("max_chars")))
    return q, docs, files, tables, limits, ranked, budget


@query(f"{CHOSEN_CTE} SELECT q_id, doc_id, block_no, place, length(snippet) AS n_chars, md5(snippet) AS digest FROM snippets")
def table_snippets(spark, sf_dir):
    """K5: the best tables of each question's files, narrowed and packed."""
    q, _, _, tables, _, _, budget = chosen(spark, sf_dir)
    out = X.table_snippets(budget, q, tables)
    return out.select("q_id", "doc_id", "block_no", "place", F.length("snippet").cast("long").alias("n_chars"), F.md5("snippet").alias("digest"))


@query(
    f"""{CHOSEN_CTE}, fs AS (SELECT q_id, doc_id, {strip("string_agg(snippet, chr(10) || chr(10) ORDER BY place)")} AS s FROM snippets GROUP BY ALL),
    fr AS (SELECT q_id, rank, file_name, max_chars, s, coalesce(sum(length(s)) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chosen JOIN fs USING (q_id, doc_id)),
    cx AS (SELECT q_id, string_agg(file_name, '|' ORDER BY rank) AS files, string_agg('=== SOURCE: ' || file_name || ' ===' || chr(10) || s, chr(10) || chr(10) ORDER BY rank) AS context FROM fr WHERE before < max_chars GROUP BY q_id)
    SELECT q_id, files, length(context) AS n_chars, md5(context) AS digest FROM cx"""
)
def source_context(spark, sf_dir):
    """K7: the whole context of each question; files in which no table scores give their best windows of lines."""
    q, docs, _, tables, limits, ranked, _ = chosen(spark, sf_dir)
    out = X.source_context(ranked, q, docs, tables, limits)
    return out.select("q_id", "files", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


_HINTS = "list_concat(" + sql_list(L.HINTS_FIRST) + ", CASE " + " ".join(f"WHEN {f} THEN {sql_list(h)}" for f, h in L.HINTS_BY_SHAPE.items()) + f" ELSE {sql_list(L.HINTS_OTHERWISE)} END)"
for _when, _hint in L.HINTS_MORE:
    _HINTS = f"list_concat({_HINTS}, CASE WHEN {_when} THEN {sql_list([_hint])} ELSE [] END)"


@query(f"{ASKS_SQL} SELECT q_id, array_to_string(list_transform({_HINTS}, lambda h: '- ' || h), chr(10)) AS strategy FROM asks")
def strategy(spark, sf_dir):
    """Hints for solving each question."""
    return asks(spark, sf_dir).select("q_id", P.strategy().alias("strategy"))


@query(f"{ASKS_SQL}, {C.SQL}, {DATED_SQL} SELECT q_id, pub_date FROM dated WHERE source_rank = 1")
def bulletin_references(spark, sf_dir):
    """Issues that a question names as such and that exist."""
    return K.references(asks(spark, sf_dir)).select("q_id", "pub_date").distinct().join(C.bulletins(spark, sf_dir), "pub_date", "left_semi").select("q_id", "pub_date")


@query(f"WITH {titles_sql('documents')} SELECT doc_id, block_no, unit_hint, title AS full_title, code AS table_code, contains(lower(title), 'contents') AS is_contents FROM titled")
def block_titles(spark, sf_dir):
    """G1 and G2 on all documents."""
    docs = table(spark, sf_dir, "documents")
    return B.block_titles(B.table_blocks(docs), docs).drop("title")


@query(
    rf"""{ASKS_SQL}, turns AS (SELECT *, substr(q_id, 2)::BIGINT AS i, (SELECT max(item_id) + 1 FROM benchmark) AS among FROM asks),
    nq_l AS (SELECT q_id, doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS x, {_ASKED_YEARS} AS ys, months AS ms, list_concat({_FOCUS}, {_ENTITIES}) AS ts, expects_series_math OR expects_regression OR expects_list OR wants_monthly_series AS whole
        FROM (SELECT doc_id, regexp_split_to_array(text, {BREAKS}) AS a FROM documents) JOIN turns ON i = doc_id % among),
    nq_s AS (SELECT q_id, doc_id, line_no, whole, {strip("x")} AS b, len(list_filter(ys, lambda y: contains({strip("x")}, y))) * 10 + len(list_filter(ms, lambda m: contains(lower(x), m))) * 5 + len(list_filter(ts, lambda t: contains(lower({strip("x")}), t))) * 8
        + CASE WHEN regexp_matches(lower(x), '\btotal\b') THEN 3 ELSE 0 END AS score FROM nq_l),
    nq_m AS (SELECT *, b <> '' AS filled, regexp_matches(replace(b, '-', ''), '^[\s|:]+$') AS bar, sum((b <> '')::INT) OVER (PARTITION BY q_id, doc_id) AS n, sum((b <> '')::INT) OVER (PARTITION BY q_id, doc_id ORDER BY line_no) AS place FROM nq_s),
    nq_g AS (SELECT *, filled AND NOT bar AND place > 2 AS data FROM nq_m), nq_r AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY data DESC, score DESC, line_no) AS r, max(CASE WHEN data THEN score END) OVER (PARTITION BY q_id, doc_id) AS best FROM nq_g)
    SELECT q_id, doc_id, line_no, score FROM nq_r WHERE whole OR n <= 42 OR (filled AND NOT data) OR (data AND r <= 40 AND (score > 0 OR best <= 0))"""
)
def row_narrow_questions(spark, sf_dir):
    """SC6: each document's lines narrowed for one of the questions, dealt by doc_id."""
    q = asks(spark, sf_dir).withColumn("_n", F.substring("q_id", 2, 20).cast("long"))
    among = q.agg(F.max("_n") + 1).first()[0] or 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(among)).alias("_n"))
    pairs = docs.join(stash(B.with_narrowing(q).select("q_id", "_n", "_y", "_m", "_t", "_whole"), "needs"), "_n")
    return B.narrow_for_question(pairs, ["q_id", "doc_id"]).drop("line")


_CUE_POINTS = " + ".join(
    [when(f"{flag} AND regexp_matches(body, {quoted(pattern)})", str(points)) for flag, pattern, points in L.WINDOW_CUES]
    + [
        when(f"(expects_sum OR expects_difference) AND regexp_matches(body, {quoted(L.WINDOW_TOTALS)})", "12"),
        when(r"expects_regression AND len(regexp_extract_all(body, '\b(?:19|20)[0-9]{2}\b', 0)) >= 4", "14"),
        when(r"expects_list AND len(regexp_extract_all(body, '-?[0-9][0-9,]*\.?[0-9]*', 0)) >= 6", "10"),
        when(f"expects_date AND regexp_matches(body, {quoted(MONTH_WORD)})", "6"),
    ]
)
WINDOWS_SQL = rf"""{PROFILE_SQL}, k AS ({_keywords_sql()}), ys AS (SELECT q_id, list(y ORDER BY y) AS years FROM y GROUP BY q_id), {SCORES_SQL.removeprefix("WITH ").replace(" s AS (SELECT item_id", " sc AS (SELECT item_id")},
    top AS (SELECT q_id, doc_id FROM sc QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 3),
    pr AS (SELECT top.q_id, d.doc_id, p.* EXCLUDE (q_id), list_transform(regexp_split_to_array(d.text, {BREAKS}), lambda x: regexp_replace(x, '[ \t\n\r\f\v]+$', '')) AS ls, coalesce(ys.years, []) AS years,
        list_transform(list_filter(string_split(k.keywords, '|'), lambda x: x <> ''), lambda x: {norm("x")}) AS keywords, CASE WHEN expects_list OR expects_regression OR expects_series_math THEN 18 WHEN expects_sum THEN 14 ELSE 10 END AS r
        FROM top JOIN documents d USING (doc_id) JOIN p ON p.q_id = 'q' || top.q_id JOIN k ON k.q_id = p.q_id LEFT JOIN ys ON ys.q_id = p.q_id),
    an AS (SELECT *, greatest(0, i - r) AS first, least(len(ls), i + r + 1) AS last FROM (SELECT *, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM pr) WHERE {norm("x")} <> '' AND {signal("x")} + {heading("x")} > 0),
    wb AS (SELECT *, array_to_string(list_transform(held, lambda z: {norm("z")}), chr(10)) AS body FROM (SELECT *, list_filter(ls[first + 1 : last], lambda z: {norm("z")} <> '') AS held FROM an)),
    ws AS (SELECT q_id, doc_id, first, last, {words_sql("body", 4, 10, 3)} + 10 * len(list_filter(years, lambda y: {number_in("body", "y")})) + least(len(list_filter(held, lambda z: {signal("z")} >= 2)), 12)
        + {total(f"list_transform(held[1:4], lambda z: {heading('z')})")} + {_CUE_POINTS} AS score FROM wb),
    w1 AS (SELECT *, first > coalesce(max(last) OVER (PARTITION BY q_id, doc_id ORDER BY score DESC, first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM ws WHERE score > 0),
    w2 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY q_id, doc_id ORDER BY score DESC, first, last ROWS UNBOUNDED PRECEDING) AS no FROM w1),
    w3 AS (SELECT q_id, doc_id, no - 1 AS place, max(first) FILTER (fresh) AS first_line, max(last) AS end_line FROM w2 WHERE no < 4 OR (no = 4 AND fresh) GROUP BY ALL),
    w4 AS (SELECT w3.*, {strip("array_to_string(ls[first_line + 1 : end_line], chr(10))")} AS snippet FROM w3 JOIN pr USING (q_id, doc_id)),
    w5 AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(length(snippet) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w4 WHERE snippet <> '' WINDOW w AS (PARTITION BY q_id, doc_id ORDER BY place))"""


@query(f"{WINDOWS_SQL} SELECT q_id, doc_id, place::INT AS place, first_line, end_line, md5(left(snippet, 4000)) AS digest FROM w5 WHERE nth = 1 OR before + length(snippet) <= 4000")
def window_snippets(spark, sf_dir):
    """SC5 and K6: the best windows of lines of each question's three best documents."""
    best = stash(A.top_k(scores(spark, sf_dir), "q_id", 3, F.desc("score"), F.col("doc_id")).select("q_id", "doc_id"), "best")
    q = P.with_profile(questions(spark, sf_dir))
    names = [f for f, _, _ in L.WINDOW_CUES] + ["expects_sum", "expects_difference", "expects_regression", "expects_list", "expects_series_math"]
    flags = F.array_compact(F.array(*(F.when(F.col(f).cast("boolean"), F.lit(f)) for f in names)))
    q = q.select(F.substring("q_id", 2, 20).cast("long").alias("q_id"), T.keywords(F.col("question")).alias("keywords"), T.years(F.col("question")).alias("years"), flags.alias("flags"))
    pairs = best.join(q, "q_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = N.window_snippets(pairs, 4000)
    return found.select("q_id", "doc_id", "place", F.col("first_line").cast("long").alias("first_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("snippet").alias("digest"))


# --- cells and their series ----------------------------------------------------------------------------------------------------

_CELL_FIGURE = lambda c: f"CASE WHEN regexp_matches({c}, '{Y.FIGURE}') THEN CASE WHEN starts_with({c}, '(') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace({c}, '[$,%() ]', '', 'g') AS DOUBLE) END"
_CELL_UNIT = "CASE " + " ".join(f"WHEN contains(lower(unit_hint), '{w}') THEN {p}" for w, p in Y.POWERS.items()) + " ELSE 0 END"


def cells_sql(tables: str) -> str:
    """CTE cells (doc_id, block_no, title, row_no, col_no, row_label, "column", cell, value, power) of ``tables`` (doc_id, block_no, title, unit_hint, body)."""
    return rf"""x_l AS (SELECT doc_id, block_no, title, {_CELL_UNIT} AS power, list_filter(regexp_split_to_array(body, {BREAKS}), lambda l: {strip("l")} <> '') AS ls FROM {tables}),
    x_r AS (SELECT *, list_transform(ls, lambda l: regexp_matches(l, '{Y.SEPARATOR}')) AS bars, list_transform(ls, lambda l: list_transform(string_split(regexp_replace({strip("l")}, '^\||\|$', '', 'g'), '|'), lambda c: {strip("c")})) AS rs FROM x_l),
    x_n AS (SELECT *, CASE WHEN coalesce(list_position(bars, true), 0) > 0 THEN list_position(bars, true) - 1
        WHEN len(list_filter(rs[1], lambda c: {_CELL_FIGURE("c")} IS NOT NULL AND NOT regexp_matches(c, '^(19|20)[0-9]{{2}}$'))) = 0 THEN 1 ELSE 0 END AS head FROM x_r),
    x_b AS (SELECT *, list_filter(list_zip(rs, bars)[head + 1 :], lambda z: NOT z[2]) AS body_rows, rs[1 : head] AS heads FROM x_n),
    x_e AS (SELECT doc_id, block_no, title, power, heads, unnest(range(len(body_rows))) AS row_no, unnest(list_transform(body_rows, lambda z: z[1])) AS r FROM x_b),
    x_c AS (SELECT doc_id, block_no, title, power, heads, row_no, r[1] AS row_label, unnest(range(len(r))) AS col_no, unnest(r) AS cell FROM x_e),
    cells AS (SELECT doc_id, block_no, title, row_no, col_no, row_label, {strip("array_to_string(list_filter(list_transform(heads, lambda h: coalesce(h[col_no + 1], '')), lambda h: h <> ''), ' ')")} AS "column", cell, {_CELL_FIGURE("cell")} AS value, power FROM x_c WHERE col_no > 0)"""


_NAMED_MONTH = rf"\b({'|'.join(L.MONTHS)})\s+((?:19|20)[0-9]{{2}})\b"
_PERIOD = f"""CASE WHEN regexp_matches(lower(row_label), '{_NAMED_MONTH}') THEN make_date(regexp_extract(lower(row_label), '{_NAMED_MONTH}', 2)::INT, list_position({sql_list(L.MONTHS)}, regexp_extract(lower(row_label), '{_NAMED_MONTH}', 1))::INT, 1)
    WHEN regexp_matches(lower(row_label), '\b(?:19|20)[0-9]{{2}}\b') THEN make_date(regexp_extract(lower(row_label), '\b((?:19|20)[0-9]{{2}})\b', 1)::INT, 1, 1) END"""


@query(f"WITH {titles_sql('documents')}, {cells_sql('titled')} SELECT doc_id, block_no, row_no, col_no, md5(row_label) AS row_label, \"column\", md5(cell) AS cell, round(value, 4) AS value, power FROM cells")
def table_cells(spark, sf_dir):
    """G2 to cells: every cell of the documents' pipe tables with its labels, value and unit."""
    docs = table(spark, sf_dir, "documents")
    blocks = B.table_blocks(docs)
    titled = blocks.join(B.block_titles(blocks, docs).select("doc_id", "block_no", "unit_hint"), ["doc_id", "block_no"])
    out = Y.cells(titled, ["doc_id", "block_no"])
    return out.select("doc_id", "block_no", "row_no", "col_no", F.md5("row_label").alias("row_label"), "column", F.md5("cell").alias("cell"), F.round("value", 4).alias("value"), "power")


@query(
    f"""WITH {C.SQL}, {titles_sql('bulletins')}, {cells_sql('titled')}, v AS (SELECT title, "column", {_PERIOD} AS period, value FROM cells), m AS (SELECT title, "column", year(period) AS y, month(period)::DOUBLE AS x, value FROM v WHERE period IS NOT NULL AND value IS NOT NULL)
    SELECT title, "column", y, count(value) AS n, round(avg(value), 2) AS mean, round(exp(avg(ln(value)) FILTER (value > 0)), 2) AS geometric_mean, round(median(value), 2) AS med, round(stddev_samp(value), 2) AS sd, round(CASE WHEN var_pop(x) > 0 THEN regr_slope(value, x) END, 2) AS slope,
    round(CASE WHEN var_pop(x) > 0 THEN regr_intercept(value, x) END, 2) AS intercept, round(covar_samp(value, x) / nullif(stddev_samp(value) * stddev_samp(x), 0), 6) AS r, round(sum(value * x) / sum(x), 2) AS weighted FROM m GROUP BY ALL"""
)
def bulletin_series(spark, sf_dir):
    """Statistics of each table title's monthly figures by year, over all bulletins."""
    docs = C.bulletins(spark, sf_dir)
    blocks = B.table_blocks(docs)
    titled = blocks.join(B.block_titles(blocks, docs).select("doc_id", "block_no", "unit_hint", F.col("full_title").alias("title")), ["doc_id", "block_no"])
    found = Y.series(Y.cells(titled, ["doc_id", "block_no", "title"]), ["title"])
    monthly = found.select("title", "column", F.year("period").cast("long").alias("y"), F.month("period").cast("double").alias("x"), "value")
    return Y.statistics(monthly, ["title", "column", "y"], "x", "value")


# --- files ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {C.SQL} SELECT file_name, year(pub_date) AS year, month(pub_date) AS month, pub_date, length(text) AS n_chars, md5(text) AS digest FROM bulletins WHERE year(pub_date) >= 1950 AND month(pub_date) IN (3, 6, 9)")
def bulletin_files(spark, sf_dir):
    """SRC1 to SRC4 and SRC12: bulletins written as files by the data source and read back, files of other years and months unread."""
    D.register(spark)
    folder = f"{shared_dir(spark)}/bulletins-{uuid.uuid4().hex}"
    C.bulletins(spark, sf_dir).select("file_name", "text").write.format("bulletins").mode("append").save(folder)
    rows = spark.read.format("bulletins").option("roots", f"{folder}-missing, {folder}").load()
    kept = rows.where((F.col("year") >= 1950) & F.col("month").isin(3, 6, 9))
    return kept.select("file_name", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "pub_date", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {C.SQL}, {titles_sql('bulletins')}, h AS (SELECT doc_id, title, min(block_no) AS place FROM titled GROUP BY ALL) SELECT file_name, md5(string_agg(title, chr(10) ORDER BY place)) AS headings FROM h JOIN bulletins USING (doc_id) GROUP BY file_name")
def feature_store(spark, sf_dir):
    """SRC4 and SRC6 over files: headings kept in a store, to which later files are added while those before are not read again."""
    D.register(spark)
    mark = uuid.uuid4().hex
    folder, name = f"{shared_dir(spark)}/issues-{mark}", f"headings_{mark}"
    docs = stash(C.bulletins(spark, sf_dir), "docs")

    def headings(files):
        keyed = files.withColumn("doc_id", F.xxhash64("file_name"))
        return O.heading_summaries(O.scored_tables(keyed)).join(keyed.select("doc_id", "file_name"), "doc_id").select("file_name", "heading")

    store = G.FeatureStore(spark, name, f"{shared_dir(spark)}/{name}", headings)
    for part in (F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 == 0):
        docs.where(part).select("file_name", "text").write.format("bulletins").mode("append").save(folder)
        store.update(folder)
    return store.read(folder).where("heading is not null").select("file_name", F.md5("heading").alias("headings"))


@query(f"{ASKS_SQL}, held AS (SELECT q_id, doc_id, years, {norm('text')} AS content FROM documents JOIN asks ON substr(q_id, 2)::BIGINT = doc_id % (SELECT max(item_id) + 1 FROM benchmark)) SELECT q_id, doc_id, len(years) AS n_years, len(list_filter(years, lambda y: {number_in('content', 'y')})) AS hits FROM held")
def year_hits(spark, sf_dir):
    """How many of a question's years each document names, the documents dealt to questions by doc_id."""
    q = questions(spark, sf_dir).select("q_id", F.substring("q_id", 2, 20).cast("long").alias("_n"), T.years(F.col("question")).alias("years"))
    among = q.agg(F.max("_n") + 1).first()[0] or 1
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.pmod("doc_id", F.lit(among)).alias("_n"), F.array_distinct(S.known_years(T.normalize(F.col("text")))).alias("_held"))
    return docs.join(q, "_n").select("q_id", "doc_id", F.size("years").cast("long").alias("n_years"), F.size(F.array_intersect("years", "_held")).cast("long").alias("hits"))
