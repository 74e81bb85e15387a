"""All queries of the engine with DuckDB SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import answers as A
from tabulith.functions import lexicon as L
from tabulith.functions import profile as P
from tabulith.functions import text as T
from tabulith.operators import candidates as C
from tabulith.operators import evaluate as E
from tabulith.operators import ranking as R
from tabulith.operators import routing as W
from tabulith.operators import tables as B
from tabulith.operators import tools as X
from tabulith.operators import voting as V
from tabulith.plans import fixtures as I
from tabulith.sources import corpus as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that restates it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def filled_shape(shapes: Column, cells: dict[str, Column]) -> Column:
    """A shape with its cells put in."""
    for name, value in cells.items():
        shapes = F.replace(shapes, F.lit("{" + name + "}"), value.cast("string"))
    return shapes


def filled_shape_sql(shape: str, cells: dict[str, str]) -> str:
    for name, value in cells.items():
        shape = f"replace({shape}, '{{{name}}}', ({value})::VARCHAR)"
    return shape


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def pick(values: list[str], at: Column) -> Column:
    return F.get(T.strings(values), at.cast("int"))


QUESTION_SHAPES = [q for _, q in I.QUESTIONS] + I.SHAPES


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, question): a question for each row of the benchmark: a shape, its subject, month and years chosen by the item's id, and the item's text."""
    n = F.col("item_id")
    year = lambda first: (F.lit(first) + n * 7 % 50)
    cells = {"s": pick(I.SUBJECTS, n * 3 % len(I.SUBJECTS)), "m": pick(I.ASKED_MONTHS, n % len(I.ASKED_MONTHS)), "y": year(1940), "y1": year(1941), "z": year(1943), "n": F.lpad(n.cast("string"), 4, "0")}
    shape = filled_shape(pick(QUESTION_SHAPES, n % len(QUESTION_SHAPES)), cells)
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), n.cast("string")).alias("q_id"), F.concat_ws(" ", shape, "text").alias("question"))


_SQL_CELLS = {"s": f"{sql_list(I.SUBJECTS)}[item_id * 3 % {len(I.SUBJECTS)} + 1]", "m": f"{sql_list(I.ASKED_MONTHS)}[item_id % {len(I.ASKED_MONTHS)} + 1]"} | {c: f"{first} + item_id * 7 % 50" for c, first in (("y", 1940), ("y1", 1941), ("z", 1943))} | {"n": "lpad(item_id::VARCHAR, 4, '0')"}
Q = f"(SELECT 'q' || item_id AS q_id, concat_ws(' ', {filled_shape_sql(f'{sql_list(QUESTION_SHAPES)}[item_id % {len(QUESTION_SHAPES)} + 1]', _SQL_CELLS)}, text) AS question FROM benchmark) AS t"

#: Pairs of a question and an answer, then shapes of answers whose questions vary.
_PAIRS, _CASES = len(I.ANSWERS), len(I.ANSWERS) + len(I.GIVEN)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, conv_id, turn, k, question, answer): an answer for each turn of the conversations: a shape chosen by the turn's number, with the turn's text in some."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 8 + F.col("turn"))
    i = F.col("k") % _CASES
    question = F.coalesce(pick([q for _, q, _ in I.ANSWERS], i), pick(I.ASKED, F.floor(F.col("k") / _CASES) % len(I.ASKED)))
    answer = filled_shape(pick([a for _, _, a in I.ANSWERS] + I.GIVEN, i), {"n": 11 + F.col("k") % 80, "t": F.coalesce("text", F.lit(""))})
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("a_id"), "conv_id", "turn", "k", question.alias("question"), answer.alias("answer"))


_K = "(conv_id * 8 + turn)"
_ANSWER_SHAPE = f"{sql_list([a for _, _, a in I.ANSWERS] + I.GIVEN)}[{_K} % {_CASES} + 1]"
N = f"""(SELECT conv_id || '-' || turn AS a_id, conv_id, turn, {_K} AS num, coalesce({sql_list([q for _, q, _ in I.ANSWERS])}[{_K} % {_CASES} + 1], {sql_list(I.ASKED)}[{_K} // {_CASES} % {len(I.ASKED)} + 1]) AS question,
    {filled_shape_sql(_ANSWER_SHAPE, {"n": f"11 + {_K} % 80", "t": "coalesce(text, '')"})} AS answer FROM conversations) AS t"""


def sql_any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def sql_unique(values: str) -> str:
    """Distinct values of a list in order of their first place."""
    return f"list_filter({values}, lambda v, i: v <> '' AND list_position({values}, v) = i)"


TRIM = r"'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$'"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, {TRIM}, '', 'g')"


# --- sources and text -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def corpus_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    """SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE
    substr(text, 1, 2666) || chr(10) || substr(text, greatest(0, length(text) // 2 - 1333) + 1, 2666) || chr(10) || right(text, 2666) END AS p FROM documents)"""
)
def corpus_preview(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("p"))
    return p.select("doc_id", F.length("p").cast("long").alias("n"), F.md5("p").alias("digest"))


@query("SELECT doc_id, md5(translate(lower(text), '''`’', '')) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query(
    r"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line <> '') AS n_filled, max(length(line)) AS longest
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents) GROUP BY doc_id"""
)
def line_explode(spark, sf_dir):
    rows = B.explode_lines(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("line") != "", 1)).alias("n_filled"), F.max(F.length("line")).cast("long").alias("longest"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents), s AS (SELECT doc_id,
    CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(line, '{L.NUMBER}', 0)) >= 2 THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}_])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*($|[^\p{{L}}\p{{N}}_])') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(line, '[%$¥£]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(line, '[ \t\n\r\f]{{2,}}|\t') THEN 1 ELSE 0 END AS sig FROM l)
    SELECT doc_id, sum(sig)::BIGINT AS table_signal, count(*) FILTER (WHERE sig >= 2) AS table_lines FROM s GROUP BY doc_id"""
)
def line_signals(spark, sf_dir):
    line = F.col("line")
    signal = T.table_signal(line)
    rows = B.explode_lines(table(spark, sf_dir, "documents")).withColumn("s", signal)
    return rows.groupBy("doc_id").agg(F.sum("s").cast("long").alias("table_signal"), F.count(F.when(F.col("s") >= 2, 1)).alias("table_lines"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(list_zip(range(len(a)), a)) AS z FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS a FROM documents)),
    r AS (SELECT doc_id, z[1] AS line_no, z[2] AS line FROM l WHERE len(regexp_extract_all(z[2], '\|', 0)) >= 2),
    g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM r),
    b AS (SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS pipe_lines, string_agg(line, chr(10) ORDER BY line_no) AS body FROM g GROUP BY doc_id, i HAVING count(*) >= 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS block_no, start_line, end_line, pipe_lines, md5(body) AS digest FROM b"""
)
def table_blocks(spark, sf_dir):
    return B.table_blocks(table(spark, sf_dir, "documents")).withColumn("digest", F.md5("body")).drop("body")


@query(f"SELECT doc_id, len({sql_unique('e')}) AS n, array_to_string({sql_unique('e')}, '|') AS entities FROM (SELECT doc_id, list_filter(list_transform(list_concat(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+', 0), regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+(?:[A-Z][a-z]+|and|of|the|for|in|to))+\\s+[A-Z][a-z]+', 0)), lambda x: lower(x)), lambda x: length(x) >= 6) AS e FROM documents)")
def named_entities(spark, sf_dir):
    e = T.named_entities(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(e).cast("long").alias("n"), F.array_join(e, "|").alias("entities"))


@query("SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '" + L.NUMBER + "', 0) AS n FROM documents)")
def number_tokens(spark, sf_dir):
    n = T.find_all(F.col("text"), L.NUMBER)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


@query(f"SELECT q_id, array_to_string({sql_unique('p')}, '|') AS phrases FROM (SELECT q_id, list_transform(regexp_extract_all(question, '[''‘’]([^''‘’]{{3,}})[''‘’]|\"([^\"]{{3,}})\"', 0), lambda h: {sql_strip('lower(substr(h, 2, length(h) - 2))')}) AS p FROM {Q})")
def quoted_phrases(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.quoted_phrases(F.col("question")), "|").alias("phrases"))


@query(f"SELECT q_id, array_to_string({sql_unique('c')}, '|') AS codes FROM (SELECT q_id, list_transform(regexp_extract_all(question, '[A-Z]{{1,6}}-[A-Z]?-?[0-9]+[A-Z]?', 0), lambda x: lower(x)) AS c FROM {Q})")
def table_codes(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.table_codes(F.col("question")), "|").alias("codes"))


FOCUS_SQL = "[" + ", ".join(f"regexp_extract(lower(question), '{p}', 0)" for p in L.FOCUS) + "]"


@query(f"SELECT q_id, array_to_string({sql_unique('f')}, '|') AS phrases FROM (SELECT q_id, {FOCUS_SQL} AS f FROM {Q})")
def focus_phrases(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.focus_phrases(F.col("question")), "|").alias("phrases"))


def _keywords_sql() -> str:
    entities = r"list_filter(list_transform(list_concat(regexp_extract_all(question, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+', 0), regexp_extract_all(question, '[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|and|of|the|for|in|to))+\s+[A-Z][a-z]+', 0)), lambda x: lower(x)), lambda x: length(x) >= 6)"
    quoted = f"list_transform(regexp_extract_all(question, '[''‘’]([^''‘’]{{3,}})[''‘’]|\"([^\"]{{3,}})\"', 0), lambda h: {sql_strip('lower(substr(h, 2, length(h) - 2))')})"
    codes = "list_transform(regexp_extract_all(question, '[A-Z]{1,6}-[A-Z]?-?[0-9]+[A-Z]?', 0), lambda x: lower(x))"
    words = f"list_filter(regexp_extract_all(lower(question), '[a-z][a-z0-9$%.-]{{2,}}', 0), lambda w: NOT list_contains({sql_list(L.STOPWORDS)}, w))"
    more = [f"CASE WHEN regexp_matches(lower(question), '{p}') THEN {sql_list(f)} ELSE []::VARCHAR[] END" for p, f in L.EXPANSIONS]
    negative = [f"CASE WHEN {sql_any('lower(question)', p)} THEN {sql_list(f)} ELSE []::VARCHAR[] END" for p, f in L.NEGATIVE]
    k = "list_concat(" * 4 + f"{FOCUS_SQL}, {entities}), {quoted}), {codes}), {words})"
    for m in more:
        k = f"list_concat({k}, {m})"
    neg = negative[0]
    for m in negative[1:]:
        neg = f"list_concat({neg}, {m})"
    return f"""SELECT q_id, array_to_string(list_slice(list_filter({sql_unique('k')}, lambda w: NOT list_contains(neg, w)), 1, 28), '|') AS keywords FROM (SELECT q_id, {k} AS k, {neg} AS neg FROM {Q})"""


@query(_keywords_sql())
def question_keywords(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.keywords(F.col("question")), "|").alias("keywords"))


_YEAR = "(19[2-9][0-9]|20[0-2][0-9])"
_SPANS = [rf"\bfrom\s+{_YEAR}\s+to\s+{_YEAR}\b", rf"\bbetween\s+{_YEAR}\s+and\s+{_YEAR}\b", rf"\b{_YEAR}\s*[-–—]\s*{_YEAR}\b"]
_SPAN_SQL = " UNION ALL ".join(f"SELECT q_id, unnest(regexp_extract_all(lower(question), '{p}', 1))::INT AS a, unnest(regexp_extract_all(lower(question), '{p}', 2))::INT AS b FROM q" for p in _SPANS)
YEARS_SQL = f"""WITH q AS (SELECT * FROM {Q}), s AS ({_SPAN_SQL}), y AS (SELECT q_id, unnest(regexp_extract_all(question, '\\b{_YEAR}\\b', 0))::INT AS y FROM q
    UNION SELECT q_id, unnest(range(least(a, b), greatest(a, b) + 1))::INT FROM s WHERE abs(a - b) BETWEEN 1 AND 20)"""


@query(f"{YEARS_SQL} SELECT q.q_id, count(y) AS n, coalesce(string_agg(y::VARCHAR, ' ' ORDER BY y), '') AS years FROM q LEFT JOIN y ON q.q_id = y.q_id GROUP BY q.q_id")
def question_years(spark, sf_dir):
    y = T.years(F.col("question"))
    return questions(spark, sf_dir).select("q_id", F.size(y).cast("long").alias("n"), F.array_join(F.transform(y, lambda v: v.cast("string")), " ").alias("years"))


# --- question profile -------------------------------------------------------------------------------------------------

FLAGS = ["expects_list", "expects_regression", "expects_series_math", "expects_date", "expects_percent", "expects_difference", "expects_sum", "expects_scalar_lookup", "wants_full_number", "mentions_veterans_admin", "include_public_works", "exclude_revolving", "exclude_trust_accounts", "exclude_territories", "exclude_regional_aggregates", "prefers_country_claims", "wants_tax_regression", "wants_january_debt_series", "wants_calendar_year", "wants_monthly_series", "wants_auction_bid_data", "wants_bill_rate_data", "wants_maturity_schedule"]
_BASE = ", ".join(f"{sql_any('lower(question)', p)} AS {n}" for n, p in L.FEATURES.items())
PROFILE_SQL = f"""{YEARS_SQL}, p0 AS (SELECT q_id, question, lower(question) AS low, {_BASE}, list_filter({sql_list(L.MONTHS)}, lambda m: contains(lower(question), m)) AS months,
    (SELECT count(*) FROM y WHERE y.q_id = q.q_id) AS year_count FROM q),
    p1 AS (SELECT *, asks_date OR expects_series_math AS expects_date, NOT no_lookup AS expects_scalar_lookup, contains(low, 'claims') AND contains(low, 'country') AND claims_words AS prefers_country_claims,
    coalesce(TRY_CAST(regexp_extract(low, '\\b([0-9]+)-year\\s+u\\.?s\\.?\\s+treasury\\s+notes?\\b', 1) AS INT), 0) AS note_term_years,
    contains(low, 'individual income tax receipts') AND regression_words AS wants_tax_regression, contains(low, 'january') AND contains(low, 'debt') AND series_words AS wants_january_debt_series,
    asks_monthly OR (expects_series_math AND len(months) > 0 AND year_count >= 2) AS wants_monthly_series, (bill_term AND bill_word) OR bill_phrase AS wants_bill_rate_data FROM p0),
    p AS (SELECT *, (contains(low, 'maturing') AND NOT wants_bill_rate_data AND NOT wants_auction_bid_data) OR schedule_phrase AS wants_maturity_schedule FROM p1)"""


@query(f"{PROFILE_SQL} SELECT q_id, array_to_string(months, '|') AS months, year_count, note_term_years, {', '.join(FLAGS)} FROM p")
def question_profile(spark, sf_dir):
    return P.with_profile(questions(spark, sf_dir)).select("q_id", F.array_join("months", "|").alias("months"), F.col("year_count").cast("long").alias("year_count"), "note_term_years", *FLAGS)


_HIT = {n: f"regexp_matches(low, '{p}')" for n, p in L.FAMILY_PATTERNS.items()} | {
    "bill_rates": "wants_bill_rate_data",
    "auction_results": "wants_auction_bid_data",
    "maturity_schedule": "wants_maturity_schedule",
}
_HIT["calendar_defense"] = f"(wants_calendar_year OR wants_monthly_series) AND {_HIT['national_defense']}"
_TAXED = "expects_regression AND contains(low, 'receipts')"
_FAMILY_LIST = "[" + ", ".join([f"CASE WHEN {_HIT[n]} THEN '{n}' ELSE '' END" for n in L.FAMILY_ORDER] + [f"CASE WHEN {_TAXED} THEN 'ffo' ELSE '' END", f"CASE WHEN {_TAXED} THEN 'tax_receipts' ELSE '' END", "CASE WHEN expects_list AND contains(low, 'debt') THEN 'fd' ELSE '' END"]) + "]"
FAMILY_SQL = f"{PROFILE_SQL}, f0 AS (SELECT *, {_FAMILY_LIST} AS f FROM p), f AS (SELECT *, {sql_unique('f')} AS families FROM f0)"


@query(f"{FAMILY_SQL} SELECT q_id, array_to_string(families, '|') AS families FROM f")
def families(spark, sf_dir):
    return P.with_profile(questions(spark, sf_dir)).select("q_id", F.array_join(P.families(), "|").alias("families"))


_DIFF = " + ".join([f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in P.DIFFICULTY.items()] + ["CASE WHEN year_count >= 3 THEN 2 ELSE 0 END", "CASE WHEN year_count >= 5 THEN 1 ELSE 0 END", "CASE WHEN length(question) >= 280 THEN 2 WHEN length(question) >= 200 THEN 1 ELSE 0 END"])


@query(f"{PROFILE_SQL} SELECT q_id, s AS score, CASE WHEN s >= 6 THEN 'hard' WHEN s >= 3 THEN 'medium' ELSE 'easy' END AS difficulty FROM (SELECT q_id, {_DIFF} AS s FROM p)")
def difficulty(spark, sf_dir):
    return P.with_profile(questions(spark, sf_dir)).select("q_id", P.difficulty_score().alias("score"), P.difficulty().alias("difficulty"))


_DIMS = f"list_filter({sql_list(L.DIMENSIONS)}, lambda t: contains(low, t))"
for _flags, _terms in L.IMPLIED_DIMENSIONS:
    _DIMS = f"list_concat({_DIMS}, CASE WHEN {' OR '.join(_flags)} THEN {sql_list(_terms)} ELSE []::VARCHAR[] END)"


@query(f"{PROFILE_SQL} SELECT q_id, array_to_string({sql_unique('d')}, '|') AS terms FROM (SELECT q_id, {_DIMS} AS d FROM p)")
def dimension_terms(spark, sf_dir):
    return P.with_profile(questions(spark, sf_dir)).select("q_id", F.array_join(P.dimension_terms(), "|").alias("terms"))


_WIDE = "expects_regression OR expects_list OR expects_series_math"
_SOME = "wants_monthly_series OR expects_sum OR expects_percent OR list_contains(families, 'calendar_defense')"


@query(
    f"""{FAMILY_SQL} SELECT q_id, greatest(2, CASE WHEN {_WIDE} THEN 4 ELSE 0 END, CASE WHEN {_SOME} THEN 3 ELSE 0 END, CASE WHEN prefers_country_claims OR year_count >= 5 THEN 4 ELSE 0 END) AS max_files,
    greatest(12000, CASE WHEN {_WIDE} THEN 22000 ELSE 0 END, CASE WHEN {_SOME} THEN 18000 ELSE 0 END) AS max_chars,
    mentions_veterans_admin OR prefers_country_claims OR {_WIDE} OR note_term_years > 0 OR (wants_monthly_series AND year_count >= 3) OR (list_contains(families, 'auction') AND expects_date) AS global_search FROM f"""
)
def context_limits(spark, sf_dir):
    rows = P.with_profile(questions(spark, sf_dir)).withColumn("families", P.families())
    files, chars = P.context_limits(F.col("families"))
    return rows.select("q_id", files.alias("max_files"), chars.alias("max_chars"), P.needs_global_search(F.col("families")).alias("global_search"))


#: Requests around the turns of conversations, for telling tasks and formats apart.
REQUESTS = ["Create a draft and translate it: {t}", "Which deal in the pipeline has this customer, and what is the account? {t}", "What are the yield of the bond and the deficit? {t}", "{t}", "In fiscal year 1984, what were receipts? {t}", "Return JSON for the portfolio: {t}", "Make a CSV format of: {t}", "Does \"{t}\" hold a contradiction?", "Give a trading decision with greeks. {t}", "Build a business overview of {t}", "Allocate the portfolio and write target weights for {t}", "Classify the risks: {t}", "U.S. Treasury and national debt: {t}", "Show your chain of thought. {t}"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r_id, request): the questions, and a request for each turn of the conversations."""
    k = F.col("conv_id") * 8 + F.col("turn")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("r_id"), filled_shape(pick(REQUESTS, k % len(REQUESTS)), {"t": F.coalesce("text", F.lit(""))}).alias("request"))
    return questions(spark, sf_dir).toDF("r_id", "request").union(turns)


REQUESTS_SQL = f"""(SELECT q_id AS r_id, question AS request FROM {Q} UNION ALL SELECT conv_id || '-' || turn, {filled_shape_sql(f"{sql_list(REQUESTS)}[(conv_id * 8 + turn) % {len(REQUESTS)} + 1]", {"t": "coalesce(text, '')"})} FROM conversations)"""
_FORMAT_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(request), '(?s){p}') THEN '{k}' END" for p, k, _ in L.FORMATS) + ")"
_ROUTE_COUNTS = ", ".join([f"len(list_filter({sql_list(e)}, lambda p: contains(lower(request), p))) AS {n}" for n, e in L.ROUTE_PHRASES.items()] + [f"len(list_filter({sql_list(e)}, lambda w: list_contains(words, w))) AS {n}" for n, e in L.ROUTE_WORDS.items()])
ROUTED_SQL = f"""w AS (SELECT *, regexp_extract_all(lower(request), '[\\p{{L}}\\p{{N}}_]+', 0) AS words FROM {REQUESTS_SQL}), n AS (SELECT r_id, request, {_ROUTE_COUNTS} FROM w),
    routed AS (SELECT r_id, request, CASE {' '.join(f"WHEN {when} THEN '{task}'" for when, task in L.ROUTES)} ELSE 'general' END AS task FROM n)"""


@query(f"WITH {ROUTED_SQL} SELECT r_id, task FROM routed")
def task_routes(spark, sf_dir):
    """The task of each question and request."""
    return W.routed(requests(spark, sf_dir), "r_id", "request")


@query(f"WITH {ROUTED_SQL} SELECT r_id, {_FORMAT_SQL} AS format, CASE WHEN task = 'officeqa' THEN CASE WHEN {_FORMAT_SQL} = 'xml_final_answer' THEN 'xml_final_answer' END ELSE {_FORMAT_SQL} END AS routed_format, coalesce(nullif(regexp_extract(upper(request), '\\bUID[0-9]{{4}}\\b', 0), ''), 'unknown') AS uid FROM routed")
def format_detect(spark, sf_dir):
    """All ten formats, with and without the task, and the question's number."""
    rows = requests(spark, sf_dir)
    both = rows.join(W.routed(rows, "r_id", "request"), "r_id")
    text = F.col("request")
    return both.select("r_id", P.output_format(text).alias("format"), P.output_format(text, F.col("task")).alias("routed_format"), T.question_uid(text).alias("uid"))


# --- ranking and packing ----------------------------------------------------------------------------------------------

_TERMS = "SELECT {k}, w AS term, count(*) AS tf FROM (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[a-z][a-z0-9]{{2,}}', 0)) AS w FROM {f}) WHERE NOT list_contains({s}, w) GROUP BY {k}, w"
SCORES_SQL = f"""WITH a AS ({_TERMS.format(k="item_id", t="text", f="benchmark", s=sql_list(L.STOPWORDS))}), h AS ({_TERMS.format(k="doc_id", t="text", f="documents", s=sql_list(L.STOPWORDS))}),
    s AS (SELECT item_id AS q_id, doc_id, sum(least(h.tf, 4) * 2)::BIGINT AS score FROM h JOIN a USING (term) GROUP BY ALL)"""


def scores(spark, sf_dir):
    return R.keyword_scores(asked(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(f"{SCORES_SQL} SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5")
def keyword_score_topk(spark, sf_dir):
    return R.top_k(scores(spark, sf_dir), "q_id", 5, F.desc("score"), F.col("doc_id"))


@query(
    f"""{SCORES_SQL}, c AS (SELECT q_id, doc_id AS idx, score, doc_id % 97 = 3 AS pinned, count(*) OVER (PARTITION BY q_id) AS n, max(score) OVER (PARTITION BY q_id) AS best FROM s)
    SELECT q_id, idx, score, pinned, row_number() OVER (PARTITION BY q_id ORDER BY pinned DESC, CASE WHEN n <= 6 OR best <= 0 THEN 0 ELSE score END DESC, idx) AS rank FROM c QUALIFY rank <= 6"""
)
def pinned_select(spark, sf_dir):
    rows = scores(spark, sf_dir).select("q_id", F.col("doc_id").alias("idx"), "score", (F.col("doc_id") % 97 == 3).alias("pinned"))
    return R.pinned_first(rows, "q_id", 6)


@query(
    """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM d WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda k: round_even(k * (n - 1) / 4, 0)::BIGINT), i)"""
)
def diversified_pick(spark, sf_dir):
    return R.diversified(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query(
    f"""{SCORES_SQL}, r AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
    b AS (SELECT r.*, length(text) AS size FROM r JOIN documents USING (doc_id)),
    p AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
    SELECT q_id, doc_id, rank, least(size, 12000) AS kept_chars FROM p WHERE rank = 1 OR before + size <= 12000"""
)
def context_pack(spark, sf_dir):
    best = R.top_k(scores(spark, sf_dir), "q_id", 20, F.desc("score"), F.col("doc_id"))
    sized = best.join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")), "doc_id")
    kept = R.pack(sized, "q_id", "rank", F.col("size"), F.lit(12000))
    return kept.select("q_id", "doc_id", "rank", F.least("size", F.lit(12000)).cast("long").alias("kept_chars"))


@query(
    """SELECT conv_id, turn, n AS files, r AS rank, CASE WHEN n = 1 THEN 22000 WHEN n = 2 AND r = 1 THEN 22000 * 55 // 100 WHEN n = 2 THEN 22000 * 45 // 100 WHEN r = 1 THEN 22000 * 40 // 100
    WHEN r = 2 THEN 22000 * 25 // 100 ELSE 22000 * 35 // (100 * greatest(1, n - 2)) END AS budget
    FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)"""
)
def budget_weights(spark, sf_dir):
    """K8: the share of each part of a conversation, its turns in order taken as the files."""
    whole = Window.partitionBy("conv_id")
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count(F.lit(1)).over(whole).alias("files"), F.row_number().over(whole.orderBy("turn")).cast("long").alias("rank"))
    return n.withColumn("budget", R.file_budget(F.col("rank"), F.col("files"), F.lit(22000)))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(list_zip(range(len(a)), a)) AS z FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS a FROM documents)),
    r AS (SELECT doc_id, z[1] AS line_no, 3 * len(regexp_extract_all(z[2], '[0-9]+', 0)) AS score FROM l WHERE z[2] <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM r)
    SELECT doc_id, line_no, score FROM k WHERE place <= 2 OR (best > 0 AND score > 0 AND r <= 40) OR (best <= 0 AND place <= 40)"""
)
def row_narrow(spark, sf_dir):
    rows = B.explode_lines(table(spark, sf_dir, "documents")).where("line <> ''")
    scored = rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.regexp_count("line", F.lit("[0-9]+")) * 3).cast("long").alias("score"))
    return B.narrow_rows(scored, "doc_id", "score")


# --- candidates by date -----------------------------------------------------------------------------------------------

ISSUES_SQL = "WITH i AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS pub_date FROM orders)"


def issues(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").cast("date").alias("pub_date")).distinct()


@query(f"{ISSUES_SQL}, m AS (SELECT c_custkey AS q_id, make_date(1992 + (c_custkey % 8)::INT, 1 + (c_custkey % 12)::INT, 1) AS mentioned FROM customer), s AS (SELECT *, unnest(range(0, 4)) AS lag FROM m) SELECT q_id, mentioned, lag, (mentioned + lag * INTERVAL 1 MONTH)::DATE AS pub_date FROM s WHERE (mentioned + lag * INTERVAL 1 MONTH)::DATE IN (SELECT pub_date FROM i)")
def lag_join(spark, sf_dir):
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), F.make_date((1992 + F.col("c_custkey") % 8).cast("int"), (1 + F.col("c_custkey") % 12).cast("int"), F.lit(1)).alias("mentioned"))
    return C.lagged(asks, issues(spark, sf_dir)).withColumn("lag", F.col("lag").cast("long"))


@query(f"{ISSUES_SQL}, a AS (SELECT c_custkey AS q_id, 1992 + c_custkey % 8 AS year FROM customer) SELECT q_id, year, pub_date FROM a JOIN i ON pub_date BETWEEN make_date(year::INT - 1, 10, 1) AND make_date(year::INT, 9, 1)")
def fiscal_join(spark, sf_dir):
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), (1992 + F.col("c_custkey") % 8).cast("int").alias("year"))
    return C.fiscal_year(asks, issues(spark, sf_dir)).select("q_id", F.col("year").cast("long").alias("year"), "pub_date")


@query(f"{ISSUES_SQL}, a AS (SELECT c_custkey AS q_id, 1992 + c_custkey % 8 AS year FROM customer) SELECT q_id, year, pub_date FROM a JOIN i ON year(pub_date) BETWEEN year AND least(year + 6, 2025)")
def followup_join(spark, sf_dir):
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), (1992 + F.col("c_custkey") % 8).cast("int").alias("year"))
    return C.following_years(asks, issues(spark, sf_dir)).select("q_id", F.col("year").cast("long").alias("year"), "pub_date")


_ANCHOR_ASKS = "SELECT c_custkey AS q_id, ['national_defense', 'fd', 'individual_income_tax', 'cm'][1 + c_custkey % 4] AS family, 1992 + c_custkey % 8 AS year FROM customer"


@query(f"{ISSUES_SQL}, a AS ({_ANCHOR_ASKS}), r AS (SELECT * FROM {I.sql_values(I.RULES, 'family, shift, month')}) SELECT DISTINCT q_id, make_date((year + shift)::INT, month::INT, 1) AS pub_date FROM a JOIN r USING (family) WHERE make_date((year + shift)::INT, month::INT, 1) IN (SELECT pub_date FROM i)")
def anchor_semi(spark, sf_dir):
    family = F.element_at(T.strings(["national_defense", "fd", "individual_income_tax", "cm"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), family.alias("family"), (1992 + F.col("c_custkey") % 8).cast("int").alias("year"))
    return C.anchors(asks, inline(spark, I.RULES, "family string, shift int, month int"), issues(spark, sf_dir)).select("pub_date", "q_id")


@query(
    """WITH a AS (SELECT o_custkey AS q_id, date_trunc('month', o_orderdate)::DATE AS pub_date, 1 AS source_rank, o_orderkey AS pos FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_custkey, date_trunc('month', o_orderdate)::DATE, 2, o_orderkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY q_id, pub_date ORDER BY source_rank, pos) AS k FROM a)
    SELECT q_id, pub_date, source_rank, pos FROM r WHERE k = 1"""
)
def ordered_union_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id"), F.trunc("o_orderdate", "month").cast("date").alias("pub_date"), F.col("o_orderkey").alias("pos"), "o_orderpriority")
    first = rows.where("o_orderpriority = '1-URGENT'").withColumn("source_rank", F.lit(1)).drop("o_orderpriority")
    return C.ordered_union(first, rows.withColumn("source_rank", F.lit(2)).drop("o_orderpriority"))


# --- answers ----------------------------------------------------------------------------------------------------------


_PH = "|".join(L.PLACEHOLDERS)
_HD = "|".join(L.HEDGES)


@query(
    f"""SELECT a_id, (lower({sql_strip("answer")}) IN ({", ".join("'" + v + "'" for v in L.PLACEHOLDER_VALUES)}) OR regexp_matches(lower({sql_strip("answer")}), '{_PH}')) AS placeholder,
    regexp_matches(lower(answer), '{_HD}') AS hedged, {sql_any("lower(answer)", L.ECHOES)} AS echo, len(regexp_extract_all(answer, '\\|', 0)) >= 2 AS pipe_row,
    {sql_any("lower(question)", ["percent", "percentage", "%"])} AS asks_percent FROM {N}"""
)
def answer_checks(spark, sf_dir):
    a, q = F.col("answer"), F.col("question")
    return answers(spark, sf_dir).select("a_id", A.placeholder(a).alias("placeholder"), A.hedged(a).alias("hedged"), A.echo(a).alias("echo"), A.pipe_row(a).alias("pipe_row"), A.asks_percent(q).alias("asks_percent"))


@query(
    f"""WITH p AS (SELECT a_id, {sql_strip("answer")} AS t, list_transform(string_split({sql_strip("answer")}, ','), lambda p: trim({sql_strip("p")}, '[]() ')) AS parts FROM {N})
    SELECT a_id, regexp_matches(t, '^\\[[^\\]]+\\]$') OR (len(parts) >= 2 AND len(list_filter(parts, lambda p: regexp_matches(p, '^[-+]?\\$?[0-9][0-9,]*\\.?[0-9]*%?$'))) >= 2) AS is_list FROM p"""
)
def list_answer(spark, sf_dir):
    return answers(spark, sf_dir).select("a_id", A.list_answer(F.col("answer")).alias("is_list"))


_NTH = " ".join(f"WHEN {sql_any('lower(question)', [w + ' value', w + ' number'])} THEN {i}" for i, w in [(4, "fourth"), (3, "third"), (2, "second"), (1, "first")])


@query(f"""SELECT a_id, coalesce(TRY_CAST(regexp_extract(lower(question), '\\bcontaining\\s+([0-9]+)\\s+numbers?\\b', 1) AS INT), CASE {_NTH} WHEN {sql_any("lower(question)", ["slope and intercept", "inside square brackets", "enclosed brackets"])} THEN 2 END) AS n FROM {N}""")
def expected_list_length(spark, sf_dir):
    return answers(spark, sf_dir).select("a_id", A.expected_length(F.col("question")).alias("n"))


def _unit_sql(text: str, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{prefix}{u}') THEN '{u}'" for u in L.UNIT_WORDS) + " END"


_BARE = "regexp_replace(regexp_replace(trim({t}, '[]() '), '(?i)trillion|billion|million|thousand', '', 'g'), '\\$|,|percent|%|dollars', '', 'g')"
_TOKEN = f"TRY_CAST({sql_strip(_BARE.format(t=sql_strip('answer')))} AS DOUBLE)"


@query(f"SELECT a_id, {_unit_sql('answer')} AS unit, round({_TOKEN}, 6) AS value, {_unit_sql('question', 'in ')} AS target FROM {N}")
def parse_scalar(spark, sf_dir):
    return answers(spark, sf_dir).select("a_id", A.scalar_unit(F.col("answer")).alias("unit"), F.round(A.scalar_value(F.col("answer")).cast("double"), 6).alias("value"), A.question_unit(F.col("question")).alias("target"))


_BARE_NUMBER = sql_strip(_BARE.format(t=sql_strip("{t}")))


def sql_exact(token: str, by: str, otherwise: str) -> str:
    """A token's number times a power of ten, its point moved among its digits; ``otherwise`` for numbers written in other ways."""
    bare = _BARE_NUMBER.replace("{t}", token)
    parts = f"list_transform([{{'n': {bare}, 'd': {by}}}], lambda s: {{'neg': starts_with(s.n, '-'), 'g': regexp_replace(s.n, '[-+.]', '', 'g'), 'p': length(regexp_extract(s.n, '^[-+]?([0-9]*)', 1)) + s.d}})"
    padded = f"list_transform({parts}, lambda s: {{'neg': s.neg, 'p': greatest(s.p, 1), 'g': CASE WHEN s.p <= 0 THEN repeat('0', 1 - s.p) || s.g ELSE rpad(s.g, greatest(s.p, length(s.g))::INT, '0') END}})"
    halves = f"list_transform({padded}, lambda s: {{'neg': s.neg, 'w': regexp_replace(left(s.g, s.p), '^0+([0-9])', '\\1'), 'r': regexp_replace(substr(s.g, s.p + 1), '0+$', '')}})"
    text = f"list_transform({halves}, lambda s: CASE WHEN s.neg AND regexp_matches(s.w || s.r, '[1-9]') THEN '-' ELSE '' END || s.w || CASE WHEN s.r <> '' THEN '.' || s.r ELSE '' END)[1]"
    return f"CASE WHEN regexp_matches({bare}, '{A.PLAIN_NUMBER}') THEN {text} ELSE {otherwise} END"


_POW = "CASE {u} WHEN 'thousand' THEN 3 WHEN 'million' THEN 6 WHEN 'billion' THEN 9 WHEN 'trillion' THEN 12 END"


@query(
    f"""WITH s AS (SELECT a_id, answer, {_unit_sql("answer")} AS unit, {_TOKEN} AS v, {_unit_sql("question", "in ")} AS target FROM {N}),
    c AS (SELECT *, CASE WHEN unit IS NULL THEN v ELSE v * power(10.0, {_POW.format(u="unit")} - {_POW.format(u="target")}) END AS x, coalesce({_POW.format(u="unit")} - {_POW.format(u="target")}, 0) AS d FROM s),
    e AS (SELECT *, {sql_exact("answer", "d", "regexp_replace(regexp_replace(TRY_CAST(x AS DECIMAL(28, 8))::VARCHAR, '0+$', ''), '[.]$', '')")} AS number FROM c)
    SELECT a_id, CASE WHEN target IS NULL OR number IS NULL THEN {sql_strip("replace(answer, '$', '')")} ELSE number END AS answer FROM e"""
)
def unit_convert(spark, sf_dir):
    return answers(spark, sf_dir).select("a_id", A.convert(F.col("question"), F.col("answer")).alias("answer"))


@query(
    f"""WITH a AS (SELECT conv_id, turn, 'noise <FINAL_ANSWER>old</FINAL_ANSWER>' || chr(10) || text || chr(10) || CASE WHEN turn % 2 = 0 THEN '<FINAL_ANSWER> ' || length(text) || ' </FINAL_ANSWER>' ELSE '' END AS r FROM conversations)
    SELECT conv_id, turn, {sql_strip("list_last(regexp_extract_all(r, '(?is)<final_answer>(.*?)</final_answer>', 1))")} AS answer FROM a"""
)
def final_answer(spark, sf_dir):
    tag = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<FINAL_ANSWER> "), F.length("text").cast("string"), F.lit(" </FINAL_ANSWER>"))).otherwise("")
    reply = F.concat(F.lit("noise <FINAL_ANSWER>old</FINAL_ANSWER>\n"), F.col("text"), F.lit("\n"), tag)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.last_tag(reply).alias("answer"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, pos, answer): each turn of a conversation votes with a figure near those of the other turns, in one of several shapes."""
    rows = table(spark, sf_dir, "conversations")
    cents = (F.col("conv_id") % 40 + 1) * 37 * (100 + F.col("turn") * F.col("conv_id") % 5)
    whole = F.floor(cents / 100).cast("string")
    value = F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    answer = filled_shape(pick(I.VOTE_SHAPES, F.col("conv_id") * (F.col("turn") + 1) % len(I.VOTE_SHAPES)), {"v": value, "w": whole})
    return rows.select(F.col("conv_id").alias("q_id"), F.col("turn").alias("pos"), answer.alias("answer"))


_CENTS = "((conv_id % 40 + 1) * 37 * (100 + turn * conv_id % 5))"
VOTES = f"""(SELECT conv_id AS q_id, turn AS pos, {filled_shape_sql(f"{sql_list(I.VOTE_SHAPES)}[conv_id * (turn + 1) % {len(I.VOTE_SHAPES)} + 1]", {"v": f"{_CENTS} // 100 || '.' || lpad(({_CENTS} % 100)::VARCHAR, 2, '0')", "w": f"{_CENTS} // 100"})} AS answer FROM conversations)"""


@query(
    f"""WITH RECURSIVE a AS (SELECT q_id, pos, answer, regexp_replace({sql_strip("regexp_replace(answer, '[$,]', '', 'g')")}, '^\\((.+)\\)$', '-\\1') AS s FROM {VOTES}),
    p AS (SELECT *, TRY_CAST(nullif(regexp_extract(s, '[-+]?[0-9]+\\.?[0-9]*', 0), '') AS DOUBLE) * coalesce(CASE {_unit_sql("answer")} WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'trillion' THEN 1e12 END, 1) AS v FROM a),
    n AS (SELECT q_id, count(*) AS n, count(v) AS m FROM p GROUP BY q_id),
    o AS (SELECT q_id, answer, v, row_number() OVER (PARTITION BY q_id ORDER BY v, pos) AS i FROM p WHERE v IS NOT NULL),
    k AS (SELECT q_id, answer, v, i, v AS c, 1 AS k FROM o WHERE i = 1 UNION ALL SELECT o.q_id, o.answer, o.v, o.i,
        CASE WHEN abs(o.v - k.c) <= CASE WHEN k.c = 0 THEN 0.5 ELSE abs(k.c) * 0.02 END THEN k.c ELSE o.v END,
        CASE WHEN abs(o.v - k.c) <= CASE WHEN k.c = 0 THEN 0.5 ELSE abs(k.c) * 0.02 END THEN k.k ELSE k.k + 1 END FROM k JOIN o ON o.q_id = k.q_id AND o.i = k.i + 1),
    b AS (SELECT q_id, k, count(*) AS size FROM k GROUP BY q_id, k QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, k) = 1),
    w AS (SELECT k.q_id, k.answer FROM k JOIN b USING (q_id, k) QUALIFY row_number() OVER (PARTITION BY k.q_id ORDER BY k.i) = b.size // 2 + 1),
    t AS (SELECT q_id, answer FROM (SELECT q_id, pos, answer, count(*) OVER (PARTITION BY q_id, lower(answer)) AS n FROM p) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY n DESC, pos) = 1)
    SELECT n.q_id, CASE WHEN n.n > 1 AND n.m >= n.n * 0.5 THEN w.answer ELSE t.answer END AS winner FROM n LEFT JOIN w ON w.q_id = n.q_id JOIN t ON t.q_id = n.q_id"""
)
def vote_answers(spark, sf_dir):
    return V.vote(votes(spark, sf_dir))


@query(
    """SELECT q_id, winner, n FROM (SELECT o_custkey AS q_id, lower(o_orderpriority) AS l, count(*) AS n, min(o_orderkey) AS place, arg_min(o_orderpriority, o_orderkey) AS winner FROM orders GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY n DESC, place) = 1"""
)
def vote_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("answer"))
    return V.modal(rows)


def _compare_sql(text: str) -> str:
    a = f"regexp_replace(lower({sql_strip(text)}), '[$,]', '', 'g')"
    a = sql_strip(f"regexp_replace(regexp_replace({a}, '\\s+', ' ', 'g'), '%+$', '')")
    return f"CASE WHEN regexp_matches({a}, '^-?[0-9]+\\.0+$') THEN regexp_extract({a}, '^(-?[0-9]+)', 1) ELSE {a} END"


@query(
    f"""WITH n AS (SELECT * FROM {N}), p AS (SELECT a.a_id AS x, b.a_id AS y, {_compare_sql("a.answer")} AS p, {_compare_sql("b.answer")} AS e FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
    SELECT x, y, p = e OR coalesce(abs(TRY_CAST(p AS DOUBLE) - TRY_CAST(e AS DOUBLE)) < 0.01 * greatest(abs(TRY_CAST(e AS DOUBLE)), 1.0), false) AS same FROM p"""
)
def eval_match(spark, sf_dir):
    """A5: each answer against the one of the next turn."""
    a = answers(spark, sf_dir)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a_id").alias("y"), F.col("answer").alias("e"))
    return a.select("conv_id", "turn", F.col("a_id").alias("x"), F.col("answer").alias("p")).join(b, ["conv_id", "turn"]).select("x", "y", A.same_answer(F.col("p"), F.col("e")).alias("same"))


@query(
    """WITH r AS (SELECT d.lang, ((d.n_chars > 1000)::INT = l.quality)::INT AS ok FROM documents d JOIN labels l USING (doc_id))
    SELECT coalesce(nullif(lang, ''), 'unknown') AS grp, sum(ok)::BIGINT AS correct, count(*) AS total, sum(ok) / count(*) AS accuracy FROM r GROUP BY 1 UNION ALL SELECT 'all', sum(ok)::BIGINT, count(*), sum(ok) / count(*) FROM r"""
)
def eval_accuracy(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.accuracy(both.withColumn("correct", (F.col("n_chars") > 1000).cast("int") == F.col("quality")), "lang")


# --- tools, series, messages ------------------------------------------------------------------------------------------


@query("SELECT event_type, count(v) AS n, sum(v) AS total, avg(v) AS mean, min(v) AS low, max(v) AS high FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL GROUP BY event_type")
def json_aggregate(spark, sf_dir):
    return X.aggregate(table(spark, sf_dir, "events"), "event_type", "props", "k")


@query("SELECT event_id, props FROM events WHERE contains(lower(json_extract_string(props, '$.k')), '7')")
def json_search(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("data", F.concat(F.lit("["), F.col("props"), F.lit("]")))
    return rows.where(F.size(X.search(rows, "data", "k", "7")) > 0).select("event_id", "props")


@query(
    """WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT y, round(avg(v), 2) AS mean, round(exp(avg(ln(v))), 2) AS geometric_mean, round(median(v), 2) AS med, round(stddev_samp(v), 2) AS sd, round(regr_slope(v, m), 2) AS slope, round(regr_intercept(v, m), 2) AS intercept,
    round(corr(v, m), 6) AS r, round(sum(v * m) / sum(m), 2) AS weighted FROM m GROUP BY y"""
)
def series_stats(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("double").alias("m")).agg(F.sum("o_totalprice").cast("double").alias("v"))
    cell = lambda c, name, d=2: F.round(c, d).alias(name)
    return months.groupBy("y").agg(cell(F.avg("v"), "mean"), cell(F.exp(F.avg(F.ln("v"))), "geometric_mean"), cell(F.median("v"), "med"), cell(F.stddev_samp("v"), "sd"), cell(F.regr_slope("v", "m"), "slope"), cell(F.regr_intercept("v", "m"), "intercept"), cell(F.corr("v", "m"), "r", 6), cell(F.sum(F.col("v") * F.col("m")) / F.sum("m"), "weighted"))


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def message_merge(spark, sf_dir):
    return S.merge_parts(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("message").alias("digest"))
