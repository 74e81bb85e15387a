"""Queries that clean, salvage and compare answers, with DuckDB SQL over the same answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import answers as A
from tabulith.functions import lexicon as L
from tabulith.operators import answering as W
from tabulith.operators import functions as U
from tabulith.operators import routing as Z
from tabulith.operators import tools as X
from tabulith.plans import fixtures as I
from tabulith.plans.catalogue import _BARE, _HD, _NTH, _PH, N, _unit_sql, answers, filled_shape, pick, query, sql_any, sql_exact, sql_list, table
from tabulith.plans.retrieval import ASKS_SQL, BREAKS, asks, quoted, strip
from tabulith.sources.scratch import shared_dir
from tabulith.streaming import messages as M

#: A response around each answer; every third one has an empty tag, every fifth no tag.
REASONS = "\nThe total amount was 12.5 million in May 1950.\nIt grew by 0.25 from 1949.\nnot available: 99 billion\nshares [1, 2%, $3] and [4, x]\n"


def responses(spark, sf_dir):
    n = F.col("k")
    body = F.concat(F.lit("<think>77 percent</think>\n"), F.lit("<REASONING>\nFirst, "), F.col("answer"), F.lit(REASONS), F.lit("</REASONING>\n"))
    tag = F.when(n % 5 == 4, F.concat(F.lit("So\n"), F.col("answer"))).when(n % 3 == 2, F.lit("<FINAL_ANSWER> </FINAL_ANSWER>")).otherwise(F.concat(F.lit("<FINAL_ANSWER>old</FINAL_ANSWER><final_answer>\n"), F.col("answer"), F.lit("\n</final_answer>")))
    return answers(spark, sf_dir).withColumn("response", F.concat(body, tag))


_N = "num"
_REASONS = "'" + REASONS.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
RESPONSES = f"""(SELECT *, '<REASONING>' || chr(10) || 'First, ' || answer || {_REASONS} || '</REASONING>' || chr(10) ||
    CASE WHEN {_N} % 5 = 4 THEN 'So' || chr(10) || answer WHEN {_N} % 3 = 2 THEN '<FINAL_ANSWER> </FINAL_ANSWER>' ELSE '<FINAL_ANSWER>old</FINAL_ANSWER><final_answer>' || chr(10) || answer || chr(10) || '</final_answer>' END AS response FROM {N})"""


# --- SQL of the parts ------------------------------------------------------------------------------------------------


def filled(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, {BREAKS}), lambda l: {strip('l')}), lambda l: l <> '')"


def bare(t: str) -> str:
    words = r"\b(the|answer|based on|according|because|from|table|therefore)\b"
    return f"({t} <> '' AND NOT contains({t}, chr(10)) AND length({t}) <= 120 AND NOT regexp_matches(lower({t}), '{words}') AND (regexp_matches(lower({t}), '^(?:{L.SCALAR})$') OR regexp_matches({t}, '^[A-Za-z][A-Za-z0-9 ,.&()/-]{{0,80}}$')))"


def value(t: str) -> str:
    return f"TRY_CAST({strip(_BARE.format(t=strip(t)))} AS DECIMAL(28, 8))"


def shown(v: str) -> str:
    return f"regexp_replace(regexp_replace(({v})::DECIMAL(28, 8)::VARCHAR, '0+$', ''), '\\.$', '')"


def clean(t: str) -> str:
    return strip(f"replace(replace(replace({t}, '$', ''), 'percent', '%'), ' ', '')")


def year_like(t: str) -> str:
    return f"regexp_matches({strip(f'''regexp_replace(trim({strip(t)}, '[]() '), '[$]|%|percent|,', '', 'g')''')}, '^(?:19|20)[0-9]{{2}}$')"


def label(t: str) -> str:
    return f"regexp_matches({strip(t)}, '^[A-Za-z]{{1,3}}-[0-9]{{1,3}}[A-Za-z]?$')"


def placeholder(a: str) -> str:
    return f"(lower({strip(a)}) IN ({', '.join(quoted(v) for v in L.PLACEHOLDER_VALUES)}) OR regexp_matches(lower({strip(a)}), '{_PH}'))"


def listed(a: str) -> str:
    parts = f"list_transform(string_split({strip(a)}, ','), lambda p: trim({strip('p')}, '[]() '))"
    return f"(regexp_matches({strip(a)}, '^\\[[^\\]]+\\]$') OR (len({parts}) >= 2 AND len(list_filter({parts}, lambda p: regexp_matches(p, '^[-+]?\\$?[0-9][0-9,]*\\.?[0-9]*%?$'))) >= 2))"


_POWER = "CASE {u} WHEN 'thousand' THEN 3 WHEN 'million' THEN 6 WHEN 'billion' THEN 9 WHEN 'trillion' THEN 12 END"
_TARGET = _unit_sql("question", "in ")


def convert(a: str) -> str:
    unit = _unit_sql(a)
    by = f"{_POWER.format(u=unit)} - {_POWER.format(u=_TARGET)}"
    scaled = f"({value(a)}::DOUBLE * power(10.0, {by}))"
    number = sql_exact(a, f"coalesce({by}, 0)", f"CASE WHEN ({unit}) IS NULL THEN {shown(value(a))} ELSE {shown(scaled)} END")
    plain = strip(f"replace({a}, '$', '')")
    return f"CASE WHEN ({_TARGET}) IS NULL THEN {plain} ELSE coalesce({number}, {plain}) END"


_LENGTH = f"""coalesce(TRY_CAST(regexp_extract(lower(question), '\\bcontaining\\s+([0-9]+)\\s+numbers?\\b', 1) AS INT), CASE {_NTH} WHEN {sql_any("lower(question)", ["slope and intercept", "inside square brackets", "enclosed brackets"])} THEN 2 END)"""
_PERCENT = sql_any("lower(question)", ["percent", "percentage", "%"])
_SIGN = f"(contains(question, '%') OR {sql_any('lower(question)', L.PERCENT_SIGN)})"
_DATED = sql_any("lower(question)", L.DATE_ASKED)


def tokens(text: str) -> str:
    """Structs (line, i, j, t) of the scalars of lines that do not deny an answer, last line first."""
    lines = f"list_filter(list_reverse({filled(text)}), lambda l: NOT {sql_any('lower(l)', L.NEGATIVE_CONTEXT)})"
    each = f"flatten(list_transform({lines}, lambda l, i: list_transform(regexp_extract_all(l, '(?i){L.SCALAR}', 0), lambda t, j: {{'line': lower(l), 'i': i, 'j': j, 't': {strip('t')}}})))"
    return f"list_filter({each}, lambda x: {value('x.t')} IS NOT NULL AND NOT {label('x.t')})"


def best(scored: str) -> str:
    """The text of the struct (s, i, j, a) of the greatest score, the first of equals."""
    return f"list_sort(list_transform({scored}, lambda x: {{'s': -x.s, 'i': x.i, 'j': x.j, 'a': x.a}}))[1].a"


def percent(text: str) -> str:
    kept = f"list_filter({tokens(text)}, lambda x: NOT {year_like('x.t')})"
    cue = f"CASE WHEN {sql_any('x.line', L.PERCENT_CUES)} THEN 2 ELSE 0 END"
    explicit = f"contains({clean('x.t')}, '%')"
    v = value("x.t")
    said = best(f"list_transform(list_filter({kept}, lambda x: {explicit}), lambda x: {{'s': {cue} + 6, 'i': x.i, 'j': x.j, 'a': {clean('x.t')}}})")
    small = f"abs({v}) > 0 AND abs({v}) < 1"
    plain = best(f"list_transform(list_filter({kept}, lambda x: NOT {explicit}), lambda x: {{'s': {cue} + CASE WHEN {small} THEN 4 WHEN abs({v}) <= 1000 THEN 2 ELSE -10 END, 'i': x.i, 'j': x.j, 'a': {sql_exact('x.t', f'CASE WHEN {small} THEN 2 ELSE 0 END', shown(f'CASE WHEN {small} THEN {v} * 100 ELSE {v} END'))}}})")
    return f"coalesce(CASE WHEN {_SIGN} THEN {said} ELSE replace({said}, '%', '') END, CASE WHEN {_SIGN} THEN {plain} || '%' ELSE {plain} END)"


def scalar(text: str) -> str:
    kept = f"list_filter({tokens(text)}, lambda x: NOT {year_like('x.t')} OR {_DATED})"
    u, v = _unit_sql("x.t"), value("x.t")
    score = f"""CASE WHEN {sql_any("x.line", L.SCALAR_CUES)} THEN 3 ELSE 0 END - CASE WHEN {sql_any("x.line", L.MONTHS)} THEN 1 ELSE 0 END + CASE WHEN ({u}) = ({_TARGET}) THEN 8 WHEN ({u}) IS NOT NULL THEN 3 ELSE 0 END
        - CASE WHEN ({u}) IS NULL AND NOT {_PERCENT} AND abs({v}) > 0 AND abs({v}) < 1 THEN 6 ELSE 0 END + CASE WHEN contains(lower(question), 'full number') AND ({u}) IS NOT NULL THEN 2 ELSE 0 END"""
    given = f"CASE WHEN ({_TARGET}) IS NOT NULL THEN {convert('x.t')} ELSE {clean('x.t')} END"
    return best(f"list_transform({kept}, lambda x: {{'s': {score}, 'i': x.i, 'j': x.j, 'a': {given}}})")


def suspicious(a: str) -> str:
    t = strip(a)
    v, u = value(t), _unit_sql(t)
    return f"""CASE WHEN {t} = '' OR (coalesce({_LENGTH}, 0) > 0 AND NOT {listed(t)}) OR {label(t)} THEN true WHEN {year_like(t)} AND NOT {_DATED} THEN true WHEN {v} IS NULL THEN false
        WHEN {_PERCENT} THEN {year_like(t)} OR abs({v}) > 1000 ELSE (({_TARGET}) IS NOT NULL OR contains(lower(question), 'full number')) AND ({u}) IS NULL AND abs({v}) > 0 AND abs({v}) < 1 END"""


def normal_list(a: str) -> str:
    inner = f"substr({strip(a)}, 2, greatest(length({strip(a)}) - 2, 0))"
    return f"'[' || array_to_string(list_transform(list_filter(list_transform(string_split({inner}, ','), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {clean('p')}), ', ') || ']'"


def bracketed(text: str) -> str:
    parts = f"list_filter(list_transform(string_split(b, ','), lambda p: {strip('p')}), lambda p: p <> '')"
    cells = f"list_transform({parts}, lambda p: trim(p, '[]() '))"
    good = f"len({cells}) > 0 AND (({_LENGTH}) IS NULL OR len({cells}) = ({_LENGTH})) AND len(list_filter({cells}, lambda c: NOT regexp_matches(c, '(?i)^(?:{L.SCALAR})$'))) = 0"
    return f"list_filter(list_transform(regexp_extract_all({text}, '\\[([^\\]]+)\\]', 1), lambda b: CASE WHEN {good} THEN '[' || array_to_string(list_transform({cells}, lambda c: {clean('c')}), ', ') || ']' END), lambda s: s IS NOT NULL)[-1]"


def preamble(a: str) -> str:
    out = a
    for p in L.PREAMBLES:
        out = strip(f"regexp_replace({out}, {quoted('(?i)' + p)}, '', 'g')")
    return out


def final(a: str, names: str) -> str:
    """SELECT that adds S9 of column ``a`` as ``f``; the first steps are columns of their own, as each is read several times."""
    return f"SELECT *, CASE WHEN {sql_any('lower(e)', L.ECHOES)} OR len(regexp_extract_all(e, '\\|', 0)) >= 2 THEN '' ELSE e END AS {a} FROM (SELECT *, CASE WHEN ends_with(d, '.') AND len(regexp_split_to_array(d, '\\s+')) <= 6 THEN rtrim(left(d, -1)) ELSE d END AS e FROM (SELECT *, trim({strip(f'''trim({strip(a + '0')}, '`')''')}, '\"'' ') AS d FROM {names}))"


# --- queries -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT a_id, {_SIGN} AS percent_sign, {_DATED} AS dated, regexp_matches(answer, '[0-9]') AND regexp_matches(lower(question), '{L.AUDITED}') AS audited, {year_like('answer')} AS year_like, {label('answer')} AS label, {sql_any('lower(answer)', L.NEGATIVE_CONTEXT)} AS negative FROM {N}")
def answer_predicates(spark, sf_dir):
    """S13, S17, S19 and U7."""
    q, a = F.col("question"), F.col("answer")
    return answers(spark, sf_dir).select("a_id", A.wants_percent_sign(q).alias("percent_sign"), A.expects_date(q).alias("dated"), A.needs_audit(q, a).alias("audited"), A.year_like(a).alias("year_like"), A.table_label(a).alias("label"), A.negative_context(a).alias("negative"))


_STRIPPED = "list_transform(list_filter(regexp_split_to_array(answer, " + BREAKS + f"), lambda l: {strip('l')} <> ''), lambda l: trim(l, ' -*:' || chr(9)))"


@query(f"SELECT a_id, CASE WHEN len({filled('answer')}) >= 2 AND {bare('(' + filled('answer') + ')[-1]')} THEN ({filled('answer')})[-1] ELSE answer END AS last_line, coalesce(list_filter({_STRIPPED}, lambda l: {bare('l')})[-1], answer) AS best_line, {clean('answer')} AS clean FROM {N}")
def answer_lines(spark, sf_dir):
    """S6, S7 and S19."""
    a = F.col("answer")
    return answers(spark, sf_dir).select("a_id", A.compact_last_line(a).alias("last_line"), A.best_compact_line(a).alias("best_line"), A.clean_scalar(a).alias("clean"))


@query(f"SELECT a_id, {percent('response')} AS percent FROM {RESPONSES}")
def percent_answers(spark, sf_dir):
    """S20."""
    return responses(spark, sf_dir).select("a_id", A.percent_answer(F.col("question"), A.without_thoughts(F.col("response"))).alias("percent"))


@query(f"SELECT a_id, {normal_list('answer')} AS normal, {bracketed('response')} AS bracketed FROM {RESPONSES}")
def list_answers(spark, sf_dir):
    """S21."""
    return responses(spark, sf_dir).select("a_id", A.normal_list(F.col("answer")).alias("normal"), A.bracketed_list(F.col("response"), A.expected_length(F.col("question"))).alias("bracketed"))


@query(f"SELECT a_id, {scalar('response')} AS number FROM {RESPONSES}")
def scalar_answers(spark, sf_dir):
    """S22."""
    return responses(spark, sf_dir).select("a_id", A.scalar_candidate(F.col("question"), A.without_thoughts(F.col("response"))).alias("number"))


@query(f"SELECT a_id, {suspicious('answer')} AS suspicious FROM {N}")
def suspicious_answers(spark, sf_dir):
    """S23."""
    return answers(spark, sf_dir).select("a_id", A.suspicious(F.col("question"), F.col("answer")).alias("suspicious"))


_SALVAGED = f"""CASE WHEN coalesce({_LENGTH}, 0) > 0 THEN CASE WHEN {listed("answer")} THEN {normal_list("answer")} ELSE coalesce({bracketed("txt")}, answer) END
    ELSE coalesce(CASE WHEN {_PERCENT} AND poor THEN nullif({percent("txt")}, '') END, CASE WHEN poor OR {listed("answer")} THEN nullif({scalar("txt")}, '') END, CASE WHEN ({_TARGET}) IS NOT NULL THEN {convert("answer")} END,
    CASE WHEN contains(answer, '$') AND NOT contains(lower(question), 'dollar') AND NOT contains(lower(question), 'money') THEN {strip("replace(answer, '$', '')")} END, answer) END"""
_WITH_TEXT = "SELECT *, array_to_string(list_filter([answer, response], lambda x: x <> ''), chr(10)) AS txt, {p} OR {s} AS poor FROM {f}"


@query(f"SELECT a_id, {_SALVAGED} AS salvaged FROM ({_WITH_TEXT.format(p=placeholder('answer'), s='(' + suspicious('answer') + ')', f=RESPONSES)})")
def salvaged_answers(spark, sf_dir):
    """S24."""
    return responses(spark, sf_dir).select("a_id", A.salvaged(F.col("question"), F.col("answer"), A.without_thoughts(F.col("response"))).alias("salvaged"))


_TAGS = "regexp_extract_all(response, '(?is)<final_answer>(.*?)</final_answer>', 1)"
_GIVEN = f"CASE WHEN contains(lower(response), '<final_answer>') THEN {strip(_TAGS + '[-1]')} ELSE ({filled('response')})[-1] END"
_REASON = filled("regexp_extract(response, '(?is)<reasoning>(.*?)</reasoning>', 1)")
_BEST_OF = lambda c: f"coalesce(list_filter(list_transform(list_filter(regexp_split_to_array({c}, {BREAKS}), lambda l: {strip('l')} <> ''), lambda l: trim(l, ' -*:' || chr(9))), lambda l: {bare('l')})[-1], {c})"
CLEANED = f"""WITH r AS (SELECT *, {_GIVEN} AS g, ({_REASON})[-1] AS why FROM {RESPONSES}), r1 AS (SELECT *, CASE WHEN g = '' AND why IS NOT NULL THEN coalesce(nullif({preamble("why")}, ''), why) ELSE g END AS h FROM r),
    r2 AS (SELECT *, CASE WHEN contains(lower(h), 'no answer found') THEN 'Unable to determine from available data' ELSE h END AS k FROM r1), r3 AS (SELECT *, coalesce(nullif({preamble("k")}, ''), k) AS l FROM r2),
    r4 AS (SELECT *, CASE WHEN len({filled("l")}) >= 2 AND {bare("(" + filled("l") + ")[-1]")} THEN ({filled("l")})[-1] ELSE l END AS m FROM r3), r5 AS (SELECT *, {_BEST_OF("m")} AS n0 FROM r4),
    r6 AS ({final("n", "r5")}), r7 AS (SELECT a_id, question, n AS answer, response FROM r6), r8 AS ({_WITH_TEXT.format(p=placeholder("answer"), s="(" + suspicious("answer") + ")", f="r7")}),
    r9 AS (SELECT a_id, CASE WHEN {placeholder("answer")} THEN {_SALVAGED} ELSE answer END AS z0 FROM r8), r10 AS ({final("z", "r9")})"""


@query(f"{CLEANED} SELECT a_id, CASE WHEN length(z) > 500 AND contains(left(z, 500), ' ') THEN regexp_replace(left(z, 500), ' [^ ]*$', '') ELSE left(z, 500) END AS answer FROM r10")
def cleaned_answers(spark, sf_dir):
    """S25."""
    return W.cleaned(responses(spark, sf_dir).drop("answer")).select("a_id", "answer")


def compared(a: str) -> str:
    return f"regexp_replace(replace(lower(trim(trim({strip(a)}, '`'), '\"'' ')), ',', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


def error(a: str) -> str:
    return f"(lower({strip(a)}) IN ('', 'no answer found', 'unable to determine', 'unable to determine from available data') OR contains(lower({a}), 'error:'))"


def supported(a: str) -> str:
    return f"(x.{a} <> '' AND {compared('x.' + a)} <> '' AND length({compared('x.' + a)}) <= 120 AND contains({compared('x.context')}, {compared('x.' + a)}))"


CONTEXT = "Totals: 14, $129,124 million and March 1977; FD-1 gave 10102000000"
_PAIRED = f"(SELECT a_id, answer AS primary_, lead(answer) OVER (PARTITION BY conv_id ORDER BY turn) AS cross_, '{CONTEXT}' AS context, {_PERCENT} AS shaped FROM {N})"


@query(f"""SELECT a_id, CASE WHEN {error("x.primary_")} AND NOT {error("x.cross_")} THEN 'cross_check' WHEN {error("x.cross_")} THEN 'primary' WHEN {compared("x.primary_")} = {compared("x.cross_")} THEN 'agree'
    WHEN {supported("primary_")} AND NOT {supported("cross_")} THEN 'primary' WHEN {supported("cross_")} AND NOT {supported("primary_")} THEN 'cross_check' WHEN shaped THEN 'primary' ELSE 'cross_check' END AS winner,
    {supported("primary_")} AS supported, {compared("x.primary_")} AS compared FROM {_PAIRED} x WHERE cross_ IS NOT NULL""")  # fmt: skip
def hybrid_winners(spark, sf_dir):
    """U17 with S28, SC7 and SC8: each answer against that of the conversation's next turn."""
    cross = F.lead("answer").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = answers(spark, sf_dir).withColumn("cross", cross).where("cross is not null")
    context = F.lit(CONTEXT)
    a = F.col("answer")
    return both.select("a_id", A.winner(A.asks_percent(F.col("question")), context, a, F.col("cross")).alias("winner"), A.supported(a, context).alias("supported"), A.for_compare(a).alias("compared"))


@query(f"SELECT a_id, len(regexp_extract_all(answer, '[0-9]', 0)) AS digits, regexp_matches(lower(answer), '{_HD}') AS hedged, coalesce(nullif({preamble('answer')}, ''), answer) AS bare FROM {N}")
def bare_answers(spark, sf_dir):
    """S2 and S4."""
    a = F.col("answer")
    return answers(spark, sf_dir).select("a_id", F.regexp_count(a, F.lit("[0-9]")).cast("long").alias("digits"), A.hedged(a).alias("hedged"), A.without_preamble(a).alias("bare"))


_SHAPE3 = "expects_regression OR expects_list OR expects_series_math"
_SHAPE2 = "expects_sum OR expects_percent OR expects_difference OR wants_monthly_series OR prefers_country_claims"


@query(f"{ASKS_SQL} SELECT q_id, pos, CASE pos WHEN 0 THEN '' ELSE {sql_list(L.PERSPECTIVES)}[pos + 1] END AS focus FROM (SELECT q_id, unnest(range(CASE WHEN {_SHAPE3} THEN 3 WHEN {_SHAPE2} THEN 3 ELSE 1 END)) AS pos FROM asks)")
def rollout_plan(spark, sf_dir):
    """U16: the runs of each question and what each is told to look at."""
    rows = W.runs(asks(spark, sf_dir).withColumn("prompt", F.lit("p")), 3)
    return rows.select("q_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("prompt", r"(?s)^p(\n\nROLLOUT FOCUS:\n)?", "").alias("focus"))


def echo_length(prompt: str, variation: float) -> str:
    """A stand-in for a model: the length of the question, a little more in varied runs."""
    n = len(prompt.split("QUESTION:\n")[1].split("\n\nROLLOUT")[0]) + (1 if variation else 0)
    return f"<think>so</think><REASONING>\nIt has {n} characters.\n</REASONING>\n<FINAL_ANSWER>\n{n}.0\n</FINAL_ANSWER>"


@query(f"{ASKS_SQL} SELECT q_id, CASE WHEN {_SHAPE3} OR {_SHAPE2} THEN (length(question) + 1)::VARCHAR || '.0' ELSE length(question)::VARCHAR || '.0' END AS answer FROM asks")
def answer_batch(spark, sf_dir):
    """U10 to U19 with a stand-in for the model; of three runs the middle answer of the one cluster wins."""
    none = spark.createDataFrame([], "q_id string, context string")
    return W.answer_batch(asks(spark, sf_dir), none, echo_length, most=3).select("q_id", "answer")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN (turn * 2.0 + 1)::DOUBLE::VARCHAR WHEN turn % 4 = 1 THEN (turn + length(text))::DOUBLE::VARCHAR WHEN turn % 4 = 2 THEN 'Unknown tool: run' ELSE 'No numeric values found for field' END AS result FROM conversations WHERE text IS NOT NULL")
def tool_calls(spark, sf_dir):
    """A tool call for each turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null").select("conv_id", "turn", F.length("text").alias("n"))
    turn = F.col("turn").cast("string")
    tool = F.get(F.array(F.lit("calculate"), F.lit("aggregate"), F.lit("run"), F.lit("aggregate")), (F.col("turn") % 4).cast("int"))
    data = F.to_json(F.array(F.struct(F.col("turn").alias("v")), F.struct(F.col("n").alias("v"))))
    given = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.concat(turn, F.lit(" * 2.0 + 1")).alias("expression")))).otherwise(
        F.to_json(F.struct(data.alias("data"), F.when(F.col("turn") % 4 == 1, "v").otherwise("w").alias("field"), F.lit("sum").alias("operation")))
    )
    return W.tool_results(rows.select("conv_id", "turn", tool.alias("tool"), given.alias("arguments"))).select("conv_id", "turn", "result")


@query(
    """WITH e AS (SELECT o_custkey AS uid, count(*)::VARCHAR AS answer, CASE WHEN o_custkey % 3 = 0 THEN 'hard' WHEN o_custkey % 3 = 1 THEN 'easy' ELSE '' END AS difficulty, count(*) AS n FROM orders GROUP BY o_custkey),
    r AS (SELECT difficulty, n::DOUBLE = n + (uid % 2) OR abs((n + (uid % 2)) - n) < 0.01 * greatest(n, 1) AS ok FROM e)
    SELECT coalesce(nullif(difficulty, ''), 'unknown') AS grp, sum(ok::INT)::BIGINT AS correct, count(*) AS total, sum(ok::INT) / count(*) AS accuracy FROM r GROUP BY 1 UNION ALL SELECT 'all', sum(ok::INT)::BIGINT, count(*), sum(ok::INT) / count(*) FROM r"""
)
def eval_driver(spark, sf_dir):
    """Answers matched with expected ones by their key."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("uid") % 3 == 0, "hard").when(F.col("uid") % 3 == 1, "easy").otherwise("")
    expected = rows.select("uid", F.col("n").cast("string").alias("answer"), level.alias("difficulty"))
    answers_ = rows.select(F.col("uid").alias("q_id"), F.concat(F.lit("$"), (F.col("n") + F.col("uid") % 2).cast("string"), F.lit(".0")).alias("answer"))
    return W.evaluate(answers_, expected)[1]


@query(
    """WITH e AS (SELECT o_custkey AS uid, count(*) AS n, CASE WHEN o_custkey % 3 = 0 THEN 'hard' WHEN o_custkey % 3 = 1 THEN 'easy' ELSE '' END AS difficulty FROM orders GROUP BY o_custkey)
    SELECT uid, difficulty, n FROM e QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5('7:' || uid), uid) <= 25"""
)
def sampled_questions(spark, sf_dir):
    """25 keys of each difficulty by the least digests."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("uid") % 3 == 0, "hard").when(F.col("uid") % 3 == 1, "easy").otherwise("")
    return Z.bottom_k(rows.withColumn("difficulty", level), "uid", 25, "difficulty", "7").select("uid", "difficulty", "n")


_B1 = f"SELECT *, coalesce(nullif({preamble('answer')}, ''), answer) AS bare, coalesce(nullif({preamble('answer')}, ''), answer) AS final0 FROM {N}"
_NUM = f"^{L.NUMBER}$"
_STRIP_DOTS = f"regexp_replace({strip('answer')}, '\\.+$', '')"
_PCT = f"CASE WHEN {_PERCENT} AND NOT contains(answer, '%') AND NOT contains(lower(answer), 'percent') AND regexp_matches({_STRIP_DOTS}, '{_NUM}') THEN {_STRIP_DOTS} || '%' ELSE answer END"
_VALUES = f"list_filter(list_transform(regexp_extract_all(answer, '{L.NUMBER}', 0), lambda n: replace(n, ',', '')), lambda n: NOT (TRY_CAST(n AS DOUBLE) BETWEEN 1900 AND 2100 AND NOT contains(n, '.')))"


@query(
    f"""SELECT a_id, bare, final, {bare(strip('bare'))} AS is_bare, CASE WHEN {sql_any("lower(question)", ["in dollars", "dollar amount", "how much money"])} AND NOT contains(v, '$') AND NOT contains(lower(v), 'dollar') AND regexp_matches({strip("v")}, '{_NUM}') THEN '$' || {strip("v")} ELSE v END AS verified,
    len(list_distinct(list_transform({_VALUES}, lambda n: TRY_CAST(n AS DOUBLE)))) > 1 AS several FROM (SELECT *, {_PCT} AS v FROM ({final("final", f"({_B1})")}))"""
)
def answer_clean(spark, sf_dir):
    """S1, S3, S4, S5 and S9."""
    a = F.col("answer")
    rows = answers(spark, sf_dir).withColumn("bare", A.without_preamble(a))
    return rows.select("a_id", "bare", A.final_text(F.col("bare")).alias("final"), A.bare_value(F.col("bare")).alias("is_bare"), A.verify(F.col("question"), a).alias("verified"), A.several_numbers(a).alias("several"))


_AT = "(o_orderkey % 1000)"


@query(
    f"""SELECT o_orderkey AS e_id, CASE o_orderkey % 5 WHEN 0 THEN (sqrt({_AT}::DOUBLE) + 8)::VARCHAR WHEN 1 THEN round((({_AT} + 5)::DOUBLE) / 7, 4)::VARCHAR WHEN 2 THEN 'error: ValueError'
    WHEN 3 THEN 'error: ZeroDivisionError' ELSE (greatest({_AT}, 9) % 4)::DOUBLE::VARCHAR END AS result FROM orders"""
)
def calculate(spark, sf_dir):
    """U4: an expression for each order."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("e_id"), filled_shape(pick(I.EXPRESSIONS, key % 5), {"n": key % 1000}).alias("expression"))
    return rows.select("e_id", X.calculate("expression").alias("result"))


_PAYLOADS = """(SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS data, list(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events GROUP BY user_id)"""
_OPERATIONS = ["sum", "avg", "min", "max", "count", "median"]


def payloads(spark, sf_dir):
    """A view of a JSON array for each user's events; for every ninth user it is broken."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("_p"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("_p", lambda p: p["props"]), ","), F.lit("]"))
    rows.select("user_id", F.when(F.col("user_id") % 9 == 0, F.concat(F.rtrim(whole, F.lit("]")), F.lit(","))).otherwise(whole).alias("data")).createOrReplaceTempView("payloads")
    U.register(spark)


@query(
    f"""WITH p AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS vs, {sql_list(_OPERATIONS)}[user_id % 6 + 1] AS operation FROM {_PAYLOADS})
    SELECT user_id, operation, CASE WHEN user_id % 9 = 0 THEN 'Tool error: JSONDecodeError' WHEN user_id % 7 = 0 OR len(vs) = 0 THEN 'No numeric values found for field' ELSE CASE operation WHEN 'sum' THEN list_sum(vs)::DOUBLE::VARCHAR
    WHEN 'avg' THEN round(list_sum(vs) / len(vs), 6)::VARCHAR WHEN 'min' THEN list_min(vs)::VARCHAR WHEN 'max' THEN list_max(vs)::VARCHAR WHEN 'count' THEN len(vs)::VARCHAR ELSE 'Unknown operation' END END AS result FROM p"""
)
def tool_aggregate_sql(spark, sf_dir):
    """U1 and A1 from SQL: an operation over each user's events, with the texts of what goes wrong."""
    payloads(spark, sf_dir)
    operations = ", ".join(f"'{o}'" for o in _OPERATIONS)
    return spark.sql(f"""WITH r AS (SELECT user_id, element_at(array({operations}), CAST(user_id % 6 + 1 AS INT)) AS operation, json_aggregate(data, CASE WHEN user_id % 7 = 0 THEN 'zz' ELSE 'k' END, element_at(array({operations}), CAST(user_id % 6 + 1 AS INT))) AS result FROM payloads)
        SELECT user_id, operation, CASE WHEN operation = 'avg' AND try_cast(result AS DOUBLE) IS NOT NULL THEN CAST(round(CAST(result AS DOUBLE), 6) AS STRING) ELSE result END AS result FROM r""")


@query("SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE user_id % 9 <> 0 AND contains(json_extract_string(props, '$.k'), '7') GROUP BY ALL")
def tool_search_sql(spark, sf_dir):
    """U6 from SQL: the objects that a search finds in each user's events, as rows of a table function."""
    payloads(spark, sf_dir)
    return spark.sql("SELECT user_id, r.k, count(*) AS n FROM (SELECT user_id, '[' || array_join(json_search(data, 'k', '7'), ',') || ']' AS found FROM payloads), LATERAL json_rows(found, 'k') r GROUP BY user_id, r.k")


@query("SELECT conv_id, count(*) AS n_parts, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def streamed_messages(spark, sf_dir):
    """SRC10 to SRC12 as a stream: parts arrive in six files, the turns of a conversation mixed, and are merged and written batch by batch."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows.repartition(6, "turn").write.parquet(f"{folder}/parts")
    parts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/parts")
    M.write_messages(M.merged(parts), f"{folder}/messages", f"{folder}/checkpoint").awaitTermination()
    return M.latest(spark, f"{folder}/messages").select("conv_id", "n_parts", F.md5("message").alias("digest"))
