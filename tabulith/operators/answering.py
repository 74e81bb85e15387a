"""Answering batches of questions: prompts, repeated runs of a pluggable answerer, cleaning, voting, choosing between two, evaluating."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import answers as A
from tabulith.functions import lexicon as L
from tabulith.functions import profile as P
from tabulith.functions import text as T
from tabulith.operators import evaluate as E
from tabulith.operators import routing as N
from tabulith.operators import tools as X
from tabulith.operators import voting as V
from tabulith.sources import corpus as S
from tabulith.sources.scratch import stash

#: Takes a prompt and how varied the answer may be (0: not at all), gives a response; an exception becomes an error text.
Answerer = Callable[[str, float], str]


def cleaned(rows: DataFrame, question: str = "question", response: str = "response") -> DataFrame:
    """Add ``answer``, the final answer of a response: the last tag's text, or the last line, bared, compacted, salvaged if it is a
    placeholder, at most 500 characters.  Each step is a column of its own, as the next reads it several times."""
    q = F.col(question)
    filled = lambda text: F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")
    out = rows.withColumn("_t", A.without_thoughts(F.coalesce(response, F.lit(""))))
    out = out.withColumns({"_lines": filled(F.col("_t")), "_tags": T.find_all(F.col("_t"), r"(?is)<final_answer>(.*?)</final_answer>", 1), "_why": filled(F.regexp_extract("_t", r"(?is)<reasoning>(.*?)</reasoning>", 1))})
    given = F.when(F.lower("_t").contains("<final_answer>"), T.strip(F.try_element_at("_tags", F.lit(-1)))).otherwise(F.try_element_at("_lines", F.lit(-1)))
    out = out.withColumn("_g", F.coalesce(given, F.lit("")))
    out = out.withColumn("_g", F.when((F.col("_g") == "") & (F.size("_why") > 0), A.without_preamble(F.try_element_at("_why", F.lit(-1)))).otherwise(F.col("_g")))
    out = out.withColumn("_g", F.when(F.lower("_g").contains("no answer found"), "Unable to determine from available data").otherwise(F.col("_g")))
    for step in (A.without_preamble, A.compact_last_line, A.best_compact_line, A.final_text):
        out = out.withColumn("_g", step(F.col("_g")))
    out = out.withColumn("_g", F.when(A.placeholder(F.col("_g")), A.salvaged(q, F.col("_g"), F.col("_t"))).otherwise(F.col("_g"))).withColumn("_g", A.final_text(F.col("_g")))
    cut = F.left("_g", F.lit(500))
    short = F.when(F.length("_g") > 500, F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)).otherwise(F.col("_g"))
    return out.withColumn("answer", short).drop("_t", "_lines", "_tags", "_why", "_g")


def prompts(asks: DataFrame, contexts: DataFrame) -> DataFrame:
    """(q_id, question, prompt): the context, if there is one, the hints for the question's shape and the question."""
    rows = asks.join(contexts.select("q_id", "context"), "q_id", "left").withColumn("_hints", P.strategy())
    data = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("REFERENCE DATA:\n\n"), F.col("context"), F.lit("\n\n---\n\n"))).otherwise("")
    return rows.withColumn("prompt", F.concat(data, F.lit("HOW TO SOLVE IT:\n"), F.col("_hints"), F.lit("\n\n---\n\nQUESTION:\n"), F.col("question"))).drop("_hints")


def rollouts(most: int) -> Column:
    """U16: how often a question is run: more often where runs differ."""
    wide = F.col("expects_regression") | F.col("expects_list") | F.col("expects_series_math")
    some = F.col("expects_sum") | F.col("expects_percent") | F.col("expects_difference") | F.col("wants_monthly_series") | F.col("prefers_country_claims")
    return F.when(F.lit(most <= 1), 1).when(wide, min(most, 3)).when(some, min(most, 2 if most < 3 else 3)).otherwise(1)


def runs(rows: DataFrame, most: int) -> DataFrame:
    """A row for each run (pos) of each question; runs after the first are told to look at something else."""
    out = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), rollouts(most) - 1)))
    focus = F.get(T.strings(L.PERSPECTIVES), F.least("pos", F.lit(len(L.PERSPECTIVES) - 1)))
    return out.withColumn("prompt", F.when(focus != "", F.concat(F.col("prompt"), F.lit("\n\nROLLOUT FOCUS:\n"), focus)).otherwise(F.col("prompt")))


def answered(rows: DataFrame, answerer: Answerer, variation: float = 0.2) -> DataFrame:
    """Add the answerer's response to each prompt.  It runs in Arrow batches on the executors, so as many calls are made at once as there are tasks.

    Responses are written before anything reads them, so that no call is made twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str, pos: int) -> str:
            try:
                return answerer(prompt, variation if pos else 0.0)
            except Exception as e:  # an answerer is foreign code: its error is the answer
                return f"<FINAL_ANSWER>Error: {e}</FINAL_ANSWER>"

        for batch in batches:
            yield pd.DataFrame({"q_id": batch["q_id"], "pos": batch["pos"], "response": [one(p, n) for p, n in zip(batch["prompt"], batch["pos"], strict=True)]})

    said = rows.select("q_id", "pos", "prompt").mapInPandas(run, "q_id string, pos int, response string")
    return rows.drop("prompt").join(stash(said, "responses"), ["q_id", "pos"])


def answer_batch(asks: DataFrame, contexts: DataFrame, answerer: Answerer, most: int = 1, second: Answerer | None = None) -> DataFrame:
    """(q_id, answer, source, difficulty) for each question (a string id).

    Each question is run as often as its shape asks for, up to ``most`` times, and the answers vote.  With a ``second`` answerer, questions
    that are not easy are asked once of the first, hard ones of the second too, and the better supported answer counts; ``source`` says which.
    """
    rows = stash(prompts(asks, contexts).withColumn("difficulty", P.difficulty()).withColumn("context", F.coalesce("context", F.lit(""))), "prompts")
    hard = F.lit(second is not None) & (F.col("difficulty") != "easy")
    voted = stash(cleaned(answered(runs(rows.where(~hard), most), answerer)).select("q_id", "pos", "answer"), "answers")
    winners = V.vote(voted).withColumnRenamed("winner", "answer")
    easy = rows.where(~hard).select("q_id", "difficulty").join(winners, "q_id", "left").select("q_id", F.coalesce("answer", F.lit("")).alias("answer"), F.lit("vote" if most > 1 else "primary").alias("source"), "difficulty")
    if second is None:
        return easy
    first = stash(cleaned(answered(rows.where(hard).withColumn("pos", F.lit(0)), answerer)).withColumnRenamed("answer", "primary"), "answers")
    focus = F.concat(F.col("prompt"), F.lit("\n\nROLLOUT FOCUS:\n" + L.PERSPECTIVES[1]))
    other = stash(cleaned(answered(rows.where(hard & (F.col("difficulty") == "hard")).withColumns({"pos": F.lit(0), "prompt": focus}), second)).select("q_id", F.col("answer").alias("cross")), "answers")
    flags = ["expects_regression", "expects_list", "expects_series_math", "wants_monthly_series", "expects_sum", "expects_percent", "expects_difference", "prefers_country_claims"]
    shaped = F.array_contains(F.array(*flags), True)
    both = first.join(other, "q_id", "left")
    source = F.when(F.col("cross").isNull(), "primary").otherwise(A.winner(shaped, F.col("context"), F.col("primary"), F.col("cross")))
    both = both.withColumn("source", source)
    kept = F.when((F.col("source") == "cross_check") & (F.col("cross") != ""), F.col("cross")).otherwise(F.col("primary"))
    return easy.union(both.select("q_id", kept.alias("answer"), "source", "difficulty"))


def audited(rows: DataFrame, auditor: Callable[[str, str], str] | None = None, question: str = "question", answer: str = "answer") -> DataFrame:
    """U8: replace answers that were computed (U7) by what an auditor makes of question and answer; without an auditor nothing changes.

    An auditor that fails or gives nothing leaves the answer as it is; what it gives is bared like an answer.  Answers that need no audit are
    not shown to it.
    """
    if auditor is None:
        return rows

    @F.pandas_udf("string")
    def ask(questions: pd.Series, answers: pd.Series, needed: pd.Series) -> pd.Series:
        def one(q: str | None, a: str | None) -> str | None:
            try:
                return auditor(q or "", a or "")
            except Exception:  # an auditor is foreign code: the answer stands
                return None

        return pd.Series([one(q, a) if n else None for q, a, n in zip(questions, answers, needed, strict=True)], dtype=object)

    said = rows.withColumn("_said", ask(F.col(question), F.col(answer), F.coalesce(A.needs_audit(F.col(question), F.col(answer)), F.lit(False))))
    bare = A.compact_last_line(A.without_preamble(T.strip(F.coalesce("_said", F.lit("")))))
    return said.withColumn(answer, F.when(bare != "", bare).otherwise(F.col(answer))).drop("_said")


def evaluate(answers: DataFrame, expected: DataFrame, group: str = "difficulty") -> tuple[DataFrame, DataFrame]:
    """Results (uid, expected, predicted, correct, group) by a keyed join of answers and expected rows (uid, answer, group), and their accuracy.

    A question without an answer counts as wrong.
    """
    given = answers.select(F.col("q_id").alias("uid"), F.col("answer").alias("predicted"))
    both = expected.select("uid", F.col("answer").alias("expected"), F.coalesce(F.col(group), F.lit("")).alias(group)).join(given, "uid", "left")
    results = both.withColumn("predicted", F.coalesce("predicted", F.lit("ERROR"))).withColumn("correct", A.same_answer(F.col("predicted"), F.col("expected")))
    return results, E.accuracy(results, group)


def run_eval(spark: SparkSession, path: str, answer: Callable[[DataFrame], DataFrame], report: str, uids: list[str] | None = None, difficulty: str | None = None, sample: int | None = None, seed: str = "0") -> DataFrame:
    """Read questions (SRC8), answer them, match them (S29), write the results as JSON (SRC9) and return the accuracy (A5).

    Only the questions ``uids`` are taken, or else a ``sample`` of so many; of these, those of a ``difficulty``.
    """
    rows = S.read_questions(spark, path)
    if uids:
        rows = rows.where(F.col("uid").isin(*uids))
    elif sample:
        rows = N.bottom_k(rows, "uid", sample, seed=seed)
    if difficulty:
        rows = rows.where(F.col("difficulty") == difficulty)
    results, accuracy = evaluate(answer(rows.select(F.col("uid").alias("q_id"), "question")), rows)
    S.write_report(results, report)
    return accuracy


# --- tools ------------------------------------------------------------------------------------------------------------


def _aggregate(data: str, field: str, operation: str) -> str:
    values = [float(row[field]) for row in json.loads(data) if row.get(field) is not None]
    if not values:
        return "No numeric values found for field"
    found = {"sum": sum, "avg": lambda v: sum(v) / len(v), "min": min, "max": max, "count": len}.get(operation)
    return str(found(values)) if found else "Unknown operation"


def _search(data: str, field: str, value: str) -> str:
    return json.dumps([row for row in json.loads(data) if field in row and value.lower() in str(row[field]).lower()], indent=2)


#: The tools an answerer may call, by name, with the names of their arguments.  Running foreign code is none of them.
TOOLS: dict[str, tuple[list[str], Callable[..., str]]] = {
    "calculate": (["expression"], lambda expression: str(X.evaluate(expression))),
    "format_json": (["json_string"], lambda json_string: json.dumps(json.loads(json_string), indent=2)),
    "search_data": (["data", "field", "value"], _search),
    "aggregate": (["data", "field", "operation"], _aggregate),
}


def execute_tool(name: str, arguments: str | None) -> str:
    """The result of a tool for arguments in JSON, or a text that says what went wrong."""
    if name not in TOOLS:
        return f"Unknown tool: {name}"
    names, tool = TOOLS[name]
    try:
        given = json.loads(arguments or "{}")
        return tool(*(given[n] for n in names))
    except Exception as e:  # whatever a model sends must not end a batch
        return f"Tool error: {type(e).__name__}"


def tool_results(calls: DataFrame, name: str = "tool", arguments: str = "arguments") -> DataFrame:
    """Add ``result`` to rows of tool calls, in Arrow batches."""

    @F.pandas_udf("string")
    def run(names: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([execute_tool(n, a) for n, a in zip(names, given, strict=True)], dtype=object)

    return calls.withColumn("result", run(F.col(name), F.col(arguments)))
