"""Scores, candidates, contexts and answering on small inputs."""

import json

from pyspark.sql import functions as F

from tabulith.functions import answers as A
from tabulith.functions import scoring as S
from tabulith.functions import text as T
from tabulith.operators import answering as W
from tabulith.operators import candidates as K
from tabulith.operators import context as X
from tabulith.operators import scoring as O
from tabulith.operators import tables as B

DOC = "doc_id long, file_name string, pub_date string, text string"


def corpus(spark, texts):
    rows = [(i, f"treasury_bulletin_{y}_{m:02d}.txt", f"{y}-{m:02d}-01", t) for i, (y, m, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).withColumn("pub_date", F.col("pub_date").cast("date"))
    tables = O.scored_tables(docs)
    return docs, O.files(docs, tables), tables


def asks(spark, *questions):
    return S.with_conditions(spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "q_id string, question string"))


DEFENSE = "Table 2.- Analysis of national defense expenditures\n(In millions of dollars)\n| Calendar year | National defense |\n|---|---|\n| 1940 | 2,602 |\n"
FISCAL = "Table 1.- Summary of Fiscal Statistics\n(In millions of dollars)\n| Fiscal year | Budget expenditures |\n|---|---|\n| 1940 | 9,055 |\n"


def test_defense_table_before_fiscal_summary(spark):
    docs, files, tables = corpus(spark, [(1941, 1, DEFENSE + "\n\n" + "x\n" * 20 + FISCAL), (1950, 6, "nothing here"), (1942, 1, None), (1943, 1, "")])
    q = asks(spark, "What was the total national defense expenditure in calendar year 1940, in millions of dollars?")
    scored = {r.title: r.s for r in O.table_hits(tables, q).join(q).select("title", S.table_score().alias("s")).collect()}
    first = [t for t in scored if "defense" in t][0]
    assert all(scored[first] > s for t, s in scored.items() if t != first)
    ranked = O.two_stage(q, docs, files, tables).orderBy("rank").collect()
    assert ranked[0].doc_id == 0 and {r.doc_id: r.score for r in ranked}[3] == 0
    chosen = q.select("q_id", F.lit(0).cast("long").alias("doc_id"), F.lit(5000).alias("budget"))
    snippet = X.file_snippets(chosen, q, docs, tables).first().snippet
    assert snippet.startswith("TABLE TITLE: Table 2.- Analysis of national defense expenditures\nUNIT: (In millions of dollars)\n| Calendar year")


def fold(blocks, order, budget):
    """The choice of sections as a loop."""
    used, seen, out = 0, set(), []
    for i in order:
        for k in (i, i - 1, i + 1):
            if not 0 <= k < len(blocks) or k in seen or not blocks[k]:
                continue
            if used + len(blocks[k]) > budget and out:
                break
            out.append(blocks[k])
            seen.add(k)
            used += len(blocks[k]) + 2
            if used >= budget:
                break
        if used >= budget:
            break
    s = "\n\n".join(out).strip()
    return s if len(s) <= budget else s[:budget].rstrip() + "\n[...truncated...]"


def test_sections_where_no_table_scores(spark):
    part = "Total receipts of the fiscal year:\n" + "national defense in 1940 and words " * 4
    text = "\n".join(["prose of no use " * 6, part, "Debt outstanding in millions:\nplain words again", "Net balance in billions:\n" + "national defense " * 3, "tail"])
    docs, _, tables = corpus(spark, [(1941, 1, text), (1941, 2, "only plain words"), (1941, 3, None)])
    q = asks(spark, "What was national defense in 1940?")
    parts = B.section_texts(docs.where("doc_id = 0"))
    scores = {r.section_no: r.s for r in O.section_hits(parts, q).crossJoin(q).select("section_no", S.section_score().alias("s")).collect()}
    texts = [r.section for r in parts.orderBy("section_no").collect()]
    order = sorted((i for i, s in scores.items() if s > 0), key=lambda i: (-scores[i], i))
    assert len(texts) > 3 and order
    for budget in (40, 150, 250, 400, 5000):
        chosen = q.crossJoin(docs.select("doc_id")).select("q_id", "doc_id", F.lit(budget).alias("budget"))
        got = {r.doc_id: r.snippet for r in X.file_snippets(chosen, q, docs, tables).collect()}
        # all lines of these short sections are in one window, so a block is its section or, without signals, the same
        assert got[0] == fold(texts, order, budget), budget
        assert got[1] == "only plain words"[:budget] and 2 not in got


def test_narrowed_keeps_positions(spark):
    body = "\n".join(["| head |", "|---|", *(f"| row {i} {1900 + i} |" for i in range(100)), "|---|", "| total |"])
    rows = spark.createDataFrame([(body, "x 1950 total"), ("| a |\n| b |", "x 1950")], "body string, question string")
    got = rows.select(B.narrowed(F.col("body"), F.array(F.lit("1950")), T.strings([]), T.strings(["row 7"]), F.lit(False)).alias("b")).collect()
    assert got[0].b.split("\n") == ["| head |", "|---|", "| row 7 1907 |", "| row 50 1950 |", *(f"| row {i} {1900 + i} |" for i in range(70, 80)), "|---|", "| total |"]
    assert got[1].b == "| a |\n| b |"


def test_narrowed_columns_are_narrowed(spark):
    bodies = ["\n".join([f"| {'total ' if i % 7 == 0 else ''}row {i} {1940 + i % 20} |" for i in range(n)] + ["|---|"]) for n in (3, 42, 90)] + ["", "\n".join(f"r{i}" for i in range(60))]
    rows = spark.createDataFrame([(i, b, w) for i, b in enumerate(bodies) for w in (True, False)], "i int, body string, w boolean")
    rows = rows.withColumns({"y": T.strings(["1950"]), "m": T.strings([]), "t": T.strings(["row 7"])})
    want = {(r.i, r.w): r.b for r in rows.select("i", "w", B.narrowed(F.col("body"), F.col("y"), F.col("m"), F.col("t"), F.col("w")).alias("b")).collect()}
    assert {(r.i, r.w): r.body for r in B.with_narrowed(rows, "body", "y", "m", "t", "w").collect()} == want
    assert want[2, False].count("\n") < bodies[2].count("\n") and want[4, False].count("\n") == 41


def test_dates_point_to_issues(spark):
    issues = spark.sql("SELECT explode(sequence(DATE '1939-01-01', DATE '2025-12-01', interval 1 month)) AS pub_date")
    q = asks(
        spark,
        "What was X in March 1977?",
        "According to the June 1992 Treasury Bulletin, what is Y?",
        "What was the national defense expenditure in 1940?",
        "What were receipts in fiscal year 1985?",
        "2-year U.S. Treasury notes maturing at the end of July 1984: which issue date?",
        "no date",
    )
    rows = K.dated_candidates(q, issues).collect()
    by = lambda q_id, source: sorted(str(r.pub_date)[:7] for r in rows if r.q_id == q_id and r.source_rank == source)
    assert by("q0", 2) == ["1977-03", "1977-04", "1977-05", "1977-06"] and by("q1", 1) == ["1992-06"] and by("q1", 2) == ["1992-07", "1992-08", "1992-09"]
    assert by("q2", 3) == ["1941-01", "1941-02"] and by("q3", 4) == ["1984-10", "1984-11", "1984-12", *(f"1985-{m:02d}" for m in range(1, 10))]
    assert "1982-08" in by("q4", 3) and "1982-09" in by("q4", 3) and not any(r.q_id == "q5" for r in rows)
    assert all(r.pinned == (r.source_rank <= 3) or r.source_rank > 3 for r in rows)


def test_best_files_without_scores_are_spread(spark):
    rows = [("a", f"f{i}", i, i == 7, 0) for i in range(10)] + [("b", f"f{i}", i, i == 2, i) for i in range(10)] + [("c", "f1", 1, False, 9), ("c", "f2", 2, True, 1)]
    limits = spark.createDataFrame([(q, 3) for q in "abc"], "q_id string, max_files int")
    got = K.best_files(spark.createDataFrame(rows, "q_id string, file_name string, place int, pinned boolean, score int"), limits).orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.file_name) for r in got] == [("a", "f7"), ("a", "f0"), ("a", "f4"), ("b", "f2"), ("b", "f9"), ("b", "f8"), ("c", "f2"), ("c", "f1")]


def test_open_thoughts(spark):
    cases = [("<think>a</think> b", "b"), ("x <think>a <FINAL_ANSWER>1", "x"), ("x <think>a</FINAL_ANSWER> y", "x </FINAL_ANSWER> y"), ("plain", "plain"), ("", "")]
    rows = spark.createDataFrame(cases, "r string, e string").select("e", A.without_thoughts(F.col("r")).alias("g")).collect()
    assert all(r.e == r.g.lstrip() or r.e == r.g for r in rows), rows


def test_two_answerers(spark):
    q = asks(spark, "What is X?", "Fit a linear regression of national defense from 1940 to 1950, rounded to the nearest ten.", "What percent is Y of Z?")
    contexts = spark.createDataFrame([("q1", "the table says 42 million")], "q_id string, context string")
    first = lambda prompt, _: "<FINAL_ANSWER>41</FINAL_ANSWER>"
    second = lambda prompt, _: "so\n<FINAL_ANSWER>42</FINAL_ANSWER>" if "ROLLOUT FOCUS" in prompt else "0"
    got = {r.q_id: (r.answer, r.source, r.difficulty) for r in W.answer_batch(q, contexts, first, second=second).collect()}
    assert got == {"q0": ("41", "primary", "easy"), "q1": ("42", "cross_check", "hard"), "q2": ("41", "primary", "medium")}

    def fails(prompt, _):
        raise OSError("no model")

    assert {r.q_id: r.answer for r in W.answer_batch(q.where("q_id = 'q0'"), contexts, fails).collect()} == {"q0": "Error: no model"}


def test_evaluation_of_a_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text('uid,question,answer,difficulty\nUID0001,"How many, in all?","1,000",easy\nUID0002,What?,7%,\nUID0003,"Two\nlines",x,hard\n')
    answer = lambda rows: rows.select("q_id", F.when(F.col("q_id") == "UID0001", "$1000.0").when(F.col("q_id") == "UID0002", "7.2").alias("answer"))
    got = {r.grp: (r.correct, r.total) for r in W.run_eval(spark, str(tmp_path / "q.csv"), answer, str(tmp_path / "out")).collect()}
    assert got == {"all": (1, 3), "easy": (1, 1), "unknown": (0, 1), "hard": (0, 1)}
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert [r.total for r in W.run_eval(spark, str(tmp_path / "q.csv"), answer, str(tmp_path / "out"), uids=["UID0002"]).collect()] == [1, 1]


def test_tools():
    data = json.dumps([{"a": 1, "n": "Xy"}, {"a": None}, {"a": "2.5", "n": "z"}, {}])
    assert W.execute_tool("calculate", '{"expression": "sqrt(16) + 1"}') == "5.0"
    assert W.execute_tool("format_json", json.dumps({"json_string": '{"b":1,"a":[2]}'})) == '{\n  "b": 1,\n  "a": [\n    2\n  ]\n}'
    assert [W.execute_tool("aggregate", json.dumps({"data": data, "field": "a", "operation": o})) for o in ("sum", "avg", "min", "max", "count", "x")] == ["3.5", "1.75", "1.0", "2.5", "2", "Unknown operation"]
    assert json.loads(W.execute_tool("search_data", json.dumps({"data": data, "field": "n", "value": "x"}))) == [{"a": 1, "n": "Xy"}]
    assert W.execute_tool("run_python", "{}").startswith("Unknown tool") and W.execute_tool("calculate", "not json").startswith("Tool error") and W.execute_tool("aggregate", None).startswith("Tool error")


def test_months_beside_accents_are_no_words(spark):
    rows = spark.createDataFrame([("mar",), ("émar",), ("maré",), ("3 Mar 4  %",)], "x string")
    assert [r.s for r in rows.select(T.table_signal(F.col("x")).alias("s")).collect()] == [1, 0, 0, 6]


def test_audit_of_computed_answers(spark):
    """Only computed numbers are shown to the auditor; its failures and empty answers change nothing."""
    from tabulith.operators import answering as W

    rows = spark.createDataFrame(
        [(1, "What is the total, in percent?", "14"), (2, "Which month was it?", "May"), (3, "What is the sum?", "7"), (4, "What is the difference?", "9"), (5, "What is the mean?", None), (6, "What is the ratio?", "0.5")], "i int, question string, answer string"
    )

    def auditor(question, answer):
        if "sum" in question:
            raise ValueError("no")
        return {"14": "So it is:\n14%", "9": "  ", "May": "June"}.get(answer, answer)

    assert {r.i: r.answer for r in W.audited(rows, auditor).collect()} == {1: "14%", 2: "May", 3: "7", 4: "9", 5: None, 6: "0.5"}
    assert W.audited(rows) is rows
