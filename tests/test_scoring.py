"""Features of texts that scores read."""

from pyspark.sql import functions as F

from tabulith.functions import rules as R
from tabulith.functions import scoring as S
from tabulith.operators import scoring as O
from tabulith.operators import tables as B
from tabulith.plans import queries as Q
from tabulith.plans import retrieval as V


def test_titles_meet_lines_by_their_numbers(spark):
    docs = spark.createDataFrame([(0, "TABLE FD-1. - Debt\n| a | b |\n| 1 | 2 |"), (1, "| a | b |\n| 1 | 2 |")], "doc_id long, text string")
    titles = B.block_titles(B.table_blocks(docs), docs)
    joins = [x for x in titles._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins) and any("line_no" in x for x in joins)
    assert {r.doc_id: r.full_title for r in titles.collect()} == {0: "TABLE FD-1. - Debt", 1: "Table block near line 1"}


def test_patterns_are_tried_where_a_word_of_theirs_stands(spark):
    assert S.literals(r"\b(?:jan|feb)[a-z.]*\b") == ["jan", "feb"] and S.literals(r"a{0,3}|word") == [] and S.literals(r"-?[0-9]+") == [] and S.literals("(?i)word") == []
    assert S.literals(r"\btable\s+5\b|\brevolving funds\b") == ["table", "revolving funds"]
    texts = [None, "", "net", "nets", "january 5 and may", "jan1 mar.b 1950", "table \n 5", "1950 " * 5, "1950 " * 900 + "1951", "x" * S.HEAD + " 1950" * 4, "veterans' administration", "3,000 1. 2 -7 8 9 10 11", "offerings of bills", "offerings of bills and notes"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = lambda r: (F.regexp_count("t", F.lit(r.pattern)) >= r.least) & (~F.col("t").rlike(r.unless) if r.unless else F.lit(True))
    for rules in (R.TABLE_RULES, R.FILE_RULES):
        fields = {r.field: F.col("t") for r in rules}
        want = F.array_compact(F.array(*(F.when(plain(r), i) for i, r in enumerate(rules)))).cast("array<int>")
        assert rows.where(~S.hits_of(rules, fields).eqNullSafe(want)).count() == 0


def test_lines_of_sections_are_looked_at_once(spark):
    text = "Total receipts:\n1950 1951 x1952\njan.b 5%\nissue date 1950\n\nmaying 1,950 2 3 4\n" + "net 1950\n" * 6
    f = S.with_section_features(spark.createDataFrame([(text,)], "section string"), "section", "f").first().f
    assert (f.n, f.dense, f.monthly, f.numeric, f.dates, f.percents, f.totals) == (11, 1, 2, 1, 3, 1, 7)
    assert f.line_years.count(1950) == 8 and f.line_years.count(1951) == 1 and f.table_years == [1950, 1951, 1952]


def test_a_pair_does_not_pay_for_long_tables(spark):
    head = "TABLE FD-1. - Debt\n| Year | Amount |\n"
    texts = [head + "| 1950 | 3,000 |\n" * n + "| 1951 | 19500 |\n| 1849 | 2 |" for n in (5, 6, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = S.with_conditions(spark.createDataFrame([("q", "What was the debt in 1950 and 1951?")], "q_id string, question string"))
    hits = O.table_hits(O.scored_tables(docs), q)
    rows = hits.crossJoin(q).select("doc_id", "features.text_years", S.table_score().alias("s")).orderBy("doc_id").collect()
    assert [r.text_years for r in rows] == [[1950] * n + [1951] for n in (5, 6, 6)]
    assert [r.s - rows[0].s for r in rows] == [0, 5, 10] and "text" not in hits.schema["features"].dataType.names


def test_codes_are_found_without_the_text_of_a_pair(spark):
    rows = [(i, f"treasury_bulletin_1950_0{i + 1}.txt", f"1950-0{i + 1}-01", t) for i, t in enumerate(["see fd-1a here", "see nothing here", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, file_name string, pub_date string, text string").withColumn("pub_date", F.col("pub_date").cast("date"))
    q = S.with_conditions(spark.createDataFrame([("q", "What is in FD-1A?")], "q_id string, question string")).withColumn("keywords", F.array(F.lit("zebra")))
    tables = O.scored_tables(docs)
    full = O.full_scores(docs.select(F.lit("q").alias("q_id"), "doc_id"), q, docs, O.files(docs, tables), tables)
    got = {r.doc_id: r.score for r in full.collect()}
    assert got[0] - got[1] == 30 and got[2] == got[3] == 0
    assert "norm_text" not in full._jdf.queryExecution().optimizedPlan().toString()


def test_every_section_of_a_long_file_is_scored(spark):
    """A section between the windows of a preview counts; a preview is read only where it is asked for."""
    prose = "plain words of no use " * 4 + "\n"
    best = "National defense expenditures:\n" + "national defense 1940 2,602 3,000 total\n" * 4
    rows = [(i, f"treasury_bulletin_1941_0{i + 1}.txt", f"1941-0{i + 1}-01", t) for i, t in enumerate([prose * 60 + best + prose * 160, prose * 220, best])]
    docs = spark.createDataFrame(rows, "doc_id long, file_name string, pub_date string, text string").withColumn("pub_date", F.col("pub_date").cast("date"))
    q = S.with_conditions(spark.createDataFrame([("q", "What was the total national defense expenditure in 1940?")], "q_id string, question string"))
    tables = O.scored_tables(docs)
    files = O.files(docs, tables)
    every = O.section_hits(B.section_texts(docs), q).crossJoin(q).groupBy("doc_id").agg(F.max(S.section_score()).alias("s"))
    want = {r.doc_id: r.s for r in every.collect()}
    got = {r.doc_id: (r.section, r.rank) for r in O.two_stage(q, docs, files, tables).collect()}
    assert {d: s for d, (s, _) in got.items()} == want and want[0] == want[2] > want[1]
    seen = O.full_scores(docs.select(F.lit("q").alias("q_id"), "doc_id"), q, docs, files, tables, preview=8000)
    assert {r.doc_id: r.section for r in seen.collect()}[0] < want[0]
    assert V.PREVIEW not in Q.ORACLE_SQL["two_stage_topk"] and V.PREVIEW in Q.ORACLE_SQL["find_sources"]
