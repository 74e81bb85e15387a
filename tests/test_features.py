"""Postings and block-max ranking, routing and samples, cells of tables, and bulletin files as a data source, each against plain Python."""

import datetime
import math
import random
import re
import statistics as st

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from tabulith.functions import lexicon as L
from tabulith.operators import cells as Y
from tabulith.operators import postings as N
from tabulith.operators import routing as W
from tabulith.sources import bulletin_files as D


def test_phrase_counts_are_those_of_replacing():
    rng = random.Random(1)
    phrases = ["a", "aa", "aba", "b a", "ab", "é", "longer phrase", "phrase"]
    machine = N.automaton(phrases)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b", " ", "é", "longer phrase"], k=rng.randrange(25)))
        assert {phrases[i]: n for i, n in N.counts(text, machine).items()} == {p: text.count(p) for p in phrases if p in text}
    assert N.automaton([]) is None and N.automaton([""]) is None


def test_phrase_hits(spark):
    texts = spark.createDataFrame([(1, "net debt, net receipts", "x"), (2, None, "y"), (3, "", None), (4, "nothing", "z"), (1, "net", "x")], "id int, t string, hits string")
    phrases = spark.createDataFrame([("net",), ("net debt",), ("receipts",), ("zzz",)], "phrase string")
    want = [(1, "x", [("net", 1)]), (1, "x", [("net", 2), ("net debt", 1), ("receipts", 1)]), (2, "y", []), (3, "", []), (4, "z", [])]
    key = lambda out: sorted((r.id, r.hits or "", sorted(r.found.items())) for r in out.collect())
    assert key(N.phrase_hits(texts, phrases, {"t": "found"})) == want
    # more phrases than one automaton may hold
    single = texts.limit(4)
    assert key(N.phrase_hits(single, phrases, {"t": "found"}, most=2)) == [w for w in want if w != (1, "x", [("net", 1)])]
    assert key(N.phrase_hits(single, phrases.limit(0), {"t": "found"})) == sorted((r.id, r.hits or "", []) for r in single.collect())


@pytest.mark.parametrize("dense", [True, False])
def test_block_max_is_the_full_ranking(spark, dense):
    rng = random.Random(dense)
    features = [f"k:{i}" for i in range(12)] + [f"t:{i}" for i in range(9)]
    posts = [(d, f, rng.randrange(1, 6)) for d in range(300) for f in features if rng.random() < (0.15 if dense else 0.004)]
    asked = []
    for q in range(14):
        for f in rng.sample(features, rng.randrange(0, 10)):
            asked.append((f"q{q}", f, 0, 3, rng.randrange(1, 9)) if f[0] == "k" else (f"q{q}", f, 1, 5, 8))
    names = [(d, f"file{(d * 37) % 300:03d}", f"{d // 40}") for d in range(300)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = N.block_max_topk(
        frame(posts, "doc int, feature string, n int"), frame(asked, "q_id string, feature string, kind int, cap int, weight int"), frame([(f"q{q}",) for q in range(15)], "q_id string"), frame(names, "doc int, name string, block string"), "doc", "name", 7
    )
    held = {(d, f): n for d, f, n in posts}
    want = []
    for q in range(15):
        mine = [a[1:] for a in asked if a[0] == f"q{q}"]
        rows = []
        for d, name, _ in names:
            words = sum(min(held.get((d, f), 0), cap) * w for f, kind, cap, w in mine if kind == 0)
            terms = min(sum((d, f) in held for f, kind, *_ in mine if kind == 1), 5) * 8
            rows.append((-(words + terms), name, d))
        want += [(f"q{q}", d, name, -s, i + 1) for i, (s, name, d) in enumerate(sorted(rows)[:7])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_question_meets_all_files(spark):
    """Plans of the cheap stage hold neither a product nor a nested loop."""
    from tabulith.plans import retrieval as V

    frame = V.cheap_file_scores(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Cross" not in plan


def route(text):
    low = text.lower()
    words = set(re.findall(r"\b\w+\b", low))
    n = {k: sum(p in low for p in v) for k, v in L.ROUTE_PHRASES.items()} | {k: len(words & set(v)) for k, v in L.ROUTE_WORDS.items()}
    if n["strong"] or n["context"] >= 2 or n["weak"] and n["fiscal"]:
        return "officeqa"
    if n["crm"] >= 2:
        return "crm"
    if n["bwim"] >= 2 or n["bwim"] and not n["financial"]:
        return "bwim"
    return "financial" if n["financial"] >= 2 else "general"


def test_routes(spark):
    rng = random.Random(2)
    pool = [*L.ROUTE_PHRASES["context"], *L.ROUTE_PHRASES["weak"], "Treasury Bulletin", "lead", "deal", "Élead", "sales stage", "create", "bond", "GDP", "receipts", "word", "make_up", "budget"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(5))) for _ in range(300)] + [""]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string")
    got = {r.id: r.task for r in W.routed(frame, "id").collect()}
    assert got == {i: route(t) for i, t in enumerate(texts)} | {999: "general"}
    assert set(got.values()) == {"officeqa", "crm", "bwim", "financial", "general"}


def test_bottom_k_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(1000).select(F.col("id").alias("uid"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("level"))
    key = lambda df: sorted((r.level or "", r.uid) for r in df.collect())
    whole = key(W.bottom_k(rows, "uid", 9, "level", "s"))
    assert len(whole) == 36 and whole == key(W.bottom_k(rows.repartition(7, "uid"), "uid", 9, "level", "s"))
    halves = [W.bottom_k(rows.where(f"uid % 2 = {i}"), "uid", 9, "level", "s") for i in range(2)]
    assert whole == key(W.bottom_k(halves[0].union(halves[1]), "uid", 9, "level", "s"))
    assert whole != key(W.bottom_k(rows, "uid", 9, "level", "t"))
    assert len(key(W.bottom_k(rows, "uid", 50))) == 50 and key(W.bottom_k(rows.limit(0), "uid", 5)) == []


def test_cells(spark):
    bodies = [
        ("a", "| Month | Amount | |\n|---|:--|--|\n| January 1950 | 1,200 | x |\n| 1951 | (3.5%) | $ 7 | extra |\n| short |", "(In millions of dollars)"),
        ("b", "| Year | 1950 | 1951 |\n| receipts | 10 | n.a. |", ""),
        ("c", "| 5 | 6 |\n| 7 | -8 |", "in thousands"),
        ("d", "| Total | of |\n| debt | notes |\n|--|--|\n|--|--|\n| May 1960 | 4 |", None),
        ("e", None, None),
        ("f", "", ""),
    ]
    got = Y.cells(spark.createDataFrame(bodies, "id string, body string, unit_hint string"), ["id"]).orderBy("id", "row_no", "col_no").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, 1, "January 1950", "Amount", "1,200", 1200.0, 6), ("a", 0, 2, "January 1950", "", "x", None, 6), ("a", 1, 1, "1951", "Amount", "(3.5%)", -3.5, 6), ("a", 1, 2, "1951", "", "$ 7", 7.0, 6), ("a", 1, 3, "1951", "", "extra", None, 6),
        ("b", 0, 1, "receipts", "1950", "10", 10.0, 0), ("b", 0, 2, "receipts", "1951", "n.a.", None, 0),
        ("c", 0, 1, "5", "", "6", 6.0, 3), ("c", 1, 1, "7", "", "-8", -8.0, 3),
        ("d", 0, 1, "May 1960", "of notes", "4", 4.0, 0),
    ]
    series = Y.series(Y.cells(spark.createDataFrame(bodies, "id string, body string, unit_hint string"), ["id"]), ["id"]).orderBy("id", "period", "value").collect()
    assert [(r.id, str(r.period), r.value) for r in series] == [("a", "1950-01-01", 1200.0), ("a", "1951-01-01", -3.5), ("a", "1951-01-01", 7.0), ("d", "1960-05-01", 4.0)]


def test_series_statistics(spark):
    values = [(1.0, 3.0), (2.0, 5.5), (3.0, 4.0), (4.0, 9.26)]
    frame = spark.createDataFrame([("k", *v) for v in values] + [("one", 2.0, 7.0), ("neg", 1.0, -4.0)], "key string, x double, y double")
    got = {r.key: r.asDict() for r in Y.statistics(frame, ["key"], "x", "y").collect()}
    xs, ys = zip(*values, strict=True)
    slope, intercept = st.linear_regression(xs, ys)
    want = {"n": 4, "mean": st.mean(ys), "geometric_mean": st.geometric_mean(ys), "med": st.median(ys), "sd": st.stdev(ys), "slope": slope, "intercept": intercept, "weighted": sum(x * y for x, y in values) / sum(xs)}
    assert {k: round(v, 2) for k, v in want.items()} == {k: got["k"][k] for k in want} and got["k"]["r"] == round(st.correlation(xs, ys), 6)
    assert got["neg"]["geometric_mean"] is None and got["one"]["sd"] is None and math.isclose(got["one"]["weighted"], 7.0)


def test_series_of_equal_months_have_no_slope(spark):
    rows = [(60, float(v % 3), 0.1) for v in range(200)] + [(61, 1.0, 2.0), (61, 2.0, None), (62, 1.0, 2.0), (62, 2.0, 5.0)]
    # counts of tasks by which a mean of equal values is not quite that value, 49 the least
    equal = spark.range(0, 60 * 7 * 49, 1, 7).selectExpr("cast(id % 60 as int) AS key", "cast(1 + id % 12 as double) AS x", "cast(id * 7919 % 500000 as double) AS y")
    frame = spark.createDataFrame(rows, "key int, x double, y double").union(equal)
    got = {r.key: (r.slope, r.intercept, r.r) for r in Y.statistics(frame, ["key"], "x", "y").collect()}
    assert all(got[k] == (None, None, None) for k in [*range(60), 61])
    assert got[60] == (0.0, 0.1, None) and got[62] == (3.0, -1.0, 1.0)


def test_bulletin_files(spark, tmp_path):
    D.register(spark)
    folder = tmp_path / "files"
    rows = [(f"treasury_bulletin_{y}_{m:02d}.txt", f"text of {y} {m}\né") for y in (1949, 1950, 1951) for m in range(1, 13)]
    written = spark.createDataFrame(rows, "file_name string, text string").repartition(5)
    written.write.format("bulletins").mode("append").save(str(folder))
    assert sorted(p.name for p in folder.iterdir()) == sorted(n for n, _ in rows)
    (folder / "treasury_bulletin_1950_13.txt").write_text("no month")
    (folder / "treasury_bulletin_1948_01.txt").write_bytes(b"\xff\xfe broken")
    (folder / "notes.txt").write_text("other")
    load = lambda **o: spark.read.format("bulletins").options(files_a_task="4", **o).load()
    got = {r.file_name: (r.year, r.month, r.pub_date, r.text) for r in load(roots=f"{tmp_path}/missing,,{folder}").collect()}
    assert len(got) == 38 and got["treasury_bulletin_1948_01.txt"] == (1948, 1, datetime.date(1948, 1, 1), "") and got["treasury_bulletin_1950_13.txt"] == (None, None, None, "no month")
    assert got["treasury_bulletin_1950_02.txt"][3] == "text of 1950 2\né"
    some = load(path=str(folder)).where("year = 1950 and month in (1, 2) and text like '%2%'")
    assert [r.file_name for r in some.collect()] == ["treasury_bulletin_1950_02.txt"]
    assert load(roots=f"{tmp_path}/none").count() == 0
    # pruned files are not even listed for a task
    reader = D.BulletinReader([str(folder)], 4)
    left = list(reader.pushFilters([EqualTo(("year",), 1950), GreaterThan(("month",), 10), StringContains(("text",), "x"), In(("file_name",), ("treasury_bulletin_1950_11.txt", "z"))]))
    assert [type(f) for f in left] == [StringContains] and [f[0] for p in reader.partitions() for f in p.names] == ["treasury_bulletin_1950_11.txt"]


def test_failed_writes_leave_no_files(spark, tmp_path):
    D.register(spark)
    bad = spark.createDataFrame([("treasury_bulletin_1950_01.txt", "a"), ("../escape.txt", "b")], "file_name string, text string").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("bulletins").mode("append").save(str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == [] and not (tmp_path / "escape.txt").exists()
