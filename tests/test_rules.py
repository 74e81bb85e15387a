"""Rules of the domain on small inline inputs."""

import random

from pyspark.sql import functions as F

from tabulith.functions import answers as A
from tabulith.functions import profile as P
from tabulith.functions import text as T
from tabulith.operators import ranking as R
from tabulith.operators import snippets as N
from tabulith.operators import tables as B
from tabulith.operators import tools as X
from tabulith.operators import voting as V
from tabulith.plans import fixtures as I
from tabulith.sources import corpus as S


def profile(spark):
    rows = P.with_profile(spark.createDataFrame(I.QUESTIONS, "q_id string, question string")).withColumn("families", P.families())
    rows = rows.withColumn("years", T.years(F.col("question"))).withColumn("keywords", T.keywords(F.col("question"))).withColumn("wide", P.needs_global_search(F.col("families")))
    return {r.q_id: r for r in rows.collect()}


def test_question_rules(spark):
    p = profile(spark)
    assert p["q01"].years == list(range(1969, 1981))
    assert {"bill_rates", "auction"} <= set(p["q02"].families)
    assert "auction_results" in p["q03"].families and "bill_rates" not in p["q03"].families
    assert "maturity_schedule" in p["q04"].families
    assert "calendar_defense" in p["q06"].families
    assert not {"activities", "associated"} & set(p["q06"].keywords)
    assert p["q07"].expects_series_math and p["q07"].wants_monthly_series and not p["q07"].expects_scalar_lookup and p["q07"].wide
    assert p["q12"].families == [] and p["q12"].years == []


def test_answers(spark):
    cases = [("nan", True), ("Not found in the provided reference data", True), ("2602", False), ("", True)]
    rows = spark.createDataFrame(cases, "a string, e boolean").select("e", A.placeholder(F.col("a")).alias("g")).collect()
    assert all(r.e == r.g for r in rows)
    units = [("in billions", "129124", "129124"), ("in billions", "129124 million", "129.124"), ("", "$5", "5")]
    rows = spark.createDataFrame(units, "q string, a string, e string").select("e", A.convert(F.col("q"), F.col("a")).alias("g")).collect()
    assert all(r.e == r.g for r in rows), rows
    bare = [("The answer is: 2602", "2602"), ("According to the table, 14%", "14%"), ("plain", "plain")]
    rows = spark.createDataFrame(bare, "a string, e string").select("e", A.without_preamble(F.col("a")).alias("g")).collect()
    assert all(r.e == r.g for r in rows), rows


def test_conversion_keeps_every_digit(spark):
    from decimal import Decimal, localcontext

    cases = [(f"in {u}", f"{n} {v}") for n in ("129124", "-0.000000000123456789", "12345678901234567890.5", "1,000", "+7.50", "0", "-0.0", ".5", "5.", "100", "$3.25") for u in ("thousand", "million", "trillion") for v in ("", "thousand", "million", "billion", "trillion")]
    power = {"": None, "thousand": 3, "million": 6, "billion": 9, "trillion": 12}
    got = spark.createDataFrame(cases, "q string, a string").select("q", "a", A.convert(F.col("q"), F.col("a")).alias("g")).collect()
    with localcontext() as exact:
        exact.prec = 60
        for r in got:
            n, _, unit = r.a.partition(" ")
            by = power[unit] - power[r.q[3:]] if unit else 0
            want = f"{Decimal(n.replace(',', '').replace('$', '')).scaleb(by):f}"
            want = want.rstrip("0").rstrip(".") if "." in want else want
            assert r.g == ("0" if not want.strip("-0.") else want), (r, want)


def test_votes(spark):
    got = {r.q_id: r.winner for r in V.vote(spark.createDataFrame(I.VOTES, "q_id string, pos int, answer string")).collect()}
    assert got == {"v1": "100.5", "v2": "march 1977", "v3": "(1,234)", "v4": "0.4", "v5": "only one", "v6": "b"}


def test_blocks(spark):
    text = "SUMMARY OF DEBT\nTable FD-1. - Summary of Federal Debt\n(In millions of dollars)\n| a | b |\n|---|---|\n| 1 | 2 |\n\nprose\n| lonely | row |\nmore"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    blocks = B.table_blocks(docs)
    assert [(r.doc_id, r.start_line, r.end_line, r.pipe_lines) for r in blocks.collect()] == [(1, 3, 5, 3)]
    title = B.block_titles(blocks, docs).collect()[0]
    assert title.unit_hint == "(In millions of dollars)" and title.title.startswith("Table FD-1")


def test_sections_cut_long_runs(spark):
    docs = spark.createDataFrame([(1, "\n".join(["word"] * 300))], "doc_id long, text string")
    assert [(r.first_line, r.n_lines) for r in B.sections(docs).orderBy("section_no").collect()] == [(0, 120), (120, 120), (240, 60)]


def test_packing_is_the_loop(spark):
    import random

    random.seed(3)
    rows = [(k, i, random.randint(1, 60)) for k in range(60) for i in range(random.randint(1, 8))]
    kept = {(r.k, r.i) for r in R.pack(spark.createDataFrame(rows, "k int, i int, n int"), "k", "i", F.col("n"), F.lit(100)).collect()}
    want = set()
    for k in range(60):
        total = 0
        for _, i, n in (r for r in rows if r[0] == k):
            if i and total + n > 100:
                break
            want.add((k, i))
            total += n + 2
    assert kept == want


def test_calculate():
    assert X.evaluate("sqrt(16) + 2 ** 3") == 12
    for bad in ("__import__('os')", "(1).__class__", "[x for x in (1,)]", "9 ** 9 ** 9"):
        try:
            X.evaluate(bad)
        except (ValueError, OverflowError, SyntaxError):
            continue
        raise AssertionError(bad)


def test_bulletin_files(spark, tmp_path):
    (tmp_path / "treasury_bulletin_1984_07.txt").write_text("one\ntwo")
    (tmp_path / "treasury_bulletin_1984_13.txt").write_text("bad month")
    (tmp_path / "other.txt").write_text("no")
    got = {r.file_name: (str(r.pub_date), r.text) for r in S.read_bulletins(spark, str(tmp_path)).collect()}
    assert got == {"treasury_bulletin_1984_07.txt": ("1984-07-01", "one\ntwo"), "treasury_bulletin_1984_13.txt": ("None", "bad month")}


def test_merge_windows_folds_against_the_last_interval(spark):
    import random

    dice = random.Random(3)
    groups = [[(dice.randrange(1, 9), a := dice.randrange(60), a + dice.randrange(1, 22)) for _ in range(dice.randrange(1, 14))] for _ in range(60)]

    def fold(rows):
        done = []
        for _, a, b in sorted((-s, a, b) for s, a, b in rows):
            if len(done) == 4:
                break
            if done and a <= done[-1][1]:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        return done

    frame = spark.createDataFrame([(i, *w) for i, g in enumerate(groups) for w in g], "i int, score int, first int, last int")
    got: dict[int, list] = {}
    for r in N.merge_windows(frame, "i").orderBy("i", "place").collect():
        got.setdefault(r.i, []).append([r["first"], r["last"]])
    assert got == {i: fold(g) for i, g in enumerate(groups)}


def test_window_snippets(spark):
    text = "\n".join(["prose"] * 30 + ["Total receipts 1953   12,000   14,000"] + ["prose"] * 30)
    rows = [("q", 1, text, ["receipts"], [1953], ["expects_difference"]), ("q", 2, None, ["receipts"], [1953], []), ("q", 3, "", ["receipts"], [], []), ("q", 4, "no sign here", ["here"], [], [])]
    frame = spark.createDataFrame(rows, "q_id string, doc_id int, text string, keywords array<string>, years array<int>, flags array<string>")
    scored = N.scored_windows(frame).collect()
    # a keyword, a year, a table line and the cue of totals
    assert [(r["first"], r["last"], r["score"]) for r in scored] == [(20, 41, 3 + 10 + 1 + 12)]
    found = N.window_snippets(frame, 70).collect()
    assert [(r.doc_id, r.first_line, r.end_line, r.snippet) for r in found] == [(1, 20, 41, "\n".join(text.split("\n")[20:41])[:70])]


def test_windows_of_long_texts_in_pieces(spark):
    """Pieces of seven lines give the windows of the whole text, and those of a loop that scores each window's own text."""
    import random
    import re

    dice = random.Random(9)
    words = ["Total receipts", "1953", "12,000 14,000", "", "plain words", "Schedule:", "May 5%", "net   1,200", "average rate", "'", "calendar year 1953", "  | a | b | 12 |"]
    text = "\n".join(" ".join(dice.choices(words, k=dice.randrange(3))) for _ in range(90))
    flags = ["expects_sum", "expects_date", "expects_percent", "wants_calendar_year"]
    rows = [("q", 1, text, ["receipts", "average rate", "Net"], [1953, 12], flags), ("p", 1, text, [], [], ["expects_list", "expects_regression"])]
    frame = spark.createDataFrame(rows, "q_id string, doc_id int, text string, keywords array<string>, years array<int>, flags array<string>")
    key = lambda got: sorted(map(tuple, got.collect()))
    whole = key(N.scored_windows(frame))
    assert whole and whole == key(N.scored_windows(frame, chunk=7))
    lines = [x.rstrip() for x in text.split("\n")]
    about = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", T.table_signal(F.col("x")).alias("t"), T.heading_signal(F.col("x")).alias("h")).collect()
    table, head = {r.i: r.t for r in about}, {r.i: r.h for r in about}
    for q, _, first, last, score in whole:
        held = [i for i in range(first, last) if lines[i].replace("'", "")]
        body = "\n".join(lines[i].lower().replace("'", "") for i in held)
        want = min(sum(table[i] >= 2 for i in held), 12) + sum(head[i] for i in held[:4])
        if q == "q":
            want += min(body.count("receipts"), 4) * 3 + min(body.count("average rate"), 4) * 10 + min(body.count("net"), 4) * 3
            want += sum(10 * bool(re.search(rf"(?<![0-9]){y}(?![0-9])", body)) for y in (1953, 12))
            want += 12 * bool(re.search(r"\b(total|net|receipts)\b", body)) + 12 * bool(re.search(r"\bdate\b|\bissue\b", body)) + 6 * bool(re.search(r"\bmay\b", body)) + 8 * ("%" in body) + 10 * bool(re.search(r"\bcalendar year\b", body))
        else:
            want += 14 * (len(re.findall(r"\b(?:19|20)[0-9]{2}\b", body)) >= 4) + 10 * (len(re.findall(r"[0-9][0-9,]*", body)) >= 6)
        assert score == want, (q, first, last)


def test_sections_of_any_length(spark):
    """Chunks of lines whose functions of the count before them are composed give the sections of a plain fold."""
    import random

    dice = random.Random(4)
    kinds = ["prose of no sign"] * 30 + [""] * 9 + ["Table of things:", "| a | b | c |", "| 1 | 2 | 3 |", "1953   12,000   14%", "  \t", "Schedule A"]
    texts = ["\n".join(dice.choices(kinds if i % 2 else ["prose", "", "more prose"], k=dice.randrange(1, 400))) for i in range(25)] + ["\n" * 50 + "late", "", "\n\n", "\n".join(["word"] * 1000)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")

    signals = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "x")).select("doc_id", "i", F.rtrim("x").alias("x"), T.table_signal(T.rstrip(F.col("x"))).alias("t"), T.table_signal(T.strip(F.col("x"))).alias("s"), T.heading_signal(F.col("x")).alias("h"))
    by_doc: dict[int, list] = {}
    for r in signals.orderBy("doc_id", "i").collect():
        by_doc.setdefault(r.doc_id, []).append((r.x.rstrip(), r.t, r.s, r.h))

    def fold(lines, most):
        out, n = [], 0
        for i, (x, _, s, h) in enumerate(lines):
            before = lines[i - 1] if i else None
            cut = before and (x.count("|") >= 3 and "|" not in before[0] or h >= 2 or s >= 3 and before[1] == 0)
            if x and (n == 0 or cut or n >= most):
                out.append([i, []])
                n = 0
            if out:
                out[-1][1].append(x)
                n += 1
        return [(k, at, sum(x != "" for x in xs), "\n".join(xs).strip(" \t\n")) for k, (at, xs) in enumerate(out)]

    want = sorted((d, *s) for d, lines in by_doc.items() for s in fold(lines, 12))
    for args in ({}, {"whole": 10, "chunk": 5}, {"whole": 200, "chunk": 37}):
        got = sorted(map(tuple, B.section_texts(docs, most=12, **args).collect()))
        assert got == want, args


def test_line_signals_count_months(spark, tmp_path):
    import re

    from tabulith.plans import catalogue

    texts = ["March 5", "march", "Marching 1,234 567", "demarche 3", "été mai 4", "x  y $\nMay 1953\n\nsept. 7  8", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def signal(line):
        month = re.search(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", line.lower(), re.ASCII)
        return bool(re.search("[0-9]", line)) + 2 * (len(re.findall("[0-9][0-9,.]*", line)) >= 2) + bool(month) + bool(re.search("[%$]", line)) + bool(re.search(r"\s{2,}|\t", line))

    got = {r.doc_id: (r.table_signal, r.table_lines) for r in catalogue.line_signals(spark, str(tmp_path)).collect()}
    want = {i: [signal(x) for x in t.split("\n")] for i, t in enumerate(texts)}
    assert got == {i: (sum(s), sum(x >= 2 for x in s)) for i, s in want.items()}
    assert got == {r.doc_id: (r.table_signal, r.table_lines) for r in catalogue.line_signals(spark, str(tmp_path)).collect()}


def test_narrow_for_question(spark):
    import random

    dice = random.Random(4)
    cells = ["1953", "19530", "March", "total", "totals", "Harbor Works", "other", "7"]
    big = ["head", "| a | b |", "|---|:--|", *("| " + " | ".join(dice.choices(cells, k=2)) + " |" for _ in range(90)), "|---|", "| last | 1953 |", ""]
    flat = ["x %d" % i for i in range(60)]
    small = ["x", "", *("y %d" % i for i in range(41))]
    texts, asked = {"big": big, "flat": flat, "small": small}, {"one": "What was Harbor Works in March 1953?", "list": "Which countries?"}
    flags = "expects_series_math expects_regression expects_list wants_monthly_series".split()
    rows = [(q, t, asked[q], "\n".join(lines), *(f == "expects_list" and q == "list" for f in flags)) for q in asked for t, lines in texts.items()]
    frame = spark.createDataFrame(rows, "q string, t string, question string, text string, " + ", ".join(f + " boolean" for f in flags))
    got = {}
    for r in B.narrow_for_question(frame, ["q", "t"]).orderBy("line_no").collect():
        got.setdefault((r.q, r.t), []).append(r.line_no)

    def score(line):
        return 10 * ("1953" in line) + 5 * ("march" in line.lower()) + 8 * ("harbor works" in line.lower()) + 3 * ("total" in line.replace("totals", ""))

    data = [i for i, x in enumerate(big) if i > 2 and x and x != "|---|"]
    best = [i for i in sorted(data, key=lambda i: -score(big[i])) if score(big[i])][:40]
    assert got["one", "big"] == sorted([0, 1, 2, 93, *best])
    assert got["one", "flat"] == list(range(42))
    assert got["one", "small"] == list(range(43))
    assert all(got["list", t] == list(range(len(x))) for t, x in texts.items())


def test_entities_of_any_length(spark):
    texts = ["Bank of therapy", "Bank of the United States and Ab", "Ab Cd", "Ab and of Cd", "Ab and", "McDonald Of the Sea\vSide", "Treasury " * 40_000, "Ab and " * 40_000 + "Cd", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.named_entities(F.col("t")).alias("e"))
    got = {r.i: r.e for r in rows.collect()}
    assert [got[i] for i in range(6)] == [[], ["united states", "bank of the united states and ab"], [], ["ab and of cd"], [], ["donald of", "donald of the sea"]]
    assert got[6] == [("treasury " * 40_000).strip()] and got[7] == ["ab and " * 40_000 + "cd"] and got[8] is None


def test_keyword_scores_in_bounded_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"debt {'bonds ' * (i % 7)} notes{i % 3} the") for i in range(50)], "doc_id int, text string")
    asked = spark.createDataFrame([(q, f"Debt, notes{q % 3} and bonds" if q % 2 else "bonds the") for q in range(6)], "q_id int, question string")
    want: dict[int, dict[str, int]] = {}
    for d, text in docs.collect():
        for w in text.split():
            want.setdefault(d, {})[w] = want.setdefault(d, {}).get(w, 0) + 1
    terms = lambda q: ["debt", f"notes{q % 3}", "bonds"] if q % 2 else ["bonds"]
    full = {(q, d): s for q in range(6) for d, tf in want.items() if (s := sum(2 * min(tf.get(t, 0), 4) for t in terms(q)))}
    monkeypatch.setattr(R, "PAIRS", 10)
    got = R.keyword_scores(asked, docs)
    assert {(r.q_id, r.doc_id): r.score for r in got.collect()} == full
    assert max(r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 60


def test_pinned_first(spark):
    rng = random.Random(8)
    rows = [(q, i, rng.choice([-2, -1, 0, 0, 3, 4]) if q % 3 else rng.choice([-1, 0]), rng.random() < 0.4) for q in range(60) for i in rng.sample(range(99), rng.randrange(1, 12))]
    got = R.pinned_first(spark.createDataFrame(rows, "q_id int, idx int, score int, pinned boolean").repartition(5), "q_id", 4).collect()
    for q in range(60):
        own = [r for r in rows if r[0] == q]
        flat = len(own) <= 4 or max(r[2] for r in own) <= 0
        own.sort(key=lambda r: (not r[3], 0 if flat else -r[2], r[1]))
        assert [tuple(r)[:4] for r in sorted((r for r in got if r.q_id == q), key=lambda r: r.rank)] == own[:4]


def test_narrowing_asks_each_question_once(spark):
    asks = P.with_profile(spark.createDataFrame([(1, "What was Gross Debt in March 1950?")], "q int, question string"))
    rows = B.with_narrowing(asks).drop("question").crossJoin(spark.createDataFrame([(7, "a\n Gross debt 1950 March \n\ntotal")], "t int, text string"))
    got = {r.line_no: r.score for r in B.narrow_for_question(rows, ["q", "t"]).collect()}
    assert got == {0: 0, 1: 23, 2: 0, 3: 3}


def test_full_titles(spark):
    table = "| a | b |\n| 1 | 2 |"
    tops = {
        "SUMMARY OF DEBT\n\nTable FD-1. - Summary of Debt\n(In millions of dollars)": ("SUMMARY OF DEBT | Table FD-1. - Summary of Debt", "fd-1", False),
        "SECTION IV\nprose of some kind\nTable FD-2. - Debt": ("Table FD-2. - Debt", "fd-2", False),
        "FIRST\nSECOND HEADER\nwords\nTABLE OF CONTENTS": ("SECOND HEADER | TABLE OF CONTENTS", "", True),
        "ONE HEADER\nTHIS SHOWS ALL OF IT": ("ONE HEADER", "", False),
        "TWICE\nTWICE": ("TWICE", "", False),
        "(IN MILLIONS)": ("Table block near line 2", "", False),
        "nothing here": ("Table block near line 2", "", False),
        "HEADER FAR ABOVE" + "\nx" * 15 + "\nTable FD-3. - Debt": ("Table FD-3. - Debt", "fd-3", False),
        "FAR" + "\n" * 16 + "Table FD-4. - Debt": ("Table FD-4. - Debt", "fd-4", False),
    }
    docs = spark.createDataFrame([(i, top + "\n" + table) for i, top in enumerate(tops)], "doc_id long, text string")
    got = {r.doc_id: (r.full_title, r.table_code, r.is_contents) for r in B.block_titles(B.table_blocks(docs), docs).collect()}
    assert got == dict(enumerate(tops.values()))
