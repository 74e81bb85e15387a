"""Context of a question: the best tables of its files, narrowed to the rows it needs, else the best windows of sections, in a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.functions import lexicon as L
from tabulith.functions import scoring as S
from tabulith.functions import text as T
from tabulith.operators import ranking as R
from tabulith.operators import scoring as O
from tabulith.operators import snippets as N
from tabulith.operators import tables as B
from tabulith.sources.scratch import spread, stash

#: Tables of a file at most, least budget of a section, and how many sections share a file's budget at most.
TABLES, SECTION_LEAST, SECTIONS = 3, 2500, 3


def needs(text: str = "question") -> dict[str, Column]:
    """What ``tables.narrowed`` asks of a question."""
    years = F.array_distinct(T.find_all(F.col(text), r"\b(19[2-9][0-9]|20[0-2][0-9])\b"))
    whole = F.coalesce(F.col("expects_series_math") | F.col("expects_regression") | F.col("expects_list") | F.col("wants_monthly_series"), F.lit(False))
    return {"years": years, "months": F.col("months"), "terms": F.concat(T.focus_phrases(F.col(text)), T.named_entities(F.col(text))), "whole": whole}


def table_snippets(chosen: DataFrame, asks: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "question") -> DataFrame:
    """K5 by tables: (q_id, key, block_no, place, snippet) of the best tables of each chosen file (q_id, key, budget) that fit its budget."""
    near = stash(O.table_hits(tables.join(chosen.select(key).distinct(), key, "left_semi"), asks), "table_hits")
    scored = spread(chosen.select("q_id", key, "budget")).join(asks, "q_id").join(near.drop("body"), key).withColumn("_s", S.table_score()).where("_s > 0")
    best = stash(R.top_k(scored.select("q_id", key, "block_no", "budget", "_s"), "q_id", TABLES, F.desc("_s"), F.col("block_no"), more=[key]).withColumnRenamed("rank", "place"), "best")
    # only the tables that are kept are narrowed
    # found once a question, not for each line of its tables
    asked = stash(asks.select("q_id", *(c.alias(f"_n_{name}") for name, c in needs(text).items())), "needs")
    rows = spread(best).join(asked, "q_id").join(tables.select(key, "block_no", "title", "unit_hint", "body"), [key, "block_no"])
    rows = B.with_narrowed(rows.withColumn("_body", T.strip(F.col("body"))), "_body", *(f"_n_{name}" for name in ("years", "months", "terms", "whole")))
    body = T.strip(F.col("_body"))
    head = F.when((F.col("unit_hint") != "") & ~F.col("title").contains(F.col("unit_hint")), F.concat(F.lit("\nUNIT: "), F.col("unit_hint"))).otherwise("")
    snippet = F.concat(F.lit("TABLE TITLE: "), F.col("title"), head, F.lit("\n"), body)
    rows = rows.select(F.struct("q_id", key).alias("_pair"), "q_id", key, "block_no", "place", "budget", snippet.alias("snippet"))
    kept = R.pack(rows, "_pair", "place", F.length("snippet"), F.col("budget"))
    return kept.select("q_id", key, "block_no", "place", F.left("snippet", F.col("budget").cast("int")).alias("snippet"))


def section_snippets(chosen: DataFrame, asks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K5 without tables: (q_id, key, snippet) from the best sections and those beside them, each cut to its best windows of lines.

    Sections are taken by score, or by how dense their lines are if none scores, or else the first.  A section that does not fit ends the
    turn of its neighbours only.  The choice is a fold over a file's sections, as each step depends on what is taken.
    """
    named = chosen.select("q_id", key, "budget")
    parts = B.section_texts(docs.join(chosen.select(key).distinct(), key, "left_semi").select(key, text), key, text)
    lines = F.filter(T.lines(F.col("section")), lambda x: T.strip(x) != "")
    dense = F.aggregate(lines, F.lit(0), lambda s, x: s + T.table_signal(x)) + F.aggregate(F.slice(lines, 1, 6), F.lit(0), lambda s, x: s + T.heading_signal(x))
    seen = stash(O.section_hits(parts.withColumn("_dense", dense), asks, out="features").select(key, "section_no", "section", "_dense", "features"), "sections")
    rows = seen.join(named, key).join(asks, "q_id")
    flags = [f for f, _, _ in L.WINDOW_CUES] + ["expects_sum", "expects_difference", "expects_regression", "expects_list", "expects_series_math"]
    rows = rows.withColumns({"_score": S.section_score("features"), "flags": F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))})
    pair = Window.partitionBy("q_id", key)
    rows = rows.withColumn("_any", F.max("_score").over(pair) > 0).withColumn("_value", F.when(F.col("_any"), F.col("_score")).otherwise(F.col("_dense")))
    scored = F.sum(F.when(F.col("_value") > 0, 1).otherwise(0)).over(pair)
    share = F.floor(F.col("budget") / F.greatest(F.lit(1), F.least(F.lit(SECTIONS), scored)))
    rows = rows.withColumn("_room", F.greatest(F.lit(SECTION_LEAST), share).cast("int")).select("q_id", key, "section_no", "section", "budget", "_room", "_value", "keywords", "years", "flags")
    cut = rows.withColumn("_d", F.struct(key, "section_no"))
    windows = N.window_snippets(cut.select("q_id", "_d", "section", "keywords", "years", "flags", F.col("_room").alias("room")), F.col("room"), "q_id", "_d", "section")
    joined = windows.groupBy("q_id", "_d").agg(F.array_sort(F.collect_list(F.struct("place", "snippet"))).alias("_w"))
    block = F.coalesce(F.nullif(T.strip(F.array_join(F.transform("_w", lambda w: w["snippet"]), "\n\n")), F.lit("")), F.col("section"))
    blocks = cut.join(joined, ["q_id", "_d"], "left").select("q_id", key, "section_no", "budget", "_value", block.alias("block"), "section")
    files = blocks.groupBy("q_id", key).agg(F.first("budget").alias("budget"), F.array_sort(F.collect_list(F.struct("section_no", "block", "_value", "section"))).alias("p"))
    order = F.transform(F.array_sort(F.transform(F.filter("p", lambda x: x["_value"] > 0), lambda x: F.struct((-x["_value"]).alias("s"), x["section_no"].alias("i")))), lambda x: x["i"])
    steps = F.flatten(F.transform(order, lambda i: F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: F.struct(i.alias("turn"), (i + d).alias("i")))))
    files = files.withColumn("_steps", F.filter(steps, lambda s: (s["i"] >= 0) & (s["i"] < F.size("p"))))
    state = lambda used, taken, skip: F.struct(used.cast("long").alias("used"), taken.alias("taken"), skip.cast("int").alias("skip"))

    def step(acc: Column, s: Column) -> Column:
        size = F.length(F.get(F.col("p"), s["i"])["block"])
        passed = (acc["used"] >= F.col("budget")) | (acc["skip"] == s["turn"]) | F.array_contains(acc["taken"], s["i"]) | (size == 0)
        full = (acc["used"] + size > F.col("budget")) & (F.size(acc["taken"]) > 0)
        return F.when(passed, acc).when(full, state(acc["used"], acc["taken"], s["turn"])).otherwise(state(acc["used"] + size + 2, F.concat(acc["taken"], F.array(s["i"])), acc["skip"]))

    taken = F.aggregate("_steps", state(F.lit(0), F.array().cast("array<int>"), F.lit(-1)), step, lambda acc: acc["taken"])
    whole = T.strip(F.array_join(F.transform(taken, lambda i: F.get(F.col("p"), i)["block"]), "\n\n"))
    first = T.strip(F.left(F.col("p")[0]["section"], F.col("budget").cast("int")))
    out = files.select("q_id", key, "budget", F.when(F.size("_steps") == 0, first).otherwise(whole).alias("s"))
    cut_off = F.concat(F.regexp_replace(F.left("s", F.col("budget").cast("int")), r"\s+$", ""), F.lit("\n[...truncated...]"))
    return out.select("q_id", key, F.when(F.length("s") > F.col("budget"), cut_off).otherwise(F.col("s")).alias("snippet"))


def file_snippets(chosen: DataFrame, asks: DataFrame, docs: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K5: (q_id, key, snippet) of each chosen file: its tables, or its sections where no table scores; files without any text have none."""
    by_table = table_snippets(chosen, asks, tables, key).groupBy("q_id", key).agg(F.array_sort(F.collect_list(F.struct("place", "snippet"))).alias("_t"))
    by_table = stash(by_table.select("q_id", key, T.strip(F.array_join(F.transform("_t", lambda t: t["snippet"]), "\n\n")).alias("snippet")), "snippets")
    rest = chosen.join(by_table, ["q_id", key], "left_anti")
    return by_table.union(section_snippets(rest, asks, docs, key, text)).where("snippet <> ''")


def source_context(ranked: DataFrame, asks: DataFrame, docs: DataFrame, tables: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K7: (q_id, files, context) from the ranked files (q_id, key, file_name, rank) of each question and its limits (q_id, max_chars).

    A file has its share of the characters by rank; files follow each other until the characters are used up.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("q_id"))
    chosen = ranked.join(limits.select("q_id", "max_chars"), "q_id").withColumn("_n", n)
    chosen = chosen.select("q_id", key, "file_name", "rank", "max_chars", R.file_budget(F.col("rank"), F.col("_n"), F.col("max_chars")).alias("budget"))
    rows = chosen.join(file_snippets(chosen, asks, docs, tables, key, text), ["q_id", key])
    before = F.coalesce(F.sum(F.length("snippet")).over(Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < F.col("max_chars"))
    block = F.concat(F.lit("=== SOURCE: "), F.col("file_name"), F.lit(" ===\n"), F.col("snippet"))
    out = rows.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), "file_name"))).alias("_b"))
    return out.select("q_id", F.array_join(F.transform("_b", lambda b: b["file_name"]), "|").alias("files"), F.array_join(F.transform("_b", lambda b: b["b"]), "\n\n").alias("context"))
