"""Scores of tables and files for batches of questions, and two-stage ranking with them.

In the cheap stage a question meets the files that postings of their headings lead to; sections, tables and whole texts meet the questions that
the cheap stage has put them before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions import scoring as S
from tabulith.functions import text as T
from tabulith.operators import postings as N
from tabulith.operators import ranking as R
from tabulith.operators import tables as B
from tabulith.sources.scratch import spread, stash


def scored_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, title, unit_hint, body, pipe_lines, features) of each table block."""
    # kept, as titles and bodies both read them
    blocks = stash(B.table_blocks(docs, key, text), "blocks")
    titles = B.block_titles(blocks, docs, key, text).select(key, "block_no", "unit_hint", F.col("full_title").alias("title"), "table_code")
    rows = blocks.join(titles, [key, "block_no"])
    # columns of their own, as dozens of patterns read them
    rows = rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumns({"_t": T.normalize(F.col("title")), "_b": T.normalize(F.col("body")), "_u": T.normalize(F.col("unit_hint"))})
    rows = rows.withColumns({"_tb": F.concat_ws("\n", "_t", "_b"), "_a": F.concat_ws("\n", "_t", "_b", "_u"), "_y": S.sorted_years(F.col("_b"))})
    features = S.table_features(F.col("_t"), F.col("_b"), F.col("_u"), F.col("_tb"), F.col("_a"), F.col("table_code"), F.col("pipe_lines"), "_y")
    return rows.select(key, "block_no", "title", "unit_hint", "body", "pipe_lines", features.alias("features"))


def heading_summaries(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, heading): the distinct titles of a document's tables in order, joined by line feeds."""
    titles = F.array_sort(F.collect_list(F.struct("block_no", "title")))
    heads = tables.groupBy(key).agg(F.array_distinct(F.transform(titles, lambda t: t["title"])).alias("_h"))
    return heads.select(key, F.array_join("_h", "\n").alias("heading"))


def files(docs: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents (key, file_name, pub_date, text) with the features that scores read; a document without tables has no heading."""
    rows = docs.select(key, "file_name", "pub_date", F.col(text).alias("text")).join(heading_summaries(tables, key), key, "left")
    rows = rows.withColumns({"_h": T.normalize(F.coalesce("heading", F.lit(""))), "_c": T.normalize(F.coalesce("text", F.lit("")))})
    features = S.file_features(F.col("_h"), F.col("_c"))
    return rows.select(key, "file_name", F.year("pub_date").alias("fy"), F.month("pub_date").alias("fm"), "pub_date", features.alias("features"))


def phrases(asks: DataFrame, *more: str) -> DataFrame:
    """The distinct keywords of all questions, and those of more columns."""
    return asks.select(F.explode(F.concat("keywords", *more)).alias("phrase")).where("phrase <> ''").distinct()


def table_hits(tables: DataFrame, asks: DataFrame) -> DataFrame:
    """Tables with the questions' keywords in their titles and texts, as SC2 reads them; their features go on without the text, which no pair needs."""
    texts = tables.withColumns({"_title": F.col("features.title"), "_text": F.col("features.text"), "features": F.col("features").dropFields("text")})
    return N.phrase_hits(texts, phrases(asks), {"_title": "title_hits", "_text": "text_hits"})


def section_hits(sections: DataFrame, asks: DataFrame, section: str = "section", out: str = "section") -> DataFrame:
    """Sections with ``out``, a struct of their features and of the questions' keywords in their titles and bodies, as SC1 reads it."""
    seen = S.with_section_features(sections, section, "_f").withColumns({"_title": F.col("_f.title"), "_body": F.col("_f.body")})
    seen = N.phrase_hits(seen, phrases(asks), {"_title": "title_hits", "_body": "body_hits"})
    whole = F.struct("_f.*", "title_hits", "body_hits")
    return seen.withColumn("_f", whole).drop("title_hits", "body_hits", *([out] if out in seen.columns else [])).withColumnRenamed("_f", out)


def heading_postings(asks: DataFrame, files_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, feature, n) of what SC3 reads of a file: the questions' keywords in its headings, dimension terms, families and its month."""
    hits = N.phrase_hits(files_.select(key, F.col("features.heading").alias("_text")), phrases(asks), {"_text": "_hits"}).select(key, F.explode("_hits").alias("_p", "n"))
    words = hits.select(key, F.concat(F.lit("k:"), "_p").alias("feature"), "n")
    terms = files_.select(key, F.explode("features.terms").alias("_t")).select(key, F.concat(F.lit("t:"), "_t").alias("feature"), F.lit(1).alias("n"))
    families = files_.select(key, F.posexplode("features.families").alias("_i", "n")).where("n > 0").select(key, F.concat(F.lit("f:"), "_i").alias("feature"), F.col("n").cast("int").alias("n"))
    months = files_.where("fy is not null and fm is not null").select(key, F.concat(F.lit("m:"), F.col("fy") * 12 + F.col("fm")).alias("feature"), F.lit(1).alias("n"))
    return words.union(terms).union(families).union(months)


def heading_askings(asks: DataFrame) -> DataFrame:
    """(q_id, feature, kind, cap, weight): what each question gives for the postings of a file's headings."""
    row = lambda feature, kind, cap, weight: ("q_id", feature.alias("feature"), F.lit(kind).alias("kind"), F.lit(cap).alias("cap"), weight.cast("int").alias("weight"))
    word = F.col("_w")
    words = asks.select("q_id", F.explode("keywords").alias("_w")).select(*row(F.concat(F.lit("k:"), word), 0, 3, F.when(word.contains(" "), 8).otherwise(3)))
    terms = asks.select("q_id", F.explode(F.array_distinct("terms")).alias("_w")).select(*row(F.concat(F.lit("t:"), word), 1, 5, F.lit(8)))
    numbers = F.array_compact(F.array(*(F.when(F.col(f"is_{f}"), i) for i, f in enumerate(S.FAMILY_NAMES))))
    families = asks.select("q_id", F.explode(numbers).alias("_w")).select(*row(F.concat(F.lit("f:"), word), 0, 4, F.lit(6)))
    # the months of issues for which a question's last year counts, instead of every question against every month
    low, high = S.PUBLICATION_SPAN
    first = F.col("last_year") * 12 + F.when(F.col("says_fiscal"), -2).otherwise(1)
    months = asks.where("last_year is not null").select("q_id", first.alias("_first"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_m"))
    months = months.select(*row(F.concat(F.lit("m:"), F.col("_first") + F.col("_m")), 0, 1, S.publication_points(F.col("_m")))).where("weight > 0")
    return words.union(terms).union(families).union(months)


def cheap_scores(asks: DataFrame, files_: DataFrame, key: str = "doc_id") -> DataFrame:
    """SC3 of the files that a question has anything in common with: (q_id, key, file_name, score); it is 0 for all others."""
    found = N.scores(heading_postings(asks, files_, key), heading_askings(asks), key).where("score > 0")
    return found.join(files_.select(key, "file_name"), key).select("q_id", key, "file_name", "score")


def cheap_best(asks: DataFrame, files_: DataFrame, first: int = 30, key: str = "doc_id") -> DataFrame:
    """The ``first`` files of each question by SC3, then name: (q_id, key, file_name, score, rank)."""
    month = F.col("fy") * 12 + F.col("fm")
    names = files_.select(key, "file_name").join(N.blocks(files_, key, month), key)
    return N.block_max_topk(heading_postings(asks, files_, key), stash(heading_askings(asks), "askings"), asks, names, key, "file_name", first)


def full_scores(pairs: DataFrame, asks: DataFrame, docs: DataFrame, files_: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text", preview: int | None = None) -> DataFrame:
    """SC4 of the given pairs (q_id, key): (q_id, key, file_name, section, table, score); only documents that pairs name are cut into sections.

    Every section of a text is scored; with ``preview``, those of a preview of each text that is longer than so many characters.
    """
    wanted = pairs.select(key).distinct()
    read = F.col(text) if preview is None else T.preview(F.col(text), preview)
    named = spread(docs.join(wanted, key, "left_semi").select(key, read.alias("_p"), T.normalize(F.col(text)).alias("_content")), 4)
    # titles and bodies stay behind, as no pair needs them
    seen = section_hits(B.section_texts(named.select(key, F.col("_p").alias("text")), key), asks)
    parts = stash(seen.select(key, F.col("section").dropFields("title", "body").alias("section")), "sections")
    near = stash(table_hits(tables.join(wanted, key, "left_semi").select(key, "features"), asks), "table_hits")
    held = files_.select(key, "file_name", "fy", "fm", "features", F.col("features.heading").alias("_heading")).join(named.select(key, "_content", (F.col("_content") != "").alias("filled")), key)
    # codes are looked for with the keywords, so that no pair meets a text
    held = stash(N.phrase_hits(held, phrases(asks, "codes"), {"_heading": "heading_hits", "_content": "content_hits"}), "file_hits")
    # a pair is cheap to move and dear to score
    met = spread(pairs.select("q_id", key)).join(asks, "q_id")
    best_section = met.join(parts, key).groupBy("q_id", key).agg(F.max(S.section_score()).alias("section"))
    best_table = met.join(near, key).groupBy("q_id", key).agg(F.max(S.table_score()).alias("table"))
    # the month asked for, of the file's own
    whole = met.join(held, key).withColumn("month_asked", F.coalesce(F.array_contains("month_numbers", F.col("fm")), F.lit(False)))
    own = whole.select("q_id", key, "file_name", F.when(F.col("filled"), S.file_score()).alias("own"))
    rows = own.join(best_section, ["q_id", key], "left").join(best_table, ["q_id", key], "left")
    section, table = F.coalesce("section", F.lit(0)), F.least(F.greatest(F.coalesce("table", F.lit(0)), F.lit(0)), F.lit(260))
    score = F.when(F.col("own").isNull(), 0).otherwise(F.col("own") + section + table)
    return rows.select("q_id", key, "file_name", section.alias("section"), table.alias("table"), score.alias("score"))


def two_stage(asks: DataFrame, docs: DataFrame, files_: DataFrame, tables: DataFrame, first: int = 30, keep: Column | int = 18, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K1: the ``first`` files of each question by the cheap score, of these the ``keep`` best by the full one; ties by file name.

    The pairs of the first stage, ``first`` a question, are kept, as the second reads them several times.
    """
    cheap = stash(cheap_best(asks, files_, first, key).select("q_id", key), "pairs")
    full = full_scores(cheap, asks, docs, files_, tables, key, text)
    if isinstance(keep, int):
        return R.top_k(full, "q_id", keep, F.desc("score"), F.col("file_name"))
    ranked = R.top_k(full, "q_id", first, F.desc("score"), F.col("file_name"))
    return ranked.join(asks.select("q_id", keep.alias("_keep")), "q_id").where(F.col("rank") <= F.col("_keep")).drop("_keep")
