"""From raw documents to training shards, in stages that each rest on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import load, stash
from tabulith.llm.decontaminate import reject_leaks
from tabulith.llm.mixing import OTHERS_WEIGHT, WEIGHTS, mix_sources
from tabulith.llm.ngram_join import ngram_join
from tabulith.llm.sharding import op10_sharding
from tabulith.llm.toxicity import fit, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches 0.3."""
    return reject_toxic(docs, fit(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of five-word shingle similarity 0.8, one row of each id; rows without an id stay."""
    members, _ = ngram_join(docs, 5, 80)
    members = stash(members.where(F.col("doc_id").isNotNull()), "members")
    others = members.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    # ids on several rows: only these rows are compared
    repeated = stash(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("component_id") == F.col("doc_id")).alias("first")).where("n > 1"), "repeated")
    kept = docs.join(others.union(repeated.select("doc_id")).distinct(), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    rows = docs.join(repeated.where("first").select("doc_id"), "doc_id", "left_semi")
    least = rows.groupBy("doc_id").agg(F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias("_row"))
    return kept.union(least.select(*(F.col(c) if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a test item."""
    return reject_leaks(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixing schedule; rows that share an id take its first position, rows without an id the first of theirs."""
    order = stash(mix_sources(docs, WEIGHTS, OTHERS_WEIGHT).groupBy("doc_id").agg(F.min("position").alias("position")), "order")
    # whole rows travel in one column, so that no column of theirs can clash with the position
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    known = rows.join(order, rows["row.doc_id"] == order["doc_id"]).select("row", "position")
    # no join on the key of rows without an id, which may be many: their position is one number
    first = order.where("doc_id is null").first()
    others = rows.where("row.doc_id is null").withColumn("position", F.lit(first.position if first else 0).cast("long"))
    return known.union(others).orderBy("position").select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal loads for 40 shards; equal texts together; each shard's slots follow the mixing schedule, read back from the written files."""
    return op10_sharding(docs, keep_order=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained model and greedy tilings decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
