"""Time the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tabulith.plans import queries as catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["keyword_score_topk", "two_stage_topk", "context_pack", "table_blocks", "section_split", "line_signals", "named_entities", "row_narrow", "followup_join", "ordered_union_dedupe", "vote_text", "json_aggregate", "series_stats", "table_scores", "find_sources", "source_context", "cleaned_answers", "window_snippets", "eval_accuracy", "message_merge"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
