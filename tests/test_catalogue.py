"""Each query with SQL gives what DuckDB gives on the smallest data set, cheap ones on the next as well."""

import math

import duckdb
import pytest

from tabulith.plans import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that take about a second on the larger set.
LARGER = ["line_signals", "section_split", "table_blocks", "table_cells", "task_routes", "answer_lines", "salvaged_answers", "vote_answers", "eval_match", "sampled_questions", "calculate", "named_entities", "streamed_messages"]


def connected(folder):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    return connected(SF.replace("sf0.001", "sf0.01"))


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, SF)


@pytest.mark.parametrize("name", LARGER)
def test_query_on_more(spark, larger, name):
    compare(spark, larger, name, SF.replace("sf0.001", "sf0.01"))


def compare(spark, db, name, folder):
    frame = catalogue.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    rel = db.sql(catalogue.ORACLE_SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == columns
    assert got == sorted(tuple(cell(r[at[c]]) for c in columns) for r in rel.fetchall())
