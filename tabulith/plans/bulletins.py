"""A corpus of monthly bulletins with titled tables, made from the orders table, for the queries that rank and read such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import lexicon as L
from tabulith.functions import text as T

#: Issues, and the month of the first.
ISSUES, FIRST = 697, "1939-01-01"
TITLES = [
    "TABLE FD-1. - Summary of Federal Debt", "TABLE FD-2. - Summary of public debt and guaranteed agency securities", "OWNERSHIP OF FEDERAL SECURITIES", "TABLE FFO-3. - Budget outlays by function", "TABLE FFO-1. - Receipts by source, fiscal year",
    "Table 3.- Analysis of general expenditures, departments and agencies", "Table 2.- Analysis of national defense expenditures, calendar year", "Table 5.- Analysis of expenditures for (1) revolving funds", "SUMMARY TABLE ON BUDGET RECEIPTS AND EXPENDITURES", "TABLE CM-1. - Total claims by country",
    "TABLE CM-2. - Total claims by type and country", "LIABILITIES TO FOREIGNERS", "TABLE ESF-1. - Exchange stabilization fund balances", "TABLE FCP-2. - Japanese yen positions and British pound positions", "TABLE PDO-2. - Offerings of bills, 13-week and 26-week treasury-bill rates",
    "TABLE PDO-4. - Public offerings of marketable securities other than regular weekly treasury bills", "TABLE TSO-1. - Maturity schedule, interest-bearing marketable public debt securities", "INDIVIDUAL INCOME TAX RECEIPTS, NET OF REFUNDS", "CORPORATION INCOME TAX RETURNS", "TABLE OF CONTENTS",
    "Table 9.- Expenditures for national defense and related activities", "SUMMARY OF BUDGET RESULTS BY MONTHS AND YEARS", "VETERANS ADMINISTRATION AND PUBLIC WORKS", "plain words that are no title at all",
]
UNITS = ["(In millions of dollars)", "(In thousands of dollars)", "(In billions)", "Source: daily statement"]
ITEMS = ["accepted tenders", "competitive", "noncompetitive", "total outlays", "average rate", "13-week", "public works", "Veterans Administration", "country", "japanese yen", "net of refunds", "all other investors", "gross federal debt 1950", "national defense 1953", "issue date 14%", "receipts"]
NOTES = ["Includes public works undertaken by the Veterans Administration.", "Does not include expenditures for (1) revolving funds or (2) transfers to trust accounts.", "The figures are preliminary."]


def sql_array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: DuckDB: doc_id, file_name, pub_date, text.
SQL = f"""b_rows AS (SELECT o_custkey % {ISSUES} AS doc_id, o_orderkey % 3 AS t, o_orderkey AS k, '| ' || {sql_array([m.title() for m in L.MONTHS])}[1 + o_orderkey % 12] || ' ' || (1930 + o_orderkey % 60) || ' | '
    || floor(o_totalprice)::BIGINT || ' | ' || {sql_array(ITEMS)}[1 + o_orderkey % {len(ITEMS)}] || ' |' AS line FROM orders),
    b_tables AS (SELECT doc_id, t, {sql_array(TITLES)}[1 + (doc_id * 5 + t * 7) % {len(TITLES)}] || chr(10) || {sql_array(UNITS)}[1 + (doc_id + t) % {len(UNITS)}] || chr(10) || '| Month | Amount | Item |' || chr(10) || '|---|---|---|' || chr(10)
    || string_agg(line, chr(10) ORDER BY k) AS body FROM b_rows GROUP BY doc_id, t),
    bulletins AS (SELECT doc_id, 'treasury_bulletin_' || strftime(d, '%Y_%m') || '.txt' AS file_name, d AS pub_date, 'TREASURY BULLETIN' || chr(10) || chr(10) || body || chr(10) || chr(10) || {sql_array(NOTES)}[1 + doc_id % {len(NOTES)}] AS text
    FROM (SELECT doc_id, (DATE '{FIRST}' + to_months(doc_id::INT))::DATE AS d, string_agg(body, chr(10) || chr(10) ORDER BY t) AS body FROM b_tables GROUP BY doc_id))"""


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, at: F.get(T.strings(values), at.cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % ISSUES).alias("doc_id"), F.col("o_orderkey").alias("k"), "o_totalprice")
    month = F.concat(pick([m.title() for m in L.MONTHS], F.col("k") % 12), F.lit(" "), (F.col("k") % 60 + 1930).cast("string"))
    line = F.concat(F.lit("| "), month, F.lit(" | "), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" | "), pick(ITEMS, F.col("k") % len(ITEMS)), F.lit(" |"))
    ordered = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["v"])
    tables = o.select("doc_id", (F.col("k") % 3).alias("t"), F.struct("k", line.alias("v")).alias("r")).groupBy("doc_id", "t").agg(F.array_join(ordered("r"), "\n").alias("body"))
    head = F.concat_ws("\n", pick(TITLES, (F.col("doc_id") * 5 + F.col("t") * 7) % len(TITLES)), pick(UNITS, (F.col("doc_id") + F.col("t")) % len(UNITS)), F.lit("| Month | Amount | Item |"), F.lit("|---|---|---|"), "body")
    docs = tables.groupBy("doc_id").agg(F.array_join(ordered(F.struct("t", head.alias("v"))), "\n\n").alias("body"))
    docs = docs.withColumn("pub_date", F.add_months(F.lit(FIRST).cast("date"), F.col("doc_id").cast("int")))
    text = F.concat(F.lit("TREASURY BULLETIN\n\n"), F.col("body"), F.lit("\n\n"), pick(NOTES, F.col("doc_id") % len(NOTES)))
    return docs.select("doc_id", F.concat(F.lit("treasury_bulletin_"), F.date_format("pub_date", "yyyy_MM"), F.lit(".txt")).alias("file_name"), "pub_date", text.alias("text"))
