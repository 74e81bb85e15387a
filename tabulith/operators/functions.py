"""Tools as SQL functions: aggregation and search over JSON payloads, called from SQL and run on the JVM; rows of payloads as a table function."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StringType, StructType

#: A number as Python shows it: with a point, without an exponent for magnitudes that need none.
_SHOWN = r"regexp_replace(regexp_replace(CAST(CAST(CAST({v} AS STRING) AS DECIMAL(38, 18)) AS STRING), '0+$', ''), '[.]$', '.0')"
_SHOW = f"CASE WHEN {{v}} IS NULL THEN NULL WHEN {{v}} = 0 THEN '0.0' WHEN abs({{v}}) BETWEEN 1e-4 AND 1e16 THEN {_SHOWN} ELSE CAST({{v}} AS STRING) END"


def _aggregate_sql() -> str:
    """The body of json_aggregate: objects without the field, or with a null in it, are left out; texts say what went wrong."""
    rows = "from_json(data, 'array<map<string,string>>')"
    given = f"filter(transform({rows}, r -> try_element_at(r, field)), v -> v IS NOT NULL)"
    values = f"transform({given}, v -> try_cast(v AS DOUBLE))"
    total = f"aggregate({values}, CAST(0 AS DOUBLE), (s, v) -> s + v)"
    found = {"sum": _SHOW.format(v=total), "avg": _SHOW.format(v=f"({total} / size({values}))"), "min": _SHOW.format(v=f"array_min({values})"), "max": _SHOW.format(v=f"array_max({values})"), "count": f"CAST(size({values}) AS STRING)"}
    cases = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in found.items())
    return f"""CASE WHEN try_parse_json(data) IS NULL THEN 'Tool error: JSONDecodeError' WHEN size({given}) = 0 THEN 'No numeric values found for field'
        WHEN exists({values}, v -> v IS NULL) THEN 'Tool error: ValueError' ELSE CASE operation {cases} ELSE 'Unknown operation' END END"""


def _search_sql() -> str:
    """The body of json_search: the objects, as they stand in the array, whose field contains the value whatever its case."""
    rows = "from_json(data, 'array<string>')"
    return f"CASE WHEN try_parse_json(data) IS NULL THEN NULL ELSE filter({rows}, r -> coalesce(contains(lower(get_json_object(r, '$.' || field)), lower(value)), false)) END"


class JsonRows:
    """Table function json_rows(data, fields): a row for each object of a JSON array, with a column for each of the fields (a constant, between commas).

    Missing fields and nulls are null, other values are texts; a payload that is no array of objects has no rows.
    """

    @staticmethod
    def analyze(data: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(data.dataType, StringType) or not fields.isConstantExpression or not fields.value:
            raise ValueError("json_rows takes a text and constant names of fields")
        schema = StructType()
        for name in fields.value.split(","):
            schema = schema.add(name.strip(), StringType())
        return AnalyzeResult(schema)

    def eval(self, data: str, fields: str) -> Iterator[tuple]:
        try:
            rows = json.loads(data) if data else []
        except json.JSONDecodeError:
            return
        names = [n.strip() for n in fields.split(",")]
        for row in rows if isinstance(rows, list) else []:
            if isinstance(row, dict):
                yield tuple(None if (v := row.get(n)) is None else v if isinstance(v, str) else json.dumps(v) for n in names)


def register(spark: SparkSession) -> None:
    """Make json_aggregate, json_search and json_rows known to a session's SQL."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json_aggregate(data STRING, field STRING, operation STRING) RETURNS STRING RETURN {_aggregate_sql()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json_search(data STRING, field STRING, value STRING) RETURNS ARRAY<STRING> RETURN {_search_sql()}")
    spark.udtf.register("json_rows", udtf(JsonRows))
