"""Tools over JSON payloads, series statistics and safe arithmetic."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, data: str, field: str, value: str) -> Column:
    """Objects of a JSON array whose field contains the value, whatever its case."""
    items = F.from_json(F.col(data), "array<map<string,string>>")
    return F.filter(items, lambda r: F.contains(F.lower(F.element_at(r, F.lit(field))), F.lit(value.lower())))


def aggregate(rows: DataFrame, key: str, data: str, field: str) -> DataFrame:
    """count, sum, avg, min and max of a numeric field over each key's JSON objects; missing fields and nulls are skipped."""
    value = F.get_json_object(data, f"$.{field}").cast("double")
    kept = rows.select(key, value.alias("v")).where("v is not null")
    return kept.groupBy(key).agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}
_NAMES = {"round": round, "abs": abs, "min": min, "max": max, "sum": sum, "len": len, "int": int, "float": float, "sqrt": math.sqrt, "log": math.log, "log10": math.log10, "pi": math.pi, "e": math.e}


def _power(base: float, exponent: float) -> float:
    if abs(exponent) > 1000 or abs(base) > 1e100:
        raise ValueError("the power is too large")
    return base**exponent


def evaluate(expression: str) -> float:
    """Arithmetic over numbers, lists and a few names; anything else is an error."""

    def walk(node: ast.AST) -> object:
        match node:
            case ast.Expression():
                return walk(node.body)
            case ast.Constant(value=int() | float()):
                return node.value
            case ast.List() | ast.Tuple():
                return [walk(x) for x in node.elts]
            case ast.BinOp(op=ast.Pow()):
                return _power(walk(node.left), walk(node.right))
            case ast.BinOp() if type(node.op) in _OPS:
                return _OPS[type(node.op)](walk(node.left), walk(node.right))
            case ast.UnaryOp() if type(node.op) in _OPS:
                return _OPS[type(node.op)](walk(node.operand))
            case ast.Name() if node.id in ("pi", "e"):
                return _NAMES[node.id]
            case ast.Call(func=ast.Name(id=name), keywords=[]) if name == "pow":
                return _power(*(walk(a) for a in node.args))
            case ast.Call(func=ast.Name(id=name), keywords=[]) if callable(_NAMES.get(name)):
                return _NAMES[name](*(walk(a) for a in node.args))
        raise ValueError(f"{type(node).__name__} is not allowed")

    return float(walk(ast.parse(expression, mode="eval")))


def _calculate(expressions: pd.Series) -> pd.Series:
    def one(expression: str | None) -> str | None:
        if expression is None:
            return None
        try:
            return repr(evaluate(expression))
        except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError) as e:
            return f"error: {type(e).__name__}"

    return expressions.map(one)


def calculate(expression: str) -> Column:
    """Results as text; errors as text that begins with 'error: '.  Arrow batches; the only operator that needs Python."""
    return F.pandas_udf(_calculate, "string")(F.col(expression))
