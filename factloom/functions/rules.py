"""Typed rule trees and spreadsheet formulas, compiled to columns."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH, NODES = 8, 200
#: Operators by kind of field.
ALLOWED = {
    "text": ("eq", "ne", "in", "not_in", "contains", "not_contains", "starts_with", "ends_with", "matches", "is_empty", "is_not_empty"),
    "number": ("eq", "ne", "lt", "lte", "gt", "gte", "between", "in", "not_in", "is_empty", "is_not_empty"),
    "date": ("eq", "ne", "lt", "lte", "gt", "gte", "between", "is_empty", "is_not_empty"),
    "boolean": ("is_true", "is_false", "is_empty", "is_not_empty"),
}


def kind_of(field: T.DataType) -> str:
    if isinstance(field, T.StringType):
        return "text"
    if isinstance(field, T.BooleanType):
        return "boolean"
    if isinstance(field, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "number"


#: What a value may be by kind of field, and operators that take none or several.
VALUES = {"text": (str,), "number": (int, float, Decimal), "date": (str, date), "boolean": ()}
NONE, SEVERAL = ("is_empty", "is_not_empty", "is_true", "is_false"), ("in", "not_in", "between")


def _leaf_problems(node: dict, schema: T.StructType) -> list[str]:
    """What is wrong with one comparison: a part that is missing, an unknown field, an operator that its kind does not have, a value of another kind."""
    field, op = node.get("field"), node.get("op")
    if field is None or op is None:
        return [f"leaf without {'field' if field is None else 'op'}"]
    if field not in schema.fieldNames():
        return [f"field {field}"]
    kind = kind_of(schema[field].dataType)
    if op not in ALLOWED[kind]:
        return [f"operator {op} on {field}"]
    if op in NONE:
        return []
    value = node.get("value")
    values = list(value) if op in SEVERAL and isinstance(value, (list, tuple)) else None if op in SEVERAL else [value]
    if values is None or not values or (op == "between" and len(values) != 2):
        return [f"value of {op} on {field}"]
    if not all(isinstance(v, VALUES[kind]) and not isinstance(v, bool) for v in values):
        return [f"value of {field}"]
    return []


def catalog(schema: T.StructType) -> list[tuple[str, str, list[str]]]:
    """(field, kind, operators) of a table: what rules over it may say."""
    return [(f.name, kind_of(f.dataType), list(ALLOWED[kind_of(f.dataType)])) for f in schema.fields]


def mapping_issues(leaves: DataFrame, fields: DataFrame) -> DataFrame:
    """(rule, field, issue) of leaves (rule, field, kind, op) that a catalog (field, kind, operators) no longer bears out: the field is gone, has another kind, or its kind lacks the operator.

    A catalog has a row for each column of a table, so it is broadcast; leaves are as many as people have made rules.
    """
    held = leaves.join(F.broadcast(fields.withColumnRenamed("kind", "now")), "field", "left")
    issue = F.when(F.col("now").isNull(), "absent").when(F.col("kind").isNull() | (F.col("kind") != F.col("now")), "kind changed").when(F.col("op").isNull() | ~F.array_contains("operators", F.col("op")), "operator not allowed")
    return held.withColumn("issue", issue).where("issue is not null").select("rule", "field", "issue")


def checked(tree: dict, schema: T.StructType) -> list[str]:
    """What is wrong with a rule tree: unknown fields, operators that a field's kind does not have, too deep or too large."""
    found, count = [], 0

    def walk(node: dict, depth: int) -> None:
        nonlocal count
        count += 1
        if depth > DEPTH:
            found.append("depth")
        if "all" in node or "any" in node:
            for x in node.get("all") or node.get("any") or []:
                walk(x, depth + 1)
            if not (node.get("all") or node.get("any")):
                found.append("empty group")
        else:
            found.extend(_leaf_problems(node, schema))

    walk(tree, 1)
    if count > NODES:
        found.append("size")
    return found


def compiled(tree: dict, schema: T.StructType) -> Column:
    """A rule tree of {"all": [...]}, {"any": [...]}, optional "not", and leaves {"field", "op", "value"} as a column that is never null."""
    if problems := checked(tree, schema):
        raise ValueError("; ".join(problems))
    return _node(tree)


def _node(node: dict) -> Column:
    if "all" in node:
        out = reduce(and_, map(_node, node["all"]))
    elif "any" in node:
        out = reduce(or_, map(_node, node["any"]))
    else:
        out = F.coalesce(_leaf(F.col(node["field"]), node["op"], node.get("value")), F.lit(False))
    return ~out if node.get("not") else out


def _leaf(c: Column, op: str, v) -> Column:
    empty = c.isNull() | (c.cast("string") == "")
    return {
        "eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "lte": lambda: c <= v, "gt": lambda: c > v, "gte": lambda: c >= v,
        "between": lambda: c.between(*v), "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v), "contains": lambda: c.contains(v), "not_contains": lambda: ~c.contains(v),
        "starts_with": lambda: c.startswith(v), "ends_with": lambda: c.endswith(v), "matches": lambda: c.rlike(v), "is_empty": lambda: empty, "is_not_empty": lambda: ~empty,
        "is_true": lambda: c, "is_false": lambda: ~c,
    }[op]()


def percent(x: Column) -> Column:
    """A share as TEXT(x, "0%")."""
    return F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))


def if_error(x: Column, other) -> Column:
    return F.coalesce(x, F.lit(other))


def ordered_value(x: Column) -> Column:
    """Sort key of a spreadsheet value given as text: numbers before text before logical values; blank counts as 0."""
    n = F.when(F.coalesce(x, F.lit("")) == "", F.lit(0.0)).otherwise(x.try_cast("double"))
    logical = F.upper(x).isin("TRUE", "FALSE")
    return F.struct(F.when(n.isNotNull(), 0).when(logical, 2).otherwise(1).alias("kind"), n.alias("number"), F.when(n.isNull(), F.lower(x)).alias("text"))
