"""Expressions with static kinds, as columns of built-in functions.

Logic has two values: a comparison with null is false, null equals null, and everything has
a truth value. NaN equals nothing and has no order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.plans.errors import WrongType
from trailweave.sources.graph import tagged

NUMBERS = ("int", "float")


@dataclass
class Value:
    """A column and its kind; ``label`` of an edge or node reference, ``item`` kind of a list."""

    column: Column
    kind: str
    label: str | None = None
    item: str | None = None


def literal(value) -> Value:
    if value is None:
        return Value(F.lit(None), "null")
    if isinstance(value, bool):
        return Value(F.lit(value), "bool")
    if isinstance(value, int):
        return Value(F.lit(value).cast("bigint"), "int")
    if isinstance(value, float):
        return Value(F.lit(value), "float")
    if isinstance(value, str):
        return Value(F.lit(value), "string")
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        kinds = {i.kind for i in items} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "null" if not kinds else "mixed"
        made = F.array(*(tagged(i.column, i.kind) if kind == "mixed" else i.column for i in items))
        return Value(made, "list", item=kind)
    raise WrongType(f"a parameter can't be {type(value).__name__}")


def truthy(x: Value) -> Column:
    c = x.column
    if x.kind == "bool":
        return F.coalesce(c, F.lit(False))
    if x.kind == "int":
        return F.coalesce(c != 0, F.lit(False))
    if x.kind == "float":
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if x.kind == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if x.kind == "list":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if x.kind == "null":
        return F.lit(False)
    if x.kind == "mixed":
        return F.coalesce(F.when(c["t"] == 1, F.length(c["s"]) > 0).when(c["t"] == 2, c["i"] != 0).when(c["t"] == 3, (c["f"] != 0) & ~F.isnan(c["f"])).when(c["t"] == 7, c["b"]), F.lit(False))
    return c.isNotNull()


def not_nan(*values: Value) -> Column | None:
    guards = [~F.coalesce(F.isnan(v.column), F.lit(False)) for v in values if v.kind == "float"]
    out = None
    for g in guards:
        out = g if out is None else out & g
    return out


def equal(a: Value, b: Value) -> Column:
    if a.kind == "null":
        return b.column.isNull() if b.kind != "null" else F.lit(True)
    if b.kind == "null":
        return a.column.isNull()
    if "mixed" in (a.kind, b.kind) and a.kind not in ("node", "edge", "list") and b.kind not in ("node", "edge", "list"):
        x, y = tagged(a.column, a.kind), tagged(b.column, b.kind)
        number = lambda v: F.when(v["t"] == 2, v["i"].cast("double")).when(v["t"] == 3, v["f"])
        return x.eqNullSafe(y) | F.coalesce((number(x) == number(y)) & ~F.isnan(number(x)), F.lit(False))
    if a.kind == b.kind or a.kind in NUMBERS and b.kind in NUMBERS:
        same, guard = a.column.eqNullSafe(b.column), not_nan(a, b)
        return same if guard is None else same & guard
    return a.column.isNull() & b.column.isNull()


def ordered(op: str, a: Value, b: Value) -> Column:
    if "mixed" in (a.kind, b.kind):
        x, y = tagged(a.column, a.kind), tagged(b.column, b.kind)
        number = lambda v: F.when(v["t"] == 2, v["i"].cast("double")).when(v["t"] == 3, F.when(~F.isnan(v["f"]), v["f"]))
        return F.coalesce(compare(op, number(x), number(y)), compare(op, x["s"], y["s"]), F.lit(False))
    if a.kind in NUMBERS and b.kind in NUMBERS or a.kind == b.kind == "string":
        found, guard = F.coalesce(compare(op, a.column, b.column), F.lit(False)), not_nan(a, b)
        return found if guard is None else found & guard
    return F.lit(False)


def compare(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind in NUMBERS and b.kind in NUMBERS:
        column = a.column + b.column if op == "+" else a.column - b.column if op == "-" else a.column * b.column
        return Value(column, "int" if a.kind == b.kind == "int" else "float")
    if op == "+" and a.kind == b.kind == "string":
        return Value(F.concat(a.column, b.column), "string")
    return Value(F.lit(None), "null")


def binary(op: str, a: Value, b: Value) -> Value:
    if op == "AND":
        return Value(truthy(a) & truthy(b), "bool")
    if op == "OR":
        return Value(truthy(a) | truthy(b), "bool")
    if op == "=":
        return Value(equal(a, b), "bool")
    if op == "<>":
        return Value(~equal(a, b), "bool")
    if op in ("<", "<=", ">", ">="):
        return Value(ordered(op, a, b), "bool")
    return arithmetic(op, a, b)


def index(base: Value, place: Value) -> Value:
    """Item of a list, from 0; null out of bounds and for negative places."""
    if base.kind == "null" or place.kind == "null":
        return Value(F.lit(None), "null")
    if base.kind != "list" or place.kind != "int":
        raise WrongType("only a list has items, at an integer place")
    return Value(F.get(base.column, place.column.try_cast("int")), base.item or "null", label=base.label)


def aggregate(name: str, x: Value | None, distinct: bool) -> Value:
    if x is None:
        return Value(F.count(F.lit(1)), "int")
    c = x.column
    if name == "count":
        return Value(F.count_distinct(c) if distinct else F.count(c), "int")
    if x.kind == "null":
        return Value(F.max(F.lit(None).cast("bigint")), "int") if name != "avg" else Value(F.avg(F.lit(None).cast("double")), "float")
    if name in ("sum", "avg"):
        if x.kind not in NUMBERS:
            raise WrongType(f"{name.upper()} of a value that isn't a number")
        if name == "avg":
            c = c.cast("double")
            return Value(_distinct("avg", c) if distinct else F.avg(c), "float")
        return Value(_distinct("sum", c) if distinct else F.sum(c), x.kind)
    if x.kind not in (*NUMBERS, "string"):
        raise WrongType(f"{name.upper()} of values without an order")
    return Value(F.min(c) if name == "min" else F.max(c), x.kind)


def _distinct(name: str, c: Column) -> Column:
    return F.sum_distinct(c) if name == "sum" else F.call_function("try_divide", F.sum_distinct(c), F.count_distinct(c).cast("double"))
