"""Table lookups: VALUEAT, MAXAT, INDEXAT, MATCH, MATCHRANGE, CHOOSE, FINDINDEX and option lists.

A table is either an array of objects in the document, searched by array functions, or a DataFrame that the
engine knows by name. Lookups in DataFrames become joins, which the plan adds to the documents before the
rule's projection (``plans.joins``); every document keeps exactly one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import RuleError
from ruleweave.functions import values as V
from ruleweave.functions.values import NULL, Val, num
from ruleweave.operators.arrays import fold_and
from ruleweave.operators.basic import numbers, toward_zero
from ruleweave.paths import dotted
from ruleweave.plans.compiler import OPERATORS, Compiler, operator
from ruleweave.plans.scope import Frame, Scope, item_frame


@dataclass(frozen=True)
class Table:
    """The rows' array, or the name of a DataFrame."""

    rows: Val | None
    name: str | None = None


def path_in(rule: Any) -> str | None:
    """The path of a bare reference."""
    if isinstance(rule, dict) and next(iter(rule), None) in ("var", "$ref", "ref"):
        given = next(iter(rule.values()))
        given = given[0] if isinstance(given, list) and given else given
        return given if isinstance(given, str) else None
    return None


def table(c: Compiler, rule: Any, s: Scope) -> Table:
    path = path_in(rule)
    if path is not None:
        if (name := dotted(path)) in s.tables:
            return Table(None, name)
        v = s.operand(path)
    else:
        v = c.value(rule, s)
    ok = v.kind == "array" and isinstance(v.type.elementType, (T.StructType, T.MapType))
    return Table(v if ok else None)


def column_name(c: Compiler, rule: Any, s: Scope) -> str:
    path = path_in(rule)
    v = s.operand(path) if path is not None else c.value(rule, s)
    if isinstance(v.const, str):
        return v.const
    if isinstance(v.const, float):
        return str(int(v.const))
    raise RuleError("a column name must be a literal text")


def cell(row: Column, kind: T.DataType, name: str) -> Val | None:
    return item_frame(row, kind).find([name]) if name else None


def first_index(rows: Val, test) -> Val:
    """Zero-based place of the first row that passes, else -1; null where there is no table."""
    found = F.array_position(F.transform(rows.col, lambda r: F.coalesce(test(r), F.lit(False))), True)
    return num((found - 1).cast("double"))


def _kind(t: Table) -> T.DataType:
    return t.rows.type.elementType


def row_at(rows: Val, index: Column) -> Val:
    """The row at an index, null outside."""
    place = F.when((index >= 0) & (index < F.size(rows.col)), index).cast("int")
    return Val(F.get(rows.col, place), rows.type.elementType)


@operator("valueat", "VALUEAT", args=(2, 3))
def valueat(c: Compiler, a: list, s: Scope) -> Val:
    """A cell, or a whole row, by index. A lookup in the same table as index is one search."""
    t = table(c, a[0], s)
    name = column_name(c, a[2], s) if len(a) == 3 and a[2] is not None else None
    if t.name:
        row = s.plan.row_of(c, t.name, a[1], s)
    elif t.rows is None:
        return NULL
    else:
        row = row_at(t.rows, toward_zero(numbers(c, a[1:2], s)[0]))
    if name is None:
        return row
    return cell(row.col, row.type, name) or NULL


@operator("maxat", "MAXAT", args=(2, 2))
def maxat(c: Compiler, a: list, s: Scope) -> Val:
    """The last row's cell."""
    t, name = table(c, a[0], s), column_name(c, a[1], s)
    if t.name:
        row = s.plan.last_row(t.name)
    elif t.rows is None:
        return NULL
    else:
        row = Val(F.when(F.size(t.rows.col) > 0, F.try_element_at(t.rows.col, F.lit(-1))), _kind(t))
    return cell(row.col, row.type, name) or NULL


@operator("indexat", "INDEXAT", args=(3, 4))
def indexat(c: Compiler, a: list, s: Scope) -> Val:
    """First row whose cell equals the value; with range, the first whose cell is at most the value."""
    t, x, name = table(c, a[1], s), c.value(a[0], s), column_name(c, a[2], s)
    span = c.value(a[3], s) if len(a) == 4 else V.literal(False)
    if t.name:
        return s.plan.index(t.name, ("range", x, name) if span.const not in (V.MISSING, False, None, 0.0, "") else ("keys", [(x, name)]))
    if t.rows is None:
        return NULL
    kind = _kind(t)

    def test(r: Column) -> Column:
        found = cell(r, kind, name)
        if found is None:
            return F.lit(False)
        below = found.col.isNotNull() & (V.to_num(found) <= V.to_num(x))
        return F.when(V.truthy(span), below).otherwise(V.loose_eq(found, x))

    return first_index(t.rows, test)


def _pairs(c: Compiler, a: list, s: Scope) -> list[tuple[Val, str]]:
    """(value, column) of arguments that alternate."""
    flat = a[0] if len(a) == 1 and isinstance(a[0], list) else a
    return [(c.value(flat[i], s), column_name(c, flat[i + 1], s)) for i in range(0, len(flat) - 1, 2)]


def _equal(r: Column, kind: T.DataType, pair: tuple[Val, str]) -> Column:
    found = cell(r, kind, pair[1])
    return F.lit(False) if found is None else V.loose_eq(found, pair[0])


@operator("match", "MATCH", args=(1, None))
def match(c: Compiler, a: list, s: Scope) -> Val:
    """First row where all pairs of (value, column) are equal."""
    t, pairs = table(c, a[0], s), _pairs(c, a[1:], s)
    if t.name:
        return s.plan.index(t.name, ("keys", pairs))
    return NULL if t.rows is None else first_index(t.rows, lambda r: fold_and([_equal(r, _kind(t), p) for p in pairs]))


@operator("choose", "CHOOSE", args=(1, None))
def choose(c: Compiler, a: list, s: Scope) -> Val:
    """First row where any pair of (value, column) is equal."""
    t, pairs = table(c, a[0], s), _pairs(c, a[1:], s)
    if t.name:
        return s.plan.index(t.name, ("any", pairs))
    if t.rows is None:
        return NULL

    def test(r: Column) -> Column:
        out = F.lit(False)
        for p in pairs:
            out = out | _equal(r, _kind(t), p)
        return out

    return first_index(t.rows, test)


@operator("matchrange", "MATCHRANGE", args=(1, None))
def matchrange(c: Compiler, a: list, s: Scope) -> Val:
    """First row where each value lies within its columns of least and greatest, both included."""
    t = table(c, a[0], s)
    flat = a[1] if len(a) == 2 and isinstance(a[1], list) else a[1:]
    ranges = [(column_name(c, flat[i], s), column_name(c, flat[i + 1], s), c.value(flat[i + 2], s)) for i in range(0, len(flat) - 2, 3)]
    if t.name:
        return s.plan.index(t.name, ("between", ranges))
    if t.rows is None:
        return NULL

    def bound(r: Column, name: str) -> Column:
        found = cell(r, _kind(t), name)
        return F.lit(0.0) if found is None else V.to_num(found)

    return first_index(t.rows, lambda r: fold_and([V.to_num(x).between(bound(r, lo), bound(r, hi)) for lo, hi, x in ranges]))


#: Spellings that a condition in list form may start with, besides operators of two values.
_JOINERS = {"&&": "and", "||": "or", "and": "and", "or": "or", "!": "!", "not": "!", "if": "if"}


def condition(x: Any) -> Any:
    """A condition of FINDINDEX as a rule: "col" is the column's truth, [op, value, col] compares the column
    with the value, and lists of conditions may be joined."""
    if isinstance(x, str):
        return {"var": x}
    if not isinstance(x, list) or not x:
        return x
    head = x[0]
    if head in _JOINERS:
        return {_JOINERS[head]: [condition(y) for y in x[1:]]}
    if isinstance(head, str) and head in OPERATORS and len(x) == 3:
        left = {"var": x[2]} if isinstance(x[2], str) else condition(x[2])
        return {head: [left, x[1]]}
    if len(x) == 1:
        return condition(head)
    raise RuleError(f"no condition: {x!r}")


def _row_scope(r: Column, kind: T.DataType, s: Scope) -> Scope:
    """Context, then the row, then the document; bare references with $ref skip the row."""
    return Scope(s.data, (*s.context, item_frame(r, kind)), s.config, s.tables, s.plan)


def _without_row(rule: Any, c: Compiler, s: Scope, held: dict[str, Val]) -> Any:
    """Replaces $ref by names of values that were looked up outside the row."""
    if isinstance(rule, list):
        return [_without_row(x, c, s, held) for x in rule]
    if isinstance(rule, dict):
        if next(iter(rule), None) in ("$ref", "ref"):
            name = f"$outer{len(held)}"
            held[name] = c.value(rule, s)
            return {"var": name}
        return {k: v if k == "return" else _without_row(v, c, s, held) for k, v in rule.items()}
    return rule


def row_test(c: Compiler, conds: list, s: Scope, kind: T.DataType):
    """The conditions as a test of a row."""
    held: dict[str, Val] = {}
    rules = [_without_row(condition(x), c, s, held) for x in conds]

    def test(r: Column) -> Column:
        inner = _row_scope(r, kind, s)
        inner = Scope(inner.data, (Frame(held), *inner.context), s.config, s.tables, s.plan)
        return fold_and([V.truthy(c.value(x, inner)) for x in rules])

    return test


@operator("findindex", "FINDINDEX", args=(1, None))
def findindex(c: Compiler, a: list, s: Scope) -> Val:
    """First row that passes all conditions."""
    t = table(c, a[0], s)
    if t.name:
        return s.plan.find(c, t.name, a[1:], s)
    return NULL if t.rows is None else first_index(t.rows, row_test(c, a[1:], s, _kind(t)))


_OPTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])


@operator("RANGEOPTIONS", "rangeoptions", args=(2, 2))
def rangeoptions(c: Compiler, a: list, s: Scope) -> Val:
    """Options for each whole number from least to greatest."""
    lo, hi = (toward_zero(x).cast("long") for x in numbers(c, a, s))
    some = F.sequence(F.when(lo <= hi, lo), F.when(lo <= hi, hi))
    made = F.transform(some, lambda i: F.struct(i.cast("string").alias("label"), i.cast("string").alias("value")))
    return Val(F.coalesce(made, F.array().cast(T.ArrayType(_OPTION))), T.ArrayType(_OPTION), nullable=False)


def _options(rows: Val, label: str, value: str) -> Val:
    kind = rows.type.elementType
    names, given = cell(F.lit(None).cast(kind), kind, label), cell(F.lit(None).cast(kind), kind, value)
    if names is None or given is None:
        return V.array_of([])
    out = T.StructType([T.StructField("label", names.type), T.StructField("value", given.type)])
    made = F.transform(rows.col, lambda r: F.struct(cell(r, kind, label).col.alias("label"), cell(r, kind, value).col.alias("value")))
    return Val(F.coalesce(made, F.array().cast(T.ArrayType(out))), T.ArrayType(out), nullable=False)


@operator("MAPOPTIONS", "mapoptions", args=(3, 3))
def mapoptions(c: Compiler, a: list, s: Scope) -> Val:
    t = table(c, a[0], s)
    rows = s.plan.rows(t.name) if t.name else t.rows
    return V.array_of([]) if rows is None else _options(rows, column_name(c, a[1], s), column_name(c, a[2], s))


def _triplets(conds: list) -> list:
    """value, operator, column - flat or in lists - as rules; other forms as in FINDINDEX."""
    compare = ("==", "!=", "===", "!==", "<", "<=", ">", ">=")
    out, i = [], 0
    while i < len(conds):
        x = conds[i]
        if isinstance(x, list) and len(x) == 3 and x[1] in compare:
            out.append({x[1]: [x[0], {"var": x[2]} if isinstance(x[2], str) else x[2]]})
        elif i + 2 < len(conds) and isinstance(conds[i + 1], str) and conds[i + 1] in compare:
            out.append({conds[i + 1]: [x, {"var": conds[i + 2]} if isinstance(conds[i + 2], str) else conds[i + 2]]})
            i += 2
        else:
            out.append(condition(x))
        i += 1
    return out


@operator("MAPOPTIONSIF", "mapoptionsif", args=(3, None))
def mapoptionsif(c: Compiler, a: list, s: Scope) -> Val:
    """Options of the rows that pass; the document's names come before the row's."""
    t = table(c, a[0], s)
    rows = s.plan.rows(t.name) if t.name else t.rows
    if rows is None:
        return V.array_of([])
    kind, rules = rows.type.elementType, _triplets(a[3:])

    def test(r: Column) -> Column:
        inner = Scope(item_frame(r, kind), (*s.context, s.data), s.config, s.tables, s.plan)
        return fold_and([V.truthy(c.value(x, inner)) for x in rules])

    return _options(Val(F.filter(rows.col, test), rows.type), column_name(c, a[1], s), column_name(c, a[2], s))
