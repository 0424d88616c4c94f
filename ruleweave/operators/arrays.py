"""Operators on arrays. Inside an item's logic only the item is visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import RuleError
from ruleweave.functions import values as V
from ruleweave.functions.values import Val, flag, num
from ruleweave.operators.basic import numbers, toward_zero
from ruleweave.plans.compiler import Compiler, operator
from ruleweave.plans.scope import Frame, Scope, item_frame


def array(c: Compiler, rule, s: Scope) -> Val | None:
    """The operand as an array, or None where it never is one."""
    v = c.value(rule, s)
    return v if v.kind == "array" else None


def _or_empty(v: Val) -> Column:
    return F.coalesce(v.col, F.array().cast(v.type))


def _typed(c: Compiler, rule, s: Scope, kind: T.DataType) -> Val:
    """The body's value for an item of a type; only its type is of interest."""
    return c.value(rule, s.only(item_frame(F.lit(None).cast(kind), kind)))


@operator("map", args=(2, 2))
def map_(c: Compiler, a: list, s: Scope) -> Val:
    v = array(c, a[0], s)
    if v is None:
        return V.array_of([])
    inner = _typed(c, a[1], s, v.type.elementType)
    kind = T.StringType() if inner.kind == "null" else inner.type
    body = lambda x: c.value(a[1], s.only(item_frame(x, v.type.elementType))).col.cast(kind)
    return Val(F.transform(_or_empty(v), body), T.ArrayType(kind), nullable=False)


@operator("filter", args=(2, 2))
def filter_(c: Compiler, a: list, s: Scope) -> Val:
    v = array(c, a[0], s)
    if v is None:
        return V.array_of([])
    return Val(F.filter(_or_empty(v), _test(c, a[1], s, v)), v.type, nullable=False)


def _test(c: Compiler, rule, s: Scope, v: Val):
    return lambda x: V.truthy(c.value(rule, s.only(item_frame(x, v.type.elementType))))


@operator("reduce", args=(3, 3))
def reduce_(c: Compiler, a: list, s: Scope) -> Val:
    """A fold; the accumulator has the type that the start value and the body agree on."""
    start = c.value(a[2], s)
    v = array(c, a[0], s)
    if v is None:
        return start
    frame = lambda x, acc, kind: Frame({"current": Val(x, v.type.elementType), "accumulator": Val(acc, kind)})
    kind = start.type
    for _ in range(3):
        made = c.value(a[1], s.only(frame(F.lit(None).cast(v.type.elementType), F.lit(None).cast(kind), kind)))
        wider = V.common(kind, made.type)
        if wider is None:
            raise RuleError("reduce: the body's value has another type than the start value")
        if wider == kind:
            break
        kind = wider
    kind = T.DoubleType() if isinstance(kind, T.NullType) else kind
    step = lambda acc, x: c.value(a[1], s.only(frame(x, acc, kind))).col.cast(kind)
    return Val(F.when(v.col.isNull(), start.col.cast(kind)).otherwise(F.aggregate(v.col, start.col.cast(kind), step)), kind)


def _quantifier(name: str, at_null: bool, how) -> None:
    @operator(name, args=(2, 2))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        v = array(c, a[0], s)
        if v is None:
            return flag(F.lit(at_null))
        return flag(F.coalesce(how(v.col, _test(c, a[1], s, v)), F.lit(at_null)))


_quantifier("all", False, F.forall)
_quantifier("some", False, F.exists)
_quantifier("none", True, lambda col, test: ~F.exists(col, test))


@operator("merge")
def merge(c: Compiler, a: list, s: Scope) -> Val:
    """One level of lists joined; single values are appended."""
    vals = c.values(a, s)
    items = [Val(F.lit(None), v.type.elementType if v.kind == "array" else v.type) for v in vals]
    if not items:
        return V.array_of([])
    _, kind = V.alike(items)
    text = isinstance(kind, T.StringType)
    parts = []
    for v in vals:
        if v.kind == "array":
            same = not text or isinstance(v.type.elementType, T.StringType)
            parts.append(_or_empty(v).cast(T.ArrayType(kind)) if same else F.transform(_or_empty(v), lambda x, t=v.type.elementType: V.to_str(Val(x, t))))
        else:
            parts.append(F.array(v.col.cast(kind) if not text or v.kind in ("str", "null") else V.to_str(v)))
    return Val(F.concat(*parts), T.ArrayType(kind), nullable=False)


#: Fixed value: from so many plain items on, a list is looked up by the items' texts.
HASHED_FROM = 33


@operator("in", args=(2, 2))
def in_(c: Compiler, a: list, s: Scope) -> Val:
    """Part of a text, or loosely equal to an item."""
    x, hay = c.values(a, s)
    if hay.kind == "str":
        return flag(F.coalesce(F.contains(hay.col, x.col), F.lit(False))) if x.kind == "str" else flag(F.lit(False))
    if hay.kind != "array":
        return flag(F.lit(False))
    if isinstance(hay.const, list) and hay.const and all(isinstance(y, str) for y in hay.const) and x.kind == "str":
        return flag(F.coalesce(x.col.isin(hay.const), F.lit(False)))
    if isinstance(hay.const, list) and hay.const and all(isinstance(y, (int, float)) and not isinstance(y, bool) for y in hay.const) and x.kind == "num":
        return flag(F.coalesce(x.col.isin(*[float(y) for y in hay.const]), F.lit(False)))
    kind = hay.type.elementType
    loose = F.coalesce(F.exists(hay.col, lambda y: V.loose_eq(x, Val(y, kind))), F.lit(False))
    if Val(hay.col, kind).kind in ("array", "object"):
        return flag(loose)
    key = lambda v: F.when(v.col.isNull(), F.lit("null")).otherwise(V.to_str(v)) if v.kind != "null" else F.lit("null")
    hashed = F.coalesce(F.array_contains(F.transform(hay.col, lambda y: key(Val(y, kind))), key(x)), F.lit(False))
    if isinstance(hay.const, list):
        return flag(hashed if len(hay.const) >= HASHED_FROM else loose)
    return flag(F.when(F.size(hay.col) >= HASHED_FROM, hashed).otherwise(loose))


@operator("sum", "SUM", args=(1, 3))
def sum_(c: Compiler, a: list, s: Scope) -> Val:
    """Sum of numbers, or of a field; a threshold n takes the first n + 1 items."""
    v = c.value(a[0], s)
    if v.kind != "array":
        return V.finite(V.to_num(v), s.config.safe_nan)
    col = _or_empty(v)
    if len(a) == 3:
        limit = toward_zero(numbers(c, a[2:], s)[0])
        n = F.least(limit + 1, F.lit(2e9)).cast("int")
        col = F.when(limit >= 0, F.slice(col, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(col)
    name = c.value(a[1], s).const if len(a) > 1 else None
    kind = v.type.elementType

    def number(x: Column) -> Column:
        if isinstance(name, str) and name:
            found = item_frame(x, kind).find([name])
            return V.to_num(found) if found is not None else F.lit(0.0)
        return V.to_num(Val(x, kind))

    return V.finite(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + number(x)), s.config.safe_nan)


def counted(start: Column, stop: Column) -> Column:
    """start, start + 1, ... below stop; empty where stop is not above start."""
    return F.when(start < stop, F.sequence(F.when(start < stop, start).cast("long"), F.when(start < stop, stop).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def for_values(c: Compiler, a: list, s: Scope) -> Val:
    start, stop = (toward_zero(x) for x in numbers(c, a[:2], s))
    frame = lambda i: Frame({"$loopIteration": num(i.cast("double"), False)})
    inner = c.value(a[2], s.with_context(frame(F.lit(0.0))))
    kind = T.StringType() if inner.kind == "null" else inner.type
    body = lambda i: c.value(a[2], s.with_context(frame(i))).col.cast(kind)
    return Val(F.transform(counted(start, stop), body), T.ArrayType(kind), nullable=False)


@operator("FOR", "for", args=(3, 3))
def for_(c: Compiler, a: list, s: Scope) -> Val:
    return for_values(c, a, s)


def _flattened(c: Compiler, a: list, s: Scope) -> Column:
    """Numbers of all operands, one level of lists opened."""
    parts = []
    for v in c.values(a, s):
        if v.kind == "array":
            parts.append(F.transform(_or_empty(v), lambda x, t=v.type.elementType: V.to_num(Val(x, t))))
        else:
            parts.append(F.array(V.to_num(v)))
    return F.concat(*parts) if parts else F.array().cast("array<double>")


@operator("MULTIPLIES", "multiplies")
def multiplies(c: Compiler, a: list, s: Scope) -> Val:
    items = _flattened(c, a, s)
    return V.finite(F.when(F.size(items) > 0, F.aggregate(items, F.lit(1.0), lambda x, y: x * y)), s.config.safe_nan)


@operator("DIVIDES", "divides")
def divides(c: Compiler, a: list, s: Scope) -> Val:
    """A left fold that skips zero divisors."""
    items = _flattened(c, a, s)
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    fold = F.aggregate(rest, F.get(items, F.lit(0)), lambda x, y: F.when(y == 0, x).otherwise(F.try_divide(x, y)))
    return V.finite(F.when(F.size(items) > 0, fold), s.config.safe_nan)


def fold_and(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts, F.lit(True)) if not parts else reduce(lambda x, y: x & y, parts)
