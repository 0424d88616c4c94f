"""Variables, logic, comparison, arithmetic and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import RuleError
from ruleweave.functions import values as V
from ruleweave.functions.values import NULL, Val, flag, num
from ruleweave.plans.compiler import Compiler, operator
from ruleweave.plans.scope import Scope


def path_of(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return str(int(x))
    raise RuleError(f"a path is a string, not {x!r}")


@operator("var", "$ref", "ref", args=(0, 2))
def var(c: Compiler, a: list, s: Scope) -> Val:
    """The value at a path; a default stands in for null."""
    found = s.lookup(path_of(a[0]) if a else "")
    if len(a) < 2:
        return found
    default = c.value(a[1], s)
    if found.kind == "null":
        return default
    cols, kind = V.alike([found, default])
    return Val(F.coalesce(*cols), kind, nullable=default.nullable)


def _absent(s: Scope, key: str) -> Column:
    if key == "":
        return F.lit(False)
    found = s.in_data(key)
    return F.lit(True) if found.kind == "null" else found.col.isNull()


def _keys(a: list) -> list[str]:
    flat = [y for x in a for y in (x if isinstance(x, list) else [x])]
    return [k for k in flat if isinstance(k, str)]


def _missing(s: Scope, keys: list[str]) -> Column:
    if not keys:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(_absent(s, k), F.lit(k)) for k in keys]))


@operator("missing")
def missing(c: Compiler, a: list, s: Scope) -> Val:
    return Val(_missing(s, _keys(a)), T.ArrayType(T.StringType()), nullable=False)


@operator("missing_some", args=(2, 2))
def missing_some(c: Compiler, a: list, s: Scope) -> Val:
    keys = _keys([a[1]])
    gone = _missing(s, keys)
    enough = F.lit(len(keys)) - F.size(gone) >= V.to_num(c.value(a[0], s))
    return Val(F.when(enough, F.array().cast("array<string>")).otherwise(gone), T.ArrayType(T.StringType()), nullable=False)


@operator("return", args=(1, None))
def raw(c: Compiler, a: list, s: Scope) -> Val:
    """JSON as it stands; a list cannot be told from one argument's list here."""
    return V.literal(a[0] if len(a) == 1 else a)


@operator("empty", "EMPTY")
def empty(c: Compiler, a: list, s: Scope) -> Val:
    return V.literal("")


@operator("isempty", "ISEMPTY", args=(1, 1))
def isempty(c: Compiler, a: list, s: Scope) -> Val:
    v = c.value(a[0], s)
    return flag(v.col.isNull() | (v.col == "")) if v.kind == "str" else flag(v.col.isNull())


@operator("ifnull", "IFNULL", args=(2, 2))
def ifnull(c: Compiler, a: list, s: Scope) -> Val:
    x, y = c.values(a, s)
    if x.kind == "null":
        return y
    (left, right), kind = V.alike([x, y])
    return Val(F.when(V.null_like(x), right).otherwise(left), kind, nullable=y.nullable)


def _flat(name: str, a: list) -> list:
    out = []
    for x in a:
        out += _flat(name, x[name]) if isinstance(x, dict) and next(iter(x), None) == name and isinstance(x[name], list) else [x]
    return out


def _chosen(vals: list[Val], stop) -> Val:
    """The first value for which ``stop`` holds, else the last."""
    cols, kind = V.alike(vals)
    out = cols[-1]
    for v, col in list(zip(vals, cols, strict=True))[-2::-1]:
        out = F.when(stop(v), col).otherwise(out)
    return Val(out, kind)


@operator("and")
def both(c: Compiler, a: list, s: Scope) -> Val:
    vals = c.values(_flat("and", a), s)
    if not vals:
        return V.literal(True)
    if all(v.kind == "bool" for v in vals):
        return flag(reduce(lambda x, y: x & y, map(V.truthy, vals)))
    return _chosen(vals, lambda v: ~V.truthy(v))


@operator("or")
def either(c: Compiler, a: list, s: Scope) -> Val:
    vals = c.values(_flat("or", a), s)
    if not vals:
        return V.literal(False)
    if all(v.kind == "bool" for v in vals):
        return flag(reduce(lambda x, y: x | y, map(V.truthy, vals)))
    return _chosen(vals, V.truthy)


@operator("!", "not", args=(1, 1))
def negation(c: Compiler, a: list, s: Scope) -> Val:
    """Two negations in a row are dropped, so the inner value keeps its type."""
    inner = a[0]
    if isinstance(inner, dict) and next(iter(inner), None) in ("!", "not"):
        given = next(iter(inner.values()))
        return c.value(given[0] if isinstance(given, list) and len(given) == 1 else given, s)
    return flag(~V.truthy(c.value(inner, s)))


@operator("if", args=(3, None))
def choice(c: Compiler, a: list, s: Scope) -> Val:
    """Condition, then, else; further arguments have no meaning."""
    test, yes, no = c.values(a[:3], s)
    (x, y), kind = V.alike([yes, no])
    return Val(F.when(V.truthy(test), x).otherwise(y), kind, nullable=yes.nullable or no.nullable)


@operator("xor", args=(2, 2))
def exclusive(c: Compiler, a: list, s: Scope) -> Val:
    x, y = map(V.truthy, c.values(a, s))
    return flag(x != y)


def _compare(name: str, test) -> None:
    @operator(name, args=(2, 2))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        x, y = c.values(a, s)
        return flag(test(x, y))


def _ordered(op):
    """Order is of numbers only; a nullable column beside a literal is tested where it is not null, and null counts as 0."""

    def test(x: Val, y: Val) -> Column:
        for v, w, swap in ((x, y, False), (y, x, True)):
            if v.kind == "num" and v.nullable and w.kind == "num" and w.const is not V.MISSING:
                bound = F.lit(int(w.const)) if isinstance(v.type, T.IntegralType) and float(w.const).is_integer() else w.col
                bare = op(bound, v.col) if swap else op(v.col, bound)
                at_null = op(float(w.const), 0.0) if swap else op(0.0, float(w.const))
                return v.col.isNull() | bare if at_null else v.col.isNotNull() & bare
        return op(*V.comparable(x, y))

    return test


_compare("==", V.loose_eq)
_compare("!=", lambda x, y: ~V.loose_eq(x, y))
_compare("===", V.strict_eq)
_compare("!==", lambda x, y: ~V.strict_eq(x, y))
_compare("<", _ordered(lambda x, y: x < y))
_compare("<=", _ordered(lambda x, y: x <= y))
_compare(">", _ordered(lambda x, y: x > y))
_compare(">=", _ordered(lambda x, y: x >= y))


def numbers(c: Compiler, a: list, s: Scope) -> list[Column]:
    return [V.to_num(v) for v in c.values(a, s)]


@operator("+")
def add(c: Compiler, a: list, s: Scope) -> Val:
    return V.finite(reduce(lambda x, y: x + y, numbers(c, _flat("+", a), s), F.lit(0.0)), s.config.safe_nan)


@operator("-")
def subtract(c: Compiler, a: list, s: Scope) -> Val:
    """A left fold; one operand is negated."""
    n = numbers(c, a, s)
    if len(n) == 1:
        return V.finite(-n[0] + 0.0, s.config.safe_nan)
    return V.finite(reduce(lambda x, y: x - y, n), s.config.safe_nan) if n else num(F.lit(0.0), False)


@operator("*")
def multiply(c: Compiler, a: list, s: Scope) -> Val:
    n = numbers(c, _flat("*", a), s)
    return V.finite(reduce(lambda x, y: x * y, n), s.config.safe_nan) if n else num(F.lit(0.0), False)


@operator("/")
def divide(c: Compiler, a: list, s: Scope) -> Val:
    n = numbers(c, a, s)
    return V.finite(reduce(F.try_divide, n), s.config.safe_nan) if n else num(F.lit(0.0), False)


@operator("%", args=(2, 2))
def modulo(c: Compiler, a: list, s: Scope) -> Val:
    """The remainder takes the dividend's sign; by 0 it is null."""
    x, y = numbers(c, a, s)
    return V.finite(F.try_mod(x, y), s.config.safe_nan)


@operator("^", "pow", "**", args=(2, 2))
def power(c: Compiler, a: list, s: Scope) -> Val:
    return V.finite(F.pow(*numbers(c, a, s)), s.config.safe_nan)


@operator("abs", args=(1, 1))
def absolute(c: Compiler, a: list, s: Scope) -> Val:
    return V.finite(F.abs(numbers(c, a, s)[0]), s.config.safe_nan)


def _extreme(name: str, pick) -> None:
    @operator(name)
    def run(c: Compiler, a: list, s: Scope) -> Val:
        n = numbers(c, a, s)
        return V.finite(pick(*n) if len(n) > 1 else n[0], s.config.safe_nan) if n else NULL


_extreme("max", F.greatest)
_extreme("min", F.least)

#: From this size on a double has no fraction, and ceil and floor would leave the range of long.
_WHOLE = float(1 << 53)


def whole(x: Column, how) -> Column:
    """ceil or floor as a double."""
    return F.when(F.abs(x) < _WHOLE, how(F.when(F.abs(x) < _WHOLE, x)).cast("double")).otherwise(x)


def half_away(x: Column) -> Column:
    """Rounding of halves away from zero."""
    up = whole(F.abs(x), F.floor)
    return F.signum(x) * (up + F.when(F.abs(x) - up >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))) + 0.0


def toward_zero(x: Column) -> Column:
    return F.signum(x) * whole(F.abs(x), F.floor) + 0.0


def _rounding(names: tuple[str, ...], how) -> None:
    @operator(*names, args=(1, 2))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        x, *d = numbers(c, a, s)
        if not d:
            return V.finite(how(x), s.config.safe_nan)
        scale = F.pow(F.lit(10.0), toward_zero(d[0]))
        return V.finite(F.try_divide(how(x * scale), scale), s.config.safe_nan)


_rounding(("round", "ROUND"), half_away)
_rounding(("roundup", "ROUNDUP"), lambda x: whole(x, F.ceil))
_rounding(("rounddown", "ROUNDDOWN"), lambda x: whole(x, F.floor))
_rounding(("trunc", "TRUNC"), toward_zero)


def _to_multiple(names: tuple[str, ...], how, least: int) -> None:
    @operator(*names, args=(least, 2))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        x, *m = numbers(c, a, s)
        step = m[0] if m else F.lit(1.0)
        return V.finite(F.when(step == 0, F.lit(0.0)).otherwise(how(F.try_divide(x, step)) * step), s.config.safe_nan)


_to_multiple(("ceiling", "CEILING"), lambda x: whole(x, F.ceil), 1)
_to_multiple(("floor", "FLOOR"), lambda x: whole(x, F.floor), 1)
_to_multiple(("mround", "MROUND"), half_away, 2)
