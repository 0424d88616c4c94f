"""Text operators. Lengths and SEARCH positions count bytes, LEFT, RIGHT, MID and slices count characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.functions import values as V
from ruleweave.functions.values import Val, num, text
from ruleweave.operators.basic import _flat, half_away, numbers
from ruleweave.plans.compiler import Compiler, operator
from ruleweave.plans.scope import Scope


def texts(c: Compiler, a: list, s: Scope) -> list[Column]:
    return [V.to_str(v) for v in c.values(a, s)]


def _count(col: Column) -> Column:
    """A whole number of a double, without leaving the range of int."""
    return F.least(F.greatest(F.floor(F.least(F.greatest(col, F.lit(-2e9)), F.lit(2e9))), F.lit(-2_000_000_000)), F.lit(2_000_000_000)).cast("int")


@operator("cat", "concat", "CONCAT")
def cat(c: Compiler, a: list, s: Scope) -> Val:
    parts = texts(c, _flat("cat", a), s)
    return Val(F.concat(*parts) if parts else F.lit(""), T.StringType(), nullable=False)


@operator("substr", args=(2, 3))
def substr(c: Compiler, a: list, s: Scope) -> Val:
    """From a zero-based place, counted from the end if negative; a negative length is 0."""
    whole = texts(c, a[:1], s)[0]
    place = _count(numbers(c, a[1:2], s)[0])
    size = F.length(whole)
    start = F.least(F.when(place < 0, F.greatest(size + place, F.lit(0))).otherwise(place), size)
    n = F.greatest(_count(numbers(c, a[2:3], s)[0]), F.lit(0)) if len(a) == 3 else size
    return text(F.substring(whole, start + 1, n))


def _edge(names: tuple[str, ...], take) -> None:
    @operator(*names, args=(1, 2))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        n = F.greatest(_count(numbers(c, a[1:], s)[0]), F.lit(0)) if len(a) == 2 else F.lit(1)
        return text(take(texts(c, a[:1], s)[0], n))


_edge(("left", "LEFT"), F.left)
_edge(("right", "RIGHT"), F.right)


@operator("mid", "MID", args=(3, 3))
def mid(c: Compiler, a: list, s: Scope) -> Val:
    """From a one-based place; beyond the end it is empty."""
    start, n = (_count(x) for x in numbers(c, a[1:], s))
    return text(F.substring(texts(c, a[:1], s)[0], F.greatest(start, F.lit(1)), F.greatest(n, F.lit(0))))


@operator("length", args=(1, 1))
def length(c: Compiler, a: list, s: Scope) -> Val:
    v = c.value(a[0], s)
    if v.kind == "str":
        return num(F.coalesce(F.octet_length(v.col), F.lit(0)).cast("double"), False)
    if v.kind == "array":
        return num(F.coalesce(F.size(v.col), F.lit(0)).cast("double"), False)
    if isinstance(v.type, T.StructType):
        return num(F.when(v.col.isNull(), F.lit(0.0)).otherwise(F.lit(float(len(v.type)))), False)
    if isinstance(v.type, T.MapType):
        return num(F.coalesce(F.size(v.col), F.lit(0)).cast("double"), False)
    return num(F.lit(0.0), False)


@operator("len", "LEN", args=(1, 1))
def length_of_text(c: Compiler, a: list, s: Scope) -> Val:
    return num(F.octet_length(texts(c, a, s)[0]).cast("double"), False)


@operator("search", "SEARCH", args=(2, 3))
def search(c: Compiler, a: list, s: Scope) -> Val:
    """One-based place of a text in another, whatever the case; null if it is not there."""
    find, within = c.values(a[:2], s)
    if find.kind != "str" or within.kind != "str":
        return V.NULL
    start = F.greatest(_count(numbers(c, a[2:], s)[0]), F.lit(1)) if len(a) == 3 else F.lit(1)
    find, within = F.lower(find.col), F.lower(within.col)
    rest = F.substring(within, start, F.length(within))
    found = F.position(find, rest)
    place = found + start - 1
    in_bytes = F.octet_length(F.substring(within, F.lit(1), place - 1)) + 1
    return num(F.when(find == "", start.cast("double")).when(found > 0, in_bytes.cast("double")))


def _pieces(whole: Column, sep: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letters = F.concat(F.array(F.lit("")), F.split(whole, F.lit("")), F.array(F.lit("")))
    return F.when(sep == "", F.when(whole == "", F.array(F.lit(""), F.lit(""))).otherwise(letters)).otherwise(F.split(whole, quoted, F.lit(-1)))


@operator("splittext", "SPLITTEXT", args=(2, 3))
def splittext(c: Compiler, a: list, s: Scope) -> Val:
    at = _count(numbers(c, a[2:], s)[0]) if len(a) == 3 else F.lit(0)
    return text(F.coalesce(F.get(_pieces(*texts(c, a[:2], s)), at), F.lit("")))


@operator("splitvalue", "SPLITVALUE", args=(2, 2))
def splitvalue(c: Compiler, a: list, s: Scope) -> Val:
    return Val(_pieces(*texts(c, a, s)), T.ArrayType(T.StringType()))


@F.pandas_udf(T.StringType())
def _exact_decimals(x: pd.Series, d: pd.Series) -> pd.Series:
    """Decimals of the exact binary value, ties to even: built-in formats round the shortest decimal."""
    return pd.Series([None if v is None or v != v else f"{v:.{int(n)}f}" for v, n in zip(x, d, strict=True)])


@operator("stringformat", "STRINGFORMAT", args=(1, 5))
def stringformat(c: Compiler, a: list, s: Scope) -> Val:
    """A number with so many decimals, a prefix, a suffix, and a mark between thousands."""
    x = numbers(c, a[:1], s)[0]
    given = c.values(a[1:], s)
    decimals = given[0] if given else V.literal(0)
    prefix, suffix, mark = (V.to_str(given[i]) if len(given) > i else F.lit(d) for i, d in ((1, ""), (2, ""), (3, ",")))
    d = F.greatest(_count(V.to_num(decimals)), F.lit(0))
    rounded = half_away(x)
    plain = F.when(F.abs(rounded) < 1e18, F.when(F.abs(rounded) < 1e18, rounded).cast("bigint").cast("string")).otherwise(F.format_string("%.0f", x))
    if decimals.const is V.MISSING:
        shown = F.when(d == 0, plain).otherwise(_exact_decimals(x, d))
    else:
        shown = plain if float(decimals.const or 0) < 1 else _exact_decimals(x, d)
    head, tail = F.substring_index(shown, ".", 1), F.regexp_extract(shown, r"(\..*)$", 1)
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d{3})+$)", "\u0001")
    return text(F.concat(prefix, F.replace(grouped, F.lit("\u0001"), mark), tail, suffix))
