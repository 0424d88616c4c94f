"""Typed column values and the coercions that every operator rests on.

Comparisons, truth and arithmetic never yield SQL's unknown: they decide nulls as the dialect does. Columns that
are numbers already stay bare, so that filters on them still reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What parses as a number.
NUMBER = r"^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"

MISSING = object()


@dataclass(frozen=True)
class Val:
    """A column, its type, and its value where that is a literal."""

    col: Column
    type: T.DataType
    const: Any = MISSING
    nullable: bool = True

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.NumericType):
            return "num"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, (T.StructType, T.MapType)):
            return "object"
        return "str"


def num(col: Column, nullable: bool = True) -> Val:
    return Val(col, T.DoubleType(), nullable=nullable)


def text(col: Column) -> Val:
    return Val(col, T.StringType())


def flag(col: Column) -> Val:
    return Val(col, T.BooleanType(), nullable=False)


class _Null:
    """The null literal; its column is made when asked for, as columns need a running session."""

    type, const, nullable, kind = T.NullType(), None, True, "null"

    @property
    def col(self) -> Column:
        return F.lit(None)


NULL = _Null()


def literal(value: Any) -> Val:
    """A JSON value as a column; numbers are doubles, mixed arrays become strings."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), value, False)
    if isinstance(value, (int, float)):
        return Val(F.lit(float(value)), T.DoubleType(), float(value), False)
    if isinstance(value, str):
        return Val(F.lit(value), T.StringType(), value, False)
    if isinstance(value, dict):
        if not value:
            return NULL
        fields = {k: literal(v) for k, v in value.items()}
        kind = T.StructType([T.StructField(k, _plain(v.type)) for k, v in fields.items()])
        return Val(F.struct(*[v.col.cast(_plain(v.type)).alias(k) for k, v in fields.items()]), kind, value, False)
    made = array_of([literal(v) for v in value])
    return Val(made.col, made.type, value, False)


def _plain(t: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(t, T.NullType) else t


def common(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """A type that holds values of both without changing them, if there is one."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        kinds = [common(x.dataType, y.dataType) for x, y in zip(a, b, strict=True)]
        return None if None in kinds else T.StructType([T.StructField(n, k) for n, k in zip(a.names, kinds, strict=True)])
    return None


def alike(values: list[Val]) -> tuple[list[Column], T.DataType]:
    """Columns of one type: the values' common type, or their texts where they have none."""
    kind: T.DataType | None = T.NullType()
    for v in values:
        kind = common(kind, v.type) if kind is not None else None
    if kind is None:
        return [F.when(v.col.isNotNull(), to_str(v)) if v.kind != "null" else F.lit(None).cast("string") for v in values], T.StringType()
    kind = _plain(kind) if isinstance(kind, T.NullType) else kind
    return [v.col.cast(kind) for v in values], kind


def array_of(values: list[Val]) -> Val:
    if not values:
        return Val(F.array().cast("array<double>"), T.ArrayType(T.DoubleType()), nullable=False)
    cols, kind = alike(values)
    return Val(F.array(*cols), T.ArrayType(kind), nullable=False)


def parse_number(col: Column) -> Column:
    """The double that a string spells, or null."""
    spelled = F.lower(col)
    value = F.when(spelled.rlike("inf"), F.when(spelled.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(spelled.try_cast("double"))
    return F.when(spelled.rlike(NUMBER), value)


def to_num(v: Val) -> Column:
    """The number of any value: unparsable, null, objects and arrays of other than one item are 0."""
    zero = F.lit(0.0)
    if v.kind == "num":
        if v.const is not MISSING:
            return F.lit(float(v.const))
        return F.coalesce(v.col.cast("double"), zero) if v.nullable else v.col.cast("double")
    if v.kind == "bool":
        return F.coalesce(v.col.cast("int").cast("double"), zero)
    if v.kind == "str":
        return F.coalesce(parse_number(v.col), zero)
    if v.kind == "array":
        inner = Val(F.get(v.col, F.lit(0)), v.type.elementType)
        return F.when(F.size(v.col) == 1, to_num(inner)).otherwise(zero)
    return zero


def finite(col: Column, safe: bool = False) -> Val:
    """Results that are no finite number become null, or 0. The remainder by infinity is the number itself, of infinity it
    is no number; the column is named once, as rules within rules would else grow by powers."""
    return num(F.nanvl(col % F.lit(float("inf")), F.lit(0.0 if safe else None).cast("double")), not safe)


def number_text(col: Column) -> Column:
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    usual = col.cast("string")
    long = F.regexp_replace(col.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.when(whole, F.when(F.abs(col) < 1e15, col).cast("bigint").cast("string")).when(usual.contains("E") & (F.abs(col) < 1e19) & (F.abs(col) >= 1e-15), long).otherwise(usual)


def to_str(v: Val) -> Column:
    """The text of any value; null is empty, arrays and objects are compact JSON."""
    empty = F.lit("")
    if v.kind == "null":
        return empty
    if v.kind == "bool":
        return F.coalesce(v.col.cast("string"), empty)
    if v.kind == "num":
        if isinstance(v.type, T.IntegralType):
            return F.coalesce(v.col.cast("string"), empty)
        return F.coalesce(number_text(v.col.cast("double")), empty)
    if v.kind == "str":
        return F.coalesce(v.col, empty)
    if v.kind == "date":
        return F.coalesce(iso_text(v.col), empty)
    return F.coalesce(F.to_json(v.col), empty)


def iso_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'00:00:00.000'Z'")


def truthy(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(False)
    if v.const is not MISSING:
        return F.lit(bool(v.const))
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False)) if v.nullable else v.col
    if v.kind == "num":
        return F.coalesce((v.col != 0) & ~F.isnan(v.col.cast("double")), F.lit(False))
    if v.kind == "str":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "array":
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def null_like(v: Val) -> Column:
    """Null, the empty string, or no number."""
    if v.kind == "null":
        return F.lit(True)
    if v.kind == "str":
        return v.col.isNull() | (v.col == "")
    if v.kind == "num" and isinstance(v.type, (T.DoubleType, T.FloatType)):
        return v.col.isNull() | F.isnan(v.col)
    return v.col.isNull()


def _same(a: Column, b: Column, x: Val, y: Val) -> Column:
    """Equality where null equals null; a plain = where neither side can be null."""
    if not x.nullable and not y.nullable:
        return a == b
    if not x.nullable or not y.nullable:
        return F.coalesce(a == b, F.lit(False))
    return a.eqNullSafe(b)


def strict_eq(a: Val, b: Val) -> Column:
    """Same kind and same value."""
    if "null" in (a.kind, b.kind):
        return a.col.isNull() & b.col.isNull()
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    if a.kind in ("array", "object"):
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    if a.kind == "num" and a.type != b.type:
        return _same(a.col.cast("double"), b.col.cast("double"), a, b)
    return _same(a.col, b.col, a, b)


def loose_eq(a: Val, b: Val) -> Column:
    """Equality after coercion: numbers with texts and flags by number; null only equals null."""
    kinds = {a.kind, b.kind}
    if len(kinds) == 1 or "null" in kinds:
        return strict_eq(a, b)
    if "date" in kinds and "str" in kinds:
        return _same(text(to_str(a)).col, text(to_str(b)).col, a, b)
    if kinds <= {"num", "str", "bool"}:

        def number(v: Val) -> Column:
            if v.kind == "str":
                return F.when(v.col == "", F.lit(0.0)).otherwise(parse_number(v.col))
            return v.col.cast("int").cast("double") if v.kind == "bool" else v.col.cast("double")

        both = a.col.isNull() & b.col.isNull()
        return both | F.coalesce(number(a) == number(b), F.lit(False))
    return a.col.isNull() & b.col.isNull()


def comparable(a: Val, b: Val) -> tuple[Column, Column]:
    """Both sides as numbers; a bare numeric column beside a literal stays bare."""
    if a.kind == b.kind == "num" and not any(v.nullable and v.const is MISSING for v in (a, b)):
        return a.col, b.col
    return to_num(a), to_num(b)


def clean_noise(v: Val, once: bool = False) -> Val:
    """Numbers next to 0, or just above an integer, lose the noise of binary fractions. once: the number is bound, so
    that a long formula is not repeated where it cannot be computed beforehand."""
    if v.kind == "num" and isinstance(v.type, (T.DoubleType, T.FloatType)):
        if once:
            return num(F.element_at(F.transform(F.array(v.col), lambda x: clean_noise(Val(x, v.type)).col), 1))
        x = v.col
        whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
        return num(F.when(F.abs(x) < 1e-10, F.lit(0.0)).when(F.abs(x - whole) < 1e-10, F.round(x)).otherwise(x))
    if v.kind == "array":
        inner = clean_noise(Val(F.lit(None), v.type.elementType)).type
        if isinstance(v.type.elementType, (T.DoubleType, T.FloatType)):
            return Val(F.transform(v.col, lambda x: clean_noise(Val(x, v.type.elementType)).col), T.ArrayType(inner))
    return v
