"""Dates. Values are ISO texts or date columns; times are dropped; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import RuleError
from ruleweave.functions import values as V
from ruleweave.functions.values import NULL, Val, num, text
from ruleweave.operators.basic import numbers, toward_zero
from ruleweave.plans.compiler import Compiler, operator
from ruleweave.plans.scope import Scope

#: Date formats in the order in which they are tried; month-first comes before day-first.
FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy"]
#: Fixed value: a time that may follow a date of year-month-day.
TIME_PART = r"^(\d{4}-\d{1,2}-\d{1,2})(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?| \d{1,2}:\d{2}(?::\d{2})?)?$"

#: Named formats as patterns of date_format.
NAMED = {
    "short": "MM/dd/yyyy", "long": "MMMM dd, yyyy", "iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "full": "EEEE, MMMM dd, yyyy",
    "monthday": "MMMM dd", "yearmonth": "yyyy-MM", "ddmmyyyy": "dd/MM/yyyy", "mmddyyyy": "MM/dd/yyyy", "yyyymmdd": "yyyy-MM-dd",
    "dd-mm-yyyy": "dd-MM-yyyy", "mm-dd-yyyy": "MM-dd-yyyy", "yyyy-mm-dd": "yyyy-MM-dd", "dd.mm.yyyy": "dd.MM.yyyy",
}

#: Strftime directives that date_format has a pattern for; the time of a date is midnight.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD",
    "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}


def unwrapped(v: Val) -> Val:
    """A list of one is its item."""
    if v.kind != "array":
        return v
    return Val(F.when(F.size(v.col) == 1, F.get(v.col, F.lit(0))), v.type.elementType)


def to_date(v: Val) -> Column:
    v = unwrapped(v)
    if v.kind == "date":
        return v.col.cast("date")
    if v.kind != "str":
        return F.lit(None).cast("date")
    day = F.regexp_extract(v.col, TIME_PART, 1)
    source = F.when(day != "", day).otherwise(v.col)
    return F.coalesce(*[F.try_to_date(source, f) for f in FORMATS])


def days(c: Compiler, a: list, s: Scope) -> list[Column]:
    return [to_date(v) for v in c.values(a, s)]


def _now(s: Scope) -> Column:
    now = F.lit(s.config.now).cast("timestamp") if s.config.now else F.current_timestamp()
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), now.cast("timestamp_ntz")) + F.make_dt_interval(mins=F.lit(s.config.timezone_minutes))


@operator("today", "TODAY")
def today(c: Compiler, a: list, s: Scope) -> Val:
    return text(V.iso_text(_now(s)))


@operator("now", "NOW")
def now(c: Compiler, a: list, s: Scope) -> Val:
    return text(F.date_format(_now(s), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@operator("days", "DAYS", args=(2, 2))
def days_between(c: Compiler, a: list, s: Scope) -> Val:
    end, start = days(c, a, s)
    return num(F.datediff(end, start).cast("double"))


def _part(names: tuple[str, str], take) -> None:
    @operator(*names, args=(1, 1))
    def run(c: Compiler, a: list, s: Scope) -> Val:
        return num(take(days(c, a, s)[0]).cast("double"))


_part(("year", "YEAR"), F.year)
_part(("month", "MONTH"), F.month)
_part(("day", "DAY"), F.dayofmonth)


@operator("date", "DATE", args=(3, 3))
def date(c: Compiler, a: list, s: Scope) -> Val:
    """Months and days out of range roll over into other years and months."""
    y, m, d = (toward_zero(x) for x in numbers(c, a, s))
    year = y + F.floor((m - 1) / 12).cast("double")
    good = (year >= 1) & (year <= 9999) & (F.abs(d) < 4_000_000)
    first = F.make_date(F.when(good, year).cast("int"), (F.pmod(m - 1, F.lit(12.0)) + 1).cast("int"), F.lit(1))
    made = F.date_add(first, (F.when(good, d).cast("int") - 1))
    if s.config.date_month_quirk:
        made = F.when(~((m <= -11) & (F.pmod(m - 1, F.lit(12.0)) == 0)), made)
    return text(V.iso_text(made))


def _strftime(pattern: str) -> str | None:
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            plain = pattern[i + 1] == "-"
            key = pattern[i + 1 + plain : i + 2 + plain]
            if key == "%":
                out += "%"
            elif key in DIRECTIVES:
                out += DIRECTIVES[key][:1] if plain else DIRECTIVES[key]
            else:
                return None
            i += 2 + plain
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else "''" if pattern[i] == "'" else f"'{pattern[i]}'" if pattern[i] in "[]{}#" else pattern[i]
            i += 1
    return out


def _strftime_column(given: Column) -> Column:
    """The pattern of date_format for a format held in a column; null where a directive is not known."""
    out = F.replace(F.replace(given, F.lit("%%"), F.lit("\u0001")), F.lit("'"), F.lit("''"))
    out = F.regexp_replace(out, r"((?:^|(?<=%[A-Za-z])|(?<=%-[A-Za-z]))[^%]+)", "'$1'")
    for name, pattern in DIRECTIVES.items():
        out = F.replace(F.replace(out, F.lit(f"%{name}"), F.lit(pattern)), F.lit(f"%-{name}"), F.lit(pattern[:1]))
    return F.when(~F.contains(out, F.lit("%")), F.replace(out, F.lit("\u0001"), F.lit("%")))


@operator("dateformat", "DATEFORMAT", args=(1, 2))
def dateformat(c: Compiler, a: list, s: Scope) -> Val:
    day = days(c, a[:1], s)[0]
    style = c.value(a[1], s) if len(a) == 2 else V.literal("iso")
    if style.const is V.MISSING:
        given = V.to_str(style)
        pattern = _strftime_column(given)
        for name, known in NAMED.items():
            pattern = F.when(F.lower(given) == name, F.lit(known)).otherwise(pattern)
        return text(F.call_function("date_format", day.cast("timestamp"), pattern))
    name = style.const if isinstance(style.const, str) else "iso"
    pattern = NAMED.get(name.lower()) or _strftime(name)
    if pattern is None:
        raise RuleError(f"no such date format: {name}")
    return text(F.date_format(day.cast("timestamp"), pattern))


@operator("YEARFRAC", "yearfrac", args=(2, 3))
def yearfrac(c: Compiler, a: list, s: Scope) -> Val:
    """Days as a share of a year of 360 days (basis 0, 2, 4), 365.25 (1) or 365 (any other)."""
    start, end = days(c, a[:2], s)
    basis = toward_zero(numbers(c, a[2:], s)[0]) if len(a) == 3 else F.lit(0.0)
    year = F.when(basis.isin(0.0, 2.0, 4.0), F.lit(360.0)).when(basis == 1, F.lit(365.25)).otherwise(F.lit(365.0))
    return num(F.datediff(end, start) / year)


@operator("DATEDIF", "datedif", args=(3, 3))
def datedif(c: Compiler, a: list, s: Scope) -> Val:
    """Whole days, months or years between, or the rest of one in the other; months go by day numbers."""
    start, end = days(c, a[:2], s)
    unit = F.upper(V.to_str(c.value(a[2], s)))
    y, m, d = (f(end) - f(start) for f in (F.year, F.month, F.dayofmonth))
    before = F.when(d < 0, F.lit(1)).otherwise(F.lit(0))
    months = y * 12 + m - before
    early = F.when((m < 0) | ((m == 0) & (d < 0)), F.lit(1)).otherwise(F.lit(0))
    anniversary = F.make_date(F.year(end) - early, F.month(start), F.least(F.dayofmonth(start), F.when((F.month(start) == 2) & (F.dayofmonth(start) == 29), F.lit(28)).otherwise(F.lit(31))))
    out = F.when(unit == "D", F.datediff(end, start)).when(unit == "M", months).when(unit == "Y", y - early)
    out = out.when(unit == "MD", F.when(d < 0, d + 30).otherwise(d)).when(unit == "YM", F.pmod(months, F.lit(12))).when(unit == "YD", F.datediff(end, anniversary))
    return num(out.cast("double"))


def date_value(v: Val) -> Val:
    return NULL if v.kind == "null" else Val(to_date(v), T.DateType())
