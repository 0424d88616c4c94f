"""Generated tables: static rows and repeated templates whose cells may read earlier and later rows.

A table is a list of row plans, in order: a static row is an object of column rules; a repeated plan is
{"$repeat": [start, end, template]} with both ends included. Cells see earlier columns of their row as $name,
``$iteration``, ``$threshold`` (the end), the table's ``$datas``, then the document. VALUEAT of the table itself at
``$iteration`` plus or minus a number reads other rows.

Plans without such reads are array transforms. Reads of earlier rows only are folds over the iterations, and reads
of later rows only are folds over the iterations in reverse. Tables that read both ways are settled by sweeps in
alternating direction, SWEEPS at most. All of it is in the JVM, with every operator.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.functions import values as V
from ruleweave.functions.values import Val, num
from ruleweave.operators.basic import toward_zero
from ruleweave.operators.lookups import path_in
from ruleweave.paths import dotted
from ruleweave.plans.compiler import Compiler
from ruleweave.plans.scope import Frame, Scope

SWEEPS = 100


def unwrap(node: Any) -> Any:
    """A cell's rule: the logic of an $evaluation, or the literal."""
    if isinstance(node, dict) and "$evaluation" in node:
        inner = node["$evaluation"]
        return inner.get("logic", inner) if isinstance(inner, dict) else inner
    return node


def _offset(rule: Any) -> float | None:
    """n where the rule is ``$iteration`` + n."""
    if path_in(rule) is not None:
        return 0.0 if dotted(path_in(rule)) == "$iteration" else None
    if isinstance(rule, dict) and next(iter(rule), None) in ("+", "-") and len(rule[next(iter(rule))]) == 2:
        op, (a, b) = next(iter(rule)), rule[next(iter(rule))]
        if _offset(a) == 0.0 and isinstance(b, (int, float)):
            return float(b) if op == "+" else -float(b)
        if op == "+" and _offset(b) == 0.0 and isinstance(a, (int, float)):
            return float(a)
    return None


def self_reads(rule: Any, name: str) -> list[tuple[float | None, str | None]]:
    """(offset, column) of each VALUEAT of the table itself; offset None: another index."""
    found = []
    if isinstance(rule, list):
        return [x for y in rule for x in self_reads(y, name)]
    if isinstance(rule, dict):
        for k, v in rule.items():
            if k in ("VALUEAT", "valueat") and isinstance(v, list) and path_in(v[0]) is not None and dotted(path_in(v[0])) == name:
                found.append((_offset(v[1]), v[2] if len(v) > 2 and isinstance(v[2], str) else None))
                found += self_reads(v[1:], name)
            else:
                found += self_reads(v, name)
    return found


class GeneratedTable:
    def __init__(self, name: str, node: dict) -> None:
        self.name, self.plans = dotted(name), node.get("$table", [])
        self.datas = {d["name"]: unwrap(d.get("data")) for d in node.get("$datas", [])}
        self.skip, self.clear = unwrap(node.get("$skip", False)), unwrap(node.get("$clear", False))

    def value(self, c: Compiler, s: Scope, gate: Column | None = None) -> Val:
        """The rows as an array of structs; gate: a condition without which the table is empty."""
        datas = Frame({k: c.value(v, s) for k, v in self.datas.items()})
        parts = [self._repeat(c, s.with_context(datas, *s.context), p["$repeat"]) if "$repeat" in p else self._static(c, s.with_context(datas, *s.context), p) for p in self.plans]
        if not parts:
            return V.array_of([])
        names = list(dict.fromkeys(n for p in parts for n in p.type.elementType.names))
        kinds = {n: V.alike([Val(F.lit(None), p.type.elementType[n].dataType) for p in parts if n in p.type.elementType.names])[1] for n in names}
        kind = T.StructType([T.StructField(n, kinds[n]) for n in names])

        def widened(p: Val) -> Column:
            own = p.type.elementType.names
            row = lambda r: F.struct(*[(r[n] if n in own else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
            return F.transform(p.col, row)

        rows = F.concat(*map(widened, parts))
        empty = F.lit(False)
        for rule in (self.skip, self.clear):
            v = c.value(rule, s)
            empty = empty | (F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else F.lit(False))
        if gate is not None:
            empty = empty | ~gate
        return Val(F.when(empty, F.array().cast(T.ArrayType(kind))).otherwise(rows), T.ArrayType(kind), nullable=False)

    def _cells(self, c: Compiler, s: Scope, template: dict, extra: dict[str, Val]) -> dict[str, Val]:
        """Cells in order; each sees those before it."""
        made: dict[str, Val] = {}
        for name, node in template.items():
            frame = Frame({f"${k}": v for k, v in made.items()} | extra)
            v = c.value(unwrap(node), s.with_context(frame, *s.context))
            made[name] = Val(v.col.cast("string"), T.StringType()) if v.kind == "null" else v
        return made

    @staticmethod
    def _struct(cells: dict[str, Val]) -> Val:
        kind = T.StructType([T.StructField(k, v.type) for k, v in cells.items()])
        return Val(F.struct(*[v.col.alias(k) for k, v in cells.items()]), kind)

    def _static(self, c: Compiler, s: Scope, row: dict) -> Val:
        made = self._struct(self._cells(c, s, row, {}))
        return Val(F.array(made.col), T.ArrayType(made.type), nullable=False)

    def _repeat(self, c: Compiler, s: Scope, plan: list) -> Val:
        start, end = (toward_zero(V.to_num(c.value(unwrap(x), s))) for x in plan[:2])
        template = plan[2]
        run = F.when(start <= end, F.sequence(F.when(start <= end, start).cast("long"), F.when(start <= end, end).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        reads = [r for node in template.values() for r in self_reads(unwrap(node), self.name)]
        extra = lambda i: {"$iteration": num(i.cast("double"), False), "$threshold": num(end, False)}
        if not reads:
            kind = self._struct(self._cells(c, s, template, extra(F.lit(0)))).type
            rows = F.transform(run, lambda i: self._struct(self._cells(c, s, template, extra(i))).col.cast(kind))
            return Val(rows, T.ArrayType(kind), nullable=False)
        ahead = [o for o, _ in reads if o is not None and o > 0]
        if ahead and len(ahead) < len([o for o, _ in reads if o != 0.0]):
            return self._settle(c, s, template, run, start, extra)
        return self._fold(c, s, template, run, start, extra, backward=bool(ahead))

    def _fold(self, c: Compiler, s: Scope, template: dict, run: Column, start: Column, extra, backward: bool) -> Val:
        """Rows made one after another; a read of the table itself is a read of the rows so far."""
        kind = self._types(c, s, template, extra)
        array = T.ArrayType(kind)
        last = F.size(run) - 1

        def step(rows: Column, i: Column) -> Column:
            own = _SelfTable(Val(rows, array), num(last.cast("double")), backward, i, start.cast("long"))
            inner = _with_self(c, s, self.name, own)
            return F.concat(rows, F.array(self._struct(self._cells(inner, s, template, extra(i))).col.cast(kind)))

        order = F.reverse(run) if backward else run
        made = F.aggregate(order, F.array().cast(array), step)
        return Val(F.reverse(made) if backward else made, array, nullable=False)

    def _types(self, c: Compiler, s: Scope, template: dict, extra) -> T.StructType:
        """Column types: cells that read the table itself are numbers unless they turn out as texts."""
        kind = T.StructType([T.StructField(k, T.DoubleType()) for k in template])
        for _ in range(3):
            own = _SelfTable(Val(F.array().cast(T.ArrayType(kind)), T.ArrayType(kind)), num(F.lit(0.0)), False, F.lit(0), F.lit(0))
            made = self._struct(self._cells(_with_self(c, s, self.name, own), s, template, extra(F.lit(0)))).type
            if made == kind:
                break
            kind = made
        return T.StructType([T.StructField(f.name, f.dataType) for f in kind])

    def _settle(self, c: Compiler, s: Scope, template: dict, run: Column, start: Column, extra) -> Val:
        """Rows that read both ways: all cells are computed in sweeps of alternating direction until none changes."""
        kind = self._types(c, s, template, extra)
        array, first = T.ArrayType(kind), start.cast("long")

        def row(rows: Column, at: Column) -> Column:
            i = first + at
            inner = _with_self(c, s, self.name, _SelfTable(Val(rows, array), num(F.lit(0.0)), False, i, first))
            return self._struct(self._cells(inner, s, template, extra(i))).col.cast(kind)

        def sweep(rows: Column, order: Column) -> Column:
            return F.aggregate(order, rows, lambda done, at: F.transform(done, lambda r, k: F.when(k == at, row(done, at)).otherwise(r)))

        def step(state: Column, n: Column) -> Column:
            last = F.size(state["rows"]) - 1
            order = F.when(n % 2 == 1, F.sequence(F.lit(0), last)).otherwise(F.sequence(last, F.lit(0)))
            after = F.transform(F.array(state["rows"]), lambda rows: sweep(rows, order))
            made = F.transform(after, lambda rows: F.struct(rows.alias("rows"), (~rows.eqNullSafe(state["rows"])).alias("go")))
            return F.when(state["go"], F.get(made, F.lit(0))).otherwise(state)

        blank = F.transform(run, lambda i: F.lit(None).cast(kind))
        begin = F.struct(blank.alias("rows"), (F.size(run) > 0).alias("go"))
        return Val(F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), begin, step, lambda state: state["rows"]), array, nullable=False)


class _SelfTable:
    """The rows made so far, of which i is the next one's iteration and start the first one's."""

    def __init__(self, rows: Val, last: Val, backward: bool, i: Column, start: Column) -> None:
        self.rows, self.last, self.backward, self.i, self.start = rows, last, backward, i, start

    def near(self, offset: float, column: str | None) -> Val:
        """The cell so many iterations away."""
        place = F.size(self.rows.col) - int(offset) - self.start if self.backward else self.i + int(offset)
        return self._at(place.cast("int"), column)

    def cell(self, index: Column, column: str | None) -> Val:
        """The cell of the row at an index; rows made backward lie in reverse."""
        place = self.last.col - index if self.backward else index
        inside = (place >= 0) & (place < F.size(self.rows.col))
        return self._at(F.when(inside, place).cast("int"), column)

    def _at(self, place: Column, column: str | None) -> Val:
        row, kind = F.get(self.rows.col, place), self.rows.type.elementType
        if column is None:
            return Val(row, kind)
        return Val(row[column], kind[column].dataType) if column in kind.names else V.NULL


def _with_self(c: Compiler, s: Scope, name: str, own: _SelfTable) -> Compiler:
    """A compiler for which VALUEAT of the table itself reads the rows so far."""

    class Inner(Compiler):
        def value(self, rule: Any, scope: Scope) -> Val:
            head = next(iter(rule), None) if isinstance(rule, dict) else None
            if head in ("VALUEAT", "valueat") and path_in(rule[head][0]) is not None and dotted(path_in(rule[head][0])) == name:
                column = rule[head][2] if len(rule[head]) > 2 else None
                offset = _offset(rule[head][1])
                if offset is not None and offset.is_integer():
                    return own.near(offset, column)
                return own.cell(toward_zero(V.to_num(self.value(rule[head][1], scope))), column)
            return super().value(rule, scope)

    return Inner(c.config)
