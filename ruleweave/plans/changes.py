"""Propagation of changes: which fields a change sets or clears, and what these change in turn.

Fields wait on a stack. A field that is taken from it runs its ``dependents`` in order: each may clear its target
and then give it a value; a target that a row has changed goes on the stack. A field runs once a row, and targets that have run
are not written again. Fields whose dependents read the changed field in a formula come back with just those dependents.

Rows differ in what changes, so the stack is unrolled once on the driver: a step for each place at which some row can
take a field, with a boolean column that tells which rows do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.config import RuleError
from ruleweave.functions import values as V
from ruleweave.operators.tables import unwrap
from ruleweave.paths import dotted
from ruleweave.plans.compiler import referenced

CHANGE = "struct<ref: string, transitive: boolean, clear: boolean, value: string, readonly: boolean, hidden: boolean>"
CHANGES = "__changes"
#: Most steps that a propagation is unrolled to.
STEPS = 5_000


def change(ref: str, value: Column, clear: Column, transitive: bool | None = None, readonly: bool = False, hidden: bool = False) -> Column:
    parts = {"ref": F.lit(ref), "transitive": F.lit(transitive), "clear": clear, "value": value, "readonly": F.lit(readonly), "hidden": F.lit(hidden)}
    kinds = {"ref": "string", "value": "string"}
    return F.struct(*[c.cast(kinds.get(n, "boolean")).alias(n) for n, c in parts.items()])


def last_of_each(changes: Column) -> Column:
    """The last change of each field, in order."""
    refs = F.reverse(F.transform(changes, lambda x: x["ref"]))
    return F.filter(changes, lambda x, i: i == F.size(changes) - F.array_position(refs, x["ref"]))


def sources(schema) -> dict[str, list[tuple[str, list[int]]]]:
    """For a nested field that formulas of dependents read: the fields that have those dependents, and their places."""
    found: dict[str, dict[str, list[int]]] = {}
    for path, f in schema.fields.items():
        for i, item in enumerate(f.node.get("dependents", [])):
            rules = [unwrap(x) for x in (item.get("value"), item.get("clear")) if isinstance(x, dict) and "$evaluation" in x]
            for read in dict.fromkeys(map(dotted, referenced(rules))):
                if "." in read and read[0] != "$" and read not in (path, dotted(item["$ref"])):
                    found.setdefault(read, {}).setdefault(path, []).append(i)
    return {k: sorted(v.items()) for k, v in found.items()}


def either(*flags: Column | None) -> Column | None:
    """None is never."""
    some = [x for x in flags if x is not None]
    return reduce(lambda a, b: a | b, some) if some else None


class Propagation:
    """Steps over a form's documents. ran: (field, place of a dependent or None for all) to a flag column."""

    def __init__(self, form) -> None:
        self.form, self.sources, self.steps = form, sources(form.schema), 0
        self.ran: dict[tuple[str, int | None], str] = {}
        form.df = form.df.withColumn(CHANGES, F.array().cast(f"array<{CHANGE}>"))

    def _flag(self, col: Column) -> str:
        name = f"__flag{len(self.form.df.columns)}_{self.steps}"
        self.form.df = self.form.df.withColumn(name, F.coalesce(col, F.lit(False)))
        return name

    def _ran(self, path: str, place: int | None) -> Column | None:
        return F.col(self.ran[path, place]) if (path, place) in self.ran else None

    def log(self, where: Column, entry: Column) -> None:
        self.form.df = self.form.df.withColumn(CHANGES, F.when(where, F.concat(CHANGES, F.array(entry))).otherwise(F.col(CHANGES)))

    def run(self, changed: list[tuple[str, bool, Column | None]]) -> None:
        """The fields changed, whether by another field, and in which rows (None: all)."""
        waiting = [(p, t, None, None if rows is None else self._flag(rows)) for p, t, rows in changed]
        for path, transitive, places, rows in reversed(waiting):
            self._take(path, transitive, places, rows, frozenset())

    def _take(self, path: str, transitive: bool, places: tuple[int, ...] | None, rows: str | None, above: frozenset) -> None:
        if (path, None) in above or (path, places) in above:
            return
        self.steps += 1
        if self.steps > STEPS:
            raise RuleError("changes lead on to too many fields")
        done = self._ran(path, None)
        here = F.col(rows) if rows else F.lit(True)
        here = self._flag(here if done is None else here & ~done)
        f = self.form.schema.fields.get(path)
        items = [(i, x) for i, x in enumerate(f.node.get("dependents", []) if f else []) if places is None or i in places]
        runs = {i: here if places is None or self._ran(path, i) is None else self._flag(F.col(here) & ~self._ran(path, i)) for i, _ in items}
        for place in (None,) if places is None else places:
            before = self._ran(path, place)
            self.ran[path, place] = here if before is None else self._flag(before | F.col(here))
        waiting = [(source, True, tuple(at), here) for source, at in self.sources.get(path, [])]
        for i, item in items:
            target = dotted(item["$ref"])
            if target in self.form.df.columns:
                waiting.append((target, True, None, self._apply(path, target, item, transitive, runs[i])))
        for source, later, at, flag in reversed(waiting):
            self._take(source, later, at, flag, above | {(path, places)})

    def _apply(self, path: str, target: str, item: dict, transitive: bool, rows: str) -> str:
        """Runs one dependent; the flag of the rows whose target it changed."""
        form = self.form
        taken = either(*(F.col(flag) for (p, _), flag in self.ran.items() if p == target))
        open_rows = F.col(rows) if taken is None else F.col(rows) & ~taken
        plain = form.scope()
        own, ref = plain.data.find(path.split(".")) or V.NULL, plain.data.find(target.split("."))
        scope = form.scope(value=own, refValue=ref)
        clear = open_rows & form.flag(item["clear"], scope) if "clear" in item else F.lit(False)
        new, moved = F.when(clear, F.lit(None)).otherwise(ref.col), clear
        if "value" in item:
            value = form.compiler.value(unwrap(item["value"]), scope)
            if value.kind != "null":
                value = V.clean_noise(value)
                cast = value.col.cast(ref.type) if value.kind == ref.kind or ref.kind != "str" else V.to_str(value)
                given = open_rows & ~V.null_like(value) & ~cast.eqNullSafe(ref.col)
                new, moved = F.when(given, cast).otherwise(new), clear | given
        n = f"__new{self.steps}"
        base = form.plan.df.withColumns({n: new.cast(ref.type), f"{n}m": F.coalesce(moved, F.lit(False)), f"{n}c": F.coalesce(clear, F.lit(False))})
        form.df = base.withColumn(target, F.col(n)).drop(*form.plan.added)
        self.log(F.col(f"{n}m"), change(target, F.col(n).cast("string"), F.col(f"{n}c"), transitive))
        name = self._flag(F.col(f"{n}m"))
        form.df = form.df.drop(n, f"{n}m", f"{n}c")
        return name

    def end(self) -> None:
        """Leaves the documents and their ``changes``, the last of each field."""
        flags = [c for c in self.form.df.columns if c.startswith("__flag")]
        self.form.df = self.form.df.drop(*flags).withColumn("changes", last_of_each(F.col(CHANGES))).drop(CHANGES)
