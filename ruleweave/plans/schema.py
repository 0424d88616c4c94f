"""Schema documents: computed fields, visibility, defaults, validation, change propagation, sub-forms, layout.

A schema is JSON on the driver. It is read once into fields and their rules; evaluating it over a DataFrame (a
document in each row) adds columns batch by batch in the order of their dependencies. Fields are columns
named by their dotted path; nested structs of the data are opened first.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import ruleweave.plans.engine  # noqa: F401  operators register when imported
from ruleweave.config import DEFAULT, EngineConfig, RuleError
from ruleweave.functions import values as V
from ruleweave.functions.values import Val
from ruleweave.operators.tables import GeneratedTable, unwrap
from ruleweave.paths import dotted, to_pointer
from ruleweave.plans.changes import Propagation, change, either
from ruleweave.plans.compiler import Compiler, is_rule, referenced
from ruleweave.plans.joins import JoinPlan, numbered
from ruleweave.plans.scope import Frame, Scope

#: Spark types of JSON Schema types, for fields that the data lacks.
TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.DoubleType(), "boolean": T.BooleanType()}


def evaluation(node: Any) -> Any:
    """The rule of {"$evaluation": ...}, else None."""
    return unwrap(node) if isinstance(node, dict) and "$evaluation" in node else None


@dataclass
class Field:
    path: str
    node: dict
    parents: tuple[str, ...]

    @property
    def type(self) -> str:
        return self.node.get("type", "")

    @property
    def rule(self) -> Any:
        """The rule that computes the field's value."""
        own = evaluation(self.node)
        return own if own is not None else evaluation(self.node.get("value"))

    @property
    def default(self) -> Any:
        v = self.node.get("value")
        return v if isinstance(v, (str, int, float, bool)) else None

    def condition(self, name: str) -> Any:
        return self.node.get("condition", {}).get(name, False)

    def config(self, name: str) -> bool:
        return self.node.get("config", {}).get("all", {}).get(name) is True


@dataclass
class FormSchema:
    """The fields, parameters, tables and sub-forms of a schema."""

    root: dict
    fields: dict[str, Field] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, GeneratedTable] = field(default_factory=dict)
    subforms: dict[str, FormSchema] = field(default_factory=dict)
    hidden_all: set[str] = field(default_factory=set)
    layouts: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def of(schema: dict | str) -> FormSchema:
        return _parsed(schema if isinstance(schema, str) else json.dumps(schema))

    def attached(self) -> list[tuple[str, list]]:
        """Layouts (owner, elements) that no layout element shows as part of another."""
        refs = {dotted(e["$ref"]) for elements in self.layouts.values() for e in _flat(elements) if "$ref" in e}
        return [(p, elements) for p, elements in self.layouts.items() if not p or p not in refs]

    def places(self) -> list[tuple[str, list[dict]]]:
        """Fields that layout elements show, with the elements and fields around each, its own element last."""
        out: list[tuple[str, list[dict]]] = []

        def walk(elements: list, around: list[dict]) -> None:
            for e in elements:
                f = self.fields.get(dotted(e["$ref"])) if "$ref" in e else None
                inner = [*around, *([f.node] if f else []), e]
                if "$ref" in e:
                    out.append((dotted(e["$ref"]), inner))
                nested = e.get("elements") or (f.node.get("$layout", {}).get("elements") if f else None)
                if nested and not any(f is not None and f.node is x for x in around):
                    walk(nested, inner)

        for _, elements in self.attached():
            walk(elements, [])
        return out

    def dependencies(self) -> dict[str, set[str]]:
        """Computed names and the computed names they read: paths by any ancestor or descendant."""
        rules = self.rules()
        out: dict[str, set[str]] = {}
        for name, rule in rules.items():
            reads = {dotted(p) for p in referenced(rule)}
            out[name] = {n for n in rules if n != name and any(r == n or r.startswith(n + ".") or n.startswith(r + ".") for r in reads)}
        return out

    def rules(self) -> dict[str, Any]:
        """Everything that is computed: parameters, tables, then fields."""
        found = {f"$params.{k}": r for k, r in _params(self.params) if r is not None}
        for name, t in self.tables.items():
            found[name] = [t.plans, list(t.datas.values()), t.skip, t.clear]
        found |= {f.path: f.rule for f in self.fields.values() if f.rule is not None}
        return found

    def batches(self) -> list[list[str]]:
        """Computed names in batches, each after those it depends on."""
        sorter = TopologicalSorter(self.dependencies())
        try:
            sorter.prepare()
        except CycleError as e:
            raise RuleError(f"Circular dependency detected: {' -> '.join(e.args[1])}") from e
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out.append(ready)
            sorter.done(*ready)
        return out

    def needed(self, paths: list[str]) -> set[str]:
        """Computed names for a selection of paths: those asked for, and what they depend on."""
        graph, wanted = self.dependencies(), {dotted(p) for p in paths}
        todo = [n for n in graph if any(n == w or n.startswith(w + ".") or w.startswith(n + ".") for w in wanted)]
        seen: set[str] = set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += graph[n]
        return seen


def _flat(elements: list) -> list[dict]:
    return [x for e in elements for x in (e, *_flat(e.get("elements", [])))]


@dataclass
class Element:
    """A layout element: its layout and place, the field it shows, its flags (None: never) and name."""

    layout: str
    place: int
    ref: str | None
    hidden: Column | None
    by_condition: Column | None
    disabled: Column | None
    around: Column | None
    name: str


def _params(node: Any, path: str = "") -> list[tuple[str, Any]]:
    """(path, rule) of each parameter; rule None: a constant or table at that path."""
    out: list[tuple[str, Any]] = []
    for k, v in node.items() if isinstance(node, dict) else []:
        here = f"{path}.{k}" if path else k
        if (rule := evaluation(v)) is not None:
            out.append((here, rule))
        elif isinstance(v, dict) and "$table" not in v:
            out += _params(v, here)
        else:
            out.append((here, None))
    return out


@lru_cache(256)
def _parsed(text: str) -> FormSchema:
    root = json.loads(text)
    out = FormSchema(root, params=root.get("$params", {}))
    _walk(root, (), out)

    def find_tables(node: Any, path: str) -> None:
        for k, v in node.items() if isinstance(node, dict) else []:
            if isinstance(v, dict) and "$table" in v:
                out.tables[f"{path}.{k}"] = GeneratedTable(f"{path}.{k}", v)
            elif isinstance(v, dict) and k != "$evaluation":
                find_tables(v, f"{path}.{k}")

    find_tables(out.params, "$params")
    return out


def _walk(node: dict, parents: tuple[str, ...], out: FormSchema) -> None:
    if "$layout" in node:
        out.layouts[".".join(parents)] = node["$layout"].get("elements", [])
        if node["$layout"].get("hideLayout", {}).get("all") is True:
            out.hidden_all.add(".".join(parents))
    for name, child in node.get("properties", {}).items():
        if not isinstance(child, dict):
            continue
        path = ".".join((*parents, name))
        if "$table" in child:
            out.tables[path] = GeneratedTable(path, child)
            continue
        out.fields[path] = Field(path, child, tuple(".".join(parents[: i + 1]) for i in range(len(parents))))
        if child.get("type") == "array" and isinstance(child.get("items"), dict):
            out.subforms[path] = _parsed(json.dumps({"$params": out.root.get("$params", {}), "properties": {child.get("itemsRootKey", name): child["items"]}}))
        elif "properties" in child:
            _walk(child, (*parents, name), out)


def opened(df: DataFrame) -> DataFrame:
    """Nested structs as columns of dotted names."""
    out: list[Column] = []

    def walk(col: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(col.getField(f.name), f.dataType, f"{name}.{f.name}")
        else:
            out.append(col.alias(name))

    for f in df.schema:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def nested(df: DataFrame, paths: list[str]) -> Column:
    """A struct of the columns of dotted names."""
    tree: dict = {}
    for p in paths:
        at = tree
        *heads, last = p.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = p

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else F.col(f"`{v}`")).alias(k) for k, v in node.items()])

    return build(tree)


def _set(item: Column, kind: T.StructType, values: dict[str, tuple[Column, T.DataType]]) -> tuple[Column, T.StructType]:
    """A struct with fields of dotted names set, and its type."""
    heads: dict[str, dict] = {}
    for name, v in values.items():
        head, _, rest = name.partition(".")
        heads.setdefault(head, {})[rest] = v
    out, fields = [], []
    for name in dict.fromkeys([*kind.names, *heads]):
        own = kind[name].dataType if name in kind.names else None
        if name not in heads:
            col, of = item.getField(name), own
        elif "" in heads[name]:
            col, of = heads[name][""]
            col = col.cast(of)
        else:
            known = isinstance(own, T.StructType)
            col, of = _set(item.getField(name) if known else F.lit(None), own if known else T.StructType([]), heads[name])
        out.append(col.alias(name))
        fields.append(T.StructField(name, of))
    return F.struct(*out), T.StructType(fields)


class _Tree(Frame):
    """Finds dotted columns by the longest name that starts a path."""

    def __init__(self, names: dict[str, Val], params: Any) -> None:
        super().__init__(names)
        object.__setattr__(self, "params", params)

    def find(self, steps: list[str]) -> Val | None:
        for n in range(len(steps), 0, -1):
            v = self._named(".".join(steps[:n]))
            if v is not None:
                from ruleweave.plans.scope import descend

                return descend(v, steps[n:])
        if steps and steps[0] == "$params":
            at = self.params
            for s in steps[1:]:
                at = at[int(s)] if isinstance(at, list) and s.isdigit() and int(s) < len(at) else at.get(s) if isinstance(at, dict) else None
            return V.literal(at) if at is not None else None
        if steps:
            head = ".".join(steps) + "."
            inner = {k[len(head) :]: self._named(k) for k in self.names if k.startswith(head)}
            if inner:
                kind = T.StructType([T.StructField(k, v.type) for k, v in inner.items()])
                return Val(F.struct(*[v.col.alias(k) for k, v in inner.items()]), kind)
        return None

    def _named(self, name: str) -> Val | None:
        return self.names.get(name)


class _Noted(_Tree):
    """Notes the columns that are read."""

    def __init__(self, tree: _Tree, read: dict[str, Val]) -> None:
        super().__init__(tree.names, tree.params)
        object.__setattr__(self, "read", read)

    def _named(self, name: str) -> Val | None:
        v = super()._named(name)
        if v is not None:
            self.read[name] = v
        return v


def _json(v: Val) -> Column:
    """JSON of a value; whole numbers have no fraction."""
    if v.kind == "num":
        return F.coalesce(V.number_text(v.col.cast("double")), F.lit("null"))
    text = F.to_json(F.array(v.col), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(text, 2, 2_000_000_000).substr(F.lit(1), F.length(text) - 2), F.lit("null"))


def _joined(parts: list) -> list:
    """Neighbouring texts as one."""
    out: list = []
    for x in parts:
        if isinstance(x, str) and out and isinstance(out[-1], str):
            out[-1] += x
        else:
            out.append(x)
    return out


def _quoted(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def is_empty(v: Val) -> Column:
    """Null, the empty text or the empty list."""
    if v.kind == "str":
        return v.col.isNull() | (v.col == "")
    if v.kind == "array":
        return v.col.isNull() | (F.size(v.col) == 0)
    return v.col.isNull()


ERROR = "struct<field: string, type: string, message: string, code: string, pattern: string, field_value: string, data: string>"


class FormEngine:
    """A schema over a DataFrame. tables: DataFrames for reference tables ("$params.name"); context: values under
    ``$context``."""

    def __init__(self, schema: dict | str, df: DataFrame, tables: dict[str, DataFrame] | None = None, context: dict | None = None, config: EngineConfig = DEFAULT) -> None:
        self.schema, self.config, self.context = FormSchema.of(schema), config, context
        self.compiler = Compiler(config)
        work = opened(df)
        have = set(work.columns)
        groups = {p for f in self.schema.fields.values() for p in f.parents}
        missing = {p: F.lit(None).cast(TYPES.get(f.type, T.StringType())) for p, f in self.schema.fields.items() if p not in have and p not in groups and f.type != "array" and "properties" not in f.node}
        self.inputs, self.computed = work.columns, []
        self.nested = False
        self.tables = {dotted(k): numbered(t) for k, t in (tables or {}).items()}
        self.df = work.withColumns(missing) if missing else work
        self.leaves = [p for p in self.schema.fields if p in self.df.columns]

    def scope(self, **names: Val) -> Scope:
        columns = {f.name: Val(F.col(f"`{f.name}`"), f.dataType, nullable=f.nullable) for f in self.df.schema}
        frames = [Frame({f"${k}": v for k, v in names.items()})] if names else []
        if self.context is not None:
            frames.append(Frame({"$context": V.literal(self.context)}))
        self.plan = JoinPlan(self.df, self.tables, self.config)
        return Scope(_Tree(columns, self.schema.params), tuple(frames), self.config, self.plan.tables, self.plan)

    def add(self, rules: dict[str, Any], clean: bool = True) -> None:
        """Columns for rules that do not read each other."""
        if not rules:
            return
        scope = self.scope()
        made = {}
        for name, rule in rules.items():
            v = rule.value(self.compiler, scope, self._gate(rule, scope)) if isinstance(rule, GeneratedTable) else self.compiler.value(rule, scope)
            made[name] = (V.clean_noise(v, once=self.nested) if clean else v).col
        self.df = self.plan.df.withColumns(made).drop(*self.plan.added)

    def _gate(self, table: GeneratedTable, scope: Scope) -> Column | None:
        """A generated table is empty where a field that it reads breaks one of its own rules."""
        read = {dotted(p) for p in referenced([table.plans, list(table.datas.values())])}
        checked = [(p, f) for p, f in self.schema.fields.items() if p in read and f.node.get("rules")]
        tests = [scope.data.find(p.split(".")).col.isNull() | self._error(p, f, scope).isNull() for p, f in checked if scope.data.find(p.split(".")) is not None]
        return reduce(lambda x, y: x & y, tests) if tests else None

    def evaluate(self, paths: list[str] | None = None) -> FormEngine:
        """Adds or replaces computed columns, in dependency order; with paths, only what they need."""
        wanted = None if paths is None else self.schema.needed(paths)
        rules = self.schema.rules()
        for batch in self.schema.batches():
            names = [n for n in batch if wanted is None or n in wanted]
            given = [n for n in names if n in self.leaves and n in self.inputs and f"{n}#given" not in self.df.columns]
            self.df = self.df.withColumns({f"{n}#given": F.col(f"`{n}`") for n in given}) if given else self.df
            self.add({n: self.schema.tables.get(n, rules[n]) for n in names})
            self.computed += [n for n in names if n not in self.computed]
        return self

    def flag(self, rule: Any, scope: Scope) -> Column | None:
        """A condition: true only if it is exactly true. None: never."""
        if isinstance(rule, bool):
            return F.lit(True) if rule else None
        inner = evaluation(rule)
        if inner is None and not is_rule(rule):
            return None
        v = self.compiler.value(inner if inner is not None else rule, scope)
        return F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else None

    def hidden(self, path: str, scope: Scope) -> Column:
        """Hidden by its own condition, that of a group around it, a hidden layout, or in every layout element that
        shows it."""
        f = self.schema.fields[path]
        if any(p in self.schema.hidden_all for p in ("", *f.parents, path)):
            return F.lit(True)
        out = either(self._by_condition(path, scope), self._by_layout(path, scope, 0))
        return F.lit(False) if out is None else out

    def _by_condition(self, path: str, scope: Scope) -> Column | None:
        fields = self.schema.fields
        return either(*(self.flag(fields[p].condition("hidden"), scope) for p in (*fields[path].parents, path) if p in fields))

    def _by_layout(self, path: str, scope: Scope, kind: int) -> Column | None:
        """Whether all elements that show the field, or a group around it, are hidden (0), by conditions alone (1)."""
        if not self.schema.layouts:
            return None
        shown: dict[str, list] = {}
        for e in self._elements(scope):
            if e.ref in (*self.schema.fields[path].parents, path):
                shown.setdefault(e.ref, []).append(e.hidden if kind == 0 else e.by_condition)
        return either(*(reduce(lambda x, y: x & y, flags) for flags in shown.values() if all(x is not None for x in flags)))

    def _elements(self, scope: Scope) -> list[Element]:
        """The elements of the layouts, each with what it takes over from the elements around it."""
        if getattr(self, "_laid", (None,))[0] is scope:
            return self._laid[1]
        out: list[Element] = []

        def walk(path: str, full: str, elements: list, hidden, condition, disabled, above: tuple) -> None:
            for i, e in enumerate(elements):
                ref = dotted(e["$ref"]) if "$ref" in e else None
                f = self.schema.fields.get(ref) if ref else None
                node = {**f.node.get("$layout", {}), **f.node, **e} if f else e
                conditions = (f.node.get("condition", {}) if f else {}) | e.get("condition", {})
                own = self.flag(conditions.get("hidden", False), scope)
                by = either(condition, own)
                away = F.lit(True) if node.get("hideLayout", {}).get("all") is True else None
                h, d = either(hidden, own, away), either(disabled, self.flag(conditions.get("disabled", False), scope))
                name = ref or f"{full}.{i}"
                out.append(Element(path, i, ref, h, by, d, hidden, name))
                if node.get("elements") and ref not in above:
                    walk(f"{path}.{i}" if path else str(i), f"{full}.{i}.elements", node["elements"], h, by, d, (*above, ref) if ref else above)

        for path, elements in self.schema.attached():
            top = F.lit(True) if path in self.schema.hidden_all else None
            walk(path, f"{path}.$layout.elements".lstrip("."), elements, top, None, None, ())
        self._laid = (scope, out)
        return out

    def documents(self) -> DataFrame:
        """The documents with computed fields, without columns of the engine's own."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.df.columns if "#" not in c])

    def visibility(self) -> DataFrame:
        """A boolean column ``path#hidden`` for each field."""
        scope = self.scope()
        return self.plan.df.withColumns({f"{p}#hidden": self.hidden(p, scope) for p in self.schema.fields})

    def defaults(self) -> FormEngine:
        """Static values of visible fields stand in for null and empty texts."""
        scope, made = self.scope(), {}
        for p in self.leaves:
            f = self.schema.fields[p]
            if f.default is not None and f.rule is None:
                own = scope.data.find(p.split("."))
                value = V.literal(f.default).col.cast(own.type)
                made[p] = F.when(is_empty(own) & ~self.hidden(p, scope), value).otherwise(own.col)
        if made:
            self.df = self.plan.df.withColumns(made)
        return self

    def _own(self, path: str) -> Val:
        return Val(F.col(f"`{path}`"), self.df.schema[path].dataType)

    def readonly(self) -> FormEngine:
        """Disabled fields with a value of the schema's take it."""
        self._sync(None)
        return self

    def _sync(self, steps: Propagation | None) -> list:
        """Read-only fields; those that changed, and in which rows."""
        scope, made, out = self.scope(), {}, []
        for p in self.leaves:
            f = self.schema.fields[p]
            if (f.default is None and f.rule is None) or f.config("skipReadOnlyValue") or (off := self.flag(f.condition("disabled"), scope)) is None:
                continue
            own = scope.data.find(p.split("."))
            value = own.col if f.rule is not None else V.literal(f.default).col.cast(own.type)
            made |= {f"{p}#off": off, f"{p}#moved": off & ~value.eqNullSafe(own.col), p: F.when(off, value).otherwise(own.col)}
            out.append(p)
        self.df = self.plan.df.withColumns(made) if made else self.df
        for p in out if steps else []:
            steps.log(F.col(f"`{p}#off`"), change(p, F.col(f"`{p}`").cast("string"), is_empty(self._own(p)), readonly=True))
        changed = [(p, True, F.col(f"`{p}#moved`")) for p in out]
        queue = [(p, t, F.col(f"`{steps._flag(c)}`")) for p, t, c in changed] if steps else []
        self.df = self.df.drop(*[f"{p}#{x}" for p in out for x in ("off", "moved")])
        return queue

    def hide(self) -> FormEngine:
        """Fields hidden by a condition are emptied, in the order in which their conditions read each other."""
        self._hide(None)
        return self

    def _hide(self, steps: Propagation | None) -> list:
        """Empties hidden fields; those that had a value, and in which rows."""
        reads = {p: {dotted(r) for r in referenced(self._conditions(p))} for p in self.leaves}
        order = TopologicalSorter({p: {q for q in self.leaves if q != p and q in reads[p]} for p in self.leaves})
        try:
            ordered = list(order.static_order())
        except CycleError:
            ordered = list(self.leaves)
        queue = []
        for p in ordered:
            scope = self.scope()
            hidden = either(self._by_condition(p, scope), self._by_layout(p, scope, 1))
            if hidden is None or self.schema.fields[p].config("keepHiddenValue"):
                continue
            own = scope.data.find(p.split("."))
            self.df = self.plan.df.withColumns({p: F.when(~hidden, own.col), f"{p}#gone": hidden & ~is_empty(own)})
            if steps:
                flag = steps._flag(F.col(f"`{p}#gone`"))
                steps.log(F.col(flag), change(p, F.lit(None), F.lit(True), hidden=True))
                queue.append((p, True, F.col(flag)))
            self.df = self.df.drop(f"{p}#gone")
        return queue

    def _conditions(self, path: str) -> list:
        """What decides whether a field is hidden: its own condition, its groups' and those of layout elements."""
        fields = self.schema.fields
        nodes = [fields[p].node for p in (*fields[path].parents, path) if p in fields]
        nodes += [e for ref, around in self.schema.places() for e in around if ref == path or path.startswith(f"{ref}.")]
        found = [n.get("condition", {}).get("hidden") for n in nodes]
        return [unwrap(x) if isinstance(x, dict) else x for x in found if x]

    def errors(self) -> Column:
        """Per row an array with the first error of each visible field."""
        scope = self.scope()
        found = [self._error(p, self.schema.fields[p], scope) for p in self.schema.fields if self.schema.fields[p].node.get("rules")]
        return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ERROR}>")

    def validate(self, keys: list[str]) -> DataFrame:
        """A row for each error: the keys, field, type, message, code, pattern, field_value, data."""
        errors = self.errors()
        return self.plan.df.select(*_quoted(keys), F.explode(errors).alias("e")).select(*_quoted(keys), "e.*")

    def validation_summary(self, keys: list[str]) -> DataFrame:
        """has_error and n_errors of each document."""
        errors = self.errors()
        return self.plan.df.select(*_quoted(keys), F.size(errors).alias("n_errors")).withColumn("has_error", F.col("n_errors") > 0)

    def _error(self, path: str, f: Field, scope: Scope) -> Column:
        v = scope.data.find(path.split(".")) or V.NULL
        empty = F.lit(True) if v.kind == "null" else is_empty(v)
        out, disabled = F.lit(None).cast(ERROR), self.flag(f.condition("disabled"), scope)
        disabled = F.lit(False) if disabled is None else disabled
        for name, spec in reversed(list(f.node["rules"].items())):
            out = self._rule(path, f, v, empty, disabled, name, spec if isinstance(spec, dict) else {"value": spec}, scope, out)
        return F.when(~self.hidden(path, scope), out)

    def _rule(self, path: str, f: Field, v: Val, empty: Column, disabled: Column, name: str, spec: dict, scope: Scope, rest: Column) -> Column:
        """The rule's error where it fails, else ``rest``."""
        given = evaluation(spec.get("value"))
        active = self.compiler.value(given, scope) if given is not None else V.literal(spec.get("value"))
        error = lambda kind, s, code, pattern=None, data=None: self._shaped(path, v, kind, s, code, pattern, data, scope)
        code = f"{path}.{name}"
        if name == "required":
            bad = F.coalesce(active.col, F.lit(False)) & ~disabled & empty if active.kind == "bool" else F.lit(False)
        elif name in ("minLength", "maxLength"):
            size = F.octet_length(v.col) if v.kind == "str" else F.size(v.col) if v.kind == "array" else F.lit(0)
            limit = V.to_num(active)
            usable = (limit >= 0) & (limit == F.floor(limit)) if active.kind == "num" else F.lit(False)
            bad = ~empty & usable & (size < limit if name == "minLength" else size > limit)
        elif name in ("minValue", "maxValue"):
            numeric = f.type in ("number", "integer")
            n = v.col.cast("double") if v.kind == "num" else V.parse_number(v.col) if v.kind == "str" and numeric else F.lit(None).cast("double")
            limit = V.to_num(active)
            bad = ~empty & n.isNotNull() & (n < limit if name == "minValue" else n > limit) if active.kind == "num" else F.lit(False)
        elif name == "pattern":
            pattern = active.const if isinstance(active.const, str) else None
            test = java_pattern(self.df.sparkSession, pattern) if v.kind == "str" and pattern is not None else None
            bad = ~empty & ~F.coalesce(v.col.rlike(test), F.lit(True)) if test is not None else F.lit(False)
            return F.when(F.coalesce(bad, F.lit(False)), error("pattern", spec, code, pattern)).otherwise(rest)
        elif name == "evaluation":
            items = spec.get("value") if isinstance(spec.get("value"), list) else spec if isinstance(spec, list) else []
            for i, item in reversed(list(enumerate(items))):
                rule = evaluation(item.get("value")) if evaluation(item.get("value")) is not None else evaluation(item)
                test = self.compiler.value(rule, scope) if rule is not None else V.literal(item.get("value"))
                rest = F.when(~V.truthy(test), error("evaluation", item, f"{path}.evaluation.{i}", data=item.get("data"))).otherwise(rest)
            return rest
        else:
            bad = ~empty & ~V.truthy(active)
            return F.when(F.coalesce(bad, F.lit(False)), error("evaluation", spec, code)).otherwise(rest)
        return F.when(F.coalesce(bad, F.lit(False)), error(name, spec, code)).otherwise(rest)

    def _shaped(self, path: str, v: Val, kind: str, spec: dict, code: str, pattern: str | None, data: Any, scope: Scope) -> Column:
        text = spec.get("message", "Validation failed")
        text = text.get("value", text) if isinstance(text, dict) and "$evaluation" not in text else text
        rule = evaluation(text)
        message = V.to_str(self.compiler.value(rule, scope)) if rule is not None else F.lit(text if isinstance(text, str) else "Validation failed")
        parts = [F.lit(path), F.lit(kind), message, F.lit(str(spec.get("code", code))), F.lit(pattern), V.to_str(v), F.lit(None if data is None else json.dumps(data))]
        names = ["field", "type", "message", "code", "pattern", "field_value", "data"]
        return F.struct(*[p.cast("string").alias(n) for p, n in zip(parts, names, strict=True)])

    def dependents(self, changed: list[str]) -> DataFrame:
        """Propagates changes: the fields' dependents, and theirs where they changed. The documents with new values, and
        a column ``changes`` of the last (ref, transitive, clear, value, readonly, hidden) of each field."""
        steps = Propagation(self)
        steps.run([(dotted(p), False, None) for p in changed])
        steps.end()
        return self.df

    def refresh(self, changed: list[str], keys: list[str]) -> DataFrame:
        """The whole pass after a change: dependents; defaults and computed fields; read-only fields and their
        dependents; hidden fields and theirs. A row (keys, ref, value, cleared, transitive, readonly, hidden) for the
        last change of each field; read-only values are told whether they changed or not."""
        steps = Propagation(self)
        steps.run([(dotted(p), False, None) for p in changed])
        rules = {f.path for f in self.schema.fields.values() if f.rule is not None}
        self.df = self.df.withColumns({f"{p}#before": F.col(f"`{p}`") for p in self.leaves})
        self.defaults().evaluate().defaults().evaluate()
        for p in self.leaves:
            if p in rules:
                moved = ~F.col(f"`{p}`").cast("string").eqNullSafe(F.col(f"`{p}#before`").cast("string"))
                steps.log(moved, change(p, F.col(f"`{p}`").cast("string"), is_empty(self._own(p))))
        self.df = self.df.drop(*[f"{p}#before" for p in self.leaves])
        steps.run(self._sync(steps))
        steps.run(self._hide(steps))
        steps.end()
        out = self.df.select(*_quoted(keys), F.explode("changes").alias("c"))
        out = out.select(*_quoted(keys), "c.ref", "c.value", F.col("c.clear").alias("cleared"), "c.transitive", "c.readonly", "c.hidden")
        self.df = self.df.drop("changes")
        return out

    def described(self, changes: DataFrame) -> DataFrame:
        """``changes`` (with a column ref) and the schema's JSON of each field and of the group around it, without what
        these hold: field_schema, parent_schema."""
        rows = []
        for p, f in self.schema.fields.items():
            parent = self.schema.fields[f.parents[-1]].node if f.parents and f.parents[-1] in self.schema.fields else self.schema.root
            rows.append((p, json.dumps(f.node), json.dumps({k: x for k, x in parent.items() if k not in ("properties", "$layout")})))
        table = changes.sparkSession.createDataFrame(rows, "ref string, field_schema string, parent_schema string")
        return changes.join(F.broadcast(table), "ref", "left").select(*changes.columns, "field_schema", "parent_schema")

    def at(self, keys: list[str], paths: list[str]) -> DataFrame:
        """The keys and the values at the paths, named by them; a path of a group is a struct of its fields."""
        scope = self.scope()
        found = {p: scope.lookup(p) for p in paths}
        return self.plan.df.select(*_quoted(keys), *[v.col.alias(dotted(p)) for p, v in found.items()])

    def resolved_schema(self, keys: list[str], path: str = "", params: bool = True) -> DataFrame:
        """(keys, schema): the schema's JSON with each evaluation replaced by its value in the document, or the part of it
        at a dotted path or pointer; without ``$params`` if params is false."""
        node: Any = self.schema.root if params else {k: x for k, x in self.schema.root.items() if k != "$params"}
        for step in [x for x in to_pointer(path).split("/") if x]:
            inside = node.get("properties", {}) if isinstance(node, dict) and step not in node else node
            node = inside[int(step)] if isinstance(inside, list) else inside.get(step) if isinstance(inside, dict) else None
        scope, where = self.scope(), {id(f.node): p for p, f in self.schema.fields.items()}
        tables = {id(t.plans): name for name, t in self.schema.tables.items()}

        def parts(x: Any, at: str | None) -> list:
            """Literal texts and columns that make up the JSON of a node; at: the field or parameter that it is."""
            if isinstance(x, dict) and ("$evaluation" in x or "$table" in x):
                own = tables.get(id(x["$table"])) if "$table" in x else at
                own = own if own in self.computed else None
                value = self.scope_value(scope, own) if own else None if "$table" in x else self.compiler.value(evaluation(x), scope)
                return ["null"] if value is None or value.kind == "null" else [_json(value)]
            if isinstance(x, dict):
                here, out = where.get(id(x)), ["{"]
                for i, (k, child) in enumerate(x.items()):
                    inner = here if k == "value" and here else f"{at}.{k}" if at else "$params" if k == "$params" and x is self.schema.root else where.get(id(child)) if isinstance(child, dict) else None
                    out += [("," if i else "") + json.dumps(k) + ":", *parts(child, inner)]
                return [*out, "}"]
            if isinstance(x, list):
                return ["[", *[y for i, child in enumerate(x) for y in ([","] if i else []) + parts(child, None)], "]"]
            return [json.dumps(x)]

        found = [F.lit(x) if isinstance(x, str) else x for x in _joined(parts(node, None))]
        return self.plan.df.select(*_quoted(keys), F.concat(*found).alias("schema"))

    @staticmethod
    def scope_value(scope: Scope, name: str) -> Val | None:
        return scope.data.find(name.split("."))

    def reload(self, schema: dict | str) -> FormEngine:
        """The same documents, given values and tables under another schema."""
        given = {c.removesuffix("#given") for c in self.df.columns if c.endswith("#given")}
        docs = self.df.select(*[F.col(f"`{c}#given`" if c in given else f"`{c}`").alias(c) for c in self.inputs])
        return FormEngine(schema, docs, self.tables, self.context, self.config)

    def subform(self, path: str, keys: list[str], **options) -> FormEngine:
        """The items of an array field as documents of their own, with ``_pos``; parents' fields stay visible."""
        root = next(iter(self.schema.subforms[path].root["properties"]))
        items = self.df.select("*", F.posexplode_outer(F.col(f"`{path}`")).alias("_pos", "__item")).drop(path)
        clash = [c for c in items.columns if c == root or c.startswith(root + ".")]
        items = items.drop(*clash).withColumnRenamed("__item", root)
        schema = json.dumps(self.schema.subforms[path].root)
        return FormEngine(schema, items.where("_pos is not null"), self.tables | options.get("tables", {}), self.context, self.config)

    def evaluate_items(self, path: str) -> FormEngine:
        """Computes the fields of an array's items where they are, without dealing documents anew. Items see their own
        fields under the items' root, then the document. Rules that look up DataFrames need ``subform``."""
        sub = self.schema.subforms[path]
        root = next(iter(sub.root["properties"]))
        rules, kind = {k: r for k, r in sub.rules().items() if k.startswith(root + ".")}, self.df.schema[path].dataType
        read: dict[str, Val] = {}
        scope = self.scope()
        self._items_made(sub, root, rules, scope.within(_Noted(scope.data, read)), F.col(f"`{path}`"), kind)
        scope = self.scope()
        if read:
            # what items read of the document is bound once: its own formula would else be put into each item's
            held = F.array(F.struct(*[v.col.alias(f"v{i}") for i, v in enumerate(read.values())]))

            def bound(p: Column) -> Column:
                names = {n: Val(p.getField(f"v{i}"), v.type, nullable=v.nullable) for i, (n, v) in enumerate(read.items())}
                return self._items_made(sub, root, rules, scope.within(_Tree({**scope.data.names, **names}, self.schema.params)), F.col(f"`{path}`"), kind)

            col = F.element_at(F.transform(held, bound), 1)
        else:
            col = self._items_made(sub, root, rules, scope, F.col(f"`{path}`"), kind)
        self.df = self.plan.df.withColumn(path, col)
        return self

    def _items_made(self, sub: FormSchema, root: str, rules: dict[str, Any], scope: Scope, col: Column, kind: T.ArrayType) -> Column:
        """The array with the computed fields of its items, batch by batch."""
        for batch in sub.batches():
            names = [n for n in batch if n in rules]
            if not names:
                continue

            def made(item: Column, own: T.DataType, names=names) -> dict[str, Val]:
                inner = scope.with_context(Frame({root: Val(item, own)}), *scope.context)
                tables = {n: sub.tables[n].value(self.compiler, inner) if n in sub.tables else self.compiler.value(rules[n], inner) for n in names}
                return {n.removeprefix(root + "."): V.clean_noise(v, once=True) for n, v in tables.items()}

            types = {n: T.StringType() if v.kind == "null" else v.type for n, v in made(F.lit(None).cast(kind.elementType), kind.elementType).items()}
            own = kind.elementType

            def step(x: Column, own=own, types=types, made=made) -> Column:
                return _set(x, own, {n: (v.col, types[n]) for n, v in made(x, own).items()})[0]

            col = F.transform(col, lambda x: step(x))
            kind = T.ArrayType(_set(F.lit(None), own, {n: (F.lit(None), t) for n, t in types.items()})[1])
        return col

    def cascade(self) -> FormEngine:
        """Computed fields of the document, of its items, and again of both, for fields that read each other."""
        self.nested = True
        for _ in range(2):
            self.evaluate()
            for path in self.schema.subforms:
                if path in self.df.columns:
                    self.evaluate_items(path)
        return self.evaluate()

    def with_items(self, path: str, keys: list[str], items: FormEngine) -> FormEngine:
        """Puts evaluated items back as the array field, in order, without dealing documents anew by other keys."""
        root = next(iter(items.schema.root["properties"]))
        names = [c for c in items.df.columns if c.startswith(root + ".") and "#" not in c]
        item = nested(items.df, names)
        packed = items.df.select(*_quoted(keys), F.struct("_pos", item.getField(root).alias("i")).alias("x"))
        packed = packed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["i"]).alias(path))
        self.df = self.df.drop(path).join(packed, keys, "left")
        return self

    def schema_value(self, keys: list[str], shape: str = "nested") -> DataFrame:
        """The data without hidden fields, with computed values: a struct, a map of texts, or (path, value) pairs. A
        computed value replaces given data only where the field is disabled or in no layout; else it fills nulls."""
        scope, made, shown = self.scope(), {}, {ref for ref, _ in self.schema.places()}
        for p in self.leaves:
            v = scope.data.find(p.split("."))
            own = v.col
            if f"{p}#given" in self.df.columns and p in shown:
                off = self.flag(self.schema.fields[p].condition("disabled"), scope)
                given = F.coalesce(F.col(f"`{p}#given`"), own)
                own = given if off is None else F.when(off, own).otherwise(given)
            made[p] = F.when(~self.hidden(p, scope), own)
        base = self.plan.df.withColumns(made)
        if shape == "nested":
            value = nested(base, self.leaves)
        else:
            texts = [V.to_str(Val(F.col(f"`{p}`"), base.schema[p].dataType)) for p in self.leaves]
            texts = [F.when(F.col(f"`{p}`").isNotNull(), t) for p, t in zip(self.leaves, texts, strict=True)]
            if shape == "flat":
                value = F.create_map(*[x for p, t in zip(self.leaves, texts, strict=True) for x in (F.lit(p), t)])
            else:
                value = F.array(*[F.struct(F.lit(p).alias("path"), t.alias("value")) for p, t in zip(self.leaves, texts, strict=True)])
        return base.select(*_quoted(keys), value.alias("value"))

    def option_urls(self, keys: list[str]) -> DataFrame:
        """(keys, field, url) of fields whose options are a URL template: {name} from its params."""
        scope, made = self.scope(), []
        for p, f in self.schema.fields.items():
            options = f.node.get("options")
            if isinstance(options, dict) and "url" in options:
                url = F.lit(options["url"])
                for name, spec in options.get("params", {}).items():
                    rule = evaluation(spec)
                    v = self.compiler.value(rule if rule is not None else spec, scope)
                    url = F.replace(url, F.lit("{" + name + "}"), V.to_str(v))
                made.append(F.struct(F.lit(p).alias("field"), url.alias("url")))
        rows = F.explode(F.array(*made)) if made else F.explode(F.array().cast("array<struct<field: string, url: string>>"))
        return self.plan.df.select(*_quoted(keys), rows.alias("o")).select(*_quoted(keys), "o.*")

    def layout(self, keys: list[str]) -> DataFrame:
        """(keys, layout_path, element_idx, ref, hidden, disabled, fullpath, path, parent_hide) of every layout element,
        flags taken over from the elements around it; fullpath: its field, else its place in the layouts."""
        scope = self.scope()
        never = lambda c: F.lit(False) if c is None else c
        rows = [
            F.struct(
                F.lit(e.layout).alias("layout_path"), F.lit(e.place).alias("element_idx"), F.lit(e.ref).alias("ref"), never(e.hidden).alias("hidden"), never(e.disabled).alias("disabled"),
                F.lit(e.name).alias("fullpath"), F.lit(e.name.rpartition(".")[2]).alias("path"), never(e.around).alias("parent_hide"),
            )
            for e in self._elements(scope)
        ]
        if not rows:
            rows = [F.lit(None).cast("struct<layout_path: string, element_idx: int, ref: string, hidden: boolean, disabled: boolean, fullpath: string, path: string, parent_hide: boolean>")]
        return self.plan.df.select(*_quoted(keys), F.explode(F.array_compact(F.array(*rows))).alias("l")).select(*_quoted(keys), "l.*")


def merged_layout(schema: dict | str, rows: list) -> dict[str, list]:
    """On the driver, for one document: each layout's elements with the flags and paths of its rows of ``layout``."""
    by_place = {(r["layout_path"], r["element_idx"]): r for r in rows}

    def walk(path: str, elements: list) -> list:
        out = []
        for i, e in enumerate(elements):
            r = by_place.get((path, i))
            made = dict(e)
            if r is not None:
                made |= {"$fullpath": r["fullpath"], "$path": r["path"], "$parentHide": r["parent_hide"]}
                made["condition"] = {**e.get("condition", {}), "hidden": r["hidden"], "disabled": r["disabled"]}
            if e.get("elements"):
                made["elements"] = walk(f"{path}.{i}" if path else str(i), e["elements"])
            out.append(made)
        return out

    return {p: walk(p, elements) for p, elements in FormSchema.of(schema).attached()}


#: Regular expressions that the rules' dialect does not have: look-around, atomic groups, back-references.
_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k[<{']|[*+?}]\+")


def java_pattern(spark, pattern: str) -> str | None:
    """A rule's pattern for Java's regular expressions; None where it is none, or is not in the rules' dialect: groups are named
    ``(?P<name>...)``, classes are of Unicode, ``.`` stops at line feeds only and ``$`` is the end of the text."""
    out, i, depth = [], 0, 0
    if _FOREIGN.search(re.sub(r"\\[^0-9k]", "", pattern)):
        return None
    several = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if pattern.startswith("(?P<", i) and not depth:
            out.append("(?<")
            i += 4
            continue
        depth += (c == "[") - (c == "]" and depth > 0)
        out.append(r"\z" if c == "$" and not depth and not several else c)
        i += 1
    made = "(?U)(?d)" + "".join(out)
    try:
        spark._jvm.java.util.regex.Pattern.compile(made)
    except Exception:  # noqa: BLE001  the JVM's error; what is no pattern matches everything
        return None
    return made
