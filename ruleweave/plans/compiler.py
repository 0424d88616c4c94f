"""Rules (JSON) to typed columns.

A rule is a literal, a list, or an object whose first key names an operator. Operators register themselves by
spelling; what they share is here: arguments, scopes, depth, referenced paths.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame

from ruleweave.config import DEFAULT, EngineConfig, RuleError
from ruleweave.functions.values import NULL, Val, array_of, clean_noise, literal
from ruleweave.plans.scope import Scope, data_frame

Operator = Callable[["Compiler", list, Scope], Val]
OPERATORS: dict[str, Operator] = {}


def operator(*names: str, args: tuple[int, int | None] = (0, None)) -> Callable[[Operator], Operator]:
    """Register an operator under its spellings, with its least and greatest number of arguments."""

    def add(f: Operator) -> Operator:
        for name in names:

            def checked(c: Compiler, a: list, s: Scope, name: str = name) -> Val:
                if len(a) < args[0] or args[1] is not None and len(a) > args[1]:
                    raise RuleError(f"{name} takes {args[0]} to {args[1] or 'any number of'} arguments, not {len(a)}")
                return f(c, a, s)

            OPERATORS[name] = checked
        return f

    return add


def register_operator(name: str, build: Callable[..., Column], result) -> None:
    """Add an operator of one's own: ``build`` gets the arguments' columns, ``result`` is its Spark type."""
    OPERATORS[name] = lambda c, a, s: Val(build(*[c.value(x, s).col for x in a]), result)


class Compiler:
    def __init__(self, config: EngineConfig = DEFAULT) -> None:
        self.config, self.depth = config, 0

    def value(self, rule: Any, scope: Scope) -> Val:
        if isinstance(rule, list):
            return array_of([self.value(x, scope) for x in rule])
        if not isinstance(rule, dict):
            return literal(rule)
        if not rule:
            return NULL
        name, given = next(iter(rule.items()))
        if name not in OPERATORS:
            raise RuleError(f"unknown operator {name!r}")
        self.depth += 1
        try:
            if self.depth > self.config.recursion_limit:
                raise RuleError("recursion limit exceeded")
            return OPERATORS[name](self, given if isinstance(given, list) else [given], scope)
        finally:
            self.depth -= 1

    def values(self, rules: list, scope: Scope) -> list[Val]:
        return [self.value(x, scope) for x in rules]


def is_rule(x: Any) -> bool:
    return isinstance(x, dict) and bool(x) and next(iter(x)) in OPERATORS


def referenced(rule: Any) -> list[str]:
    """Paths that a rule reads, in order of appearance, each once."""
    found: dict[str, None] = {}

    def walk(x: Any) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            for k, y in x.items():
                if k in ("var", "$ref", "ref"):
                    first = y[0] if isinstance(y, list) and y else y
                    if isinstance(first, str):
                        found[first] = None
                    walk(y[1:] if isinstance(y, list) else None)
                elif k in ("missing", "missing_some"):
                    keys = y if k == "missing" else (y[1] if isinstance(y, list) and len(y) > 1 else [])
                    for key in keys if isinstance(keys, list) else [keys]:
                        if isinstance(key, str):
                            found[key] = None
                elif k != "return":
                    walk(y)

    walk(rule)
    return list(found)


@lru_cache(4096)
def parse(rule_json: str) -> Any:
    """A rule of JSON text; equal texts are parsed once."""
    return json.loads(rule_json)


def as_rule(rule: Any) -> Any:
    return parse(rule) if isinstance(rule, str) and rule[:1] in "{[" else rule


def compile_rule(rule: Any, df: DataFrame, config: EngineConfig = DEFAULT, clean: bool = False) -> Column:
    """The rule as a column over ``df``. Lookups in tables that are DataFrames need ``plans.engine``."""
    v = Compiler(config).value(as_rule(rule), Scope(data_frame(df), config=config))
    return (clean_noise(v) if clean else v).col
