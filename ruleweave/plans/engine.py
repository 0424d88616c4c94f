"""Rules over whole DataFrames: every document is a row, every rule a column."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import ruleweave.operators.arrays
import ruleweave.operators.basic
import ruleweave.operators.dates
import ruleweave.operators.lookups
import ruleweave.operators.strings  # noqa: F401  operators register when imported
from ruleweave.config import DEFAULT, EngineConfig
from ruleweave.functions import values as V
from ruleweave.functions.values import Val
from ruleweave.paths import dotted
from ruleweave.plans.compiler import Compiler, as_rule, referenced
from ruleweave.plans.joins import JoinPlan, numbered
from ruleweave.plans.scope import Frame, Scope, data_frame


class Rules:
    """Named rules over one DataFrame. tables: DataFrames that lookups may name, their rows in order (numbered
    by ``_idx`` where they have that column). context: values that come before the data's."""

    def __init__(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, context: dict[str, Any] | None = None, config: EngineConfig = DEFAULT) -> None:
        self.columns = df.columns
        self.plan = JoinPlan(df, {dotted(k): numbered(t) for k, t in (tables or {}).items()}, config)
        frames = (Frame({k: V.literal(v) for k, v in context.items()}),) if context else ()
        self.scope = Scope(data_frame(df), frames, config, self.plan.tables, self.plan)
        self.compiler = Compiler(config)

    def value(self, rule: Any) -> Val:
        return self.compiler.value(as_rule(rule), self.scope)

    def columns_of(self, rules: dict[str, Any], clean: bool = False) -> DataFrame:
        """The documents with a column for each rule."""
        made = {name: self.value(rule) for name, rule in rules.items()}
        made = {name: V.clean_noise(v) if clean else v for name, v in made.items()}
        return self.plan.df.select(*[F.col(f"`{c}`") for c in self.columns if c not in made], *[v.col.alias(n) for n, v in made.items()])


def evaluate(
    df: DataFrame,
    rules: dict[str, Any],
    tables: dict[str, DataFrame] | None = None,
    context: dict[str, Any] | None = None,
    config: EngineConfig = DEFAULT,
    clean: bool = False,
) -> DataFrame:
    """``df`` with a column for each rule; rules do not see each other."""
    return Rules(df, tables, context, config).columns_of(rules, clean)


def keep(df: DataFrame, rule: Any, tables: dict[str, DataFrame] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The documents for which the rule is true."""
    rules = Rules(df, tables, None, config)
    test = V.truthy(rules.value(rule))
    return rules.plan.df.where(test).select(*[F.col(f"`{c}`") for c in rules.columns])


class LogicStore:
    """Rules under numbers: equal rules, whatever the order of their keys and their spacing, share one."""

    def __init__(self, config: EngineConfig = DEFAULT) -> None:
        self.config, self.ids, self.rules = config, {}, []

    def compile(self, rule: Any) -> int:
        """The rule's number, from 1; a rule that does not compile over an empty document is refused."""
        rule = as_rule(rule)
        key = json.dumps(rule, sort_keys=True)
        if key not in self.ids:
            Compiler(self.config).value(rule, Scope(Frame({}), config=self.config))
            self.rules.append(rule)
            self.ids[key] = len(self.rules)
        return self.ids[key]

    def reads(self, number: int) -> list[str]:
        return referenced(self.rules[number - 1])

    def run(self, df: DataFrame, numbers: dict[str, int], **more) -> DataFrame:
        """``df`` with a column for each name, by the rules of these numbers."""
        return evaluate(df, {name: self.rules[n - 1] for name, n in numbers.items()}, config=self.config, **more)


def is_in(df: DataFrame, column: str, values: DataFrame, of: str, absent: bool = False) -> DataFrame:
    """The documents whose value is (or is not) among another DataFrame's: a semi or anti join."""
    side = values.select(F.col(of).alias("__in")).distinct()
    return df.join(side, F.col(column) == F.col("__in"), "left_anti" if absent else "left_semi")


def run_json(spark, rule: Any, data: Any = None, config: EngineConfig = DEFAULT, clean: bool = False, context: dict[str, Any] | None = None) -> Any:
    """One rule over one JSON document, for trying rules out: the document becomes a single row."""
    root = V.literal(data if isinstance(data, dict) and data else {"__none": 0})
    df = spark.range(1).select(root.col.alias("d")).select("d.*")
    out = evaluate(df, {"__result": rule}, context=context, config=config, clean=clean)
    return plain(out.select(F.col("__result")).first()[0])


def plain(x: Any) -> Any:
    """Rows, dates and whole doubles as JSON values."""
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, float) and abs(x) < 2**53 and x == int(x):
        return int(x)
    return x
