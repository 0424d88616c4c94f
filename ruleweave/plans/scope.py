"""What a path means at a place in a rule: a chain of frames, innermost first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.config import DEFAULT, EngineConfig
from ruleweave.functions.values import NULL, Val
from ruleweave.paths import segments


@dataclass(frozen=True)
class Frame:
    """Names that a path can start with. item: the value that the empty path means."""

    names: dict[str, Val] = field(default_factory=dict)
    item: Val | None = None
    whole: Callable[[], Val] | None = None

    def find(self, steps: list[str]) -> Val | None:
        if not steps:
            return self.item or (self.whole() if self.whole else None)
        if steps[0] in self.names:
            return descend(self.names[steps[0]], steps[1:])
        return descend(self.item, steps) if self.item is not None else None


def descend(v: Val, steps: list[str]) -> Val | None:
    for s in steps:
        t = v.type
        if isinstance(t, T.StructType):
            if s not in t.names:
                return None
            v = Val(v.col.getField(s), t[s].dataType)
        elif isinstance(t, T.ArrayType):
            if not s.isdigit():
                return None
            v = Val(F.get(v.col, F.lit(int(s))), t.elementType)
        elif isinstance(t, T.MapType):
            v = Val(F.try_element_at(v.col, F.lit(s)), t.valueType)
        else:
            return None
    return v


def item_frame(col: Column, kind: T.DataType) -> Frame:
    return Frame(item=Val(col, kind))


def data_frame(df: DataFrame) -> Frame:
    names = {f.name: Val(F.col(f"`{f.name}`"), f.dataType, nullable=f.nullable) for f in df.schema}

    def whole() -> Val:
        return Val(F.struct(*[F.col(f"`{n}`") for n in names]), df.schema)

    return Frame(names, whole=whole)


@dataclass(frozen=True)
class Scope:
    """context frames are asked before data; ``data`` is what missing, table operands and "" see first."""

    data: Frame
    context: tuple[Frame, ...] = ()
    config: EngineConfig = DEFAULT
    tables: dict[str, DataFrame] = field(default_factory=dict)
    plan: object = None

    def lookup(self, path: str) -> Val:
        steps = segments(path)
        if steps:
            for frame in self.context:
                if (v := frame.find(steps)) is not None:
                    return v
        return self.data.find(steps) or NULL

    def in_data(self, path: str) -> Val:
        return self.data.find(segments(path)) or NULL

    def operand(self, path: str) -> Val:
        """Table operands look in the data before the context."""
        steps = segments(path)
        found = self.data.find(steps)
        for frame in self.context if found is None else ():
            found = frame.find(steps) if found is None else found
        return found or NULL

    def only(self, frame: Frame) -> Scope:
        """Inside an item's logic: the item is all there is."""
        return Scope(frame, (), self.config, self.tables, self.plan)

    def with_context(self, *frames: Frame) -> Scope:
        return Scope(self.data, tuple(frames), self.config, self.tables, self.plan)

    def within(self, data: Frame) -> Scope:
        """The same place over other data."""
        return Scope(data, self.context, self.config, self.tables, self.plan)
