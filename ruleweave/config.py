"""Settings of the rule engine, fixed when a rule is compiled."""

from __future__ import annotations

from dataclasses import dataclass, replace


class RuleError(ValueError):
    """A rule or schema that cannot be compiled."""


@dataclass(frozen=True)
class EngineConfig:
    """safe_nan: non-finite results become 0 instead of null. recursion_limit: deepest nesting of a rule.
    timezone_minutes: offset that TODAY and NOW add to UTC. now: fixed instant (ISO) for both, else the
    query's start. track: keep the list of referenced paths. date_month_quirk: DATE with a month of 1 modulo
    12 that is -11 or less gives null, as documented users may rely on it. broadcast_rows: largest reference
    table that is broadcast, after counting it."""

    safe_nan: bool = False
    recursion_limit: int = 1000
    timezone_minutes: int = 0
    now: str | None = None
    track: bool = True
    date_month_quirk: bool = True
    broadcast_rows: int = 100_000

    def with_(self, **changes) -> EngineConfig:
        return replace(self, **changes)


DEFAULT = EngineConfig()
PERFORMANCE = EngineConfig(track=False)
SAFE = EngineConfig(safe_nan=True)
MINIMAL = EngineConfig(track=False, recursion_limit=100)
