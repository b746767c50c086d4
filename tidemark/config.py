"""Engine settings: plain values that become literals in plans."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the score, state machine, trend and portfolio. Every operator takes its values as arguments; this is their source."""

    #: Fixed values from here on: thresholds, weights, tiers and tables of the rules.
    enter_2: float = 2.0
    enter_1: float = 3.5
    leave_2: float = 2.0
    leave_1: float = 3.0
    days_enter: int = 3
    days_leave_2: int = 5
    days_leave_1: int = 10
    hold_last_score: bool = True
    hard_floor: float = 3.5
    weights: dict[str, float] = field(default_factory=lambda: {"curve": 2.0, "spread": 1.5, "activity": 1.0, "ratio": 0.5, "sentiment": 0.5})
    trend_window: int = 200
    trading_days: int = 252
    target_vol: float = 0.41
    leverage_cap: float = 2.0
    portfolio_ma: int = 200
    portfolio_vol: int = 20
    portfolio_target: float = 0.35
    portfolio_cap: float = 2.0
    bond10_duration: float = 8.5
    bond2_duration: float = 1.9
    bond_carry: bool = True
    fear_tiers: tuple[tuple[int, float, float], ...] = ((1, 1.2, 0.85), (2, 1.0, 0.70), (3, 0.6, 0.50))
    equity: dict[tuple[str, str], float] = field(default_factory=lambda: {("DEFCON2", "UP"): 0.5, ("DEFCON2", "DOWN"): 0.3, ("DEFCON2", "UNKNOWN"): 0.4, ("DEFCON1", "UP"): 0.7, ("DEFCON1", "DOWN"): 1.0, ("DEFCON1", "UNKNOWN"): 0.8})
    macro: dict[str, float] = field(default_factory=lambda: {"WARMUP": 0.0, "NORMAL": 1.0, "DEFCON2": 1.0, "DEFCON1": 1.0})
    valid_days: dict[str, int] = field(default_factory=lambda: {"1D": 4, "1W": 21, "1M": 62})
    tz: str = "UTC"


    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "TIDEMARK_") -> EngineConfig:
        """The defaults with the plain values that variables like TIDEMARK_TREND_WINDOW set; a value that does not fit raises ValueError."""
        found = {}
        for f in fields(cls):
            text, kind = env.get(prefix + f.name.upper()), type(f.default)
            if text is not None and kind in (int, float, bool, str):
                if kind is bool and text.lower() not in ("1", "0", "true", "false"):
                    raise ValueError(f"{prefix}{f.name.upper()}: {text!r} is neither true nor false")
                found[f.name] = text.lower() in ("1", "true") if kind is bool else kind(text)
        return replace(cls(), **found)


DEFAULT = EngineConfig()
