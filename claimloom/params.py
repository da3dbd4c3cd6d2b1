"""Parameters of the engine; nothing reads the wall clock."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Params:
    as_of_claims: datetime = datetime(2001, 8, 2)
    as_of_events: datetime = datetime(2024, 1, 31)
    conversion_factor: str = "36.04"
    ml_threshold: float = 0.8
    charge_low: int = 50
    charge_high: int = 20_000
    allow_global_fc: bool = False  # whether a financial class without a facility fits any facility
    window_days: int = 90
    salt: str = "pepper"
    cooldown_minutes: dict[str, int] = field(default_factory=lambda: {"error": 60})


_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def resolve(value: object, env: dict[str, str] | None = None) -> object:
    """Expands ${NAME} and ${NAME:-default} in strings, through nested mappings and lists."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    return [resolve(v, env) for v in value] if isinstance(value, list) else value
