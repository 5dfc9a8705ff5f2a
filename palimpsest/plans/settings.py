"""Settings of a compaction: defaults, merged with those of a JSON file, and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from palimpsest.operators.changelog import LEVELS
from palimpsest.operators.statements import CODES


@dataclass(frozen=True)
class Settings:
    level: str = "standard"
    rules: dict[str, bool] = field(default_factory=dict)
    lint: tuple[str, ...] = CODES
    most_bytes: int = 5_000_000
    server_version: int = 17
    confidence: float = 0.85

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"unknown safety level {self.level!r}")
        if unknown := sorted(set(self.lint) - set(CODES)):
            raise ValueError(f"unknown lint rules {unknown}")
        if self.most_bytes <= 0 or not 0 <= self.confidence <= 1 or self.server_version < 10:
            raise ValueError("a setting is out of its range")


def load_settings(text: str, base: Settings | None = None) -> Settings:
    """base (the defaults if None) with what the JSON text sets; rules are merged one by one. Unknown names are errors."""
    given, base = json.loads(text), base or Settings()
    if unknown := sorted(set(given) - {f.name for f in fields(Settings)}):
        raise ValueError(f"unknown settings {unknown}")
    merged = given | {"rules": base.rules | given.get("rules", {}), "lint": tuple(given.get("lint", base.lint))}
    return replace(base, **merged)
