"""Settings of a run: defaults, over them a TOML file, over that the environment."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

#: Names in the environment begin with this; ``RATEWRIGHT_WINDOW_DAYS`` sets ``window_days``. The file is named by ``RATEWRIGHT_SETTINGS``.
PREFIX = "RATEWRIGHT_"


@dataclass(frozen=True)
class Settings:
    warehouse: str = "warehouse"
    inbox: str = "inbox"
    checkpoint: str = "checkpoint"
    window_days: int = 90
    dedup_days: int = 3
    amount_tolerance: float = 0.005
    settlement_days: int = 14
    horizon_days: int = 90

    @classmethod
    def load(cls, path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        """A missing file is no error; an unknown name in it, or a value of the wrong kind, is one (ValueError)."""
        environment = os.environ if environment is None else environment
        path = path or environment.get(f"{PREFIX}SETTINGS")
        given: dict[str, object] = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := sorted(set(given) - set(kinds)):
            raise ValueError(f"no settings: {', '.join(unknown)}")
        given |= {name: environment[PREFIX + name.upper()] for name in kinds if PREFIX + name.upper() in environment}
        return cls(**{name: kinds[name](value) for name, value in given.items()})
