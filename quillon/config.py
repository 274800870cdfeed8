"""Parameters of the panel jobs, with their usual values."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class UniverseThresholds:
    price: float = 10.0
    average_volume: float = 300_000.0
    market_cap: float = 2e9
    lookback: int = 22


@dataclass(frozen=True)
class Normalisation:
    """``lag`` rows between what is known and what is used; ``history`` clean rows before an instrument counts."""

    lag: int = 2
    history: int = 60
    volatility_floor: float = 0.005
    trailing: tuple[int, ...] = (5, 21, 63)
    forward: tuple[int, ...] = (20, 60, 90)
    least_members: int = 10
    deviations: float = 5.0
    norm_window: int = 63
    norm_least: int = 20


@dataclass(frozen=True)
class CrossValidation:
    """Blocks of ``block`` dates after ``least_train`` dates. ``least_features``: share that a row needs. ``least_rows``: of a fold's training and validation parts."""

    least_train: int = 504
    block: int = 63
    least_rows: int = 10_000
    least_stop_rows: int = 50
    least_features: float = 0.8


@dataclass(frozen=True)
class Boosting:
    """``rows`` and ``features``: shares that a tree draws. ``bins``: of a feature, that splits lie between. ``tolerance``: the fall of the loss, as a share of it, under which a fit stops."""

    trees: int = 150
    depth: int = 4
    rate: float = 0.05
    least_leaf: int = 5
    rows: float = 0.8
    features: float = 0.8
    tolerance: float = 0.0001
    median_error: float = 0.001
    bins: int = 32
    seed: int = 42


@dataclass(frozen=True)
class Paths:
    root: str = "data"
    checkpoints: str = "checkpoints"
    extra: dict[str, str] = field(default_factory=dict)

    def at(self, name: str) -> str:
        return self.extra.get(name, f"{self.root.rstrip('/')}/{name}.parquet")


def environment_file(path: str) -> dict[str, str]:
    """``KEY=value`` lines of a file, without comments and quotes; what the process has set already wins."""
    p = Path(path)
    if not p.exists():
        return {}
    rows = (x.strip() for x in p.read_text().splitlines())
    pairs = (x.split("=", 1) for x in rows if x and not x.startswith("#") and "=" in x)
    return {k.strip(): os.environ.get(k.strip(), v.strip().strip("'\"")) for k, v in pairs}
