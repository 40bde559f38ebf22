"""Run configuration from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..operators.features import FEATURES


@dataclass
class Asset:
    symbol: str
    period: str = "730d"
    interval: str = "1h"


@dataclass
class Model:
    candidate_states: list[int] = field(default_factory=lambda: [2, 3, 4, 5, 6])
    covariance_type: str = "full"
    n_restarts: int = 10
    n_iter: int = 1000
    init_strategy: str = "kmeans"
    seed_base: int = 42
    emission_dist: str = "gaussian"


@dataclass
class Evaluation:
    run_stability: bool = False
    stability_n_runs: int = 3
    run_walk_forward: bool = False
    walk_forward_train_window: str = "180d"
    walk_forward_recalibration: str = "monthly"
    walk_forward_n_restarts: int = 3


@dataclass
class Config:
    asset: Asset
    features: list[tuple[str, dict]]
    model: Model = field(default_factory=Model)
    criterion: str = "bic"
    output_dir: str = "results/{symbol}/"
    evaluation: Evaluation = field(default_factory=Evaluation)


def days(period: str) -> int:
    """Days of ``<N>d``."""
    if not period.endswith("d") or not period[:-1].isdigit():
        raise ValueError(f"a period is a number of days such as 180d, not {period!r}")
    return int(period[:-1])


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}, not {value!r}")


def load(path: str | Path) -> Config:
    raw = yaml.safe_load(Path(path).read_text()) or {}
    if "symbol" not in raw.get("asset", {}):
        raise ValueError("asset.symbol is missing")
    features = [(f["name"], f.get("params") or {}) for f in raw.get("features", [])]
    config = Config(Asset(**raw["asset"]), features, Model(**raw.get("model", {})), raw.get("selection", {}).get("criterion", "bic"), raw.get("run", {}).get("output_dir", "results/{symbol}/"), Evaluation(**raw.get("evaluation", {})))
    for name, _ in features:
        _one_of("a feature", name, tuple(FEATURES))
    if not config.model.candidate_states or min(config.model.candidate_states) < 2:
        raise ValueError("candidate_states start at 2")
    _one_of("covariance_type", config.model.covariance_type, ("full", "diag", "tied", "spherical"))
    _one_of("emission_dist", config.model.emission_dist, ("gaussian", "student_t"))
    _one_of("init_strategy", config.model.init_strategy, ("kmeans", "spectral", "tensor"))
    _one_of("criterion", config.criterion, ("aic", "bic"))
    _one_of("walk_forward_recalibration", config.evaluation.walk_forward_recalibration, ("monthly",))
    days(config.evaluation.walk_forward_train_window)
    if config.asset.interval == "1h" and days(config.asset.period) > 730:
        raise ValueError("hourly bars go back 730 days at most")
    return config
