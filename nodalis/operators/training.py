"""Training bookkeeping: loss weights, schedules, early stopping, histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class LossWeights:
    """Weights of the terms; a weight of 0 leaves its term out."""

    reconstruction: float = 1.0
    forward: float = 0.0
    backward: float = 0.0
    rollout: float = 0.0
    eigenvalue: float = 0.0
    lie: float = 0.0
    pde: float = 0.0
    sparsity: float = 0.0
    worst_case: float = 0.0

    def total(self, terms: dict[str, float]) -> float:
        return sum(getattr(self, k) * v for k, v in terms.items())

    def active(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name)]


def linear_ramp(start: LossWeights, end: LossWeights, epochs: int) -> Callable[[int], LossWeights]:
    """From ``start`` to ``end``, there at epoch epochs - 1."""
    if epochs < 1:
        raise ValueError("a ramp has an epoch at least")

    def at(epoch: int) -> LossWeights:
        k = 1.0 if epochs == 1 else min(1.0, max(0.0, epoch / (epochs - 1)))
        return LossWeights(**{f.name: (1 - k) * getattr(start, f.name) + k * getattr(end, f.name) for f in fields(start)})

    return at


def weights_at(epoch: int, weights: LossWeights | None = None, schedule: Callable[[int], LossWeights] | None = None) -> LossWeights:
    return schedule(epoch) if schedule else weights or LossWeights()


def mean_terms(parts: Sequence[dict[str, float]]) -> dict[str, float]:
    """Plain means over trajectories."""
    return {k: sum(p[k] for p in parts) / len(parts) for k in parts[0]}


def monitor(name: str, has_validation: bool) -> str:
    if name == "auto":
        return "validation" if has_validation else "training"
    if name not in ("validation", "training") or name == "validation" and not has_validation:
        raise ValueError(f"cannot monitor {name!r}")
    return name


@dataclass
class EarlyStopping:
    """Stops after ``patience`` epochs without an improvement over ``least``."""

    patience: int | None = None
    least: float = 0.0
    best: float = float("inf")
    since: int = 0

    def stop(self, loss: float) -> bool:
        if loss < self.best - self.least:
            self.best, self.since = loss, 0
        else:
            self.since += 1
        return self.patience is not None and self.since >= self.patience


@dataclass
class History:
    """Terms by epoch."""

    epochs: list[dict[str, float]] = field(default_factory=list)

    def add(self, terms: dict[str, float]) -> None:
        self.epochs.append(dict(terms))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, float(v)) for i, e in enumerate(self.epochs) for k, v in e.items()], "epoch int, term string, value double")
