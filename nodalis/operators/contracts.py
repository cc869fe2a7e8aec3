"""What other code may rely on, as protocols."""

from __future__ import annotations

import inspect
from collections.abc import Sequence
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

from nodalis.operators.frames import Frames
from nodalis.operators.spectrum import Spectrum


@runtime_checkable
class LatentOperator(Protocol):
    def matrix(self) -> np.ndarray: ...

    def advance(self, z: np.ndarray, u=None) -> np.ndarray: ...

    def inverse_step(self, z: np.ndarray, u=None) -> np.ndarray: ...

    def bound(self) -> float: ...


@runtime_checkable
class SpectrumProvider(Protocol):
    def spectrum(self) -> Spectrum: ...


@runtime_checkable
class Forecaster(Protocol):
    def fit(self, frames: Frames): ...

    def predict(self, origins, steps: int) -> DataFrame: ...

    def spectrum(self) -> Spectrum: ...


@runtime_checkable
class IntervalForecaster(Protocol):
    def predict_interval(self, frames: Frames, steps: int, level: float = 0.9) -> DataFrame: ...


def takes_only_data(model) -> bool:
    """Whether ``predict`` can be called without controls."""
    params = list(inspect.signature(model.predict).parameters.values())
    return all(p.default is not p.empty or p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in params[2:])


def resolve_spectrum(source, **options) -> Spectrum:
    """A spectrum itself, or a provider's with the options that it knows."""
    if isinstance(source, Spectrum):
        return source
    if not isinstance(source, SpectrumProvider):
        raise TypeError("neither a spectrum nor something that has one")
    known = inspect.signature(source.spectrum).parameters
    return source.spectrum(**{k: v for k, v in options.items() if k in known and v is not None})


def similarity(a, b, method: str = "wasserstein", modes: int | None = None, **options) -> float:
    """Spectral distance of two sources under the same options."""
    from nodalis.operators.spectrum import distance

    return distance(resolve_spectrum(a, **options), resolve_spectrum(b, **options), method, modes)


def similarity_matrix(sources: Sequence, method: str = "wasserstein", modes: int | None = None, **options) -> np.ndarray:
    from nodalis.operators.spectrum import pairwise

    return pairwise([resolve_spectrum(s, **options) for s in sources], method, modes)
