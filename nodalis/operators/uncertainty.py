"""Predictive intervals from members, and Gaussian propagation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantile_levels(level: float) -> tuple[float, float]:
    if not 0 < level < 1:
        raise ValueError("the level must lie between 0 and 1")
    return (1 - level) / 2, 1 - (1 - level) / 2


def member_interval(members: DataFrame, by: Sequence[str], value: str, level: float = 0.9) -> DataFrame:
    """(*by, mean, lower, upper): mean and linearly interpolated quantiles over
    members; a single member is its own interval."""
    lo, hi = quantile_levels(level)
    q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
    return members.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("_q")).select(*by, "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def propagate(transition: np.ndarray, cov: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A P A' + Q, symmetrised."""
    p = transition @ cov @ transition.T + noise
    return (p + p.T) / 2


def nodewise(k: np.ndarray, nodes: int) -> np.ndarray:
    """The same operator on every node: I (x) K."""
    return np.kron(np.eye(nodes), k)


def gaussian_forecast(transition: np.ndarray, mean: np.ndarray, cov: np.ndarray, noise: float, steps: int, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of 1 .. steps of m' = A m + b, P' = A P A' + Q."""
    q, ms, ps = noise * np.eye(len(mean)), [], []
    for h in range(steps):
        mean = transition @ mean + (0 if drift is None else drift[h])
        cov = propagate(transition, cov, q)
        ms.append(mean)
        ps.append(cov)
    return np.array(ms), np.array(ps)


def sampled_interval(mean: np.ndarray, cov: np.ndarray, decode, level: float = 0.9, samples: int = 64, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, lower, upper) of decoded samples of a Gaussian."""
    low = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
    draws = mean + np.random.default_rng(seed).normal(size=(samples, len(mean))) @ low.T
    y = np.array([decode(z) for z in draws])
    a, b = np.quantile(y, quantile_levels(level), axis=0)
    return decode(mean), a, b


class GaussianForecaster:
    """Intervals of a fitted model from Gaussian latent uncertainty: the filtered
    state and covariance of each origin's node move by the operator, and samples
    are decoded."""

    def __init__(self, model, process: float = 1e-3, noise: float = 1e-2, prior: float = 1.0, samples: int = 64, seed: int = 0):
        if min(process, noise, prior) <= 0 or samples < 1:
            raise ValueError("variances and the number of samples must be positive")
        self.model, self.process, self.noise, self.prior, self.samples, self.seed = model, process, noise, prior, samples, seed

    def _transition(self) -> np.ndarray:
        from nodalis.operators.latent import ContinuousOperator

        op = self.model.operator
        return op.transition(self.model.time_step) if isinstance(op, ContinuousOperator) else op.matrix()

    def filtered(self, frames) -> DataFrame:
        """(traj, t, node, f, var): filtered latent means and variances."""
        from nodalis.operators.estimation import Observer

        return Observer(self._transition(), self.process, self.noise, self.prior).filter(frames.with_features(self.model.encode(frames)))

    def predict(self, frames, steps: int) -> DataFrame:
        return self.model.predict(frames, steps)

    def predict_interval(self, frames, steps: int, level: float = 0.9) -> DataFrame:
        """(traj, origin, h, node, c, mean, lower, upper)."""
        import pandas as pd

        k, decoder, q, n, seed = self._transition(), self.model.decoder, self.process, self.samples, self.seed

        def batch(parts):
            for pdf in parts:
                rows = []
                for r in pdf.itertuples(index=False):
                    ms, ps = gaussian_forecast(k, np.array(r.f), np.diag(r.var), q, steps)
                    for h in range(steps):
                        mean, lo, hi = sampled_interval(ms[h], ps[h], lambda z: decoder @ z, level, n, seed + h)
                        rows += [(r.traj, r.t, h + 1, r.node, c, float(mean[c]), float(lo[c]), float(hi[c])) for c in range(len(mean))]
                yield pd.DataFrame(rows, columns=["traj", "origin", "h", "node", "c", "mean", "lower", "upper"])

        return self.filtered(frames).mapInPandas(batch, "traj int, origin int, h int, node int, c int, mean double, lower double, upper double")
