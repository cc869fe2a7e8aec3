"""Operator spectra, their distances, and anomaly thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions.linalg import expm


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues by falling magnitude (ties by falling real, then imaginary
    part) with their vectors; growth and frequency by unit of time."""

    values: np.ndarray
    vectors: np.ndarray
    magnitude: np.ndarray
    growth: np.ndarray
    frequency: np.ndarray
    time_step: float

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(v.real), float(v.imag), float(m), float(g), float(f)) for i, (v, m, g, f) in enumerate(zip(self.values, self.magnitude, self.growth, self.frequency, strict=True))]
        return spark.createDataFrame(rows, "mode int, re double, im double, magnitude double, growth double, freq double")

    def amplitudes(self, latent: np.ndarray) -> np.ndarray:
        """Coordinates of states (rows) in the eigenvectors."""
        return np.linalg.solve(self.vectors, np.atleast_2d(latent).T.astype(complex)).T


def _sorted(m: np.ndarray):
    w, v = np.linalg.eig(np.asarray(m, float))
    order = np.lexsort((-w.imag, -w.real, -np.round(np.abs(w), 12)))
    return w[order], v[:, order]


def compute_spectrum(operator: np.ndarray, time_step: float = 1.0) -> Spectrum:
    """Of a discrete operator: growth ln|l| / dt (minus infinity at 0), frequency
    angle / (2 pi dt)."""
    w, v = _sorted(operator)
    mag = np.abs(w)
    with np.errstate(divide="ignore"):
        growth = np.log(mag) / time_step
    return Spectrum(w, v, mag, growth, np.angle(w) / (2 * np.pi * time_step), time_step)


def generator_spectrum(generator: np.ndarray) -> Spectrum:
    """Of a continuous generator: growth is the real part."""
    w, v = _sorted(generator)
    return Spectrum(w, v, np.abs(w), w.real, w.imag / (2 * np.pi), 1.0)


def spectrum_at(generator: np.ndarray, dt: float) -> Spectrum:
    return compute_spectrum(expm(np.asarray(generator) * dt), dt)


def distance(a: Spectrum, b: Spectrum, method: str = "wasserstein", modes: int | None = None) -> float:
    """'wasserstein': mean difference of sorted magnitudes, the shorter padded with
    zeros; 'subspace_angle': mean principal angle between leading eigenvectors."""
    if method == "wasserstein":
        x, y = a.magnitude[:modes], b.magnitude[:modes]
        n = max(len(x), len(y))
        return float(np.abs(np.pad(x, (0, n - len(x))) - np.pad(y, (0, n - len(y)))).mean())
    if method != "subspace_angle":
        raise ValueError(f"unknown method {method!r}")
    if len(a.vectors) != len(b.vectors):
        raise ValueError("subspaces of different dimensions")
    n = min(modes or len(a.values), len(a.values), len(b.values))
    q, r = np.linalg.qr(a.vectors[:, :n])[0], np.linalg.qr(b.vectors[:, :n])[0]
    s = np.clip(np.linalg.svd(q.conj().T @ r, compute_uv=False), -1, 1)
    return float(np.arccos(s).mean())


def pairwise(spectra: Sequence[Spectrum], method: str = "wasserstein", modes: int | None = None) -> np.ndarray:
    n = len(spectra)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            out[i, j] = out[j, i] = distance(spectra[i], spectra[j], method, modes)
    return out


# --- the same on tables: one row per (group, mode) -------------------------------


def ranked(spectra: DataFrame, group: str = "grp", modes: int | None = None) -> DataFrame:
    """(group, rank, magnitude): magnitudes by falling size."""
    w = Window.partitionBy(group).orderBy(F.desc("magnitude"))
    out = spectra.select(group, F.row_number().over(w).alias("rank"), "magnitude")
    return out if modes is None else out.where(F.col("rank") <= modes)


def magnitude_distances(spectra: DataFrame, group: str = "grp", modes: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b of a stated, small set of groups: each
    group's magnitudes become one sorted array, so a pair is one row."""
    w = F.reverse(F.array_sort(F.collect_list("magnitude")))
    one = spectra.groupBy(group).agg((w if modes is None else F.slice(w, 1, modes)).alias("m"))
    a, b = one.select(F.col(group).alias("a"), F.col("m").alias("x")), one.select(F.col(group).alias("b"), F.col("m").alias("y"))
    n = F.greatest(F.size("x"), F.size("y"))
    gap = F.zip_with("x", "y", lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / n).alias("distance"))


def threshold(distances: DataFrame, method: str = "percentile", q: float = 95.0, k: float = 2.0) -> DataFrame:
    """(threshold): the q-th percentile (linear interpolation), or mean plus k
    population deviations, of distances between references."""
    if method == "percentile":
        return distances.agg(F.percentile("distance", q / 100).alias("threshold"))
    if method == "std":
        return distances.agg((F.avg("distance") + k * F.stddev_pop("distance")).alias("threshold"))
    raise ValueError(f"unknown method {method!r}")


def is_anomaly(references: Sequence[Spectrum], test: Spectrum, limit: float, method: str = "wasserstein", modes: int | None = None) -> tuple[float, bool]:
    """(mean distance to the references, whether it exceeds the limit)."""
    d = float(np.mean([distance(r, test, method, modes) for r in references]))
    return d, d > limit


def calibrate(references: Sequence[Spectrum], method: str = "percentile", q: float = 95.0, k: float = 2.0, **how) -> float:
    if len(references) < 2:
        raise ValueError("two references at least are needed")
    d = pairwise(references, **how)[np.triu_indices(len(references), 1)]
    return float(np.percentile(d, q)) if method == "percentile" else float(d.mean() + k * d.std())
