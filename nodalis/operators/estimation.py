"""State estimation: Kalman filter, Rauch-Tung-Striebel smoother, imputation and
recursive least squares.

Filters are ordered folds, so each runs in one Arrow call for its group.  An
operator that acts on nodes one by one (I (x) K) with isotropic noise filters
each (trajectory, node) on its own, which gives the joint filter's numbers and as
many independent groups as there are nodes; a graph-coupled operator filters a
whole trajectory at once and is meant for small graphs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodalis import schema
from nodalis.functions import vectors as V
from nodalis.functions.linalg import rls_update
from nodalis.operators.frames import Frames


def kalman(a, q, h, r, ys, x0, p0, drift=None, observed=None):
    """(means, covariances, predicted means, predicted covariances).  The first
    step uses the prior without predicting; ``a`` is one transition or one for
    each interval; rows of ``observed`` say which measurements exist."""
    n, d = len(ys), len(x0)
    out = [np.zeros((n, d)), np.zeros((n, d, d)), np.zeros((n, d)), np.zeros((n, d, d))]
    x, p = np.asarray(x0, float), np.asarray(p0, float)
    for t in range(n):
        if t:
            k = a[t - 1] if np.ndim(a) == 3 else a
            x = k @ x + (0 if drift is None else drift[t - 1])
            p = k @ p @ k.T + q
            p = (p + p.T) / 2
        out[2][t], out[3][t] = x, p
        use = np.ones(len(ys[t]), bool) if observed is None else np.asarray(observed[t], bool)
        if use.any():
            hh = h[use]
            s = hh @ p @ hh.T + r[np.ix_(use, use)]
            g = np.linalg.solve(s, hh @ p).T
            x = x + g @ (np.asarray(ys[t], float)[use] - hh @ x)
            p = (np.eye(d) - g @ hh) @ p
            p = (p + p.T) / 2
        out[0][t], out[1][t] = x, p
    return tuple(out)


def smooth(a, means, covs, pred_means, pred_covs):
    """The backward pass; the last step stays as it is."""
    m, c = means.copy(), covs.copy()
    for t in range(len(means) - 2, -1, -1):
        k = a[t] if np.ndim(a) == 3 else a
        g = np.linalg.solve(pred_covs[t + 1], k @ covs[t]).T
        m[t] = means[t] + g @ (m[t + 1] - pred_means[t + 1])
        p = covs[t] + g @ (c[t + 1] - pred_covs[t + 1]) @ g.T
        c[t] = (p + p.T) / 2
    return m, c


class Observer:
    """Filtering of a sequence whose features (or their linear encoding) follow
    ``transition``."""

    def __init__(self, transition: np.ndarray, process: float = 1e-3, noise: float = 1e-2, prior: float = 1.0, adjacency: np.ndarray | None = None, neighbour: np.ndarray | None = None):
        if min(process, noise, prior) <= 0:
            raise ValueError("variances must be positive")
        self.k, self.process, self.noise, self.prior = np.asarray(transition, float), process, noise, prior
        self.adjacency, self.neighbour = adjacency, neighbour

    def _run(self, frames: Frames, back: bool) -> DataFrame:
        d, k, q, r, p0 = len(self.k), self.k, self.process, self.noise, self.prior
        snap = frames.snap
        if frames.mask is not None:
            snap = snap.join(frames.mask, ["traj", "t", "node"], "left").select("traj", "t", "node", "f", F.coalesce("observed", F.lit(True)).alias("observed"))
        else:
            snap = snap.withColumn("observed", F.lit(True))
        adj, nbr = self.adjacency, self.neighbour
        whole = nbr is not None

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["t", "node"])
            n = pdf.node.nunique()
            y = np.array(pdf.f.tolist(), float).reshape(-1, n * d)
            seen = np.repeat(pdf.observed.to_numpy().reshape(-1, n), d, axis=1)
            a = np.kron(np.eye(n), k) + (np.kron(adj, nbr) if whole else 0)
            eye = np.eye(n * d)
            x0 = np.where(seen[0], y[0], 0.0)
            got = kalman(a, q * eye, eye, r * eye, y, x0, p0 * eye, observed=seen)
            m, c = smooth(a, *got) if back else got[:2]
            var = np.array([np.diag(x) for x in c])
            return pd.DataFrame({"traj": pdf.traj, "t": pdf.t, "node": pdf.node, "f": list(m.reshape(-1, d)), "var": list(var.reshape(-1, d))})

        by = ["traj"] if whole else ["traj", "node"]
        return snap.groupBy(*by).applyInPandas(one, schema.SNAP + ", var array<double>")

    def filter(self, frames: Frames) -> DataFrame:
        """(traj, t, node, f, var): filtered means and variances."""
        return self._run(frames, False)

    def smooth(self, frames: Frames) -> DataFrame:
        return self._run(frames, True)

    def impute(self, frames: Frames, smoother: bool = True) -> DataFrame:
        """(traj, t, node, f): estimates at unobserved nodes only (everywhere
        without a mask)."""
        est = self._run(frames, smoother).select("traj", "t", "node", F.col("f").alias("_e"))
        both = frames.snap.join(est, ["traj", "t", "node"])
        if frames.mask is None:
            return both.select("traj", "t", "node", F.col("_e").alias("f"))
        both = both.join(frames.mask, ["traj", "t", "node"], "left")
        return both.select("traj", "t", "node", F.when(F.coalesce("observed", F.lit(True)), F.col("f")).otherwise(F.col("_e")).alias("f"))


class RecursiveFit:
    """Recursive least squares of K (and B) from transitions in order of (t, node)."""

    def __init__(self, dim: int, control_dim: int = 0, forget: float = 0.99, regularization: float = 1000.0):
        if dim < 1 or not 0 < forget <= 1 or regularization <= 0:
            raise ValueError("dimension, forgetting factor or regularization out of range")
        self.dim, self.control_dim, self.forget = dim, control_dim, forget
        self.w = np.zeros((dim + control_dim, dim))
        self.w[:dim] = np.eye(dim)
        self.p = regularization * np.eye(dim + control_dim)
        self.change = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return self.w[: self.dim].T

    @property
    def control(self) -> np.ndarray:
        return self.w[self.dim :]

    def update(self, x: np.ndarray, y: np.ndarray, u: np.ndarray | None = None) -> float:
        """Rows one after another; returns the Frobenius norm of K's change."""
        before = self.w.copy()
        if (u is None) != (self.control_dim == 0):
            raise ValueError("a control is needed exactly when there is a control dimension")
        for i, (a, b) in enumerate(zip(np.atleast_2d(x), np.atleast_2d(y), strict=True)):
            phi = a if u is None else np.r_[a, np.atleast_2d(u)[i if np.ndim(u) > 1 else 0]]
            self.w, self.p, _ = rls_update(self.w, self.p, phi, b, self.forget)
        self.change = float(np.linalg.norm(self.w[: self.dim] - before[: self.dim]))
        return self.change


def recursive_fit(frames: Frames, forget: float = 0.99, regularization: float = 1000.0) -> DataFrame:
    """(traj, name, i, j, v): each trajectory's operator after all its transitions
    in order of (t, node).

    The recursion has a closed form: transition k of n weighs forget^(n - k) in
    the sums x x' and x y', the start's identity over ``regularization`` weighs
    forget^n.  So transitions are numbered (a running count over steps, a place
    within each step) and added up with partial sums; only d x d sums are solved,
    one trajectory a call."""
    if not 0 < forget <= 1 or regularization <= 0:
        raise ValueError("forgetting factor or regularization out of range")
    p = frames.pairs()
    d = frames.channels
    steps = p.groupBy("traj", "t").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("traj")
    steps = steps.select("traj", "t", F.sum("_n").over(w.orderBy("t")).alias("_end"), "_n", F.sum("_n").over(w).alias("_all"))
    place = F.row_number().over(Window.partitionBy("traj", "t").orderBy("node"))
    rows = p.withColumn("_at", place).join(steps, ["traj", "t"]).withColumn("_w", F.pow(F.lit(float(forget)), F.col("_all") - F.col("_end") + F.col("_n") - F.col("_at")))
    entries = [F.sum(F.col("_w") * F.col("x")[i] * F.col(c)[j]) for c in "xy" for i in range(d) for j in range(d)]
    sums = rows.groupBy("traj").agg(F.max("_all").alias("n"), F.array(*entries).alias("s"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for traj, n, s in zip(pdf.traj, pdf.n, pdf.s, strict=True):
            start = forget ** float(n) / regularization * np.eye(d)
            s = np.asarray(s, float).reshape(2, d, d)
            k = np.linalg.solve(s[0] + start, s[1] + start).T
            i, j = np.indices(k.shape)
            out.append(pd.DataFrame({"traj": traj, "name": "K", "i": i.ravel(), "j": j.ravel(), "v": k.ravel()}))
        return pd.concat(out)

    return sums.mapInPandas(lambda parts: (one(x) for x in parts if len(x)), "traj int, " + schema.MATRIX)


def node_dmd(frames: Frames, rank: int | None = None) -> DataFrame:
    """(traj, node, mode, re, im, magnitude): spectra of each node's own operator,
    one small solve for each group."""
    from nodalis.operators.fit import solve
    from nodalis.operators.spectrum import compute_spectrum

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf.x.tolist(), float), np.array(pdf.y.tolist(), float)
        s = compute_spectrum(solve(x.T @ x, x.T @ y, rank).T)
        return pd.DataFrame({"traj": pdf.traj.iloc[0], "node": pdf.node.iloc[0], "mode": range(len(s.values)), "re": s.values.real, "im": s.values.imag, "magnitude": s.magnitude})

    return frames.pairs().groupBy("traj", "node").applyInPandas(one, "traj int, node int, mode int, re double, im double, magnitude double")


def forecast_variance(filtered: DataFrame, k: np.ndarray, process: float, steps: int) -> DataFrame:
    """(traj, origin, h, node, f, var): diagonal Gaussian forecasts from filtered
    rows; exact for a diagonal K."""
    rows, power, noise = [], np.eye(len(k)), np.zeros(len(k))
    for h in range(1, steps + 1):
        power, noise = k @ power, (k**2) @ noise + process
        rows.append(F.struct(F.lit(h).alias("h"), V.matvec(power, "f").alias("f"), V.add(V.matvec(power**2, "var"), F.array(*[F.lit(float(v)) for v in noise])).alias("var")))
    return filtered.select("traj", F.col("t").alias("origin"), "node", F.explode(F.array(*rows)).alias("_r")).select("traj", "origin", "_r.h", "node", "_r.f", "_r.var")
