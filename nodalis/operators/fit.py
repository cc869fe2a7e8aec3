"""Linear-operator models fitted from distributed sufficient statistics.

Regressor and target vectors of a transition sit in one row each; Gram matrices
are sums over rows of their outer products.  ``gram`` makes them with partial
sums inside Arrow batches (one d x d block leaves a task), so what reaches the
driver is d^2 numbers whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators.frames import Frames
from nodalis.operators.spectrum import Spectrum, compute_spectrum


def gram(rows: DataFrame, left: str, right: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(L'L, L'R, rows) of array columns."""

    def sums(batches):
        xx = xy = None
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
            y = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
            a, c = x.T @ x, x.T @ y
            xx, xy, n = (a, c, b.num_rows) if xx is None else (xx + a, xy + c, n + b.num_rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([xx.ravel()]), pa.array([xy.ravel()])], names=["n", "xx", "xy"])

    parts = rows.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).mapInArrow(sums, "n long, xx array<double>, xy array<double>")
    # tasks' blocks add up entry by entry before the driver sees them
    each = parts.select("n", F.posexplode(F.concat("xx", "xy")).alias("i", "v"), F.size("xx").alias("d2")).groupBy("i").agg(F.sum("v").alias("v"), F.max("d2").alias("d2"), F.sum("n").alias("n"))
    got = each.toArrow().to_pandas().sort_values("i")
    if not len(got):
        raise ValueError("no transitions to fit")
    d2 = int(got.d2.iloc[0])
    d = round(d2**0.5)
    v = got.v.to_numpy()
    return v[:d2].reshape(d, d), v[d2:].reshape(d, -1), int(got.n.iloc[0])


def solve(xx: np.ndarray, xy: np.ndarray, rank: int | None = None) -> np.ndarray:
    """A of min |L A - R| from its Gram matrices: minimum norm where they are
    rank-deficient, or in the leading ``rank`` directions of L."""
    w, v = np.linalg.eigh(xx)
    order = np.argsort(-w)
    w, v = w[order], v[:, order]
    keep = w > max(w.max(initial=0.0), 0.0) * len(w) * np.finfo(float).eps
    if rank is not None:
        if rank < 1:
            raise ValueError("the rank must be positive")
        keep &= np.arange(len(w)) < rank
    return v[:, keep] @ ((v[:, keep].T @ xy) / w[keep, None])


def powers(k: np.ndarray, n: int) -> list[np.ndarray]:
    """K, K^2 .. K^n."""
    out = [np.eye(len(k))]
    for _ in range(n):
        out.append(k @ out[-1])
    return out[1:]


class LinearModel:
    """Common part of fitted linear forecasters."""

    def __init__(self, time_step: float = 1.0, rank: int | None = None):
        if time_step <= 0:
            raise ValueError("the time step must be positive")
        if rank is not None and rank < 1:
            raise ValueError("the rank must be positive")
        self.time_step, self.rank = time_step, rank
        self.operator: np.ndarray | None = None
        self.nodes: list[int] = []
        self.channels = 0

    def _fitted(self) -> np.ndarray:
        if self.operator is None:
            raise RuntimeError("fit the model first")
        return self.operator

    def _states(self, frames: Frames) -> DataFrame:
        if frames.dynamic:
            raise ValueError("a static topology is needed")
        if frames.num_timesteps < 2:
            raise ValueError("two steps at least are needed")
        self.nodes = [r.node for r in frames.snap.select("node").distinct().orderBy("node").collect()]  # as many as a state vector has rows
        self.channels = frames.channels
        return frames.wide()

    def _pairs(self, wide: DataFrame) -> DataFrame:
        nxt = wide.select("traj", (F.col("t") - 1).alias("t"), F.col("x").alias("y"))
        return wide.join(nxt, ["traj", "t"])

    def spectrum(self) -> Spectrum:
        return compute_spectrum(self._fitted(), self.time_step)

    def _forecast(self, origins: DataFrame, column: str, maps: list[np.ndarray], push: list[np.ndarray] | None = None) -> DataFrame:
        """(traj, origin, h, node, f) of ``maps[h - 1]`` times each origin's
        state, plus ``push[h - 1]``.  The matrices are broadcast (d^2 numbers a
        horizon, as many as the driver holds), the plan stays small; no shuffle."""
        nodes, c = np.array(self.nodes, np.int32), self.channels
        own = origins.sparkSession.sparkContext.broadcast((maps, push))

        def run(batches):
            maps, push = own.value
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    b = whole.slice(at, 64)
                    x = np.asarray(b.column(2).flatten(), float).reshape(b.num_rows, -1)
                    for h, m in enumerate(maps, 1):
                        y = x @ m.T + (0 if push is None else push[h - 1])
                        n = y.size // c
                        rows = pa.array(np.repeat(np.arange(len(x)), len(nodes)))
                        f = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, c, dtype=np.int32)), pa.array(y.ravel()))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(n, h, np.int32)), pa.array(np.tile(nodes, len(x))), f], names=["traj", "origin", "h", "node", "f"])

        return origins.select("traj", "t", column).mapInArrow(run, "traj int, origin int, h int, node int, f array<double>")


class DMD(LinearModel):
    """x' = K x for all nodes' features together."""

    def fit(self, frames: Frames) -> DMD:
        p = self._pairs(self._states(frames))
        self.operator = solve(*gram(p, "x", "y")[:2], self.rank).T
        return self

    def predict(self, origins: DataFrame, steps: int) -> DataFrame:
        """Forecasts of 1 .. steps from (traj, t, node, f) origins: K^h once each on
        the driver, one product a batch and horizon."""
        return self._forecast(Frames(origins, origins).wide(), "x", powers(self._fitted(), steps))


class DMDc(LinearModel):
    """x' = K x + B' u with one control vector for all nodes."""

    control: np.ndarray | None = None

    def fit(self, frames: Frames) -> DMDc:
        if frames.ctrl is None or frames.ctrl.where("node is not null").limit(1).count():
            raise ValueError("controls common to all nodes are needed")
        p = self._pairs(self._states(frames)).join(frames.ctrl.select("traj", "t", "u"), ["traj", "t"])
        xx, xy, _ = gram(p.select(F.concat("x", "u").alias("l"), "y"), "l", "y")
        a = solve(xx, xy, self.rank)
        d = xy.shape[1]
        self.operator, self.control = a[:d].T, a[d:]
        return self

    def predict(self, origins: DataFrame, steps: int, controls: list[list[float]]) -> DataFrame:
        if len(controls) != steps:
            raise ValueError("one control for each step is needed")
        k = self._fitted()
        push = [np.zeros(len(k))]
        for u in controls:
            push.append(k @ push[-1] + np.asarray(u, float) @ self.control)
        return self._forecast(Frames(origins, origins).wide(), "x", powers(k, steps), push[1:])


class EDMD(LinearModel):
    """Linear steps in a dictionary of observables; forecasts lift once and come
    back through a least-squares reconstruction."""

    def __init__(self, time_step: float = 1.0, rank: int | None = None, dictionary: str = "polynomial", degree: int = 2, centers: int | None = None, length: float = 1.0, kernel: str = "gaussian", gamma: float = 1.0, coef0: float = 1.0):
        super().__init__(time_step, rank)
        if dictionary not in ("polynomial", "rbf", "kernel") or kernel not in ("gaussian", "polynomial", "linear") or degree not in (1, 2) and dictionary == "polynomial":
            raise ValueError("unknown dictionary, kernel or degree")
        self.dictionary, self.degree, self.count, self.length, self.kernel, self.gamma, self.coef0 = dictionary, degree, centers, length, kernel, gamma, coef0
        self.centers: list[list[float]] = []
        self.back: np.ndarray | None = None

    def _lift(self, x) -> Column:
        if self.dictionary == "polynomial":
            return V.polynomial(x, self.degree)
        if self.dictionary == "rbf" or self.kernel == "gaussian":
            return V.rbf(x, self.centers, self.length)
        if self.kernel == "polynomial":
            return V.polynomial_kernel(x, self.centers, self.degree, self.gamma, self.coef0)
        return V.linear_kernel(x, self.centers)

    def fit(self, frames: Frames) -> EDMD:
        wide = self._states(frames)
        if self.dictionary != "polynomial":
            total = frames.num_timesteps
            m = self.count or (min(32, total) if self.dictionary == "rbf" else total)
            if m > total:
                raise ValueError("more centers than steps")
            at = sorted({int(round(x)) for x in np.linspace(0, total - 1, m)})  # half to even
            self.centers = [r.x for r in wide.where(F.col("t").isin(at) & (F.col("traj") == 0)).orderBy("t").collect()]  # m rows
        lifted = wide.withColumn("o", self._lift("x"))
        p = self._pairs(lifted.select("traj", "t", F.col("o").alias("x")))
        self.operator = solve(*gram(p, "x", "y")[:2], self.rank).T
        self.back = solve(*gram(lifted, "o", "x")[:2]).T
        return self

    def predict(self, origins: DataFrame, steps: int) -> DataFrame:
        maps = [self.back @ p for p in powers(self._fitted(), steps)]
        return self._forecast(Frames(origins, origins).wide().withColumn("o", self._lift("x")), "o", maps)


def graph_least_squares(frames: Frames) -> DataFrame:
    """(k_self, k_nbr, pairs): x' = k_self x + k_nbr (A_hat x) for the first
    channel, by Cramer's rule on five sums."""
    from nodalis.operators.topology import adjacency_matvec

    n = adjacency_matvec(frames).select("traj", "t", "node", F.col("f")[0].alias("a"))
    p = frames.pairs().select("traj", "t", "node", F.col("x")[0].alias("x"), F.col("y")[0].alias("y")).join(n, ["traj", "t", "node"])
    s = p.agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i, j in ("xx", "xa", "aa", "xy", "ay")], F.count("*").alias("pairs"))
    det = F.col("xx") * F.col("aa") - F.col("xa") * F.col("xa")
    return s.select(((F.col("xy") * F.col("aa") - F.col("ay") * F.col("xa")) / det).alias("k_self"), ((F.col("ay") * F.col("xx") - F.col("xy") * F.col("xa")) / det).alias("k_nbr"), "pairs")


def node_ar1(frames: Frames) -> DataFrame:
    """(traj, node, k): each node's own one-step factor of the first channel."""
    p = frames.pairs().select("traj", "node", F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))
    return p.groupBy("traj", "node").agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("k"))


def gram_entries(frames: Frames) -> DataFrame:
    """(i, j, v): entries of X'X over steps for the first channel, as one equi-join
    on the step."""
    a = frames.snap.select("traj", "t", F.col("node").alias("i"), F.col("f")[0].alias("a"))
    b = frames.snap.select("traj", "t", F.col("node").alias("j"), F.col("f")[0].alias("b"))
    return a.join(b, ["traj", "t"]).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def save_matrix(spark: SparkSession, name: str, m: np.ndarray) -> DataFrame:
    """(name, i, j, v) rows of a small matrix."""
    return spark.createDataFrame([(name, i, j, float(v)) for (i, j), v in np.ndenumerate(np.atleast_2d(m))], "name string, i int, j int, v double")
