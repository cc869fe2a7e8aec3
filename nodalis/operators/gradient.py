"""Gradient training of operator and decoder.

The encoder stays fixed; operator K and decoder C are trained by Adam on
reconstruction, roll-out and forward-consistency terms, whose gradients through
a roll-out of linear steps are written out.  A step is one Spark job: every task
adds up the gradients of its windows, entries add up across tasks, and the driver
gets as many numbers as there are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodalis.operators.frames import Frames
from nodalis.operators.latent import DiscreteOperator
from nodalis.operators.model import GraphModel
from nodalis.operators.training import EarlyStopping, History, LossWeights, monitor, weights_at

TERMS = ("reconstruction", "rollout", "forward")


def gradients(k: np.ndarray, c: np.ndarray, z0: np.ndarray, z1: np.ndarray, targets: np.ndarray, w: LossWeights) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Sums over rows of dK, dC and of each term; ``targets`` is rows x steps x
    channels.  Terms are means over a row's entries."""
    h = targets.shape[1]
    zs, errs = [z0], []
    for i in range(h):
        zs.append(zs[-1] @ k.T)
        errs.append(zs[-1] @ c.T - targets[:, i])
    miss = zs[1] - z1
    terms = {"reconstruction": float((errs[0] ** 2).mean(1).sum()), "rollout": float(sum((e**2).mean(1).sum() for e in errs) / h), "forward": float((miss**2).mean(1).sum())}
    dk, dc, dz = np.zeros_like(k), np.zeros_like(c), np.zeros_like(z0)
    for i in range(h - 1, -1, -1):
        share = w.rollout / h + (w.reconstruction if i == 0 else 0.0)
        de = 2 * share * errs[i] / c.shape[0]
        dc += de.T @ zs[i + 1]
        dz = dz + de @ c
        if i == 0:
            dz = dz + 2 * w.forward * miss / k.shape[0]
        dk += dz.T @ zs[i]
        dz = dz @ k
    return dk, dc, terms


class Adam:
    def __init__(self, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        if lr <= 0:
            raise ValueError("the learning rate must be positive")
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        self.m: list = []
        self.v: list = []

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], scale: float = 1.0) -> list[np.ndarray]:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t += 1
        out = []
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            self.m[i] = self.b1 * self.m[i] + (1 - self.b1) * g
            self.v[i] = self.b2 * self.v[i] + (1 - self.b2) * g * g
            out.append(p - scale * self.lr * (self.m[i] / (1 - self.b1**self.t)) / (np.sqrt(self.v[i] / (1 - self.b2**self.t)) + self.eps))
        return out


def examples(model: GraphModel, frames: Frames, horizon: int) -> DataFrame:
    """(traj, t, node, z, z1, y): latent start and next, and the features of the
    following ``horizon`` steps; unobserved targets leave their window out."""
    z = model.encode(frames).withColumnRenamed("f", "z")
    rows = z.join(frames.snap, ["traj", "t", "node"])
    if frames.mask is not None:
        rows = rows.join(frames.mask, ["traj", "t", "node"], "left").withColumn("f", F.when(F.coalesce("observed", F.lit(True)), F.col("f")))
    w = Window.partitionBy("traj", "node").orderBy("t")
    y = F.array(*[F.lead("f", i).over(w) for i in range(1, horizon + 1)])
    out = rows.select("traj", "t", "node", "z", F.lead("z").over(w).alias("z1"), y.alias("y"))
    return out.where(F.col("z1").isNotNull() & F.forall("y", lambda v: v.isNotNull()))


def summed(rows: DataFrame, k: np.ndarray, c: np.ndarray, w: LossWeights) -> tuple[np.ndarray, np.ndarray, dict[str, float], int]:
    """Gradients and terms averaged over the rows, and their number."""

    def run(batches):
        total, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            z0 = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
            z1 = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
            y = np.asarray(b.column(2).flatten().flatten(), float).reshape(b.num_rows, -1, len(c))
            dk, dc, terms = gradients(k, c, z0, z1, y, w)
            part = np.r_[dk.ravel(), dc.ravel(), [terms[t] for t in TERMS], b.num_rows]
            total = part if total is None else total + part
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    got = rows.select("z", "z1", "y").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_pandas().sort_values("i")
    if not len(got):
        raise ValueError("no windows to learn from")
    v = got.v.to_numpy()
    n = v[-1]
    a, b = k.size, c.size
    return v[:a].reshape(k.shape) / n, v[a : a + b].reshape(c.shape) / n, dict(zip(TERMS, v[a + b : -1] / n, strict=True)), int(n)


def train(model: GraphModel, frames: Frames, epochs: int = 100, lr: float = 1e-3, weights: LossWeights | None = None, schedule: Callable[[int], LossWeights] | None = None, horizon: int = 1, batches: int = 1, seed: int = 0, max_norm: float | None = None, lr_schedule: Callable[[int], float] | None = None, validation: Frames | None = None, patience: int | None = None, least: float = 0.0, watch: str = "auto") -> History:
    """Adam over ``epochs``; the best state stays.  With ``batches`` above 1 an
    epoch is that many steps over windows dealt by a hash of seed and epoch.
    Starts from the model's fitted state, or from the identity."""
    if epochs < 1 or horizon < 1 or batches < 1:
        raise ValueError("epochs, horizon and batches must be positive")
    rows = examples(model, frames, horizon).persist()
    val = examples(model, validation, horizon).persist() if validation is not None else None
    name = monitor(watch, val is not None)
    if model.operator is None:
        d = len(rows.select("z").first().z)
        model.operator = DiscreteOperator(d, "dense", seed=seed)
        model.decoder = np.eye(frames.channels, d)
    k, c = model.operator.matrix().copy(), model.decoder.copy()
    adam, stopping, best = Adam(lr), EarlyStopping(patience, least), (k, c)
    try:
        for epoch in range(epochs):
            w = weights_at(epoch, weights, schedule)
            seen, sums = 0, dict.fromkeys(TERMS, 0.0)
            for b in range(batches):
                part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(F.lit(seed + epoch), "traj", "t"), F.lit(batches)) == b)
                try:
                    dk, dc, terms, n = summed(part, k, c, w)
                except ValueError:
                    continue  # a batch that no window fell into
                size = float(np.sqrt((dk**2).sum() + (dc**2).sum()))
                clip = min(1.0, max_norm / size) if max_norm and size > 0 else 1.0
                k, c = adam.step([k, c], [clip * dk, clip * dc], lr_schedule(epoch) if lr_schedule else 1.0)
                seen += n
                sums = {t: sums[t] + n * terms[t] for t in TERMS}
            if not seen:
                raise ValueError("no windows to learn from")
            entry = {t: v / seen for t, v in sums.items()}
            entry["total"] = w.total(entry)
            if val is not None:
                entry["validation"] = w.total(summed(val, k, c, w)[2])
            model.history.add(entry)
            loss = entry["validation"] if name == "validation" else entry["total"]
            if loss < stopping.best:
                best = (k, c)
            if stopping.stop(loss):
                break
    finally:
        rows.unpersist()
        if val is not None:
            val.unpersist()
    model.operator.set_dense(best[0])
    model.decoder = best[1]
    return model.history
