"""The terms of the training objective, each one aggregation on a sequence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators import metrics
from nodalis.operators.frames import Frames
from nodalis.operators.latent import ContinuousOperator, GraphOperator, eigenvalue_penalty
from nodalis.operators.model import GraphModel
from nodalis.operators.training import LossWeights


def _one(df: DataFrame, name: str) -> float:
    return float(df.first()[name] or 0.0)


def reconstruction(model: GraphModel, frames: Frames) -> float:
    """Mean over transitions of the squared error of one decoded step; unobserved
    targets do not count."""
    pred = model.predict(frames, 1).select("traj", (F.col("origin") + 1).alias("t"), "node", "f")
    err = metrics.node_errors(pred, frames.snap, ["traj", "t", "node"])
    if frames.mask is not None:
        err = err.join(frames.mask.where("observed").select("traj", "t", "node"), ["traj", "t", "node"], "left_semi")
    return _one(err.groupBy("traj", "t").agg(F.avg("se").alias("e")).agg(F.avg("e").alias("loss")), "loss")


def forward_consistency(model: GraphModel, frames: Frames) -> float:
    """|advance(z_t) - z_t+1|^2 in latent space."""
    latent = frames.with_features(model.encode(frames))
    return _one(metrics.pair_loss(latent, lambda z: model.operator.column(z)), "loss")


def backward_consistency(model: GraphModel, frames: Frames) -> float:
    """|inverse(z_t+1) - z_t|^2; the inverse is made once."""
    latent = frames.with_features(model.encode(frames))
    back = model.operator.transition(-model.time_step) if isinstance(model.operator, ContinuousOperator) else model.operator.inverse_matrix()
    p = latent.pairs()
    d = V.sub(V.matvec(back, "y"), "x")
    if frames.mask is not None:
        p = p.join(frames.pair_mask(), ["traj", "t", "node"]).where("observed")
    return _one(p.groupBy("traj", "t").agg(F.avg(V.mean(V.mul(d, d))).alias("e")).agg(F.avg("e").alias("loss")), "loss")


def rollout_loss(model: GraphModel, frames: Frames, horizon: int, starts: Sequence[int] = (0,)) -> float:
    """Mean over starts and steps of the squared error of a free roll-out."""
    if not starts or max(starts) + horizon >= frames.num_timesteps or min(starts) < 0:
        raise ValueError("a start leaves too few steps")
    pred = model.predict(frames, horizon).where(F.col("origin").isin(list(starts))).withColumn("t", F.col("origin") + F.col("h"))
    truth = frames.snap.select("traj", "t", "node", F.col("f").alias("y"))
    d = V.sub("f", "y")
    both = pred.join(truth, ["traj", "t", "node"])
    if frames.mask is not None:
        both = both.join(frames.mask.where("observed").select("traj", "t", "node"), ["traj", "t", "node"], "left_semi")
    per = both.groupBy("traj", "origin", "h").agg(F.avg(V.mean(V.mul(d, d))).alias("e"))
    return _one(per.groupBy("traj", "origin").agg(F.avg("e").alias("e")).agg(F.avg("e").alias("loss")), "loss")


def worst_case(model: GraphModel, frames: Frames) -> float:
    """Mean over transitions of the worst node's error."""
    pred = model.predict(frames, 1).select("traj", (F.col("origin") + 1).alias("t"), "node", "f")
    err = metrics.node_errors(pred, frames.snap, ["traj", "t", "node"])
    return _one(metrics.worst_node(err, mask=frames.mask).agg(F.avg("worst").alias("loss")), "loss")


def pde_residual(model: GraphModel, frames: Frames, residual: Callable[[Column, Column], Column]) -> float:
    """Mean square of a residual of (field now, decoded field next)."""
    pred = model.predict(frames, 1).select("traj", F.col("origin").alias("t"), "node", F.col("f").alias("p"))
    r = frames.snap.join(pred, ["traj", "t", "node"]).select("traj", "t", "node", residual(F.col("f"), F.col("p")).alias("r"))
    if frames.mask is not None:
        r = r.join(frames.mask.where("observed").select("traj", "t", "node"), ["traj", "t", "node"], "left_semi")
    return _one(r.groupBy("traj", "t").agg(F.avg(V.mean(V.mul("r", "r"))).alias("e")).agg(F.avg("e").alias("loss")), "loss")


def lie_consistency(lift: Callable[[Column], Column], field: Callable[[Column], Column], generator: np.ndarray, frames: Frames, step: float = 1e-5) -> float:
    """|d lift(x) . field(x) - L lift(x)|^2 by central differences along the field;
    for uncontrolled continuous dynamics."""
    x = F.col("f")
    ahead, behind = V.add(x, V.scale(field(x), step)), V.sub(x, V.scale(field(x), step))
    d = V.sub(V.scale(V.sub(lift(ahead), lift(behind)), 1 / (2 * step)), V.matvec(generator, lift(x)))
    return _one(frames.snap.select(V.mean(V.mul(d, d)).alias("e")).agg(F.avg("e").alias("loss")), "loss")


def sparsity(operator, p: float = 1.0, eps: float = 1e-8) -> float:
    """Mean |k| of the operator's entries, or (k^2 + eps)^(p/2)."""
    m = np.concatenate([operator.own.matrix().ravel(), operator.neighbour.matrix().ravel()]) if isinstance(operator, GraphOperator) else operator.matrix().ravel()
    return float(np.abs(m).mean() if p == 1 else ((m**2 + eps) ** (p / 2)).mean())


def training_loss(model: GraphModel, frames: Frames, weights: LossWeights | None = None, horizon: int | None = None, starts: Sequence[int] = (0,), residual=None) -> dict[str, float]:
    """Terms with a weight, and their weighted total."""
    w = weights or LossWeights()
    make = {
        "reconstruction": lambda: reconstruction(model, frames),
        "forward": lambda: forward_consistency(model, frames),
        "backward": lambda: backward_consistency(model, frames),
        "rollout": lambda: rollout_loss(model, frames, horizon or 1, starts),
        "eigenvalue": lambda: eigenvalue_penalty(model.operator),
        "pde": lambda: pde_residual(model, frames, residual),
        "sparsity": lambda: sparsity(model.operator),
        "worst_case": lambda: worst_case(model, frames),
    }
    if "lie" in w.active():
        raise ValueError("the lie term needs the field: use lie_consistency")
    if "pde" in w.active() and residual is None:
        raise ValueError("the pde term needs a residual")
    terms = {k: make[k]() for k in w.active()}
    return {**terms, "total": w.total(terms)}


def mode_shapes(model: GraphModel, modes: Sequence[int] | None = None) -> np.ndarray:
    """Decoded eigenvectors (modes x channels, complex): what a linear decoder makes
    of each mode."""
    s = model.spectrum()
    at = list(range(len(s.values))) if modes is None else list(modes)
    return (model.decoder @ s.vectors[:, at]).T
