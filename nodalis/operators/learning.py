"""Training of networks: encoders and decoders end to end with the operator, and
forecasters, by Adam on gradients of the networks' own forward passes.

An example is a whole graph over some steps, one row (traj, t, past, next): as
many numbers as its nodes have, so graphs are bounded as in ``nets.encode``.
Examples are dealt over tasks; a step adds up gradients by partition, then entry
by entry, and the driver moves parameters only.  Rows are read from a persisted
table, which a lost executor recomputes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodalis import schema
from nodalis.functions.tape import Node, gradients, leaves, rebuilt
from nodalis.operators.frames import Frames
from nodalis.operators.gradient import Adam
from nodalis.operators.nets import GraphNet, _edge_arrays
from nodalis.operators.training import EarlyStopping, History, LossWeights, monitor, weights_at

TERMS = ("reconstruction", "forward", "backward", "rollout", "sparsity", "worst_case")


def with_parameters(net, new):
    """A copy of a network whose arrays come from iterator ``new``."""
    own = object.__new__(type(net))
    own.__dict__ = rebuilt(net.__dict__, new)
    return own


def examples(frames: Frames, history: int, horizon: int) -> DataFrame:
    """(traj, t, x): nodes in order, each with its features of ``history`` steps up
    to t and ``horizon`` steps after, none of them missing or unobserved."""
    snap = frames.snap
    if frames.mask is not None:
        snap = snap.join(frames.mask, ["traj", "t", "node"], "left").withColumn("f", F.when(F.coalesce("observed", F.lit(True)), F.col("f")))
    w = Window.partitionBy("traj", "node").orderBy("t")
    steps = F.array(*[F.lag("f", -i).over(w) for i in range(1 - history, horizon + 1)])
    rows = snap.select("traj", "t", "node", steps.alias("x")).groupBy("traj", "t").agg(F.array_sort(F.collect_list(F.struct("node", "x"))).alias("r"))
    return rows.select("traj", "t", F.transform("r", lambda n: n.x).alias("x")).where(F.forall("x", lambda n: F.forall(n, lambda f: f.isNotNull())))


def _loss_terms(loss: Callable, params: list[np.ndarray], w: LossWeights, x: np.ndarray) -> tuple[list[np.ndarray], dict[str, float]]:
    nodes = [Node(p) for p in params]
    terms = loss(nodes, x)
    total = sum((terms[k] * getattr(w, k) for k in terms if getattr(w, k, 0)), Node(0.0))
    return gradients(total, nodes), {k: float(v.value) for k, v in terms.items()}


def summed(rows: DataFrame, loss: Callable, params: list[np.ndarray], w: LossWeights, shape: tuple[int, int]) -> tuple[list[np.ndarray], dict[str, float], int]:
    """Gradients and terms averaged over all examples, and their number.  ``shape``
    is (steps, channels) of an example."""
    own = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        total = None
        for b in batches:
            for cell in b.column(0):
                x = np.asarray(cell.values.flatten().flatten(), float).reshape(-1, *shape).swapaxes(0, 1)
                grads, terms = _loss_terms(loss, own.value, w, x)
                part = np.concatenate([*[g.ravel() for g in grads], [terms.get(t, 0.0) for t in TERMS], [1.0]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    got = rows.select("x").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_pandas().sort_values("i")
    if not len(got):
        raise ValueError("no examples to learn from")
    v = got.v.to_numpy()
    n, out, at = v[-1], [], 0
    for p in params:
        out.append(v[at : at + p.size].reshape(p.shape) / n)
        at += p.size
    return out, dict(zip(TERMS, v[at:-1] / n, strict=True)), int(n)


def fitted(rows: DataFrame, loss: Callable, params: list[np.ndarray], shape: tuple[int, int], epochs: int, lr: float, weights: LossWeights | None = None, schedule=None, batches: int = 1, seed: int = 0, max_norm: float | None = None, lr_schedule=None, validation: DataFrame | None = None, patience: int | None = None, least: float = 0.0, watch: str = "auto", history: History | None = None) -> list[np.ndarray]:
    """Parameters after ``epochs`` of Adam, the best ones seen."""
    if epochs < 1 or batches < 1:
        raise ValueError("epochs and batches must be positive")
    rows = rows.persist()
    name, adam, stopping, best = monitor(watch, validation is not None), Adam(lr), EarlyStopping(patience, least), params
    try:
        for epoch in range(epochs):
            w, seen, sums, before = weights_at(epoch, weights, schedule), 0, dict.fromkeys(TERMS, 0.0), params
            for b in range(batches):
                part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(F.lit(seed + epoch), "traj", "t"), F.lit(batches)) == b)
                try:
                    grads, terms, n = summed(part, loss, params, w, shape)
                except ValueError:
                    continue  # a batch that no example fell into
                size = float(np.sqrt(sum((g**2).sum() for g in grads)))
                clip = min(1.0, max_norm / size) if max_norm and size > 0 else 1.0
                params = adam.step(params, [clip * g for g in grads], lr_schedule(epoch) if lr_schedule else 1.0)
                seen += n
                sums = {t: sums[t] + n * terms[t] for t in TERMS}
            if not seen:
                raise ValueError("no examples to learn from")
            entry = {t: v / seen for t, v in sums.items()}
            entry["total"] = w.total(entry)
            if validation is not None:
                entry["validation"] = w.total(summed(validation, loss, params, w, shape)[1])
            if history is not None:
                history.add(entry)
            now = entry["validation"] if name == "validation" else entry["total"]
            if now < stopping.best:
                # the loss of one step an epoch is of the parameters before it
                best = params if name == "validation" or batches > 1 else before
            if stopping.stop(now):
                break
    finally:
        rows.unpersist()
    return best


def train_forecaster(net, frames: Frames, epochs: int = 50, lr: float = 1e-2, horizon: int = 1, validation: Frames | None = None, **how):
    """A trained copy of a forecaster (recurrent, temporal or dilated) and its
    history; the loss is the mean squared error of ``horizon`` steps, each fed
    with those before."""
    src, dst, w = _edge_arrays(frames)
    past, log = net.history, History()

    def loss(params, x):
        own, seen, total = with_parameters(net, iter(params)), list(x[:past]), Node(0.0)
        for h in range(horizon):
            y = own(np.stack(seen[-past:]), src, dst, w)
            d = y - x[past + h]
            total = total + (d * d).mean() * (1 / horizon)
            seen.append(y)
        return {"reconstruction": total}

    rows = examples(frames, past, horizon)
    val = None if validation is None else examples(validation, past, horizon)
    best = fitted(rows, loss, leaves(net.__dict__), (past + horizon, frames.channels), epochs, lr, LossWeights(), validation=val, history=log, **how)
    return with_parameters(net, iter(best)), log


class LearnedModel:
    """Encoder network, dense operator and decoder network, trained together.

    z = [x | encoder(x)] unless ``plain``, then encoder(x) alone; forecasts are
    decoder(z K'^h).  Either network may be any ``GraphNet`` or absent (identity
    and a linear map)."""

    def __init__(self, channels: int, encoder: GraphNet | None = None, decoder: GraphNet | None = None, plain: bool = False, seed: int = 0):
        if plain and encoder is None:
            raise ValueError("an encoder is needed")
        self.channels, self.encoder, self.plain = channels, encoder, plain
        self.dim = (0 if plain else channels) + (encoder.out if encoder else 0)
        if decoder is not None and (decoder.channels != self.dim or decoder.out != channels):
            raise ValueError("the decoder maps the latent state to the features")
        r = np.random.default_rng(seed)
        self.decoder = decoder
        self.linear = None if decoder else np.eye(self.dim, channels) + 0.01 * r.normal(size=(self.dim, channels))
        self.k = np.eye(self.dim) + 0.01 * r.normal(size=(self.dim, self.dim))
        self.log = History()

    def parts(self) -> dict:
        return {"encoder": self.encoder.layers if self.encoder else [], "decoder": self.decoder.layers if self.decoder else [self.linear], "k": self.k}

    def _put(self, parts: dict) -> LearnedModel:
        own = object.__new__(LearnedModel)
        own.__dict__ = dict(self.__dict__)
        if self.encoder:
            own.encoder = object.__new__(GraphNet)
            own.encoder.__dict__ = {**self.encoder.__dict__, "layers": parts["encoder"]}
        if self.decoder:
            own.decoder = object.__new__(GraphNet)
            own.decoder.__dict__ = {**self.decoder.__dict__, "layers": parts["decoder"]}
        else:
            own.linear = parts["decoder"][0]
        own.k = parts["k"]
        return own

    def encode(self, x, src, dst, w):
        if self.encoder is None:
            return x
        z = self.encoder(x, src, dst, w)
        return z if self.plain else np.concatenate([x, z], 1)

    def decode(self, z, src, dst, w):
        return self.decoder(z, src, dst, w) if self.decoder else z @ self.linear

    def losses(self, x, src, dst, w) -> dict:
        """Terms for steps x (steps x N x C)."""
        z = [self.encode(v, src, dst, w) for v in x]
        mean = lambda d: (d * d).mean()
        ahead, free = z[0] @ self.k.T, z[0]
        one = self.decode(ahead, src, dst, w) - x[1]
        roll = Node(0.0)
        for h in range(1, len(x)):
            free = free @ self.k.T
            roll = roll + mean(self.decode(free, src, dst, w) - x[h]) * (1 / (len(x) - 1))
        return {
            "reconstruction": mean(one),
            "forward": mean(ahead - z[1]),
            "backward": mean(z[1] @ np.linalg.inv(self.k).T - z[0]),
            "rollout": roll,
            "sparsity": np.absolute(self.k).mean(),
            "worst_case": (one * one).mean(1).max(),
        }

    def fit(self, frames: Frames, epochs: int = 100, lr: float = 1e-2, weights: LossWeights | None = None, horizon: int = 1, validation: Frames | None = None, **how) -> LearnedModel:
        src, dst, w = _edge_arrays(frames)
        parts, kind = self.parts(), self

        def loss(params, x):
            return kind._put(rebuilt(parts, iter(params))).losses(x, src, dst, w)

        rows = examples(frames, 1, horizon)
        val = None if validation is None else examples(validation, 1, horizon)
        best = fitted(rows, loss, leaves(parts), (1 + horizon, self.channels), epochs, lr, weights or LossWeights(), validation=val, history=self.log, **how)
        self.__dict__.update(self._put(rebuilt(parts, iter(best))).__dict__)
        return self

    def predict(self, frames: Frames, steps: int) -> DataFrame:
        """(traj, origin, h, node, f) from every step of ``frames``."""
        src, dst, w = _edge_arrays(frames)
        own = self

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            z, rows = own.encode(np.array(pdf.f.tolist(), float), src, dst, w), []
            for h in range(1, steps + 1):
                z = z @ own.k.T
                rows.append(pd.DataFrame({"traj": pdf.traj.to_numpy(), "origin": pdf.t.to_numpy(), "h": h, "node": pdf.node.to_numpy(), "f": list(own.decode(z, src, dst, w))}))
            return pd.concat(rows)

        return frames.snap.groupBy("traj", "t").applyInPandas(one, schema.FORECAST)
