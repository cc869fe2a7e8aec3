"""The forecasting model: encode, advance linearly, decode.

Training is closed-form: the encoder is a set of observables or a graph network
with fixed weights, the operator and the decoder are ridge regressions from
distributed Gram matrices.  Everything learned is a few small matrices.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators import metrics
from nodalis.operators.estimation import RecursiveFit
from nodalis.operators.fit import gram, save_matrix
from nodalis.operators.frames import Frames
from nodalis.operators.latent import DISCRETE, ContinuousOperator, Control, DiscreteOperator, constrain, increments, rollout, rollout_at
from nodalis.operators.nets import GraphNet, encode
from nodalis.operators.spectrum import Spectrum
from nodalis.operators.topology import concatenated, observable, topk_pool, unpool
from nodalis.operators.training import History
from nodalis.operators.uncertainty import member_interval

FORMAT = 1


def ridge(rows: DataFrame, left: str, right: str, penalty: float) -> tuple[np.ndarray, float]:
    """(A, rows) of min |L A - R|^2 + penalty |A|^2."""
    xx, xy, n = gram(rows, left, right)
    return np.linalg.solve(xx + penalty * np.eye(len(xx)), xy), n


class GraphModel:
    """x -> [x | observables | network] -> K -> linear decoder."""

    def __init__(self, time_step: float = 1.0, observables: Sequence[str | Callable] = (), network: GraphNet | None = None, delays: int = 1, penalty: float = 1e-6, dynamics: str = "discrete", kind: str = "dense", bound: float = 1.0):
        if time_step <= 0 or delays < 1 or penalty < 0 or dynamics not in ("discrete", "continuous"):
            raise ValueError("time step, delays, penalty or dynamics out of range")
        self.time_step, self.observables, self.network, self.delays, self.penalty, self.dynamics = time_step, list(observables), network, delays, penalty, dynamics
        if kind not in DISCRETE:
            raise ValueError(f"no closed or constrained fit of {kind!r}")
        self.kind, self.bound = kind, bound
        self.operator: DiscreteOperator | None = None
        self.decoder: np.ndarray | None = None
        self.history = History()
        self.adapter: RecursiveFit | None = None

    # --- encode, decode ---------------------------------------------------

    def encode(self, frames: Frames) -> DataFrame:
        """(traj, t, node, f): latent features."""
        src = frames.windowed(self.delays) if self.delays > 1 else frames
        out = src.snap.select("traj", "t", "node", "f")
        for o in self.observables:
            out = concatenated(out, observable(o)(src))
        return concatenated(out, encode(self.network, src)) if self.network else out

    def decode(self, latent: DataFrame) -> DataFrame:
        return latent.withColumn("f", V.matvec(self._fitted().decoder, "f"))

    def _fitted(self) -> GraphModel:
        if self.operator is None:
            raise RuntimeError("fit the model first")
        return self

    # --- fit --------------------------------------------------------------

    def fit(self, frames: Frames) -> GraphModel:
        if frames.num_timesteps < 2:
            raise ValueError("two steps at least are needed")
        z = self.encode(frames)
        latent = frames.with_features(z)
        rows = latent.pairs()
        if frames.mask is not None:
            rows = rows.join(frames.pair_mask(), ["traj", "t", "node"]).where("observed")
        u = frames.control_dim
        if u:
            on = ["traj", "t"] if frames.ctrl.where("node is not null").limit(1).count() == 0 else ["traj", "t", "node"]
            rows = rows.join(frames.ctrl.select(*on, "u"), on).withColumn("x", F.concat("x", "u"))
        xx, xy, _ = gram(rows, "x", "y")
        xx = xx + self.penalty * np.eye(len(xx))
        a = np.linalg.solve(xx, xy)
        d = a.shape[1]
        control = Control(u, latent=d, b=a[d:] if u else None)
        make = ContinuousOperator if self.dynamics == "continuous" else DiscreteOperator
        self.operator = make(d, self.kind, self.bound, control=control)
        if self.kind != "dense":
            # with controls the states' metric is what the controls leave of it
            left = xx[:d, :d] - xx[:d, d:] @ np.linalg.solve(xx[d:, d:], xx[d:, :d]) if u else xx
            constrain(self.operator, a[:d].T, left, self.time_step if self.dynamics == "continuous" else None)
            step = self.operator.transition(self.time_step) if self.dynamics == "continuous" else self.operator.matrix()
            if u:
                control.b = np.linalg.solve(xx[d:, d:], xy[d:] - xx[d:, :d] @ step.T)
            a = np.r_[step.T, control.b] if u else step.T
        elif self.dynamics == "continuous":
            self.operator.set_discrete(a[:d].T, self.time_step)
        else:
            self.operator.set_dense(a[:d].T)
        both = z.join(frames.snap.select("traj", "t", "node", F.col("f").alias("y")), ["traj", "t", "node"])
        self.decoder = ridge(both, "f", "y", self.penalty)[0].T
        self.history.add({"forward": float(metrics.pair_loss(latent, lambda x: V.matvec(a[:d].T, x)).first().loss or 0.0)} if not u else {})
        return self

    # --- forecasts --------------------------------------------------------

    def predict(self, frames: Frames, steps: int, controls: list[list[float]] | None = None) -> DataFrame:
        """(traj, origin, h, node, f) from every step of ``frames``: encoded once,
        advanced in latent space, decoded at each step."""
        self._fitted()
        if isinstance(self.operator, ContinuousOperator):
            if controls is not None:
                raise ValueError("controls of a continuous model go through the operator's own step")
            return rollout_at(self.operator, self.encode(frames), [self.time_step * h for h in range(1, steps + 1)]).withColumn("f", V.matvec(self.decoder, "f"))
        return rollout(self.operator, self.encode(frames), steps, controls, self.decoder)

    def predict_at(self, frames: Frames, query_times: list[float] | None = None, deltas: list[float] | None = None) -> DataFrame:
        self._fitted()
        continuous = isinstance(self.operator, ContinuousOperator)
        dts = increments(query_times, deltas, None if continuous else self.time_step)
        if not continuous:
            return self.predict(frames, len(dts))
        return rollout_at(self.operator, self.encode(frames), np.cumsum(dts).tolist()).withColumn("f", V.matvec(self.decoder, "f"))

    def evaluate(self, frames: Frames, horizons: Sequence[int] = (3, 6, 12)) -> DataFrame:
        return metrics.evaluate(self.predict(frames, max(horizons)), frames, horizons)

    def spectrum(self, dt: float | None = None) -> Spectrum:
        op = self._fitted().operator
        return op.spectrum(dt) if isinstance(op, ContinuousOperator) else op.spectrum(self.time_step)

    # --- online adaptation --------------------------------------------------

    def enable_adaptation(self, forget: float = 0.99, regularization: float = 1000.0) -> None:
        op = self._fitted().operator
        self.adapter = RecursiveFit(op.dim, op.control.dim, forget, regularization)
        self.adapter.w[: op.dim] = op.matrix().T if not isinstance(op, ContinuousOperator) else op.transition(self.time_step).T
        if op.control.dim:
            self.adapter.w[op.dim :] = op.control.b

    def adapt(self, x: np.ndarray, y: np.ndarray, u: np.ndarray | None = None) -> float:
        """One transition of latent rows; returns how much the operator changed."""
        if self.adapter is None:
            raise RuntimeError("enable adaptation first")
        change = self.adapter.update(x, y, u)
        if isinstance(self.operator, ContinuousOperator):
            self.operator.set_discrete(self.adapter.matrix, self.time_step)
        else:
            self.operator.set_dense(self.adapter.matrix, self.adapter.control if self.operator.control.dim else None)
        return change

    def disable_adaptation(self) -> None:
        self.adapter = None

    # --- persistence --------------------------------------------------------

    def save(self, spark: SparkSession, folder: str) -> None:
        """Settings as one row of JSON, matrices as rows; any Spark path."""
        if any(callable(o) for o in self.observables):
            raise ValueError("observables of your own can't be saved; pass them to load")
        op = self._fitted().operator
        net = None if self.network is None else {"kind": self.network.kind, "activation": self.network.activation, "layers": [{k: v.tolist() for k, v in p.items()} for p in self.network.layers], "out": self.network.out, "channels": self.network.channels}
        meta = {"format": FORMAT, "time_step": self.time_step, "observables": self.observables, "delays": self.delays, "penalty": self.penalty, "dynamics": self.dynamics, "control": op.control.dim, "kind": op.kind, "bound": op.radius, "network": net}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
        m = save_matrix(spark, "decoder", self.decoder)
        for name, own in op.params.items():
            m = m.unionByName(save_matrix(spark, f"operator.{name}", own))
        if op.control.dim:
            m = m.unionByName(save_matrix(spark, "control", op.control.b))
        m.coalesce(1).write.mode("overwrite").parquet(f"{folder}/matrices")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, observables: Sequence[Callable] | None = None) -> GraphModel:
        meta = json.loads(spark.read.text(f"{folder}/metadata").first().value)
        if meta.get("format") != FORMAT:
            raise ValueError(f"unknown model format {meta.get('format')!r}")
        if missing := {"time_step", "observables", "delays", "penalty", "dynamics", "control", "kind", "bound", "network"} - set(meta):
            raise ValueError(f"the model lacks {sorted(missing)}")
        net = None
        if meta["network"]:
            n = meta["network"]
            net = GraphNet(n["kind"], n["channels"], 1, n["out"], 1, n["activation"])
            net.layers = [{k: np.array(v) for k, v in p.items()} for p in n["layers"]]
        self = cls(meta["time_step"], observables or meta["observables"], net, meta["delays"], meta["penalty"], meta["dynamics"], meta["kind"], meta["bound"])
        mats = {}
        for name, g in spark.read.parquet(f"{folder}/matrices").toPandas().groupby("name"):
            m = np.zeros((g.i.max() + 1, g.j.max() + 1))
            m[g.i, g.j] = g.v
            mats[name] = m
        d = mats["decoder"].shape[1]
        kind = ContinuousOperator if self.dynamics == "continuous" else DiscreteOperator
        self.operator = kind(d, meta["kind"], meta["bound"], control=Control(meta["control"], latent=d, b=mats.get("control")))
        # vectors were written as matrices of one row
        self.operator.params = {k: mats[f"operator.{k}"].reshape(np.shape(v)) for k, v in self.operator.params.items()}
        self.decoder = mats["decoder"]
        return self


class Ensemble:
    """Independent members, by seed; intervals are quantiles over them."""

    def __init__(self, members: Sequence[GraphModel]):
        if not members:
            raise ValueError("an ensemble has a member at least")
        self.members = list(members)

    @classmethod
    def of(cls, factory: Callable[[int], GraphModel], n: int, seeds: Sequence[int] | None = None) -> Ensemble:
        return cls([factory(s) for s in (seeds if seeds is not None else range(n))])

    def fit(self, frames: Frames) -> Ensemble:
        for m in self.members:
            m.fit(frames)
        return self

    def _all(self, frames: Frames, steps: int) -> DataFrame:
        parts = [m.predict(frames, steps).withColumn("member", F.lit(i)) for i, m in enumerate(self.members)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("member", "traj", "origin", "h", "node", F.posexplode("f").alias("c", "v"))

    def predict_interval(self, frames: Frames, steps: int, level: float = 0.9) -> DataFrame:
        return member_interval(self._all(frames, steps), ["traj", "origin", "h", "node", "c"], "v", level)

    def predict(self, frames: Frames, steps: int) -> DataFrame:
        g = self._all(frames, steps).groupBy("traj", "origin", "h", "node", "c").agg(F.avg("v").alias("v"))
        return g.groupBy("traj", "origin", "h", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s.v).alias("f"))

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(json.dumps({"format": FORMAT, "members": len(self.members)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        for i, m in enumerate(self.members):
            m.save(spark, f"{folder}/member-{i}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Ensemble:
        meta = json.loads(spark.read.text(f"{folder}/manifest").first().value)
        if meta.get("format") != FORMAT:
            raise ValueError("unknown ensemble format")
        return cls([GraphModel.load(spark, f"{folder}/member-{i}") for i in range(meta["members"])])


class Hierarchical:
    """Nodes pooled by score, an inner model on what is kept, and back."""

    def __init__(self, inner: GraphModel, score: Sequence[float], ratio: float = 0.5):
        self.inner, self.score, self.ratio = inner, list(score), ratio

    def pool(self, frames: Frames) -> tuple[Frames, DataFrame]:
        """(coarse frames, kept nodes); the choice of the sequence's first step holds."""
        start = frames.snap.groupBy("traj").agg(F.min("t").alias("t"))
        first = topk_pool(frames.snap.join(start, ["traj", "t"]), self.score, self.ratio).select("traj", "node", "new")
        snap = frames.snap.join(first, ["traj", "node"]).select("traj", "t", F.col("new").cast("int").alias("node"), "f")
        e = frames.edges
        for side in ("src", "dst"):
            e = e.join(first.select("traj", F.col("node").alias(side), F.col("new").alias(f"_{side}")), ["traj", side])
        e = e.select("traj", "t", F.col("_src").cast("int").alias("src"), F.col("_dst").cast("int").alias("dst"), "w")
        return Frames(snap, e, frames.ctrl, frames.times, None, frames.dynamic), first

    def fit(self, frames: Frames) -> Hierarchical:
        self.inner.fit(self.pool(frames)[0])
        return self

    def predict(self, frames: Frames, steps: int, resolution: str = "fine") -> DataFrame:
        coarse, perm = self.pool(frames)
        out = self.inner.predict(coarse, steps)
        if resolution == "coarse":
            return out
        c = frames.channels
        grid = frames.snap.select("traj", F.col("t").alias("origin"), "node").join(out.select("traj", "origin", "h").distinct(), ["traj", "origin"])
        fine = out.withColumnRenamed("node", "new").join(perm, ["traj", "new"]).select("traj", "origin", "h", "node", "f")
        return grid.join(fine, ["traj", "origin", "h", "node"], "left").select("traj", "origin", "h", "node", F.coalesce("f", V.zeros(c)).alias("f"))

    def spectrum(self) -> Spectrum:
        return self.inner.spectrum()


__all__ = ["Ensemble", "GraphModel", "Hierarchical", "ridge", "unpool"]
