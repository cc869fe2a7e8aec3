"""A temporal graph sequence as a bundle of DataFrames, and its projections.

Every method is a filter, window or aggregation on the bundle's tables, keyed by
(traj, t[, node]); nothing is collected but single totals.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis import schema
from nodalis.functions import vectors as V
from nodalis.functions.indexing import dense_index


def kept(df: DataFrame) -> DataFrame:
    """A table that several plans read, made once: checkpointed where a shared
    folder is configured, else persisted.  Meant for aggregates, which are small
    beside the tables that they come from."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return df.checkpoint()
    return df.persist()


@dataclass(frozen=True)
class Frames:
    """snap (traj, t, node, f); edges (traj, t, src, dst, w) with t null where the
    topology is static; optional ctrl, times and mask."""

    snap: DataFrame
    edges: DataFrame
    ctrl: DataFrame | None = None
    times: DataFrame | None = None
    mask: DataFrame | None = None
    dynamic: bool = False

    # --- metadata ---------------------------------------------------------

    @cached_property
    def _shape(self):
        return self.snap.agg(F.countDistinct("node").alias("n"), F.countDistinct("t").alias("t"), F.max(F.size("f")).alias("c"), F.min("t").alias("first"), F.max("t").alias("last")).first()

    @property
    def num_nodes(self) -> int:
        return self._shape.n

    @property
    def num_timesteps(self) -> int:
        return self._shape.t

    @property
    def channels(self) -> int:
        return self._shape.c or 0

    @cached_property
    def control_dim(self) -> int:
        return 0 if self.ctrl is None else self.ctrl.agg(F.max(F.size("u"))).first()[0] or 0

    @property
    def edge_index(self) -> DataFrame:
        if self.dynamic:
            raise ValueError("a dynamic sequence has no single edge list")
        return self.edges.select("src", "dst")

    @property
    def edge_weight(self) -> DataFrame:
        if self.dynamic:
            raise ValueError("a dynamic sequence has no single edge list")
        return self.edges.select("src", "dst", "w")

    # --- projections ------------------------------------------------------

    def _each(self, f) -> Frames:
        keep = lambda d: None if d is None else f(d)
        return replace(self, snap=f(self.snap), edges=self.edges if not self.dynamic else f(self.edges), ctrl=keep(self.ctrl), times=keep(self.times), mask=keep(self.mask))

    def slice(self, start: int, stop: int) -> Frames:
        """Steps start <= t < stop of every table."""
        if not 0 <= start < stop <= self.num_timesteps:
            raise ValueError(f"0 <= {start} < {stop} <= {self.num_timesteps} does not hold")
        return self._each(lambda d: d.where((F.col("t") >= start) & (F.col("t") < stop)))

    def split(self, train: float = 0.7, val: float = 0.1, test: float = 0.2, least: tuple[int, int, int] = (2, 2, 1)) -> Split:
        """Contiguous parts in time: ends truncate, then minima hold."""
        a, b = split_points(self.num_timesteps, train, val, test, least)
        return Split(self.slice(0, a), self.slice(a, b), self.slice(b, self.num_timesteps))

    def windowed(self, delays: int, stride: int = 1, pad: bool = True, zero_unobserved: bool = True) -> Frames:
        """Delay vectors, oldest to newest, at every ``stride``-th end step; steps
        before the first are zeros (or not ends at all without ``pad``)."""
        if delays < 1 or stride < 1:
            raise ValueError("delays and stride must be at least 1")
        src = self.zeroed() if zero_unobserved else self.snap
        w = Window.partitionBy("traj", "node").orderBy("t")
        lags = [F.coalesce(F.lag("f", k).over(w), V.zeros(self.channels)) for k in range(delays - 1, 0, -1)]
        first = 0 if pad else delays - 1
        ends = (F.col("t") >= first) & ((F.col("t") - first) % stride == 0)
        own = lambda d: None if d is None else d.where(ends).withColumn("t", ((F.col("t") - first) / stride).cast("int"))
        snap = src.withColumn("f", F.concat(*lags, F.col("f")) if lags else F.col("f"))
        return replace(self, snap=own(snap), edges=own(self.edges) if self.dynamic else self.edges, ctrl=own(self.ctrl), times=own(self.times), mask=own(self.mask))

    def zeroed(self) -> DataFrame:
        """Features with unobserved nodes' set to 0."""
        if self.mask is None:
            return self.snap
        seen = self.snap.join(self.mask, ["traj", "t", "node"], "left")
        return seen.select("traj", "t", "node", F.when(F.coalesce("observed", F.lit(True)), F.col("f")).otherwise(F.transform("f", lambda x: F.lit(0.0))).alias("f"))

    def with_features(self, snap: DataFrame) -> Frames:
        return replace(self, snap=snap)

    # --- time and controls ------------------------------------------------

    def delta_t(self, default: float | None = None) -> DataFrame:
        """(traj, t, dt) of each transition t -> t + 1."""
        if self.times is None:
            if default is None:
                raise ValueError("the sequence has no timestamps")
            return self.snap.select("traj", "t").distinct().where(F.col("t") < self._shape.last).withColumn("dt", F.lit(float(default)))
        w = Window.partitionBy("traj").orderBy("t")
        return self.times.withColumn("dt", F.lead("ts").over(w) - F.col("ts")).where("dt is not null").select("traj", "t", "dt")

    def pair_mask(self) -> DataFrame:
        """(traj, t, node, observed): seen at both ends of t -> t + 1."""
        w = Window.partitionBy("traj", "node").orderBy("t")
        return self.mask.withColumn("next", F.lead("observed").over(w)).where("next is not null").select("traj", "t", "node", (F.col("observed") & F.col("next")).alias("observed"))

    def controls(self, start: int, steps: int) -> DataFrame | None:
        if self.ctrl is None:
            return None
        if start < 0 or start + steps > self.num_timesteps:
            raise ValueError("controls reach beyond the sequence")
        return self.ctrl.where((F.col("t") >= start) & (F.col("t") < start + steps))

    def pairs(self) -> DataFrame:
        """(traj, t, node, x, y): features at t and t + 1, by one window."""
        w = Window.partitionBy("traj", "node").orderBy("t")
        return self.snap.select("traj", "t", "node", F.col("f").alias("x"), F.lead("f").over(w).alias("y"), F.lead("t").over(w).alias("_n")).where(F.col("_n") == F.col("t") + 1).drop("_n")

    def wide(self) -> DataFrame:
        """(traj, t, x): all nodes' features of a step, by node then channel."""
        return self.snap.groupBy("traj", "t").agg(F.array_sort(F.collect_list(F.struct("node", "f"))).alias("_r")).select("traj", "t", F.flatten(F.transform("_r", lambda r: r.f)).alias("x"))

    # --- checks -----------------------------------------------------------

    def validate(self) -> Frames:
        """Raises ValueError on the first rule that is broken: constant nodes and
        channels, strictly increasing times, an observed node at every step."""
        per = self.snap.groupBy("traj", "t").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d"), F.min(F.size("f")).alias("a"), F.max(F.size("f")).alias("b"))
        s = per.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("d").alias("d0"), F.min("a").alias("a"), F.max("b").alias("b")).first()
        if s.n0 is None:
            raise ValueError("the sequence is empty")
        if s.n0 != s.n1 or s.d0 != s.n0 or s.a != s.b:
            raise ValueError("nodes and channels must be the same at every step")
        if self.times is not None and self.delta_t().where("dt <= 0").limit(1).count():
            raise ValueError("timestamps must increase strictly")
        if self.mask is not None and self.mask.groupBy("traj", "t").agg(F.max(F.col("observed").cast("int")).alias("o")).where("o = 0").limit(1).count():
            raise ValueError("every step needs an observed node")
        return self

    def is_dynamic(self) -> bool:
        """Whether the flag is set and any step's edges differ from another's
        (weights and order do not count)."""
        if not self.dynamic:
            return False
        return topology_versions(self.edges).select("edges").distinct().limit(2).count() > 1


class Split(NamedTuple):
    train: Frames
    val: Frames
    test: Frames


def split_points(steps: int, train: float, val: float, test: float, least: tuple[int, int, int] = (2, 2, 1)) -> tuple[int, int]:
    if min(train, val, test) < 0 or abs(train + val + test - 1) > 1e-6:
        raise ValueError("the ratios must be non-negative and add up to 1")
    if sum(least) > steps:
        raise ValueError("too few steps for the parts' minima")
    # shares truncate one by one, then minima push the ends; the last part's comes first
    first = int(steps * train)
    second = first + int(steps * val)
    first = max(first, least[0])
    second = min(max(second, first + least[1]), steps - least[2])
    if second - first < least[1]:
        raise ValueError("too few steps for the validation part")
    return first, second


def topology_versions(edges: DataFrame) -> DataFrame:
    """(traj, t, edges): a hash of each step's set of edges, order left out."""
    return edges.groupBy("traj", "t").agg(F.hash(F.array_sort(F.collect_list(F.struct("src", "dst")))).alias("edges"))


def from_arrays(spark: SparkSession, features, edges, weights=None, controls=None, times=None, masks=None, traj: int = 0) -> Frames:
    """Frames of nested lists: features (T x N x C), edges ((src, dst) pairs, or a
    list of such lists for each step), and the optional others."""
    if not len(features):
        raise ValueError("at least one step is needed")
    snap = [(traj, t, n, [float(v) for v in f]) for t, step in enumerate(features) for n, f in enumerate(step)]
    dynamic = bool(len(edges)) and not isinstance(edges[0][0], int) if len(edges) and len(edges[0]) else False
    if dynamic and len(edges) != len(features):
        raise ValueError("one edge list for each step is needed")
    per = [(t, e, None if weights is None else weights[t]) for t, e in enumerate(edges)] if dynamic else [(None, edges, weights)]
    rows = []
    for t, e, w in per:
        if w is not None and len(w) != len(e):
            raise ValueError("one weight for each edge is needed")
        rows += [(traj, t, int(a), int(b), 1.0 if w is None else float(w[k])) for k, (a, b) in enumerate(e)]
    opt = lambda data, ddl: None if data is None else spark.createDataFrame(data, ddl)
    ctrl = None
    if controls is not None:
        ctrl = [(traj, t, None, [float(v) for v in u]) if not hasattr(u[0], "__len__") else None for t, u in enumerate(controls)]
        if None in ctrl:
            ctrl = [(traj, t, n, [float(v) for v in x]) for t, u in enumerate(controls) for n, x in enumerate(u)]
    return Frames(
        spark.createDataFrame(snap, schema.SNAP),
        spark.createDataFrame(rows, schema.EDGES),
        opt(ctrl, schema.CTRL),
        opt(None if times is None else [(traj, t, float(x)) for t, x in enumerate(times)], schema.TIMES),
        opt(None if masks is None else [(traj, t, n, bool(o)) for t, m in enumerate(masks) for n, o in enumerate(m)], schema.MASK),
        dynamic,
    ).validate()


def multi(frames: Iterable[Frames]) -> Frames:
    """Several sequences as trajectories 0, 1, .. of one bundle."""
    some = list(frames)
    if not some:
        raise ValueError("at least one trajectory is needed")

    def joined(name: str):
        parts = [getattr(f, name) for f in some]
        if any(p is None for p in parts):
            return None
        return reduce(DataFrame.unionByName, [p.withColumn("traj", F.lit(i)) for i, p in enumerate(parts)])

    return Frames(*(joined(n) for n in ("snap", "edges", "ctrl", "times", "mask")), any(f.dynamic for f in some))


def windows(frames: Frames, length: int, seed: int | None = None, epoch: int = 0, limit: int | None = None, batch: int = 8) -> DataFrame:
    """(traj, start, rank, batch): all windows of ``length`` steps, shuffled by a
    hash of seed + epoch where a seed is given, cut to ``limit`` if one is."""
    if length < 2:
        raise ValueError("a window has two steps at least")
    per = frames.snap.groupBy("traj").agg(F.max("t").alias("last"))
    all_ = per.where(F.col("last") + 1 >= length).select("traj", F.explode(F.sequence(F.lit(0), F.col("last") + 1 - length)).alias("start"))
    order = F.xxhash64(F.lit(seed + epoch), "traj", "start") if seed is not None else F.col("traj")
    ranked = dense_index(all_, order, ("traj", "start"), "rank")
    ranked = ranked if limit is None else ranked.where(F.col("rank") < limit)
    return ranked.withColumn("batch", F.floor(F.col("rank") / batch).cast("int"))


def rollout_origins(steps: int, horizon: int, starts: str | Sequence[int] | None = None, per_epoch: int | None = None, seed: int = 0, epoch: int = 0) -> list[int]:
    """Starts from which ``horizon`` steps lie within the sequence: all of them,
    a checked list, 0 alone, or draws with replacement."""
    valid = steps - horizon
    if valid < 1:
        raise ValueError("the horizon is longer than the sequence")
    if per_epoch is not None:
        import random

        r = random.Random(seed + epoch)
        return [r.randrange(valid) for _ in range(per_epoch)]
    if starts == "all":
        return list(range(valid))
    if starts is None:
        return [0]
    if any(not 0 <= s < valid for s in starts):
        raise ValueError("a start leaves too few steps")
    return list(starts)


def hold_last(edges: DataFrame, steps: int) -> DataFrame:
    """Edges for steps 0 .. steps - 1, each step without edges of its own having
    the last earlier ones (an as-of join on t)."""
    own = edges.select("traj", "t").distinct()
    grid = own.select("traj").distinct().select("traj", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    w = Window.partitionBy("traj").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = grid.join(own.withColumnRenamed("t", "step").withColumn("has", F.col("step")), ["traj", "step"], "left").withColumn("from", F.last("has", ignorenulls=True).over(w))
    return at.join(edges.withColumnRenamed("t", "from"), ["traj", "from"]).select("traj", F.col("step").alias("t"), "src", "dst", "w")


