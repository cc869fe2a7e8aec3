"""Row-generating dynamics: each step is an edge join and an aggregation.

A rollout keeps one table for each step; its plan is cut by a reliable
checkpoint every CUT steps where a checkpoint folder is set.  Chaotic and
spectral systems advance inside one Arrow function for each trajectory.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis import schema
from nodalis.functions import vectors as V
from nodalis.operators.frames import Frames, kept
from nodalis.operators.topology import apply, grid_edges, knn_edges, normalized_laplacian, path_edges, ring_edges, with_self

CUT = 10


def _cut(df: DataFrame, k: int) -> DataFrame:
    return df.checkpoint() if k % CUT == CUT - 1 and df.sparkSession.sparkContext.getCheckpointDir() else df


def nodes(spark: SparkSession, n: int, channels: int, initial: str = "random", seed: int = 0) -> DataFrame:
    """(traj, t, node, f) at t = 0: standard normal or all ones."""
    if initial not in ("random", "ones"):
        raise ValueError(f"unknown initial state {initial!r}")
    f = [F.randn(seed + c) if initial == "random" else F.lit(1.0) for c in range(channels)]
    return spark.range(n).select(F.lit(0).alias("traj"), F.lit(0).alias("t"), F.col("id").cast("int").alias("node"), F.array(*f).alias("f"))


def step_entries(edges: DataFrame, rate: float, snap: DataFrame) -> DataFrame:
    """Entries of I - rate L; the row of an isolated node is the identity's."""
    if not 0 <= rate <= 1:
        raise ValueError("the diffusion rate must be in [0, 1]")
    eye = snap.select("traj", F.lit(None).cast("int").alias("t"), F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    lap = normalized_laplacian(edges).withColumn("w", -rate * F.col("w"))
    return eye.unionByName(lap.select(*eye.columns)).groupBy("traj", "t", "src", "dst").agg(F.sum("w").alias("w"))


def diffusion(snap: DataFrame, edges: DataFrame, steps: int, rate: float, decay: float, channels: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Steps 0 .. steps - 1 of x' = decay (I - rate L) x + noise."""
    if decay <= 0 or noise < 0 or steps < 1:
        raise ValueError("decay must be positive, noise not negative, and there must be a step")
    entries = kept(step_entries(edges, rate, snap))
    out, now = [snap], snap
    for k in range(1, steps):
        now = apply(entries, now.withColumn("t", F.lit(k)), channels, complete=True).withColumn("f", F.transform("f", lambda x: x * decay))
        if noise > 0:
            now = now.withColumn("f", V.add("f", F.array(*[noise * F.randn(seed * 1000 + k * channels + c) for c in range(channels)])))
        now = _cut(now, k)
        out.append(now)
    return reduce(DataFrame.unionByName, out)


def synthetic(spark: SparkSession, n: int = 20, steps: int = 50, channels: int = 3, topology: str = "path", rate: float = 0.5, decay: float = 0.95, noise: float = 0.0, initial: str = "random", seed: int = 0) -> Frames:
    e = {"path": path_edges, "ring": ring_edges}[topology](spark, n)
    return Frames(diffusion(nodes(spark, n, channels, initial, seed), e, steps, rate, decay, channels, noise, seed), e)


def grid(spark: SparkSession, rows: int = 10, cols: int = 10, steps: int = 40, channels: int = 3, rate: float = 0.1, decay: float = 0.99, noise: float = 0.01, initial: str = "random", seed: int = 0) -> Frames:
    e = grid_edges(spark, rows, cols)
    return Frames(diffusion(nodes(spark, rows * cols, channels, initial, seed), e, steps, rate, decay, channels, noise, seed), e)


def advection_step(snap: DataFrame, rows: int, cols: int, decay: float = 0.85, west: float = 0.7, north: float = 0.2) -> DataFrame:
    """x' = decay x + (1 - decay) mix of lattice neighbours: weights of the west
    and north ones, the rest shared by the others there are, divided by the sum."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    spark = snap.sparkSession
    e = grid_edges(spark, rows, cols).select("src", "dst")
    kind = F.when(F.col("dst") == F.col("src") - 1, "w").when(F.col("dst") == F.col("src") - cols, "n").otherwise("o") if cols > 1 else F.when(F.col("dst") == F.col("src") - cols, "n").otherwise("o")
    e = e.withColumn("kind", kind)
    others = F.sum(F.when(F.col("kind") == "o", 1).otherwise(0)).over(Window.partitionBy("src"))
    e = e.withColumn("w", F.when(F.col("kind") == "w", west).when(F.col("kind") == "n", north).otherwise((1 - west - north) / others))
    e = with_self(e.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), spark.range(rows * cols).select(F.col("id").cast("int").alias("node")), "w")
    both = snap.join(e, F.col("node") == F.col("_src"))
    # a node's neighbours weighted, entry by entry, and its own values
    part = both.select("traj", "t", F.col("_dst").alias("node"), "_self", F.posexplode(F.transform("f", lambda x: x * F.col("_w"))).alias("c", "x"))
    got = part.groupBy("traj", "t", "node", "c").agg(F.sum(F.when(~F.col("_self"), F.col("x"))).alias("m"), F.max(F.when(F.col("_self"), F.col("x"))).alias("x"))
    step = decay * F.col("x") + (1 - decay) * F.coalesce("m", "x")
    out = got.groupBy("traj", "t", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", step.alias("v")))), lambda s: s.v).alias("f"))
    return out.select("traj", (F.col("t") + 1).alias("t"), "node", "f")


def advection(spark: SparkSession, rows: int = 10, cols: int = 10, steps: int = 40, channels: int = 1, initial: str = "random", seed: int = 0, **how) -> Frames:
    now = nodes(spark, rows * cols, channels, initial, seed)
    out = [now]
    for k in range(1, steps):
        now = _cut(advection_step(now, rows, cols, **how), k)
        out.append(now)
    return Frames(reduce(DataFrame.unionByName, out), grid_edges(spark, rows, cols))


def epidemic(spark: SparkSession, start: DataFrame, edges: DataFrame, steps: int, beta: float, gamma: float, controls: list[float] | None = None) -> DataFrame:
    """S, I, R shares over steps: infection beta (1 - u) s (A i) with A's rows
    divided by their number of different neighbours, recovery gamma i."""
    e = edges.select("src", "dst").distinct()
    deg = e.groupBy("src").agg(F.count("*").alias("d"))
    e = e.join(deg, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.greatest("d", F.lit(1))).alias("w"))
    e = kept(with_self(e, start, "w"))
    out, now = [start], start
    for k in range(1, steps):
        u = controls[k - 1] if controls else 0.0
        own = F.max(F.when(F.col("_self"), F.col("f"))).alias("f")
        s = now.join(e, F.col("node") == F.col("_src")).groupBy("traj", F.col("_dst").alias("node")).agg(own, F.sum(F.when(~F.col("_self"), F.col("_w") * F.col("f")[1])).alias("p"))
        s = s.select("traj", "node", F.col("f")[0].alias("s"), F.col("f")[1].alias("i"), F.col("f")[2].alias("r"), F.coalesce("p", F.lit(0.0)).alias("p"))
        s = s.withColumn("new", beta * (1 - u) * F.col("s") * F.col("p")).withColumn("rec", gamma * F.col("i"))
        s = s.withColumn("i2", F.greatest(F.lit(0.0), F.col("i") + F.col("new") - F.col("rec"))).withColumn("r2", F.greatest(F.lit(0.0), F.col("r") + F.col("rec")))
        now = _cut(s.select("traj", F.lit(k).alias("t"), "node", F.array(F.greatest(F.lit(0.0), 1 - F.col("i2") - F.col("r2")), "i2", "r2").alias("f")), k)
        out.append(now)
    return reduce(DataFrame.unionByName, out)


def small_world(n: int, k: int = 4, chance: float = 0.1, seed: int = 0) -> list[tuple[int, int]]:
    """Both directions of a ring lattice of k neighbours with edges rewired."""
    r = np.random.default_rng(seed)
    pairs = {tuple(sorted((i, (i + j) % n))) for i in range(n) for j in range(1, k // 2 + 1)}
    for a, b in sorted(pairs):
        if r.random() < chance:
            free = [c for c in range(n) if c != a and tuple(sorted((a, c))) not in pairs]
            if free:
                pairs.discard((a, b))
                pairs.add(tuple(sorted((a, int(r.choice(free))))))
    return sorted(p for a, b in pairs for p in ((a, b), (b, a)))


def lorenz96_path(x: np.ndarray, steps: int, force: float = 8.0, dt: float = 0.05, burn: int = 200) -> np.ndarray:
    """Fourth-order Runge-Kutta of (x[i+1] - x[i-2]) x[i-1] - x[i] + force."""
    f = lambda v: (np.roll(v, -1) - np.roll(v, 2)) * np.roll(v, 1) - v + force
    out = []
    for k in range(burn + steps):
        if k >= burn:
            out.append(x)
        a = f(x)
        b = f(x + dt / 2 * a)
        c = f(x + dt / 2 * b)
        d = f(x + dt * c)
        x = x + dt / 6 * (a + 2 * b + 2 * c + d)
    return np.array(out)


def kuramoto_path(u: np.ndarray, steps: int, length: float = 22.0, dt: float = 0.25, burn: int = 100, contour: int = 32) -> np.ndarray:
    """Kuramoto-Sivashinsky by exponential time differencing (ETDRK4)."""
    n = len(u)
    k = 2 * np.pi / length * np.fft.rfftfreq(n, 1 / n)
    lin = k**2 - k**4
    r = np.exp(1j * np.pi * (np.arange(1, contour + 1) - 0.5) / contour)
    lr = dt * lin[:, None] + r
    q = dt * ((np.exp(lr / 2) - 1) / lr).real.mean(1)
    f1 = dt * ((-4 - lr + np.exp(lr) * (4 - 3 * lr + lr**2)) / lr**3).real.mean(1)
    f2 = dt * ((2 + lr + np.exp(lr) * (lr - 2)) / lr**3).real.mean(1)
    f3 = dt * ((-4 - 3 * lr - lr**2 + np.exp(lr) * (4 - lr)) / lr**3).real.mean(1)
    e, e2, g = np.exp(dt * lin), np.exp(dt * lin / 2), -0.5j * k
    v, out = np.fft.rfft(u), []
    non = lambda w: g * np.fft.rfft(np.fft.irfft(w, n) ** 2)
    for s in range(burn + steps):
        if s >= burn:
            out.append(np.fft.irfft(v, n))
        nv = non(v)
        a = e2 * v + q * nv
        na = non(a)
        b = e2 * v + q * na
        nb = non(b)
        c = e2 * a + q * (2 * nb - nv)
        v = e * v + nv * f1 + 2 * (na + nb) * f2 + non(c) * f3
    return np.array(out)


def kuramoto_start(n: int, length: float = 22.0, r: np.random.Generator | None = None) -> np.ndarray:
    """One wave with small noise, or with a small modulation where there is no
    generator."""
    x = length * np.arange(n) / n
    wave = np.cos(2 * np.pi * x / length)
    return wave * (1 + 0.1 * np.sin(x)) if r is None else wave + 0.01 * r.normal(size=n)


def trajectories(spark: SparkSession, seeds: list[int], n: int, steps: int, kind: str = "lorenz96", **how) -> DataFrame:
    """(traj, t, node, f) of chaotic systems, one Arrow call for each trajectory."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.random.default_rng(int(pdf.seed.iloc[0]))
        if kind == "lorenz96":
            x = np.full(n, how.get("force", 8.0))
            path = lorenz96_path(x + 0.01 * r.normal(size=n), steps, **how)
        else:
            path = kuramoto_path(kuramoto_start(n, how.get("length", 22.0), r), steps, **how)
        t, i = np.divmod(np.arange(path.size), n)
        return pd.DataFrame({"traj": int(pdf.traj.iloc[0]), "t": t, "node": i, "f": [[v] for v in path.ravel()]})

    return spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "traj int, seed long").groupBy("traj").applyInPandas(one, schema.SNAP)


# Fixed values of the wake: first amplitude; depth and width of the mean deficit;
# width, wave number and onset of the two modes.
WAKE_START = 0.05 + 0.02j
WAKE_DEPTH, WAKE_WIDTH = 0.35, 1.2
MODE_WIDTH, MODE_NUMBER, MODE_ONSET = 1.4, 0.9, 0.5


def wake_field(x: Column, y: Column, re: Column, im: Column) -> Column:
    """The mean wake and two modes by their amplitudes."""
    gate = lambda v: 1 / (1 + F.exp(-v))
    env = F.exp(-F.pow(y / MODE_WIDTH, 2)) * gate(x + MODE_ONSET)
    return -WAKE_DEPTH * F.exp(-F.pow(y / WAKE_WIDTH, 2)) * gate(x) + env * (re * F.sin(MODE_NUMBER * x) + im * F.cos(MODE_NUMBER * x))


def wake(spark: SparkSession, n: int = 72, steps: int = 120, dt: float = 0.15, omega: float = 0.8, mu: float = 0.15, seed: int = 0) -> Frames:
    """A field of a mean and two modes whose complex amplitude follows the
    Stuart-Landau equation, on a mesh of 6 nearest neighbours around a cylinder."""
    r = np.random.default_rng(seed)
    points = []
    while len(points) < n:
        x, y = r.uniform(-1.5, 8.5), r.uniform(-2.5, 2.5)
        if x * x + y * y > 0.25:
            points.append((len(points), [float(x), float(y)]))
    mesh = spark.createDataFrame(points, "node long, x array<double>")
    z, amps = WAKE_START, []
    for t in range(steps):
        amps.append((t, z.real, z.imag))
        z += dt * ((mu + 1j * omega) * z - abs(z) ** 2 * z)
    a = spark.createDataFrame(amps, "t int, re double, im double")
    field = wake_field(F.col("x")[0], F.col("x")[1], F.col("re"), F.col("im"))
    snap = mesh.crossJoin(F.broadcast(a)).select(F.lit(0).alias("traj"), "t", F.col("node").cast("int").alias("node"), F.array(field).alias("f"))
    e = knn_edges(mesh, 6).select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.lit(1.0).alias("w"))
    return Frames(snap, e)
