"""Named sequences with their usual sizes; all deterministic for a seed."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators.frames import Frames
from nodalis.operators.topology import apply, ring_edges
from nodalis.sources import matpower, simulators


def power_grid(spark: SparkSession, case: matpower.Case, steps: int = 80, rate: float = 0.35, decay: float = 0.98, swing: float = 0.1, period: int = 24, noise: float = 0.0, seed: int = 0, ramp: bool = False) -> Frames:
    """Buses with voltages that diffuse and loads that swing about their base; an
    optional ramp from 1 as control."""
    e = matpower.edges(case).select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), "src", "dst", F.lit(1.0).alias("w"))
    start = matpower.features(case).select(F.lit(0).alias("traj"), F.lit(0).alias("t"), F.col("node").cast("int").alias("node"), "f")
    base = start.select("traj", "node", F.slice("f", 3, 2).alias("b"))
    entries = simulators.step_entries(e, rate, start)
    volts = start.withColumn("f", F.slice("f", 1, 2))
    out = [start]
    for k in range(1, steps):
        volts = simulators._cut(apply(entries, volts.withColumn("t", F.lit(k)), 2, complete=True).withColumn("f", V.scale("f", decay)), k)
        load = 1 + swing * math.sin(2 * math.pi * (k + 1) / period)
        now = volts.join(base, ["traj", "node"]).select("traj", "t", "node", F.concat("f", V.scale("b", load)).alias("f"))
        if noise > 0:
            now = now.withColumn("f", V.add("f", F.array(*[noise * F.randn(seed * 1000 + 4 * k + c) for c in range(4)])))
        out.append(now)
    ctrl = None
    if ramp:
        ctrl = spark.range(steps).select(F.lit(0).alias("traj"), F.col("id").cast("int").alias("t"), F.lit(None).cast("int").alias("node"), F.array((1 - F.col("id") / max(1, steps - 1))).alias("u"))
    return Frames(reduce(DataFrame.unionByName, out), e, ctrl)


def epidemic_network(spark: SparkSession, nodes: int = 24, steps: int = 45, beta: float = 0.5, gamma: float = 0.1, topology: str = "ring", controls: list[float] | None = None, seed: int = 0) -> Frames:
    """Shares of susceptible, infected and recovered; two first patients."""
    if topology == "ring":
        e = ring_edges(spark, nodes)
    else:
        e = spark.createDataFrame([(0, None, a, b, 1.0) for a, b in simulators.small_world(nodes, seed=seed)], "traj int, t int, src int, dst int, w double")
    i = F.when(F.col("id") == 0, 0.08).when(F.col("id") == 1, 0.03).otherwise(0.0)
    start = spark.range(nodes).select(F.lit(0).alias("traj"), F.lit(0).alias("t"), F.col("id").cast("int").alias("node"), F.array(1 - i, i, F.lit(0.0)).alias("f"))
    snap = simulators.epidemic(spark, start, e, steps, beta, gamma, controls)
    ctrl = None
    if controls:
        ctrl = spark.createDataFrame([(0, t, None, [float(u)]) for t, u in enumerate(controls)], "traj int, t int, node int, u array<double>")
    return Frames(snap, e, ctrl)


def chaotic_ring(spark: SparkSession, nodes: int = 40, steps: int = 400, seeds: tuple[int, ...] = (0,), force: float = 8.0) -> Frames:
    return Frames(simulators.trajectories(spark, list(seeds), nodes, steps, "lorenz96", force=force), _rings(spark, nodes, len(seeds)))


def flame_front(spark: SparkSession, nodes: int = 64, steps: int = 300, seeds: tuple[int, ...] = (0,), length: float = 22.0) -> Frames:
    return Frames(simulators.trajectories(spark, list(seeds), nodes, steps, "kuramoto", length=length), _rings(spark, nodes, len(seeds)))


def _rings(spark: SparkSession, nodes: int, n: int) -> DataFrame:
    return ring_edges(spark, nodes).drop("traj").crossJoin(spark.range(n).select(F.col("id").cast("int").alias("traj"))).select("traj", "t", "src", "dst", "w")  # a ring for each of a few seeds
