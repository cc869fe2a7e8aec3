"""Graph operators: edge joins and aggregations.

Conventions: a matrix-vector product aggregates x[dst] into src; degrees sum
weights by src; imputation averages x[src] into dst.  Parallel edges add up.
Nodes come from the snapshot side, so isolated ones keep a row.  Every function
takes and returns DataFrames keyed by (traj, t, ...); edges with a null t hold at
every step and are joined without it, so a static graph is one small side that
adaptive execution may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.functions.indexing import dense_index
from nodalis.operators.frames import Frames, kept


def _step(frames: Frames) -> list[str]:
    return ["traj", "t"] if frames.dynamic else ["traj"]


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(traj, t, node, deg): weighted out-degree; 0 for ``nodes`` without edges."""
    deg = edges.groupBy("traj", "t", F.col("src").alias("node")).agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("deg"))
    if nodes is None:
        return deg
    a, b = nodes.alias("a"), deg.alias("b")
    return a.join(b, (F.col("a.traj") == F.col("b.traj")) & F.col("a.t").eqNullSafe(F.col("b.t")) & (F.col("a.node") == F.col("b.node")), "left").select("a.traj", "a.t", "a.node", F.coalesce("b.deg", F.lit(0.0)).alias("deg"))


def support(edges: DataFrame) -> DataFrame:
    """(traj, t, node): nodes of positive degree."""
    return degrees(edges).where("deg > 0").select("traj", "t", "node")


def normalized_adjacency(edges: DataFrame, accumulate: bool = True) -> DataFrame:
    """(traj, t, src, dst, w): w / sqrt(deg src * deg dst); 0 where a degree is
    not positive.  Parallel edges become one entry unless ``accumulate`` is off."""
    by = ["traj", "t"]
    deg = degrees(edges).select(*by, "node", F.when(F.col("deg") > 0, F.pow("deg", F.lit(-0.5))).otherwise(0.0).alias("r"))
    e = edges.alias("e")
    for side in ("src", "dst"):
        d = deg.select(F.col("traj").alias(f"{side}_traj"), F.col("t").alias(f"{side}_t"), F.col("node").alias(f"{side}_node"), F.col("r").alias(f"{side}_r"))
        e = e.join(d, (F.col("traj") == F.col(f"{side}_traj")) & F.col("t").eqNullSafe(F.col(f"{side}_t")) & (F.col(side) == F.col(f"{side}_node")), "left").drop(f"{side}_traj", f"{side}_t", f"{side}_node")
    out = e.select(*by, "src", "dst", (F.coalesce("w", F.lit(1.0)) * F.coalesce("src_r", F.lit(0.0)) * F.coalesce("dst_r", F.lit(0.0))).alias("w"))
    return out.groupBy(*by, "src", "dst").agg(F.sum("w").alias("w")) if accumulate else out


def normalized_laplacian(edges: DataFrame) -> DataFrame:
    """Entries of P - A_hat; P is 1 on nodes of positive degree."""
    diagonal = support(edges).select("traj", "t", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    return diagonal.unionByName(normalized_adjacency(edges).withColumn("w", -F.col("w"))).groupBy("traj", "t", "src", "dst").agg(F.sum("w").alias("w"))


def random_walk(edges: DataFrame) -> DataFrame:
    """Entries divided by their row's sum (1e-6 at least)."""
    e = edges.groupBy("traj", "t", "src", "dst").agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("w"))
    w = Window.partitionBy("traj", "t", "src")
    return e.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(w), F.lit(1e-6)))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two sparse entry tables of the same trajectories and steps."""
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, (F.col("x.traj") == F.col("y.traj")) & F.col("x.t").eqNullSafe(F.col("y.t")) & (F.col("x.dst") == F.col("y.src")))
    return j.groupBy("x.traj", "x.t", "x.src", "y.dst").agg(F.sum(F.col("x.w") * F.col("y.w")).alias("w")).select("traj", "t", "src", "dst", "w")


def diffusion_supports(edges: DataFrame, nodes: DataFrame, steps: int, interleaved: bool = False) -> DataFrame:
    """(support, traj, t, src, dst, w): the identity, then powers of the forward
    and of the backward random walk, block by block or interleaved."""
    if steps < 1:
        raise ValueError("diffusion needs a step at least")
    flip = edges.select("traj", "t", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    eye = nodes.select("traj", "t", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    out = eye.withColumn("support", F.lit(0))
    for back, e in enumerate((edges, flip)):
        base = random_walk(e)
        power = base
        for k in range(1, steps + 1):
            number = 2 * k - 1 + back if interleaved else k + back * steps
            out = out.unionByName(power.withColumn("support", F.lit(number)))
            power = matmul(power, base)
    return out.select("support", "traj", "t", "src", "dst", "w")


def apply(entries: DataFrame, snap: DataFrame, channels: int, dynamic: bool = False, complete: bool = False) -> DataFrame:
    """(traj, t, node, f): entries times features, zero rows where a node has no
    entry.  One equi-join on the node and one aggregation with partial sums.  With
    ``complete`` every node has an entry (a diagonal, say), and the plan reads
    ``snap`` once, so that steps in a row make a plan of linear size."""
    e = entries.select(F.col("traj").alias("_traj"), F.col("t").alias("_t"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("w").alias("_w"))
    on = (F.col("traj") == F.col("_traj")) & (F.col("node") == F.col("_dst"))
    if dynamic:
        on &= F.col("t") == F.col("_t")
    sums = [F.sum(F.col("_w") * F.col("f")[c]).alias(f"_{c}") for c in range(channels)]
    got = snap.join(e, on).groupBy("traj", "t", F.col("_src").alias("node")).agg(*sums).select("traj", "t", "node", F.array(*[f"_{c}" for c in range(channels)]).alias("_f"))
    if complete:
        return got.withColumnRenamed("_f", "f")
    return snap.select("traj", "t", "node").join(got, ["traj", "t", "node"], "left").select("traj", "t", "node", F.coalesce("_f", V.zeros(channels)).alias("f"))


def with_self(edges: DataFrame, nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(_src, _dst, _w, _self), and _traj if both sides tell trajectories: edges and
    a marked loop at every node, so that one join and one aggregation bring a node
    its neighbours' values and its own."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = ["traj"] if "traj" in edges.columns and "traj" in nodes.columns else []
    keep = [F.col(c).alias(f"_{c}") for c in by]
    e = edges.select(*keep, F.col("src").alias("_src"), F.col("dst").alias("_dst"), w.alias("_w"), F.lit(False).alias("_self"))
    own = nodes.select(*by, "node").distinct()
    return e.unionByName(own.select(*keep, F.col("node").alias("_src"), F.col("node").alias("_dst"), F.lit(1.0).alias("_w"), F.lit(True).alias("_self")))


def adjacency_matvec(frames: Frames) -> DataFrame:
    return apply(normalized_adjacency(frames.edges), frames.snap, frames.channels, frames.dynamic)


def laplacian(frames: Frames, snap: DataFrame | None = None) -> DataFrame:
    """L x for every step: isolated nodes give 0."""
    return apply(normalized_laplacian(frames.edges), frames.snap if snap is None else snap, frames.channels, frames.dynamic)


def curvature(frames: Frames) -> DataFrame:
    """L (L x)."""
    return laplacian(frames, laplacian(frames))


def gradient(frames: Frames) -> DataFrame:
    """sqrt(max(0, sum over edges of w_hat (x_dst - x_src)^2)) by channel."""
    e = normalized_adjacency(frames.edges).select(F.col("traj").alias("_traj"), F.col("t").alias("_t"), "src", "dst", F.col("w").alias("_w"))
    a = frames.snap
    on = (F.col("traj") == F.col("_traj")) & (F.col("node") == F.col("src"))
    if frames.dynamic:
        on &= F.col("t") == F.col("_t")
    far = a.select(F.col("traj").alias("traj2"), F.col("t").alias("t2"), F.col("node").alias("node2"), F.col("f").alias("g"))
    both = a.join(e, on).join(far, (F.col("traj") == F.col("traj2")) & (F.col("t") == F.col("t2")) & (F.col("dst") == F.col("node2")))
    n = frames.channels
    sums = [F.sum(F.col("_w") * F.pow(F.col("g")[c] - F.col("f")[c], F.lit(2.0))).alias(f"_{c}") for c in range(n)]
    got = both.groupBy("traj", "t", "node").agg(*sums).select("traj", "t", "node", F.array(*[F.sqrt(F.greatest(F.lit(0.0), F.col(f"_{c}"))) for c in range(n)]).alias("_f"))
    return a.select("traj", "t", "node").join(got, ["traj", "t", "node"], "left").select("traj", "t", "node", F.coalesce("_f", V.zeros(n)).alias("f"))


def polynomial(frames: Frames, degree: int) -> DataFrame:
    return frames.snap.withColumn("f", V.polynomial("f", degree))


OBSERVABLES = {"laplacian": laplacian, "gradient": gradient, "curvature": curvature}


def observable(name):
    """A lifting function by preset name, ``polynomial(k)``, or one of your own."""
    import re

    if callable(name):
        return name
    if name in OBSERVABLES:
        return OBSERVABLES[name]
    if m := re.fullmatch(r"polynomial\((\d+)\)", name):
        return lambda frames: polynomial(frames, int(m[1]))
    raise ValueError(f"unknown observable {name!r}")


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """Features of both, those of ``first`` before."""
    return first.join(second.withColumnRenamed("f", "_g"), ["traj", "t", "node"]).select("traj", "t", "node", F.concat("f", "_g").alias("f"))


# --- topology from data -------------------------------------------------------


def path_edges(spark: SparkSession, n: int) -> DataFrame:
    """Both directions of 0 - 1 - .. - n-1."""
    i = spark.range(max(0, n - 1)).select(F.col("id").cast("int").alias("a"), (F.col("id") + 1).cast("int").alias("b"))
    return _both(i)


def ring_edges(spark: SparkSession, n: int) -> DataFrame:
    """Both directions of a ring; of two nodes each edge is there twice."""
    i = spark.range(n if n > 1 else 0).select(F.col("id").cast("int").alias("a"), ((F.col("id") + 1) % n).cast("int").alias("b"))
    return _both(i)


def grid_edges(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Both directions of a 4-connected lattice with row-major numbers."""
    i = spark.range(rows * cols).select(F.col("id").cast("int").alias("a"))
    right = i.where(F.col("a") % cols < cols - 1).withColumn("b", F.col("a") + 1)
    down = i.where(F.col("a") < (rows - 1) * cols).withColumn("b", F.col("a") + cols)
    return _both(right.unionByName(down))


def _both(e: DataFrame) -> DataFrame:
    one = e.select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    return one.unionByName(one.select("traj", "t", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def gaussian_adjacency(distances: DataFrame, sensors: DataFrame, least: float = 0.1) -> DataFrame:
    """(src, dst, w) from (from, to, cost) rows between known sensors (id, node):
    w = exp(-(cost / std)^2) with the population's std, under ``least`` left out.
    Of repeated pairs the last in order of ``pos`` (or the largest cost) holds."""
    d = distances
    for a, b in (("from", "src"), ("to", "dst")):
        s = sensors.select(F.col("id").alias(f"_{a}"), F.col("node").alias(b))
        d = d.join(s, F.col(a) == F.col(f"_{a}"))
    last = F.max_by("cost", "pos") if "pos" in distances.columns else F.max("cost")
    std = d.agg(F.stddev_pop("cost").alias("std"))
    one = d.groupBy("src", "dst").agg(last.alias("cost")).crossJoin(F.broadcast(std))  # one row
    return one.select("src", "dst", F.exp(-F.pow(F.col("cost") / F.col("std"), F.lit(2.0))).alias("w")).where(F.col("w") >= least)


def symmetric_support(edges: DataFrame) -> DataFrame:
    """Edges of positive weight, and the reverse of those that lack it with the
    same weight."""
    e = edges.where("w > 0")
    back = e.select(*[c for c in e.columns if c not in ("src", "dst")], F.col("dst").alias("src"), F.col("src").alias("dst")).select(*e.columns)
    return e.unionByName(back.join(e, [c for c in e.columns if c not in ("w", "t")], "left_anti").select(*e.columns))


def knn_edges(points: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(src, dst): each point's k nearest others by Euclidean distance, ties to the
    smaller number, made symmetric.  ``points`` is (node, x array<double>).

    Points fall into blocks by hash; every pair of blocks is a bounded group that
    keeps its k best for each point, so no table of all pairs is made.  The search
    is exact and its work grows with the square of the points: it is meant for
    meshes and sensor sets of up to some hundred thousand points."""
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-points.count() // block))
    src = points.select(F.col("node").cast("long").alias("node"), "x", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("b"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = src.select("node", "x", F.col("b").alias("q"), each.alias("p")).withColumn("side", F.lit(0))
    p = src.select("node", "x", F.col("b").alias("p"), each.alias("q")).withColumn("side", F.lit(1)).select(*q.columns)

    def best(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        x = np.array(t.column("x").to_pylist(), float)
        ids = t.column("node").to_numpy()
        a, b, i, j = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
        order = np.argsort(j, kind="stable")  # ties go to the smaller number
        b, j = b[order], j[order]
        out = ([], [], [])
        for r in range(len(a)):
            d = ((b - a[r]) ** 2).sum(1)
            d[j == i[r]] = np.inf
            take = np.arange(len(d))
            if len(d) > k:
                take = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            take = take[np.isfinite(d[take])]
            take = take[np.argsort(d[take], kind="stable")[:k]]
            out[0].append(np.full(len(take), i[r]))
            out[1].append(j[take])
            out[2].append(d[take])
        cat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(float))], names=["src", "dst", "d"])

    near = q.unionByName(p).groupBy("q", "p").applyInArrow(best, "src long, dst long, d double")
    w = Window.partitionBy("src").orderBy("d", "dst")
    e = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, numbering) of the subgraph on ``nodes`` (node), numbered anew in
    order: two semi-join like equi-joins."""
    new = dense_index(nodes.select("node").distinct(), "node", name="new")
    e = edges
    for side in ("src", "dst"):
        e = e.join(new.select(F.col("node").alias(side), F.col("new").alias(f"_{side}")), side)
    return e.select(*[F.col(f"_{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]), new


# --- imputation and pooling ---------------------------------------------------


def diffuse_impute(snap: DataFrame, mask: DataFrame, edges: DataFrame, channels: int, rounds: int = 8) -> DataFrame:
    """Jacobi rounds: an unobserved node takes the mean of its in-neighbours (0
    without any), observed ones keep their values.  ``edges`` static."""
    keys = ["traj", "t", "node"]
    out = snap.join(mask, keys, "left").select(*keys, "f", F.coalesce("observed", F.lit(True)).alias("o"))
    e = kept(with_self(edges, snap))  # read in every round
    far = ~F.col("_self")
    for k in range(rounds):
        sums = [F.sum(F.when(far, F.col("f")[c])).alias(f"_{c}") for c in range(channels)]
        own = F.max(F.when(F.col("_self"), F.struct("o", "f"))).alias("_own")
        got = out.join(e, (F.col("node") == F.col("_src")) & (F.col("traj") == F.col("_traj"))).groupBy("traj", "t", F.col("_dst").alias("node")).agg(F.sum(far.cast("int")).alias("_n"), own, *sums)
        mean = F.array(*[F.coalesce(F.col(f"_{c}") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)) for c in range(channels)])
        out = got.select(*keys, F.when(F.col("_own.o"), F.col("_own.f")).otherwise(mean).alias("f"), F.col("_own.o").alias("o"))
        if k % 4 == 3 and k + 1 < rounds and out.sparkSession.sparkContext.getCheckpointDir():
            out = out.checkpoint()
    return out.select(*keys, "f")


def topk_pool(snap: DataFrame, score_vector: list[float], ratio: float) -> DataFrame:
    """(traj, t, node, new, f): each step's ceil(ratio N) nodes of the largest
    score x.p / |p| (ties to the smaller node), features gated by tanh(score)."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    norm = sum(p * p for p in score_vector) ** 0.5 or 1.0
    s = snap.withColumn("_s", V.dot("f", F.array(*[F.lit(p / norm) for p in score_vector])))
    w = Window.partitionBy("traj", "t")
    keep = s.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_s"), "node"))).where(F.col("_r") <= F.ceil(F.col("_n") * ratio))
    gated = F.col("f") if ratio >= 1 else V.scale("f", F.tanh("_s"))
    return keep.select("traj", "t", "node", (F.col("_r") - 1).alias("new"), gated.alias("f"))


def unpool(coarse: DataFrame, perm: DataFrame, nodes: DataFrame, channels: int) -> DataFrame:
    """Features of kept nodes back at their places, zeros elsewhere.  ``perm`` is
    (traj, t, node, new), ``coarse`` (traj, t, node = new, f)."""
    fine = perm.select("traj", "t", "node", "new").join(coarse.select("traj", "t", F.col("node").alias("new"), "f"), ["traj", "t", "new"])
    return nodes.select("traj", "t", "node").join(fine.select("traj", "t", "node", "f"), ["traj", "t", "node"], "left").withColumn("f", F.coalesce("f", V.zeros(channels)))


def pool_controls(ctrl: DataFrame, perms: list[DataFrame]) -> DataFrame:
    """Node controls of the kept nodes, level by level; global ones unchanged."""
    out = ctrl
    for perm in perms:
        own = out.where("node is not null").join(perm.select("traj", "t", "node", "new"), ["traj", "t", "node"]).select("traj", "t", F.col("new").alias("node"), "u")
        out = out.where("node is null").select("traj", "t", "node", "u").unionByName(own)
    return out
