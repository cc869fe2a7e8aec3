"""Forecast errors, masked errors and loss reductions as two-level aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators.frames import Frames

EPS = 1e-8


def entries(pred: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row for each entry: (*on, c, p, y)."""
    both = pred.select(*on, F.col("f").alias("_p")).join(truth.select(*on, F.col("f").alias("_y")), list(on))
    return both.select(*on, F.posexplode(F.arrays_zip("_p", "_y")).alias("c", "_e")).select(*on, "c", F.col("_e._p").alias("p"), F.col("_e._y").alias("y"))


def mae(p: Column, y: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(p: Column, y: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mape(p: Column, y: Column, eps: float = EPS) -> Column:
    """A fraction, not per cent."""
    return F.avg(F.abs((p - y) / (F.abs(y) + eps)))


def node_errors(pred: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, ae, se, re): channel means of absolute, squared and relative errors;
    no explode."""
    both = pred.select(*on, F.col("f").alias("_p")).join(truth.select(*on, F.col("f").alias("_y")), list(on))
    d = F.zip_with("_p", "_y", lambda p, y: F.struct((p - y).alias("d"), y.alias("y")))
    return both.select(
        *on,
        V.mean(F.transform(d, lambda e: F.abs(e.d))).alias("ae"),
        V.mean(F.transform(d, lambda e: e.d * e.d)).alias("se"),
        V.mean(F.transform(d, lambda e: F.abs(e.d / (F.abs(e.y) + EPS)))).alias("re"),
    )


def masked(errors: DataFrame, mask: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, mae, rmse, mape) over observed nodes; 0 where none is observed."""
    e = errors.join(mask.select(*on, "observed"), list(on), "left").withColumn("_m", F.coalesce("observed", F.lit(True)).cast("double"))
    part = lambda c: F.coalesce(F.sum(F.col(c) * F.col("_m")) / F.nullif(F.sum("_m"), F.lit(0.0)), F.lit(0.0))
    return e.groupBy(*by).agg(part("ae").alias("mae"), F.sqrt(part("se")).alias("rmse"), part("re").alias("mape"))


def masked_mse(errors: DataFrame, mask: DataFrame, on: Sequence[str]) -> DataFrame:
    """(mse): mean squared error over observed nodes and channels."""
    e = errors.join(mask.select(*on, "observed"), list(on), "left").withColumn("_m", F.coalesce("observed", F.lit(True)).cast("double"))
    return e.agg(F.coalesce(F.sum(F.col("se") * F.col("_m")) / F.nullif(F.sum("_m"), F.lit(0.0)), F.lit(0.0)).alias("mse"))


def worst_node(errors: DataFrame, by: Sequence[str] = ("traj", "t"), mask: DataFrame | None = None) -> DataFrame:
    """(*by, worst): the largest channel-mean squared error of a(n observed) node."""
    e = errors if mask is None else errors.join(mask.where("observed").select("traj", "t", "node"), ["traj", "t", "node"], "left_semi")
    return e.groupBy(*by).agg(F.max("se").alias("worst"))


def evaluate(forecast: DataFrame, frames: Frames, horizons: Sequence[int] = (3, 6, 12), origins: Sequence[int] | None = None) -> DataFrame:
    """(horizon, mae, rmse, mape, origins): each origin's metric, then the mean
    over origins that have the largest horizon ahead; a last row with a null
    horizon is the plain mean over horizons.  ``forecast`` is (traj, origin, h,
    node, f).  Masked nodes at the target step do not count."""
    hs = sorted(set(horizons))
    if not hs or hs[0] < 1:
        raise ValueError("horizons must be positive")
    last = frames.num_timesteps - 1 - hs[-1]
    if last < 0:
        raise ValueError("the sequence is shorter than the largest horizon")
    some = forecast.where(F.col("h").isin(hs) & (F.col("origin") <= last))
    if origins is not None:
        some = some.where(F.col("origin").isin(list(origins)))
    on = ["traj", "origin", "h", "node"]
    truth = frames.snap.withColumnRenamed("t", "_t")
    aligned = some.withColumn("_t", F.col("origin") + F.col("h")).join(truth.select("traj", "_t", "node", F.col("f").alias("y")), ["traj", "_t", "node"])
    d = F.zip_with("f", "y", lambda p, y: F.struct((p - y).alias("d"), y.alias("y")))
    err = aligned.select(*on, "_t", V.mean(F.transform(d, lambda e: F.abs(e.d))).alias("ae"), V.mean(F.transform(d, lambda e: e.d * e.d)).alias("se"), V.mean(F.transform(d, lambda e: F.abs(e.d / (F.abs(e.y) + EPS)))).alias("re"))
    if frames.mask is not None:
        per = masked(err, frames.mask.select("traj", F.col("t").alias("_t"), "node", "observed"), ["traj", "_t", "node"], ["traj", "origin", "h"])
    else:
        per = err.groupBy("traj", "origin", "h").agg(F.avg("ae").alias("mae"), F.sqrt(F.avg("se")).alias("rmse"), F.avg("re").alias("mape"))
    by_h = per.groupBy(F.col("h").alias("horizon")).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"), F.count("*").alias("origins"))
    total = by_h.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"), F.max("origins").alias("origins")).where("origins is not null").select(F.lit(None).cast("int").alias("horizon"), "mae", "rmse", "mape", "origins")
    return by_h.unionByName(total)


def persistence(frames: Frames, horizons: Sequence[int]) -> DataFrame:
    """The last value as forecast: (traj, origin, h, node, f)."""
    return frames.snap.select("traj", F.col("t").alias("origin"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"), "node", "f")


def coverage(intervals: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """(coverage): share of truths within closed intervals (lower, upper)."""
    return intervals.join(truth, list(on)).agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))


def pair_loss(frames: Frames, advance, masked_pairs: bool = True) -> DataFrame:
    """(loss): mean over transitions of the squared error between ``advance`` of
    the features at t and those at t + 1."""
    p = frames.pairs().withColumn("_e", V.mean(V.mul(V.sub(advance(F.col("x")), "y"), V.sub(advance(F.col("x")), "y"))))
    if frames.mask is not None and masked_pairs:
        p = p.join(frames.pair_mask(), ["traj", "t", "node"]).where("observed")
    return p.groupBy("traj", "t").agg(F.avg("_e").alias("_e")).agg(F.avg("_e").alias("loss"))


def sparsity(matrix: DataFrame, p: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """(loss): mean |v|^p of matrix entries, smoothed for p under 1."""
    return matrix.agg(F.avg(F.abs("v") if p == 1 else F.pow(F.col("v") * F.col("v") + eps, F.lit(p / 2))).alias("loss"))
