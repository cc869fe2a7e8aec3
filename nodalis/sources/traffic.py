"""Sensor speeds: cleaning, scaling, adjacency and the cached payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.operators.frames import Frames
from nodalis.operators.topology import gaussian_adjacency, symmetric_support


def clean(speeds: DataFrame, node: str = "node", t: str = "t", x: str = "x") -> DataFrame:
    """Values that are missing, NaN or not positive take the last one before, else
    the first after; a sensor without any gets 0."""
    ok = F.when(~F.isnan(x) & (F.col(x) > 0), F.col(x))
    w = Window.partitionBy(node).orderBy(t)
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return speeds.withColumn("_v", ok).withColumn(x, F.coalesce(before, after, F.lit(0.0))).drop("_v")


def zscore(speeds: DataFrame, node: str = "node", x: str = "x") -> DataFrame:
    """Scaled by each sensor's mean and population deviation over all time; a
    deviation under 1e-6 counts as 1."""
    per = speeds.groupBy(node).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return speeds.join(per, node).withColumn(x, (F.col(x) - F.col("_m")) / F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def window(speeds: DataFrame, steps: int, offset: int = 0) -> DataFrame:
    """Steps [offset, offset + steps), pushed down to the scan."""
    if steps < 1 or offset < 0:
        raise ValueError("a window needs a step and no negative offset")
    return speeds.where((F.col("t") >= offset) & (F.col("t") < offset + steps)).withColumn("t", F.col("t") - offset)


def sensors(spark: SparkSession, path: str) -> DataFrame:
    """(id, node) from a file of comma-separated ids."""
    ids = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*,\s*")).alias("node", "id"))
    return ids.where("id <> ''").select("id", "node")


def distances(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, cost) with ids as text."""
    return spark.read.csv(path, header=True, schema="`from` string, `to` string, cost double")


def payload(speeds: DataFrame, ids: DataFrame, dist: DataFrame, least: float = 0.1) -> Frames:
    """Cleaned and scaled speeds on the symmetrised Gaussian adjacency."""
    e = symmetric_support(gaussian_adjacency(dist, ids, least))
    snap = zscore(clean(speeds)).select(F.lit(0).alias("traj"), F.col("t").cast("int").alias("t"), F.col("node").cast("int").alias("node"), F.array(F.col("x").cast("double")).alias("f"))
    return Frames(snap, e.select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "w"))


def save(frames: Frames, folder: str, force: bool = False) -> None:
    """Tables of a bundle as Parquet; existing ones stay unless ``force``."""
    for name in ("snap", "edges", "ctrl", "times", "mask"):
        if (df := getattr(frames, name)) is not None:
            df.write.mode("overwrite" if force else "ignore").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, dynamic: bool = False) -> Frames:
    """A bundle that ``save`` wrote."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    def read(name: str):
        try:
            return spark.read.parquet(f"{folder}/{name}")
        except (AnalysisException, Py4JError):
            if name in ("snap", "edges"):
                raise
            return None

    return Frames(*(read(n) for n in ("snap", "edges", "ctrl", "times", "mask")), dynamic)
