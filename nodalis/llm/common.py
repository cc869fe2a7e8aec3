"""Helpers shared by the training-data operators.

Work folders: every intermediate table lives under the folder named by
``spark.checkpoint.dir`` (shared by driver and executors on a cluster).  Where
that setting is missing a local master, as in unit tests, gets a folder of its
own; any other master is an error, as its executors would not see one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id) modulo this that marks a held-out document.
HOLD_OUT_MOD = 5


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but
    lies in a folder that they see."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` by workers that can import this package."""
    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared work folder; sets a local one only when none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="nodalis-"))
    return os.path.dirname(spark.sparkContext.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: ends the lineage and survives
    the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder of ours, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows, or elements of their arrays, that a broadcast side may have (some tens of MB).
SMALL = 500_000


def if_small(df: DataFrame, size=None) -> DataFrame:
    """A checkpointed table, marked for broadcast if it has SMALL rows (of
    ``size`` each, 1 by default) at most; else Spark deals both sides by key."""
    df = cut(df)
    n = df.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    return F.broadcast(df) if n <= SMALL else df


#: Rows of one key that a join leaves in one task, and keys with more that are broadcast at most.
HOT_ROWS = 20_000
HOT_KEYS = 100_000


def salted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", stable: bool = False) -> DataFrame:
    """``left.join(right, on, how)`` where one key of ``left`` may have any share
    of the rows and ``right`` has one row a key: rows of hot keys are cut into
    chunks of HOT_ROWS, by their values (by their number in a ``stable``, that is
    checkpointed, left, which splits equal rows too), that meet a copy of right's
    row each.  Keys with that many rows are few; beyond HOT_KEYS of them their
    table is dealt like the others."""
    on = [on] if isinstance(on, str) else on
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_chunks"))
    few = hot.limit(HOT_KEYS + 1).collect()
    if not few:
        return left.join(right, on, how)
    if len(few) <= HOT_KEYS:
        hot = F.broadcast(left.sparkSession.createDataFrame(few, hot.schema))
    row = F.monotonically_increasing_id() if stable else F.xxhash64(*left.columns)
    a = left.withColumn("_row", row).join(hot, on, "left").withColumn("_salt", F.pmod("_row", F.coalesce("_chunks", F.lit(1))).cast("int"))
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    return a.drop("_chunks", "_row").join(b.drop("_chunks"), [*on, "_salt"], how).drop("_salt")


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT_MOD == 0


def bounded_sample(df: DataFrame, key: str, by: str | None, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` for each value of ``by`` (all together if
    None), those with the smallest hash of ``key``: a deterministic sample whose
    size does not grow with the input.  Counts by group set a bar that about
    twice as many rows pass, so the exact cut sorts a bounded number of rows
    however many partitions there are.  Only (key, by) are ranked."""
    from pyspark.sql import Window

    group = F.col(by) if by else F.lit(0)
    slim = df.select(F.col(key).alias("_key"), group.alias("_g"), F.xxhash64(key).alias("_h"))
    size = slim.groupBy("_g").agg(F.count("*").alias("_n"))
    bar = F.lit(2.0 * rows + 64) / F.col("_n")
    near = slim.join(size, "_g").where(F.col("_n").isNotNull() & ((F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) < bar))
    w = Window.partitionBy("_g").orderBy(F.pmod("_h", F.lit(1 << 30)), "_key")
    keep = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).select("_key").distinct()
    return df.join(F.broadcast(keep), df[key] == keep["_key"], "left_semi")
