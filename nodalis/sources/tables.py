"""Graph sequences from the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions.indexing import dense_index
from nodalis.operators.frames import Frames, kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(values: DataFrame, nodes: DataFrame, steps: DataFrame, columns: list[str]) -> DataFrame:
    """Every (t, node) with its features, zeros where there are no rows.  Steps are
    the smaller dimension table (a row for each month or day)."""
    full = nodes.crossJoin(F.broadcast(steps)).join(values, ["t", "node"], "left")
    return full.select(F.lit(0).alias("traj"), F.col("t").cast("int").alias("t"), F.col("node").cast("int").alias("node"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("f"))


def _static(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("w").cast("double").alias("w"))


def trade(spark: SparkSession, sf_dir: str, unit: float = 1e8) -> Frames:
    """Nations by month: order value in units of ``unit`` cents (millions) and
    order count of a nation's customers; edges join the nations of a region.
    Values are summed in whole cents, so any order of the rows gives the same
    number.  The 25 nations are counted after orders are summed by customer
    nation and month, so one shuffle of partial sums is all that grows with orders."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("t"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("node"))
    # every later plan reads these sums (nations x months), not orders again
    v = kept(o.join(c, "o_custkey").groupBy("t", "node").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(unit)).alias("x"), F.count("*").alias("c")))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("r"))
    steps = v.select("t").distinct()
    e = n.select(F.col("node").alias("src"), "r").join(n.select(F.col("node").alias("dst"), "r"), "r").where("src <> dst").withColumn("w", F.lit(1.0))
    return Frames(_grid(v, n.select("node"), steps, ["x", "c"]), _static(e))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj, t, src, dst, w): revenue in millions from customer to supplier
    nations, both directions added, without loops."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    pairs = li.join(s, "l_suppkey").join(o.join(c, "o_custkey"), "l_orderkey").groupBy("a", "b").agg((F.sum("rev") / 1e6).alias("w")).where("a <> b")
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    return kept(_static(both.groupBy("src", "dst").agg(F.sum("w").alias("w"))))  # pairs of nations


def _days(e: DataFrame) -> DataFrame:
    return e.withColumn("day", F.to_date("ts")).withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date")))


def _from_zero(d: DataFrame) -> DataFrame:
    first = d.agg(F.min("t").alias("_first"))
    return d.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("_first")).drop("_first")  # one row


def events(spark: SparkSession, sf_dir: str) -> Frames:
    """Event types by day: count, sum and mean of values; an edge's weight is how
    often one type follows another of the same user."""
    e = _from_zero(_days(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")))
    kinds = e.select("event_type").distinct().withColumn("node", F.row_number().over(Window.orderBy("event_type")) - 1)
    k = e.join(F.broadcast(kinds), "event_type")  # a handful of types
    v = kept(k.groupBy("t", "node").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    follow = k.select("node", F.lead("node").over(w).alias("dst")).where("dst is not null").groupBy(F.col("node").alias("src"), "dst").agg(F.count("*").cast("double").alias("w"))
    return Frames(_grid(v, kinds.select("node"), v.select("t").distinct(), ["n", "s", "m"]), _static(follow))


def users(spark: SparkSession, sf_dir: str) -> Frames:
    """Users by day: sum and count of values, on a ring of users in order of
    their ids; days without an event are unobserved."""
    e = _from_zero(_days(read(spark, sf_dir, "events").select("ts", "user_id", "value")))
    v = kept(e.groupBy("t", "user_id").agg(F.sum("value").alias("s"), F.count("*").alias("n")))
    ids = dense_index(v.select("user_id").distinct(), "user_id")
    v = v.join(ids, "user_id").select("t", "node", "s", "n")
    nodes, steps = ids.select("node"), v.select("t").distinct()
    mask = nodes.crossJoin(F.broadcast(steps)).join(v.select("t", "node", F.lit(True).alias("o")), ["t", "node"], "left").select(F.lit(0).alias("traj"), F.col("t").cast("int").alias("t"), F.col("node").cast("int").alias("node"), F.coalesce("o", F.lit(False)).alias("observed"))
    size = ids.agg(F.count("*").alias("_n"))
    one = ids.crossJoin(F.broadcast(size)).select(F.col("node").alias("src"), F.pmod(F.col("node") + 1, F.col("_n")).alias("dst"), F.lit(1.0).alias("w"))  # one row
    ring = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return Frames(_grid(v, nodes, steps, ["s", "n"]), _static(ring), mask=mask)


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, x, label): the embeddings as points."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("node"), F.col("embedding").cast("array<double>").alias("x"), "label")
