"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins on the edge table; the edges are
checkpointed in the shared folder after each, so no lineage grows and a lost
executor costs one round at most.  Nothing but two totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodalis.llm.common import cut, salted_join


#: Partitions of a table of edges at least, and edges of one about.
LEAST_PARTS, PART_ROWS = 8, 100_000


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an
    edge.  Self-loops, repeated edges and edges with a null end are ignored; no
    edges give an empty table."""
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).distinct()
    e = cut(e)  # a > b
    before, n = None, e.count()
    while True:
        # small tables go on in few partitions: each costs files in every step
        parts = max(LEAST_PARTS, -(-n // PART_ROWS))
        e = e.coalesce(parts)
        # large star: larger neighbours of a node move to its smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(parts)
        big = salted_join(both.where(F.col("b") > F.col("a")), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts)
        # small star: a node and its smaller neighbours move to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = salted_join(big, low, "a")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct().coalesce(parts))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, n = now, now.n
