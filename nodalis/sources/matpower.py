"""Power-grid case files as DataFrames: regular expressions in the JVM."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Case(NamedTuple):
    base_mva: DataFrame  # (base)
    bus: DataFrame  # (pos, v array<double>)
    branch: DataFrame  # (pos, v array<double>)


def parse(text: DataFrame, column: str = "value") -> Case:
    """A case from one row of text: its base power and two blocks of numbers.
    Comments (%) are dropped; rows end with a semicolon."""
    base = text.select(F.regexp_extract(column, r"mpc\.baseMVA\s*=\s*([0-9.eE+-]+)", 1).cast("double").alias("base"))

    def block(name: str) -> DataFrame:
        body = F.regexp_replace(F.regexp_extract(column, rf"(?s)mpc\.{name}\s*=\s*\[(.*?)\]", 1), r"%[^\n]*", "")
        rows = text.select(F.posexplode(F.split(body, ";")).alias("pos", "row")).where(F.trim(F.regexp_replace("row", r"\s+", " ")) != "")
        return rows.select("pos", F.transform(F.split(F.trim(F.regexp_replace("row", r"[\s,]+", " ")), " "), lambda x: x.try_cast("double")).alias("v"))

    return Case(base, block("bus"), block("branch"))


def read(spark: SparkSession, path: str) -> Case:
    return parse(spark.read.text(path, wholetext=True))


def bus_numbers(case: Case) -> DataFrame:
    """(bus, node): numbers from 0 in file order (a case's rows are one small block)."""
    return case.bus.select(F.col("v")[0].cast("int").alias("bus"), "pos").withColumn("node", F.row_number().over(Window.orderBy("pos")) - 1).select("bus", "node")


def features(case: Case) -> DataFrame:
    """(node, f): voltage magnitude and angle, active and reactive load by base power."""
    n = bus_numbers(case)
    return case.bus.join(n, F.col("v")[0].cast("int") == F.col("bus")).crossJoin(F.broadcast(case.base_mva)).select("node", F.array(F.col("v")[7], F.col("v")[8], F.col("v")[2] / F.col("base"), F.col("v")[3] / F.col("base")).alias("f"))


def edges(case: Case) -> DataFrame:
    """(src, dst): both directions of branches in service; parallel lines stay."""
    n = bus_numbers(case)
    on = case.branch.where(F.col("v")[10] == 1).select(F.col("v")[0].cast("int").alias("a"), F.col("v")[1].cast("int").alias("b"))
    e = on.join(n.select(F.col("bus").alias("a"), F.col("node").alias("src")), "a").join(n.select(F.col("bus").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
