"""Structured Streaming: events to snapshots, and operators that adapt online."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nodalis.operators.estimation import RecursiveFit


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of event files; event time becomes a timestamp, which watermarks need."""
    s = spark.read.parquet(folder).schema
    return spark.readStream.schema(s).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): counts and sums of windows; events later than
    the watermark are dropped, state of closed windows too."""
    w = F.window("ts", width)
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window("ts", width, slide)
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): each user's sessions."""
    w = F.session_window("ts", gap)
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


STATE = "blob binary"
OUT = "traj int, seen long, change double, k array<double>"


def adapt(pairs: DataFrame, dim: int, forget: float = 0.99, regularization: float = 1000.0) -> DataFrame:
    """Recursive least squares as keyed state: (traj, t, node, x, y) rows update
    their trajectory's operator in order of (t, node) within each batch; a row a
    batch tells the operator and how much it changed."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r, seen = pickle.loads(state.get[0]) if state.exists else (RecursiveFit(dim, 0, forget, regularization), 0)
        rows = pd.concat(list(frames))
        rows = rows.sort_values(["t", "node"])
        change = r.update(np.array(rows.x.tolist(), float), np.array(rows.y.tolist(), float))
        seen += len(rows)
        state.update((pickle.dumps((r, seen)),))
        yield pd.DataFrame({"traj": [key[0]], "seen": [seen], "change": [change], "k": [r.matrix.ravel().tolist()]})

    return pairs.groupBy("traj").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now, into a table in memory (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
