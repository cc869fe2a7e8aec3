import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from nodalis.operators.frames import from_arrays
from nodalis.streaming import snapshots as S


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(hours=5 * i), i % 3, "ab"[i % 2], float(i)) for i in range(40)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events(spark).repartition(1).write.parquet(f"{tmp_path}/in")
    s = S.event_stream(spark, f"{tmp_path}/in")
    batch = {(r.start, r.event_type): (r.n, r.total) for r in S.tumbling(events(spark).withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {(r.start, r.event_type): (r.n, r.total) for r in S.run_once(S.tumbling(s), "tumbling", f"{tmp_path}/c1", "complete").collect()}
    assert got == batch and sum(n for n, _ in got.values()) == 40
    assert S.run_once(S.sliding(S.event_stream(spark, f"{tmp_path}/in")), "sliding", f"{tmp_path}/c2", "complete").count() > len(got)
    ses = S.run_once(S.sessions(S.event_stream(spark, f"{tmp_path}/in"), "20 hours"), "sessions", f"{tmp_path}/c3", "complete")
    assert {r.user_id for r in ses.collect()} == {0, 1, 2}


def test_late_rows_are_dropped(spark, tmp_path):
    events(spark).where("event_id > 20").repartition(1).write.parquet(f"{tmp_path}/in")
    q = S.tumbling(S.event_stream(spark, f"{tmp_path}/in"))
    run = lambda: q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    events(spark).where("event_id <= 5").repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert first > 0 and out.agg({"start": "min"}).first()[0] >= dt.datetime(2024, 1, 5)


def test_adaptation_state_survives_batches(spark, tmp_path):
    k = np.array([[0.9, 0.1], [-0.1, 0.8]])
    x, out = np.random.default_rng(0).normal(size=(4, 2)), []
    for _ in range(30):
        out.append(x.tolist())
        x = x @ k.T
    pairs = from_arrays(spark, out, [(0, 1), (1, 0)]).pairs()
    for part in ("t < 15", "t >= 15"):
        pairs.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = S.run_once(S.adapt(s, 2, 1.0), "adapted", f"{tmp_path}/c", "append").orderBy("seen").collect()
    assert [r.seen for r in rows][-1] == 116 and len(rows) == 2
    assert np.allclose(np.array(rows[-1].k).reshape(2, 2), k, atol=0.02)
