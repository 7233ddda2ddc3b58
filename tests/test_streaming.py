"""Streamed bars and alerts equal the batch's on replay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.sources.market import resample
from tickloom.streaming.bars import stream_alerts, stream_bars


def test_replay(spark, tmp_path):
    r, t0 = random.Random(1), dt.datetime(2024, 1, 2, 9, 30)
    rows = [("s", t0 + dt.timedelta(seconds=20 * i), 100 + r.gauss(0, 1) - i / 50, 10) for i in range(300)]
    rows.append(("s", t0 + dt.timedelta(days=1), 100.0, 1))  # moves the watermark on
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size long")
    frame.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    q = stream_bars(stream).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = [tuple(x) for x in spark.table("streamed").orderBy("ts").drop("ts").collect()]
    batch = resample(frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "5 minutes").orderBy("ts").drop("ts", "day", "tod").collect()
    assert got == [tuple(x) for x in batch[:-1]] and len(got) == 20

    bars = spark.table("streamed")
    bars.coalesce(1).write.parquet(f"{tmp_path}/bars")
    s = stream_alerts(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/bars"), streak=3, cooldown_minutes=30)
    q = s.writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/d").start()
    q.awaitTermination()
    times = [x["ts"] for x in spark.table("alerts").orderBy("ts").collect()]
    assert times and all((b - a).total_seconds() >= 1800 for a, b in zip(times, times[1:], strict=False))
