"""Alerts with state that ends, written once whatever is run again."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from tickloom.streaming.alerts import below_vwap, read_alerts, write_once

pytest.importorskip("google.protobuf")
T0 = dt.datetime(2024, 1, 2, 9, 30, tzinfo=dt.UTC)
BARS = "symbol string, ts timestamp, high double, low double, close double, volume long"


def made(seed):
    r = random.Random(seed)
    rows = []
    for day in range(3):
        for s in ("a", "b"):
            p = 100.0
            for i in range(60):
                p += r.gauss(-0.02, 0.3)
                rows.append((s, T0 + dt.timedelta(days=day, minutes=5 * i), p + 0.1, p - 0.1, p, r.randint(1, 50)))
    return rows


def expected(rows, streak=3, cooldown=1800):
    state, out = defaultdict(lambda: [None, 0.0, 0.0, 0, -1e18]), []
    for s, t, h, lo, c, v in sorted(rows, key=lambda x: x[1]):
        x = state[s]
        if x[0] != t.date():
            x[:4] = [t.date(), 0.0, 0.0, 0]
        x[1], x[2] = x[1] + (h + lo + c) / 3 * v, x[2] + v
        x[3] = x[3] + 1 if c < x[1] / x[2] else 0
        if x[3] >= streak and t.timestamp() - x[4] >= cooldown:
            out.append((s, t))
            x[4] = t.timestamp()
    return sorted(out)


def test_restart_in_a_replay_gives_alerts_once(spark, tmp_path):
    rows = sorted(made(1), key=lambda x: x[1])
    cut = [0, 100, 200, 300, len(rows)]
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        spark.createDataFrame(rows[a:b], BARS).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    calls = []

    def fail(number):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost after writing")

    def start():
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return write_once(below_vwap(stream), f"{tmp_path}/out", f"{tmp_path}/state", fail)

    with pytest.raises(Exception, match="lost after writing"):
        start().awaitTermination()
    start().awaitTermination()
    assert calls[1] == calls[2]  # the same batch again
    got = sorted((x["symbol"], x["ts"].astimezone(dt.UTC)) for x in read_alerts(spark, f"{tmp_path}/out").collect())
    want = expected(rows)
    assert [(s, t.timestamp()) for s, t in got] == [(s, t.timestamp()) for s, t in want] and len(want) > 5


def test_state_ends_with_the_session(spark, tmp_path):
    """Days after a symbol's last bar its state is gone."""
    rows = sorted(made(2), key=lambda x: x[1])
    spark.createDataFrame(rows, BARS).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    for k, days in enumerate((10, 11)):  # the first moves the watermark, the second lets timers run
        spark.createDataFrame([("z", T0 + dt.timedelta(days=days), 1.0, 1.0, 1.0, 1)], BARS).coalesce(1).write.parquet(f"{tmp_path}/in/part={k + 1}")
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = write_once(below_vwap(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    values = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "session").load()
    assert {x["key"]["symbol"] for x in values.select("key").collect()} == {"z"}
