"""Alerts over a stream of bars: state by symbol that ends with its session, and a sink that a replay does not double."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.ship import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "day string, value double, volume double, run int, alerted double, seen double"
ALERT = "symbol string, ts timestamp, close double, vwap double"
DAY = dt.timedelta(days=1)


class BelowVwap(StatefulProcessor):
    """A close below the session's average price for `streak` bars in a row, not again within the cooldown.

    State is a row a symbol: the day, its cumulated value and volume, the streak, the last alert and the last bar.
    A bar that is not later than the last one seen is dropped. A timer at the end of the day (and `grace` more)
    ends the state, so symbols that no longer trade hold none.
    """

    def __init__(self, streak: int, cooldown: float, grace: float):
        self.streak, self.cooldown, self.grace = streak, cooldown, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, value, volume, run, alerted, seen = self.state.get() if self.state.exists() else ("", 0.0, 0.0, 0, -1e18, -1e18)
        out = []
        for b in pd.concat(list(rows)).sort_values("ts").itertuples():
            now, today = b.ts.timestamp(), str(b.ts.date())
            if now <= seen:
                continue
            if today != day:
                day, value, volume, run = today, 0.0, 0.0, 0
            seen, value, volume = now, value + (b.high + b.low + b.close) / 3 * b.volume, volume + b.volume
            vwap = value / volume if volume else None
            run = run + 1 if vwap is not None and b.close < vwap else 0
            if run >= self.streak and now - alerted >= self.cooldown:
                out.append((key[0], b.ts, b.close, vwap))
                alerted = now
        self.state.update((day, float(value), float(volume), int(run), float(alerted), float(seen)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if day:
            end = dt.datetime.combine(dt.date.fromisoformat(day), dt.time(), dt.UTC) + DAY
            self.handle.registerTimer(int((end.timestamp() + self.grace) * 1000))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "close", "vwap"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def below_vwap(bars: DataFrame, streak: int = 3, cooldown_minutes: int = 30, late: str = "10 minutes", grace_minutes: int = 60) -> DataFrame:
    """(symbol, ts, close, vwap) alerts of a stream of bars (symbol, ts timestamp, high, low, close, volume).

    State ends with the day by event time; bars later than `late` behind the watermark are dropped. The state store must be the one
    that knows timers; it is set for the session. Days are those of UTC.
    """
    spark = ship(bars.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = bars.withWatermark("ts", late).groupBy("symbol")
    return marked.transformWithStateInPandas(BelowVwap(streak, 60.0 * cooldown_minutes, 60.0 * grace_minutes), ALERT, "Append", "EventTime")


def write_once(alerts: DataFrame, path: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start writing a stream to `path`, a folder a batch, with all that is there now.

    A batch that is run again after a failure has the number it had, and replaces its folder, so rows are there once.
    `then` is called with the number when a batch is written.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(number)

    return alerts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT).parquet(path).select("symbol", "ts", "close", "vwap")
