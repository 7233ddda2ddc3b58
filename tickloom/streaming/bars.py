"""Bars and alerts over a stream: beyond the batch inventory, with the same definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, rule: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream of (symbol, ts timestamp, price, size); ticks later than `late` are dropped."""
    at = F.window("ts", rule).alias("w")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", at).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_alerts(bars: DataFrame, streak: int = 3, cooldown_minutes: int = 30) -> DataFrame:
    """(symbol, ts, close, vwap): a close under the day's VWAP for `streak` bars in a row, not again
    within the cooldown. State a symbol: the day, its cumulated value and volume, the streak, the
    last alert. Bars of a symbol are taken in time order within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, value, volume, run, last = state.get if state.exists else ("", 0.0, 0.0, 0, -1e18)
        out = []
        for b in pd.concat(list(batches)).sort_values("ts").itertuples():
            if str(b.ts.date()) != day:
                day, value, volume, run = str(b.ts.date()), 0.0, 0.0, 0
            value, volume = value + (b.high + b.low + b.close) / 3 * b.volume, volume + b.volume
            vwap = value / volume if volume else None
            run = run + 1 if vwap is not None and b.close < vwap else 0
            now = b.ts.timestamp()
            if run >= streak and now - last >= 60 * cooldown_minutes:
                out.append((key[0], b.ts, b.close, vwap))
                last = now
        state.update((day, float(value), float(volume), int(run), float(last)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "vwap"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, vwap double", "day string, value double, volume double, run int, last double", "append", GroupStateTimeout.NoTimeout)
