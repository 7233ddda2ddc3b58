"""Triple-barrier labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_touch(events: DataFrame, width: float, bars: int, cost_bps: float) -> DataFrame:
    """events (symbol, day, ts, pos, high, low, close, sigma) with label, touch (a bar number) and ret.

    Barriers are close * exp(+-width * sigma); the later bars of the day, `bars` at most, are
    tried in turn, the upper one first. If none is touched the last bar's return decides, 0 if it is
    under half a sigma. Events whose width does not pay cost_bps, or without a sigma, go.
    ret is the log return to the close of the touching bar.
    """
    ahead = F.collect_list(F.struct("pos", "high", "low", "close")).over(Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(1, bars))
    rows = events.withColumn("ahead", ahead).where((F.col("sigma") > 0) & (F.col("sigma") * width * 1e4 >= cost_bps))
    up, down = F.col("close") * F.exp(width * F.col("sigma")), F.col("close") * F.exp(-width * F.col("sigma"))
    hit = F.get(F.filter("ahead", lambda x: (x["high"] >= up) | (x["low"] <= down)), F.lit(0))
    end = F.coalesce(F.try_element_at("ahead", F.lit(-1)), F.struct("pos", "high", "low", "close"))
    rows = rows.withColumns({"hit": hit, "end": F.coalesce(hit, end)})
    ret = F.log(F.col("end")["close"] / F.col("close"))
    side = F.when(F.abs(ret) < F.col("sigma") / 2, 0).otherwise(F.signum(ret).cast("int"))
    label = F.when(F.col("hit").isNull(), side).when(F.col("hit")["high"] >= up, 1).otherwise(-1)
    return rows.select("symbol", "day", "ts", "pos", label.alias("label"), F.col("end")["pos"].alias("touch"), ret.alias("ret"))


def meta_labels(entries: DataFrame, k: float, most: int, cost: float) -> DataFrame:
    """entries (…, signal, sigma, path) with hit, net and meta (1 if net > 0).

    path is the later bars of the day in order (open, high, low, close): the first one's open is
    the entry, the `most` after it are tried, at a distance of k * sigma * sqrt(their number). A bar
    that touches both barriers counts as the stop; without a touch the last close decides.
    """
    n = F.least(F.lit(most), F.size("path") - 1)
    rows = entries.where((F.size("path") > 1) & (F.col("sigma") > 0)).withColumn("w", k * F.col("sigma") * F.sqrt(n))
    sign: Column = F.when(F.col("signal") == "BUY", 1).otherwise(-1)
    entry = F.col("path")[0]["open"]
    target, stop = entry * (1 + sign * F.col("w")), entry * (1 - sign * F.col("w"))
    won = lambda x: F.when(sign == 1, x["high"] >= target).otherwise(x["low"] <= target)
    lost = lambda x: F.when(sign == 1, x["low"] <= stop).otherwise(x["high"] >= stop)
    tried = F.slice("path", F.lit(2), n)
    rows = rows.withColumn("first", F.get(F.filter(tried, lambda x: won(x) | lost(x)), F.lit(0)))
    hit = F.when(F.col("first").isNull(), "vertical").when(lost(F.col("first")), "stop").otherwise("target")
    gross = F.when(hit == "vertical", sign * (F.element_at("path", n + 1)["close"] / entry - 1)).when(hit == "stop", -F.col("w")).otherwise(F.col("w"))
    return rows.withColumns({"hit": hit, "net": gross - cost}).withColumn("meta", (F.col("net") > 0).cast("int")).drop("first", "path", "w")
