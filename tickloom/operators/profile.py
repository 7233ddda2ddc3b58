"""Volume profiles, value areas and equal-volume buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def volume_profile(bars: DataFrame, width: float) -> DataFrame:
    """(symbol, day, bin, volume, delta): each bar's volume spread evenly over the bins its range touches."""
    lo, hi = F.floor(F.col("low") / width), F.floor(F.col("high") / width)
    n = hi - lo + 1
    spread = bars.select("symbol", "day", F.explode(F.sequence(lo, hi)).alias("bin"), (F.col("volume") / n).alias("v"), (F.signum(F.col("close") - F.col("open")) * F.col("volume") / n).alias("d"))
    return spread.groupBy("symbol", "day", "bin").agg(F.sum("v").alias("volume"), F.sum("d").alias("delta"))


def value_area(profile: DataFrame, share: float = 0.70) -> DataFrame:
    """(symbol, day, poc, val, vah): from the fullest bin (lowest of equals) the area grows to the
    fuller side, upwards if equal, until it holds `share` of the volume.

    A fold over a day's bins; a day's profile is bounded by its price range.
    """
    bins = F.sort_array(F.collect_list(F.struct("bin", F.round("volume", 6).alias("volume"))))
    day = profile.groupBy("symbol", "day").agg(bins.alias("b"))
    top = F.array_max(F.transform("b", lambda x: x["volume"]))
    day = day.withColumns({"p": F.array_position(F.transform("b", lambda x: x["volume"]), top).cast("int"), "total": F.aggregate("b", F.lit(0.0), lambda s, x: s + x["volume"])})
    at = lambda i: F.coalesce(F.try_element_at("b", i)["volume"], F.lit(-1.0))
    state = F.struct(F.col("p").alias("lo"), F.col("p").alias("hi"), F.element_at("b", F.col("p"))["volume"].alias("v"))

    def grow(s, _):
        up = at(s["hi"] + 1)
        down = F.when(s["lo"] > 1, at(F.greatest(s["lo"] - 1, F.lit(1)))).otherwise(-1.0)
        done = (s["v"] >= F.col("total") * share) | ((up < 0) & (down < 0))
        rise = up >= down
        return F.when(done, s).otherwise(F.struct(F.when(rise, s["lo"]).otherwise(s["lo"] - 1).alias("lo"), F.when(rise, s["hi"] + 1).otherwise(s["hi"]).alias("hi"), (s["v"] + F.when(rise, up).otherwise(down)).alias("v")))

    day = day.withColumn("s", F.aggregate("b", state, grow))
    name = lambda i: F.element_at("b", i)["bin"]
    return day.select("symbol", "day", name(F.col("p")).alias("poc"), name(F.col("s.lo")).alias("val"), name(F.col("s.hi")).alias("vah"))


def volume_buckets(bars: DataFrame, size: float, buy_share: str) -> DataFrame:
    """(symbol, bucket, ts, imbalance): bars cut into buckets of equal volume, abs(buy - sell) / size.

    A bar covers an interval of cumulated volume; its overlap with each bucket is its share,
    so no sequential filling is needed. The unfinished last bucket is dropped; ts is the bar
    that completes a bucket.
    """
    order = Window.partitionBy("symbol").orderBy("ts")
    c1 = F.sum(F.col("volume").cast("double")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = bars.withColumn("c1", c1).withColumn("c0", F.col("c1") - F.col("volume")).where("volume > 0")
    cut = cut.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("c0") / size), F.ceil(F.col("c1") / size) - 1)))
    part = F.least(F.col("c1"), (F.col("bucket") + 1) * size) - F.greatest(F.col("c0"), F.col("bucket") * size)
    out = cut.groupBy("symbol", "bucket").agg(F.sum(part).alias("filled"), F.abs(F.sum(part * (2 * F.col(buy_share) - 1)) / size).alias("imbalance"), F.max("ts").alias("ts"))
    return out.where(F.col("filled") >= size - 1e-6).drop("filled")
