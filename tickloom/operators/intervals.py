"""Overlaps and uniqueness of intervals by their endpoints: running sums instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[str], sums: list[str]) -> DataFrame:
    """rows with each of `sums` added up from the group's first row on, in order.

    The sums run within a bucket (a day, say) and start from those of all buckets before it, so a
    group of any size is spread over its buckets. bucket must not fall along the order.
    """
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(*by, "_bucket").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({s: F.sum(s).over(within) for s in sums})
    return local.join(totals, [*by, "_bucket"]).withColumns({s: F.col(s) + F.col(f"_{s}") for s in sums}).drop("_bucket", *(f"_{s}" for s in sums))


def overlaps(rows: DataFrame, by: list[str], key: str, start: str, stop: str) -> DataFrame:
    """(by, key, n): how many intervals of the group, itself included, touch each one; ends count.

    Those that began by its end, less those that ended before its start: four rows an interval
    and one sort, whatever overlaps. key is unique in the group; times are timestamps.
    """
    point = lambda at, phase, began, ended, sign: F.struct(F.col(at).alias("at"), F.lit(phase).alias("phase"), F.lit(began).alias("began"), F.lit(ended).alias("ended"), F.lit(sign).alias("sign"))
    # At one time: first the question what ended before, then the ends and starts, then what has begun.
    points = F.array(point(start, 0, 0, 0, -1), point(start, 1, 1, 0, 0), point(stop, 1, 0, 1, 0), point(stop, 2, 0, 0, 1))
    spread = rows.select(*by, key, F.inline(points))
    counted = running(spread, by, F.to_date("at"), ["at", "phase"], ["began", "ended"]).where("sign <> 0")
    return counted.groupBy(*by, key).agg(F.sum(F.when(F.col("sign") > 0, F.col("began")).otherwise(-F.col("ended"))).alias("n"))


def uniqueness(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (symbol, day, pos, stop) with uniqueness: the mean, over a span's bars, of one over the spans there.

    bars is (symbol, day, pos), pos a symbol's bar number; spans end on their day. Two running sums a day.
    """
    ends = spans.select("symbol", "day", F.inline(F.array(F.struct(F.col("pos").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("step")))))
    steps = ends.groupBy("symbol", "day", "pos").agg(F.sum("step").alias("step"))
    day = Window.partitionBy("symbol", "day").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = bars.join(steps, ["symbol", "day", "pos"], "left").withColumn("open", F.sum(F.coalesce("step", F.lit(0))).over(day))
    at = at.withColumn("sum", F.sum(F.when(F.col("open") > 0, 1 / F.col("open")).otherwise(0.0)).over(day))
    to = at.select("symbol", "day", F.col("pos").alias("stop"), F.col("sum").alias("to"))
    since = at.select("symbol", "day", (F.col("pos") + 1).alias("pos"), F.col("sum").alias("since"))
    out = spans.join(to, ["symbol", "day", "stop"]).join(since, ["symbol", "day", "pos"], "left")
    return out.withColumn("uniqueness", (F.col("to") - F.coalesce("since", F.lit(0.0))) / (F.col("stop") - F.col("pos") + 1)).drop("to", "since")
