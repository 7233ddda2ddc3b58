"""Gaps and islands, and greedy cooldowns over a group's ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_islands(triggers: DataFrame, by: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Triggers with an `island` number: a new one begins after a gap to the last trigger over gap_seconds."""
    order = Window.partitionBy(*by).orderBy(at)
    far = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(order).cast("timestamp")) > gap_seconds
    return triggers.withColumn("island", F.sum(F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).over(order))


def cooldown(edges: DataFrame, by: list[str], at: str, seconds: int) -> DataFrame:
    """The edges that a chronological greedy sweep keeps: none within `seconds` of the last kept.

    A fold over each group's sorted times; group by day (as the rule does) to bound the array.
    """
    times = F.sort_array(F.collect_list(F.unix_timestamp(F.col(at).cast("timestamp"))))
    keep = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= seconds), F.concat(kept, F.array(t))).otherwise(kept)
    kept = F.aggregate(times, F.array().cast("array<bigint>"), keep)
    return edges.groupBy(*by).agg(kept.alias("_kept")).select(*by, F.explode("_kept").alias("_t")).select(*by, F.timestamp_seconds("_t").cast("timestamp_ntz").alias(at))


def spaced(edges: DataFrame, by: str, at: str, least: int) -> DataFrame:
    """The edges that a sweep over each group keeps: none within `least` positions of the last kept.

    An edge that far from the edge before it is kept whatever came earlier, so the sweep is cut
    there and a fold sees the edges between two such gaps only.
    """
    order = Window.partitionBy(by).orderBy(at)
    far = F.coalesce(F.col(at) - F.lag(at).over(order) >= least, F.lit(True))
    cut = edges.withColumn("_island", F.sum(far.cast("int")).over(order))
    rest = [c for c in edges.columns if c not in (by, at)]
    items = cut.groupBy(by, "_island").agg(F.sort_array(F.collect_list(F.struct(at, *rest))).alias("_rows"))
    keep = lambda a, x: F.when((F.size(a) == 0) | (x[at] - F.element_at(a, -1)[at] >= least), F.concat(a, F.array(x))).otherwise(a)
    return items.select(by, F.inline(F.aggregate("_rows", F.slice("_rows", 1, 0), keep))).select(*edges.columns)
