"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is one node of the component.

    Each round every node hooks to its least neighbour by a hash order, the pointers
    are followed once more, and edges are contracted to the new nodes; in a random
    order the number of nodes falls by a constant factor a round, so the rounds are
    logarithmic in the number of nodes. Hubs are no issue: minima are pre-aggregated
    map-side and joins are plain equi-joins, which AQE splits when skewed. Each round
    is written to the shared folder. Edges with a null end and loops are ignored.
    """
    order = F.xxhash64("node")
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near")
        best = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("near").alias("o"), F.col("near").alias("n"))).alias("m"))
        hook = best.select("node", F.when(F.struct(F.col("m.o"), F.col("m.n")) < F.struct(order, F.col("node")), F.col("m.n")).otherwise(F.col("node")).alias("up"))
        hook = written(hook, "hook")
        upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = written(hook.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "parent")
        remove(hook)
        pa, pb = parent.toDF("a", "ua"), parent.toDF("b", "ub")
        new = edges.join(pa, "a").join(pb, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        new = written(new, "edges")
        if labels is None:
            moved = parent.toDF("node", "component")
        else:
            up = parent.toDF("component", "up")
            moved = written(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
            remove(labels)
            remove(parent)
        remove(edges)
        labels, edges = moved, new
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
