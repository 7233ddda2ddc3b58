"""Exact quantiles of groups of any size: counts in ever finer buckets, then one small bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .ranges import SMALL

#: Values of a group that are sorted in one buffer at most.
MOST = 100_000
#: Buckets that a bucket is cut into.
FINER = 1024


def crowded(rows: DataFrame, by: Sequence[str], most: int | None = None) -> bool:
    """Whether a group has more than `most` rows."""
    found = rows.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (found or 0) > (MOST if most is None else most)


def quantiles(rows: DataFrame, by: Sequence[str], values: Mapping[str, tuple[Column, float]], most: int | None = None, heavy: bool | None = None) -> DataFrame:
    """(by, names): for each name the share-quantile of its values, interpolated between ranks; null without values.

    Groups of up to `most` rows are sorted by Spark's own percentile. Of larger ones no task holds more than
    `most` values: see refined. `heavy` tells whether there are such groups, if the caller knows. NaN counts as null.
    """
    most = MOST if most is None else most
    heavy = crowded(rows, by, most) if heavy is None else heavy
    value = {k: F.when(~F.isnan(v.cast("double")), v.cast("double")) for k, (v, _) in values.items()}
    plain = lambda d: d.groupBy(*by).agg(*(F.percentile(F.col(f"_{k}"), share).alias(k) for k, (_, share) in values.items()))
    rows = rows.select(*by, *(v.alias(f"_{k}") for k, v in value.items()))
    if not heavy:
        return plain(rows)
    sizes = staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    big = sizes.where(F.col("_size") > most).select(*by)
    n = big.count()
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by] or F.lit(True)
    few = F.broadcast(big) if n <= SMALL else big
    large = rows.join(few, same(rows, few), "left_semi") if by else rows
    out = big if by else rows.sparkSession.range(1).select()
    for k, (_, share) in values.items():
        one = refined(large.select(*by, F.col(f"_{k}").alias("x")).where("x IS NOT NULL"), by, share, most).withColumnRenamed("q", k)
        keys = one.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), k)
        out = out.join(keys, [out[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] or F.lit(True), "left").drop(*(f"_k{i}" for i in range(len(by))))
    if not by:
        return out
    return plain(rows.join(few, same(rows, few), "left_anti")).unionByName(out)


def refined(rows: DataFrame, by: Sequence[str], share: float, most: int) -> DataFrame:
    """(by, q) of rows (by, x), x not null.

    The buckets of the first pass are powers of two (a few thousand for any numbers), those of later passes FINER
    equal parts of the bucket that holds the wanted rank. Passes end when that has one value or `most` rows;
    only these are then sorted. Each pass reads the rows of the open buckets only.
    """
    power = F.floor(F.log2(F.abs("x"))) + 2000
    first = F.when(F.col("x") == 0, 0).when(F.col("x") > 0, power).otherwise(-power)
    part = rows.withColumn("_path", F.lit("")).withColumn("_bucket", first.cast("long"))
    wanted, done = None, None
    while True:
        hist = part.groupBy(*by, "_path", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        hist = hist.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by, "_path").orderBy("_bucket")) - F.col("_n"))  # a row a bucket
        if wanted is None:
            total = hist.groupBy(*by).agg(F.sum("_n").alias("_size")).withColumn("_exact", share * (F.col("_size") - 1)).withColumn("_path", F.lit(""))
            wanted = total.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_exact"), F.ceil("_exact"))))).select(*by, "_path", "_rank", F.col("_rank").alias("_place"), "_exact")
        w = wanted.alias("w")
        on = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*by, "_path")]
        hit = w.join(hist.alias("h"), on).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        path = F.concat_ws("/", F.col("w._path"), F.col("_bucket"))
        hit = hit.select(*(F.col(f"w.{c}").alias(c) for c in by), F.col("w._path").alias("_old"), "_bucket", path.alias("_path"), (F.col("_rank") - F.col("_before")).alias("_rank"), "_place", "_exact", "_n", "_lo", "_hi")
        hit = staged(hit, "ranks")
        ready = hit.where("_lo = _hi").select(*by, "_place", "_exact", F.col("_lo").alias("_value"))
        done = ready if done is None else done.unionByName(ready)
        left = hit.where("_lo < _hi")
        inside = left.select(*by, "_old", "_bucket", "_path", "_n", "_lo", "_hi").distinct()
        here = part.alias("p").join(F.broadcast(inside.alias("i")) if inside.count() <= SMALL else inside.alias("i"), [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in by] + [F.col("p._path") == F.col("i._old"), F.col("p._bucket") == F.col("i._bucket")])
        here = here.select(*(F.col(f"p.{c}").alias(c) for c in by), "x", F.col("i._path").alias("_path"), "_n", "_lo", "_hi")
        # What fits into a buffer is sorted, the rest cut on.
        ends = here.where(F.col("_n") <= most).groupBy(*by, "_path").agg(F.sort_array(F.collect_list("x")).alias("_xs"))
        l = left.where(F.col("_n") <= most).alias("l")
        read = l.join(ends.alias("e"), [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*by, "_path")])
        done = done.unionByName(read.select(*(F.col(f"l.{c}").alias(c) for c in by), "_place", "_exact", F.element_at("_xs", (F.col("_rank") + 1).cast("int")).alias("_value")))
        wanted = left.where(F.col("_n") > most).select(*by, "_path", "_rank", "_place", "_exact")
        if wanted.isEmpty():
            break
        step = F.floor((F.col("x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * FINER)  # halves: no overflow
        part = here.where(F.col("_n") > most).select(*by, "x", "_path", F.least(F.lit(FINER - 1), step).cast("long").alias("_bucket"))
    lo, hi = F.min_by("_value", "_place"), F.max_by("_value", "_place")
    return done.groupBy(*by).agg((lo + (hi - lo) * F.first(F.col("_exact") - F.floor("_exact"))).alias("q"))
