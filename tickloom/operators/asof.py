"""As-of and interval joins without blow-up, on time slices of bounded size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .ranges import in_slice, seconds, small, with_edges

#: Rows and intervals of one time bucket that meet in one task at most.
CROWD = 200_000
#: How many finer buckets a crowded one is cut into.
FINER = 60
#: Pairs that are tried in a bucket of the first width at most before it is cut, where pairs are kept.
TILE = 1_000_000
#: Into how many it is cut then, if that leaves so many rows in each; else into FINER.
FEWER, TOGETHER = (10, 20), 300
#: Pairs that are tried in a task, about.
SHARE = 100_000_000


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], columns: Sequence[str], direction: str = "backward", most: int | None = None) -> DataFrame:
    """left with `columns` of the last right row at or before `on` (backward) or the first at or after (forward).

    Exact matches count. Of right rows with one time the last in (on, columns) order wins (forward: the first).
    Both sides are put together and sorted by slices of a key's time, at most `most` rows each; a slice
    begins with the last right row of those before it. So a hot key, or none at all, is spread over its
    slices, and no pair is built. Left rows with a null time get nulls; null keys match null keys.
    """
    back = direction == "backward"
    keep = F.struct(*columns)
    timed = left.where(F.col(on).isNotNull())
    nothing = F.lit(None).cast(right.select(keep.alias("s")).schema["s"].dataType)
    l = timed.select("*", nothing.alias("_right"), F.lit(1 if back else -1).alias("_side"))
    r = right.where(F.col(on).isNotNull()).select(*by, on, keep.alias("_right"), F.lit(0).alias("_side"))
    both = with_edges(l.unionByName(r, allowMissingColumns=True), by, on, ["_right"], ["_right"], F.col("_side") == 0, back, most)
    # Forward runs back in time: a frame that ends with the row is carried on, one that begins with it is read anew for every row.
    turn = F.asc if back else F.desc
    over = in_slice(by, turn(on), turn("_side"), turn("_right")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_right", ignorenulls=True).over(over)
    out = both.withColumn("_found", found).where(~F.col("_edge") & (F.col("_side") != 0)).select(*left.columns, *(F.col("_found")[c].alias(c) for c in columns))
    return out.unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)


def finer(width: int, parts: int) -> int:
    """The seconds of finer buckets, of which `parts` or more make up one of `width`."""
    return max(x for x in range(1, max(1, width // parts) + 1) if width % x == 0)


def interval_join(events: DataFrame, rows: DataFrame, start: str, stop: str, at: str, width_seconds: int, by: Sequence[str] = (), crowd: int | None = None, tile: int | None = None, share: int | None = None) -> DataFrame:
    """Pairs with start <= at <= stop by an equi-join on time buckets of width_seconds.

    An event is put into every bucket it touches, a row into one; choose the width near the usual length.
    Buckets are counted first: one in which more than `crowd` rows or events would meet is cut into FINER
    finer ones on both sides, down to a second, so a busy hour is no hot key. Where the pairs themselves are kept,
    give `tile`: a bucket in which more pairs would meet is cut once. So few rows are left in it that the pairs of
    one event after another name the same ones in the same order, which columnar files hold in little room. (An
    aggregate by event would get a row from each of the finer buckets.) Where there are many pairs, a task gets
    about `share` of them, however small its input. What is left are the pairs themselves. No nested loop.
    """
    crowd, tile, share = CROWD if crowd is None else crowd, math.inf if tile is None else tile, SHARE if share is None else share
    e = events.withColumns({"_since": seconds(start), "_until": seconds(stop)})
    r = rows.withColumn("_at", seconds(at)).where("_at IS NOT NULL")
    e = e.where("_since <= _until").withColumn("_width", F.lit(width_seconds)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_since") / width_seconds), F.floor(F.col("_until") / width_seconds))))
    r = r.withColumn("_width", F.lit(width_seconds)).withColumn("_bucket", F.floor(F.col("_at") / width_seconds))
    keys, width, pairs = [*by, "_width", "_bucket"], width_seconds, 0
    while width > 1:
        # Only buckets that both sides have: others meet nobody.
        met = e.groupBy(*keys).count().join(r.groupBy(*keys).agg(F.count("*").alias("_rows")), keys).where(F.col("_width") == width)
        over = F.greatest("count", "_rows") > crowd
        tries = F.col("count").cast("double") * F.col("_rows")
        cuts = over | (tries > tile) if width == width_seconds else over
        found = met.agg(F.count_if(cuts).alias("n"), F.count_if(over).alias("over"), F.sum(tries).alias("tries")).first()
        n, pairs = found["n"], pairs or found["tries"] or 0
        if not n:
            break
        fine = finer(width, FINER)
        some = reduce(lambda other, k: F.when(F.col("_rows") <= k * TOGETHER, finer(width, k)).otherwise(other), sorted(FEWER, reverse=True), F.lit(fine))
        mark = small(met.where(cuts).select(*keys, F.when(over, fine).otherwise(some).alias("_fine")), n)
        cut = F.col("_fine").isNotNull()
        # The finer buckets of an event are those of its part that lies in the crowded one.
        lo, hi = F.greatest(F.col("_since"), F.col("_bucket") * width), F.least(F.col("_until"), (F.col("_bucket") + 1) * width - 1)
        parts = F.when(cut, F.sequence(F.floor(lo / F.col("_fine")), F.floor(hi / F.col("_fine")))).otherwise(F.array("_bucket"))
        e = e.join(mark, keys, "left").withColumns({"_next": F.explode(parts), "_width": F.coalesce("_fine", "_width")}).drop("_bucket", "_fine").withColumnRenamed("_next", "_bucket")
        r = r.join(mark, keys, "left").withColumns({"_bucket": F.when(cut, F.floor(F.col("_at") / F.col("_fine"))).otherwise(F.col("_bucket")), "_width": F.coalesce("_fine", "_width")}).drop("_fine")
        width = fine
        if not found["over"]:
            break
    tasks = math.ceil(pairs / share)
    if tasks > e.sparkSession.sparkContext.defaultParallelism:
        e, r = e.repartition(tasks, *keys), r.repartition(tasks, *keys)
    r = r.drop("_at").hint("merge") if width < width_seconds else r.drop("_at")  # pairs come out bucket by bucket
    return e.join(r, keys).where(F.col(at).between(F.col(start), F.col(stop))).drop("_bucket", "_width", "_since", "_until")


def unmet(events: DataFrame, rows: DataFrame, start: str, stop: str, at: str, span_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """events for which no row has start <= at <= stop; stop is span_seconds after start.

    In time buckets of that length an interval is the end of one and the beginning of the next, so a bucket's
    last row and the next one's first tell whether there is any. Rows are reduced to two times a bucket; no pair
    is built, and events are only sent to be joined where buckets are too many to be broadcast.
    """
    span, micros = span_seconds * 1_000_000, lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: micros(c) - F.pmod(micros(c), F.lit(span))
    ends = rows.where(F.col(at).isNotNull()).groupBy(*by, bucket(at).alias("_bucket")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    of = lambda back, first, last: F.struct((F.col("_bucket") - back).alias("_bucket"), first.alias("_first"), last.alias("_last"))
    none = F.lit(None).cast(rows.schema[at].dataType)
    sides = ends.select(*by, F.inline(F.array(of(0, none, F.col("_last")), of(span, F.col("_first"), none))))
    sides = staged(sides.groupBy(*by, "_bucket").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")), "sides")
    sides = small(sides, sides.count()).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_bucket"])), "_first", "_last")
    placed = events.withColumn("_bucket", bucket(start))
    on = [placed[c] == F.col(f"_k{i}") for i, c in enumerate([*by, "_bucket"])]
    return placed.join(sides, [*on, (F.col("_last") >= F.col(start)) | (F.col("_first") <= F.col(stop))], "left_anti").drop("_bucket")
