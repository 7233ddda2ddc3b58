"""Exponential averages and spreads and rolling medians of whole series, by blocks of rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .intervals import running
from .ranges import sliced

#: What lies so many blocks (of block_of rows) before a row's own has a weight under 2^-900, and does not count.
BEHIND = 16
#: Rows of a block of a rolling median.
BLOCK = 50_000


def numbered(rows: DataFrame, by: Sequence[str], order: str, most: int | None = None) -> DataFrame:
    """rows with `_n`, 0 and up in the group's order of time; counted within slices of time, from the counts before."""
    cut = sliced(rows, by, order, most).withColumn("_n", F.lit(1).cast("long"))
    return running(cut, list(by), F.col("_slot"), [order], ["_n"]).withColumn("_n", F.col("_n") - 1).drop("_slot")


def ema(rows: DataFrame, by: list[str], order: str, value: str, span: float) -> DataFrame:
    """rows with `ema`: e = e * (1 - a) + value * a, a = 2 / (span + 1), from the group's first value on.

    Rows are numbered and cut into blocks so long that what lies before the last block has
    decayed below a double's precision. Within a block the average is a running sum of values
    over powers of the decay; the block before it adds one number. Linear in the rows.
    Null values are not allowed.
    """
    a = 2 / (span + 1)
    keep = 1 - a
    block = block_of(keep)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    rows = rows.withColumn("_n", number).withColumns({"_b": F.floor(F.col("_n") / block), "_i": F.col("_n") % block})
    # The first value of a group is its start: it counts whole.
    share = F.when(F.col("_n") == 0, F.col(value)).otherwise(F.col(value) * a)
    over = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(share * F.pow(F.lit(keep), -F.col("_i"))).over(over) * F.pow(F.lit(keep), "_i"))
    last = rows.groupBy(*by, "_b").agg(F.max_by("_s", "_i").alias("_last")).withColumn("_b", F.col("_b") + 1)
    rows = rows.join(last, [*by, "_b"], "left")
    carried = F.coalesce(F.col("_last") * F.pow(F.lit(keep), F.col("_i") + 1), F.lit(0.0))
    return rows.withColumn("ema", F.col("_s") + carried).drop("_n", "_b", "_i", "_s", "_last")


def block_of(keep: float) -> int:
    """Rows after which a weight has fallen by 2^60."""
    return max(2, math.ceil(60 * math.log(2) / -math.log(keep)))


def ewm_spread(rows: DataFrame, by: Sequence[str], order: str, value: str, span: float, least: int, name: str = "sigma", backfill: bool = False, block: int | None = None, most: int | None = None) -> DataFrame:
    """rows with the exponentially weighted standard deviation, corrected for bias; null before `least` values.

    A value k rows back weighs (1 - 2 / (span + 1)) ** k; nulls weigh nothing but count as rows. Each block of rows
    sums weights, squared weights, weighted values and weighted squares, and carries the four sums and the count to the
    next: the sums of BEHIND blocks, decayed, are added to those of a row's own. No task sees a whole series.
    backfill gives the rows before `least` values the first spread (which looks ahead).
    """
    keep = 1 - 2 / (span + 1)
    block = min(block or block_of(keep), block_of(keep))
    x, here = F.col(value).cast("double"), F.col(value).isNotNull()
    rows = numbered(rows, by, order, most).withColumns({"_b": F.floor(F.col("_n") / block), "_i": F.col("_n") % block})
    up = F.pow(F.lit(keep), -F.col("_i"))
    terms = {"_w": F.when(here, up), "_w2": F.when(here, up * up), "_s": up * x, "_q": up * x * x, "_c": F.when(here, 1.0)}
    down = {"_w": 1, "_w2": 2, "_s": 1, "_q": 1, "_c": 0}  # how often a sum decays at each row
    over = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    decay = lambda k, i: F.pow(F.lit(keep), i * down[k]) if down[k] else F.lit(1.0)
    rows = rows.withColumns({k: F.coalesce(F.sum(t).over(over), F.lit(0.0)) * decay(k, F.col("_i")) for k, t in terms.items()})
    ends = rows.groupBy(*by, "_b").agg(F.max_by(F.struct(*terms), "_i").alias("_end"))
    behind = math.ceil(BEHIND * block_of(keep) / block)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(-behind, -1)  # a row a block
    zero = F.struct(*(F.lit(0.0).alias(k) for k in terms))
    add = lambda a, e: F.struct(*((a[k] * (keep ** (block * down[k])) + e[k]).alias(k) for k in terms))
    carried = ends.withColumn("_carried", F.aggregate(F.collect_list("_end").over(before), zero, add)).drop("_end")
    # The count is that of all blocks before.
    total = F.coalesce(F.sum("_end._c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = ends.withColumn("_all", total).join(carried, [*by, "_b"]).drop("_end")
    rows = rows.join(carried, [*by, "_b"])
    whole = {k: F.col(k) + F.col("_carried")[k] * decay(k, F.col("_i") + 1) for k in ("_w", "_w2", "_s", "_q")}
    rows = rows.withColumns({**whole, "_c": F.col("_c") + F.col("_all")})
    spread = F.col("_q") / F.col("_w") - F.pow(F.col("_s") / F.col("_w"), 2)
    free = F.pow("_w", 2) - F.col("_w2")
    sigma = F.when((F.col("_c") >= max(least, 2)) & (free > 0), F.sqrt(F.greatest(spread, F.lit(0.0)) * F.pow("_w", 2) / free))
    out = rows.withColumn(name, sigma).drop("_b", "_i", "_all", "_carried", *terms)
    if backfill:
        first = out.where(F.col(name).isNotNull()).groupBy(*by).agg(F.min_by(name, "_n").alias("_first"))
        out = out.join(first, [*by], "left").withColumn(name, F.coalesce(name, "_first")).drop("_first")
    return out.drop("_n")


def medians(values: Sequence[float | None], window: int, least: int) -> Iterator[float | None]:
    """The median of the last `window` values at each place, None under `least` values (None ones do not count).

    Two heaps, the lower and the upper half; what has left the window is dropped when it comes to the top.
    """
    low: list[tuple[float, int]] = []  # negated: the largest first
    high: list[tuple[float, int]] = []
    lower: dict[int, bool] = {}  # of the values in the window: whether in the lower half
    n_low = n_high = 0

    def top(heap: list[tuple[float, int]], side: bool) -> tuple[float, int]:
        while lower.get(heap[0][1]) is not side:
            heapq.heappop(heap)
        return heap[0]

    for i, v in enumerate(values):
        gone = lower.pop(i - window, None)
        n_low, n_high = n_low - (gone is True), n_high - (gone is False)
        if v is not None and v == v:
            if not n_low or v <= -top(low, True)[0]:
                heapq.heappush(low, (-v, i))
                lower[i], n_low = True, n_low + 1
            else:
                heapq.heappush(high, (v, i))
                lower[i], n_high = False, n_high + 1
        while n_low > n_high + 1:
            x, k = top(low, True)
            heapq.heappop(low)
            heapq.heappush(high, (-x, k))
            lower[k], n_low, n_high = False, n_low - 1, n_high + 1
        while n_high > n_low:
            x, k = top(high, False)
            heapq.heappop(high)
            heapq.heappush(low, (-x, k))
            lower[k], n_low, n_high = True, n_low + 1, n_high - 1
        if n_low + n_high < max(1, least):
            yield None
        else:
            a = -top(low, True)[0]
            yield a if n_low > n_high else (a + top(high, False)[0]) / 2


def rolling_median(rows: DataFrame, by: Sequence[str], order: str, value: str, window: int, least: int, name: str = "median", block: int | None = None, most: int | None = None) -> DataFrame:
    """(by, order, name): the median of the last `window` rows' values, null under `least` values.

    Rows are numbered and cut into blocks; the last window - 1 rows of a block also go to the next. So a row is sent
    twice at most (for blocks of a window or more), and costs the logarithm of the window.
    """
    block = max(block or BLOCK, window)
    rows = numbered(rows.select(*by, order, F.col(value).cast("double").alias("_x")), by, order, most)
    mine = F.floor(F.col("_n") / block)
    more = F.when(F.col("_n") % block >= block - window + 1, F.array(mine, mine + 1)).otherwise(F.array(mine))
    spread = rows.withColumn("_b", F.explode(more))
    schema = spread.select(*by, order, F.lit(None).cast("double").alias(name)).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n", ignore_index=True)
        own = group["_n"] // block == group["_b"].iloc[0]
        x = [None if v is None or v != v else float(v) for v in group["_x"]]
        group[name] = pd.Series(list(medians(x, window, least)), dtype="float64")
        return group.loc[own, [*by, order, name]]

    ship(rows.sparkSession)
    return spread.groupBy(*by, "_b").applyInPandas(run, schema)
