"""Ordered work on groups of any size: time slices of a bounded number of rows, and what is carried over their edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task sorts at most, where times differ by a second.
MOST = 2_000_000
#: Seconds of the slices that a day with more rows is cut into; the first that will do is taken.
WIDTHS = (3600, 60, 1)
DAY = 86_400
#: Rows of a table that is broadcast at most, each a key and two numbers.
SMALL = 100_000


def seconds(at: str) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be joined: broadcast if it has so few rows (as counted), else left to the join."""
    return F.broadcast(df) if rows <= SMALL else df


def sliced(rows: DataFrame, by: Sequence[str], at: str, most: int | None = None) -> DataFrame:
    """rows with `_slot`, the first second of a slice: a day, or less on a group's days of over `most` rows.

    Days are counted first. Those with more rows are counted by the second, and get the widest slices of
    which none has more. Rows without a time have no slot.
    """
    most = MOST if most is None else most
    second = seconds(at)
    whole = F.floor(second / DAY) * DAY
    counts = rows.where(F.col(at).isNotNull()).groupBy(*by, whole.alias("_day")).count()
    heavy = counts.where(F.col("count") > most).drop("count")
    n = heavy.count()
    if not n:
        return rows.withColumn("_slot", whole)
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in (*by, "_day")]
    dated = rows.withColumns({"_day": whole, "_second": second})
    h = small(heavy, n)
    fine = dated.join(h, same(dated, h), "left_semi").groupBy(*by, "_day", "_second").count()
    levels = F.array(*(F.struct(F.lit(w).alias("width"), F.floor(F.col("_second") / w).alias("place")) for w in WIDTHS))
    sums = fine.select(*by, "_day", "count", F.inline(levels)).groupBy(*by, "_day", "width", "place").agg(F.sum("count").alias("n"))
    peaks = sums.groupBy(*by, "_day", "width").agg(F.max("n").alias("n"))
    fits = peaks.groupBy(*by, "_day").agg(F.coalesce(F.max(F.when(F.col("n") <= most, F.col("width"))), F.lit(WIDTHS[-1])).alias("_width"))
    fits = small(fits.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_day"])), "_width"), n)
    on = [dated[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_day"])]
    slot = F.when(F.col("_width").isNull(), F.col("_day")).otherwise(F.floor(F.col("_second") / F.col("_width")) * F.col("_width"))
    return dated.join(fits, on, "left").withColumn("_slot", slot).select(*rows.columns, "_slot")


def with_edges(rows: DataFrame, by: Sequence[str], at: str, columns: Sequence[str], order: Sequence[str] = (), where: Column | None = None, back: bool = True, most: int | None = None) -> DataFrame:
    """rows in slices (`_slot`), and for each slice one more row (`_edge` true): it holds `columns` of
    the last row before the slice (back) or of the first row after it, in order of (at, *order), of those for which
    `where` holds.

    So a window over (*by, _slot) that puts the edge first (or last) sees what a window over the whole group
    would, as far as one row goes. Only one row a slice is sorted by the group as a whole.
    """
    cut = sliced(rows, by, at, most)
    key = F.struct(at, *order)
    pick = F.max_by if back else F.min_by
    ends = cut.groupBy(*by, "_slot").agg(pick(F.struct(*columns), key if where is None else F.when(where, key)).alias("_end"))
    over = Window.partitionBy(*by).orderBy(F.asc("_slot") if back else F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last("_end", ignorenulls=True).over(over)
    edge = ends.withColumn("_end", found).where("_end IS NOT NULL")
    edge = edge.select(*by, "_slot", *(F.col("_end")[c].alias(c) for c in columns if c not in by), F.lit(True).alias("_edge"))
    return cut.withColumn("_edge", F.lit(False)).unionByName(edge, allowMissingColumns=True)


def in_slice(by: Sequence[str], *order: str | Column, back: bool = True):
    """The window over a slice with its edge first (back) or last."""
    return Window.partitionBy(*by, "_slot").orderBy(F.desc("_edge") if back else F.asc("_edge"), *order)


def value_cuts(rows: DataFrame, value: Column, by: Sequence[str], parts: int) -> DataFrame:
    """(by, _cuts): numbers that cut each group's values into about `parts` equal shares."""
    shares = F.array(*(F.lit((k + 1) / parts) for k in range(parts - 1)))
    return rows.groupBy(*by).agg(F.percentile_approx(value, shares, max(1000, 20 * parts)).alias("_cuts"))


def ranked(rows: DataFrame, value: str, by: Sequence[str] = (), parts: int = 64, name: str = "rank") -> DataFrame:
    """rows with `rank`: 1 and up by value within the group, tied values sharing their mean rank; null for null.

    Distinct values are counted, cut into `parts` ranges, and added up within each range; a range
    starts from the counts of those before it. Ties are never cut, since they are one counted row; no task
    sees a whole group.
    """
    x = F.col(value)
    counts = rows.where(x.isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        cuts = value_cuts(rows, x, by, parts).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_cuts")
        counts = counts.join(cuts, [counts[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
        part = F.aggregate("_cuts", F.lit(0), lambda a, c: a + (c < x).cast("int"))
        counts = counts.withColumn("_part", part).drop("_cuts", *(f"_k{i}" for i in range(len(by))))
        before = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
        before = before.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_m"))  # parts rows a group
        before = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_part"])), "_before")
        counts = counts.join(before, [counts[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_part"])])
    else:
        ends = value_cuts(rows, x, (), parts).first()["_cuts"] or []
        part = sum((F.lit(1) * (x > e).cast("int") for e in sorted(set(ends))), F.lit(0))
        counts = counts.withColumn("_part", part)
        sums, total = [0] * (len(ends) + 1), 0
        for r in counts.groupBy("_part").agg(F.sum("_n").alias("_m")).orderBy("_part").collect():  # parts rows
            sums[r["_part"]], total = total, total + r["_m"]
        counts = counts.withColumn("_before", F.get(F.array(*(F.lit(s).cast("long") for s in sums)), F.col("_part")))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(value))
    mean = F.col("_before") + upto - (F.col("_n") - 1) / 2
    found = counts.withColumn(name, mean).select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate([*by, value])), name)
    return rows.join(found, [rows[c].eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate([*by, value])], "left").select(*rows.columns, name)
