"""Changepoints of each group's series: the segments that cost least under a Gaussian kernel."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Breaks are looked for at multiples of JUMP; scaled distances are held within these bounds.
JUMP, LEAST_DISTANCE, MOST_DISTANCE = 5, 0.01, 100.0


def pair_median(x: np.ndarray) -> float:
    """The median of the squared differences of all pairs, by counting pairs within a distance: no pair is stored."""
    x = np.sort(x)
    n = len(x)
    pairs = n * (n - 1) // 2

    def kth(k: int) -> float:
        """The k-th least distance (from 1), found bit by bit: doubles from zero up are ordered like their bits."""
        lo, hi = -1, int(np.float64(x[-1] - x[0]).view(np.int64))
        while hi - lo > 1:
            mid = (lo + hi) // 2
            reach = x + np.int64(mid).view(np.float64)
            if int((np.searchsorted(x, reach, "right") - np.arange(n) - 1).sum()) >= k:
                hi = mid
            else:
                lo = mid
        return float(np.int64(hi).view(np.float64))

    if not pairs:
        return 0.0
    low = kth((pairs + 1) // 2) ** 2
    return low if pairs % 2 else (low + kth(pairs // 2 + 1) ** 2) / 2


def segments(x: np.ndarray, penalty: float, least: int, jump: int = JUMP) -> list[int]:
    """Ends of the segments, the last one len(x), that minimise the sum of their costs and a penalty each.

    A segment's cost is its length less the mean of its kernel values times its length; the kernel's width comes
    from the median squared difference. Segments have `least` values or more; inner ends are multiples of jump.
    Kernel sums of all open starts grow by one column of the kernel at a time, so memory is linear. A start is
    dropped when a later one is better for every end that both allow.
    """
    n = len(x)
    if n < 2 * least:
        return [n]
    scale = pair_median(x)
    scale = 1 / scale if scale > 0 else 1.0
    total = np.zeros(n)  # of the kernel over [start, end) squared
    best, last = {0: -penalty}, {0: 0}
    open_, closing = [0], []  # starts; (end from which on a start is dropped, start)
    for end in range(1, n + 1):
        first = open_[0]
        k = np.exp(-np.clip(np.square(x[first:end] - x[end - 1]) * scale, LEAST_DISTANCE, MOST_DISTANCE))
        k[-1] = 1.0
        total[first:end] += 2 * np.cumsum(k[::-1])[::-1] - 1
        if end < least or (end % jump and end < n):
            continue
        gone = {s for e, s in closing if e <= end}
        open_, closing = [s for s in open_ if s not in gone], [(e, s) for e, s in closing if e > end]
        able = [s for s in open_ if end - s >= least]
        at = np.array(able)
        value = np.array([best[s] for s in able]) + (end - at) - total[at] / (end - at) + penalty
        k_best = int(value.argmin())
        best[end], last[end] = float(value[k_best]), able[k_best]
        # Splitting a segment never costs more, so such a start loses to `end` wherever `end` may be a start.
        closing += [(end + least, s) for s, v in zip(able, value, strict=True) if v - penalty > best[end]]
        if end < n:
            open_.append(end)
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = last[at]
    return ends[::-1]


def breaks(x: np.ndarray, least: int) -> list[int]:
    """Inner ends of the segments under a penalty of 2 ln n; none of a series too short for three segments."""
    return segments(x, 2 * math.log(len(x)), least)[:-1] if len(x) >= 3 * least else []


def changepoints(rows: DataFrame, by: Sequence[str], at: str, value: str, least: int = 6, spread: int = 6) -> DataFrame:
    """(by, series, at): the last row of each segment but the last, of the values ('level') and of their rolling standard
    deviation over `spread` values ('spread'). Groups are held whole (a day of one symbol); nulls are left out."""
    ship(rows.sparkSession)
    made = rows.select(*by, at, F.col(value).cast("double").alias("_x"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        out = []
        for name, series in (("level", group["_x"]), ("spread", group["_x"].rolling(spread).std())):
            kept = series.notna()
            times = group.loc[kept, at].tolist()
            out += [(name, times[e - 1]) for e in breaks(series[kept].to_numpy(float), least)]
        found = pd.DataFrame(out, columns=["series", at])
        for c in by:
            found[c] = group[c].iloc[0]
        return found[[*by, "series", at]]

    schema = made.select(*by, F.lit("").alias("series"), at).schema
    return made.groupBy(*by).applyInPandas(run, schema)


def phases(rows: DataFrame, by: Sequence[str], at: str, price: str, least: int = 20, most: int = 8, penalty: float = 5.0) -> DataFrame:
    """(by, phase, first, last): each group's phases of its standardised log price, 1 and up; neighbours share a row.

    The penalty grows by half until there are `most` phases or fewer. A group of under two least segments, or of one
    price, is one phase.
    """
    ship(rows.sparkSession)
    made = rows.where(F.col(price) > 0).select(*by, at, F.log(F.col(price)).alias("_x"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        x, times = group["_x"].to_numpy(float), group[at].tolist()
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        ends = [len(x)]
        if len(x) >= 2 * least and sd >= 1e-9:
            z, p = (x - x.mean()) / sd, penalty
            while len(ends := segments(z, p, least)) > most:
                p *= 1.5
        marks = [0, *(e - 1 for e in ends)]
        found = pd.DataFrame([(k + 1, times[a], times[b]) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))], columns=["phase", "first_ts", "last_ts"])
        for c in by:
            found[c] = group[c].iloc[0]
        return found[[*by, "phase", "first_ts", "last_ts"]]

    schema = made.select(*by, F.lit(0).cast("long").alias("phase"), F.col(at).alias("first_ts"), F.col(at).alias("last_ts")).schema
    return made.groupBy(*by).applyInPandas(run, schema)
