"""Accumulation and distribution rules over bars: features, gates, edges, cooldowns and outcomes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.stage import staged
from .asof import asof_join


@dataclass(frozen=True)
class Rules:
    """Thresholds; windows are in bars, times in minutes. The defaults are those of one-minute bars."""

    imb_window: int = 30
    buy_thresh: float = 0.20
    sell_thresh: float = -0.20
    relvol_fast: int = 10
    relvol_slow: int = 50
    relvol_thresh: float = 1.25
    clv_smooth: int = 10
    open_from_min: int = 5
    open_window_min: int = 75
    open_high_min: int = 15
    below_vwap_bars: int = 15
    reclaim_bars: int = 10
    cooldown_min: int = 30
    buy_cutoff_min: int = 330
    runup_gate: float | None = 0.10
    prior_vwap_gate: bool = True
    gap_gate: bool = True
    target_pct: float = 1.25
    bar_min: int = 1
    open_at_min: int = 570

    def scaled(self, bar_min: int) -> Rules:
        """The windows for bars of bar_min minutes: as many minutes, one bar at least."""
        bars = lambda n: max(1, round(n * self.bar_min / bar_min))
        names = ("imb_window", "relvol_fast", "relvol_slow", "clv_smooth", "below_vwap_bars", "reclaim_bars")
        return replace(self, bar_min=bar_min, **{n: bars(getattr(self, n)) for n in names})

    def loosened(self) -> Rules:
        """The rules with lower thresholds and without the gates of context, to see whether they fire at all."""
        return replace(self, buy_thresh=self.buy_thresh * 0.7, sell_thresh=self.sell_thresh * 0.7, relvol_thresh=min(1.0, self.relvol_thresh), runup_gate=None, prior_vwap_gate=False, gap_gate=False, open_high_min=24 * 60)

    def earlier(self) -> Rules:
        """The first version of the rules, without the gates that came later."""
        return replace(self, buy_cutoff_min=390 * max(1, self.bar_min), runup_gate=None, prior_vwap_gate=False)


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol", "day").orderBy("ts")


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def so_far() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def _full(agg, column: Column | str, n: int, count: str | None = None) -> Column:
    """agg over the last n bars, null until there are n (or n values of `count`)."""
    over = by_symbol().rowsBetween(1 - n, 0)
    return F.when(F.count(count or F.lit(1)).over(over) >= n, agg(column).over(over))


def features(bars: DataFrame, p: Rules) -> DataFrame:
    """bars (symbol, day, ts, open, high, low, close, volume) with the rules' features.

    Rolling windows go on over days, running ones start with each day. Zero volume and
    zero range give null shares and a location of 0. Three sorts: by symbol, by day, and a join
    with one row a day.
    """
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_day())), F.lit(0.0))
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    minute = F.hour("ts") * 60 + F.minute("ts") - p.open_at_min
    df = bars.withColumns(
        {
            "sv": sign * F.col("volume"),
            "clv": F.coalesce(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread, F.lit(0.0)),
            "vwap": F.sum(price * F.col("volume")).over(so_far()) / F.nullif(F.sum("volume").over(so_far()), F.lit(0)),
            "min_of_day": minute,
            "day_high": F.max("high").over(so_far()),
        }
    )
    df = df.withColumns(
        {
            "imb": _full(F.sum, "sv", p.imb_window) / F.nullif(_full(F.sum, "volume", p.imb_window), F.lit(0)),
            "relvol": _full(F.avg, "volume", p.relvol_fast) / F.nullif(_full(F.avg, "volume", p.relvol_slow), F.lit(0.0)),
            "clv_s": _full(F.avg, "clv", p.clv_smooth),
            "above": F.coalesce(F.col("close") > F.col("vwap"), F.lit(False)),
            "cum": F.sum("sv").over(so_far()),
            "day_imb": F.sum("sv").over(so_far()) / F.nullif(F.sum("volume").over(so_far()), F.lit(0)),
            "hod_min": F.last(F.when(F.col("high") >= F.col("day_high"), F.col("min_of_day")), ignorenulls=True).over(so_far()),
        }
    )
    touched = F.coalesce((F.col("high") >= F.col("vwap")) & ~F.col("above"), F.lit(False)).cast("int")
    df = df.withColumns(
        {
            "cum_high": F.max("cum").over(so_far()),
            "island": F.sum(F.col("above").cast("int")).over(so_far()),
            # Before there are enough bars a reclaim counts as failed.
            "failed_reclaim": F.coalesce(_full(F.max, touched, p.reclaim_bars) == 1, F.lit(True)),
        }
    )
    streak = Window.partitionBy("symbol", "day", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("streak", F.sum((~F.col("above")).cast("int")).over(streak))
    days = df.groupBy("symbol", "day").agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"), F.max_by("vwap", "ts").alias("v"))
    before = Window.partitionBy("symbol").orderBy("day")
    lagged = lambda c, k=1: F.lag(c, k).over(before)
    days = days.select("symbol", "day", F.coalesce(F.col("o") >= lagged("c"), F.lit(False)).alias("gap_up"), lagged("v").alias("prior_vwap"), (lagged("c") / lagged("c", 4) - 1).alias("runup_3d"))
    return df.join(days, ["symbol", "day"])


def gates(p: Rules) -> dict[str, Column]:
    """Each rule's gates but for the flow thresholds; a null gate does not hold, a null run-up does not stop."""
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    rested = ~no(c("runup_3d") > p.runup_gate) if p.runup_gate is not None else F.lit(True)
    buy = (c("min_of_day") >= p.imb_window * p.bar_min) & (c("min_of_day") <= p.buy_cutoff_min) & rested & c("above") & (c("relvol") >= p.relvol_thresh) & (c("clv_s") > 0) & (c("cum") >= c("cum_high"))
    context = (c("close") < c("prior_vwap")) | c("prior_vwap").isNull() if p.prior_vwap_gate else F.lit(True)
    gap = c("gap_up") if p.gap_gate else F.lit(True)
    opening = c("min_of_day").between(p.open_from_min, p.open_window_min) & (c("hod_min") <= p.open_high_min) & gap & context & ~c("above") & (c("relvol") >= p.relvol_thresh)
    return {"accumulation": no(buy), "opening-rejection": no(opening), "distribution": no((c("streak") >= p.below_vwap_bars) & (c("clv_s") < 0))}


def holds(trigger: str, buy: Column, sell: Column, prefix: str = "") -> Column:
    """Whether a trigger's gates and flow thresholds hold, of this bar or, by a prefix, of another."""
    c = lambda name: F.col(prefix + name)
    gate = c(trigger)
    flow = {"accumulation": c("imb") >= buy, "opening-rejection": c("day_imb") <= sell, "distribution": (c("imb") <= sell) & (c("failed_reclaim") | (c("day_imb") <= sell))}
    return F.coalesce(gate & flow[trigger], F.lit(False))


def cooled(rows: DataFrame, by: list[str], minutes: int) -> DataFrame:
    """rows (…, ts) that a chronological sweep of each group keeps: none within `minutes` of the last kept one.

    A fold over one group's rows; put a day into `by` to bound it.
    """
    others = [c for c in rows.columns if c not in (*by, "ts")]
    items = F.sort_array(F.collect_list(F.struct("ts", *others)))
    grouped = rows.groupBy(*by).agg(items.alias("rows"))
    at = lambda x: F.unix_timestamp(x["ts"].cast("timestamp"))
    empty = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", empty, lambda a, x: F.when((F.size(a) == 0) | (at(x) - at(F.element_at(a, -1)) >= minutes * 60), F.concat(a, F.array(x))).otherwise(a))
    return grouped.select(*by, F.inline(kept)).select(*rows.columns)


def edges(feat: DataFrame, p: Rules, grid: DataFrame | None = None) -> DataFrame:
    """(trial columns, symbol, day, ts, trigger, signal, price, imb): bars at which a rule begins to hold.

    grid: a small table (buy_thresh, sell_thresh) of threshold pairs, each judged on the same features.
    """
    marked = feat.withColumns(gates(p))
    names = [*gates(p), "imb", "day_imb", "failed_reclaim"]
    marked = marked.withColumns({f"was_{n}": F.lag(n).over(by_symbol()) for n in names})
    marked = marked.where(" OR ".join(f"`{g}`" for g in gates(p)))
    trial = []
    if grid is not None:
        marked, trial = marked.crossJoin(F.broadcast(grid)), grid.columns  # a few rows
    buy, sell = (F.col("buy_thresh"), F.col("sell_thresh")) if grid is not None else (F.lit(p.buy_thresh), F.lit(p.sell_thresh))
    found = [F.when(holds(g, buy, sell) & ~holds(g, buy, sell, "was_"), F.lit(g)) for g in gates(p)]
    out = marked.withColumn("trigger", F.explode(F.array_compact(F.array(*found))))
    side = F.when(F.col("trigger") == "accumulation", "BUY").otherwise("SELL")
    return out.select(*trial, "symbol", "day", "ts", "trigger", side.alias("signal"), F.col("close").alias("price"), F.round("imb", 3).alias("imb"))


def signals(feat: DataFrame, p: Rules, grid: DataFrame | None = None) -> DataFrame:
    """The edges that two sweeps keep: of each trigger by itself, then of each side, within a day.
    At one time the first trigger by name stays."""
    trial = grid.columns if grid is not None else []
    once = cooled(edges(feat, p, grid), [*trial, "symbol", "day", "trigger"], p.cooldown_min)
    return cooled(once, [*trial, "symbol", "day", "signal"], p.cooldown_min)


def side(signal: Column) -> Column:
    return F.when(signal == "BUY", 1).otherwise(-1)


def later(feat: DataFrame, sig: DataFrame) -> DataFrame:
    """Each signal with the later bars of its day: move is the signed change in per cent."""
    path = feat.select("symbol", "day", F.col("ts").alias("bar_ts"), F.col("high").alias("bar_high"), F.col("low").alias("bar_low"), F.col("close").alias("bar_close"), F.col("vwap").alias("bar_vwap"))
    rows = sig.join(path, ["symbol", "day"]).where("bar_ts > ts")
    return rows.withColumn("move", (F.col("bar_close") / F.col("price") - 1) * 100 * side(F.col("signal")))


def outcomes(feat: DataFrame, sig: DataFrame, target_pct: float) -> DataFrame:
    """The rest of the day of each signal: mfe, mae, to_close, managed and exit.

    The exit is the first bar that closes at the target or across the day's average price; the
    target counts first. Signals at a day's last bar have no outcome.
    """
    crossed = F.when(F.col("signal") == "BUY", F.col("bar_close") < F.col("bar_vwap")).otherwise(F.col("bar_close") > F.col("bar_vwap"))
    target = F.col("move") >= target_pct
    first = F.min(F.when(target | crossed, F.struct(F.col("bar_ts").alias("at"), target.alias("target"), F.col("move").alias("move"))))
    out = later(feat, sig).groupBy("symbol", "day", "ts", "signal", "trigger", "price")
    out = out.agg(F.max("move").alias("mfe"), F.min("move").alias("mae"), F.max_by("move", "bar_ts").alias("to_close"), first.alias("first"))
    won = F.col("first")["target"]
    managed = F.when(won, target_pct).when(F.col("first").isNotNull(), F.col("first")["move"]).otherwise(F.col("to_close"))
    return out.withColumns({"managed": managed, "exit": F.when(won, "target").when(F.col("first").isNotNull(), "vwap-stop").otherwise("close")}).drop("first")


def forward(feat: DataFrame, sig: DataFrame, minutes: tuple[int, ...]) -> DataFrame:
    """sig with fwd_{m}m: the signed move to the last bar at or before m minutes later, on the same day."""
    after = (F.unix_timestamp(F.col("bar_ts").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60
    keys = ["symbol", "day", "ts", "signal", "trigger", "price"]
    moves = later(feat, sig).groupBy(*keys).agg(*(F.max_by("move", F.when(after <= m, F.col("bar_ts"))).alias(f"fwd_{m}m") for m in minutes))
    joined = sig.select(*keys).join(moves, keys, "left")
    return joined.select(*keys, *(F.coalesce(f"fwd_{m}m", F.lit(0.0)).alias(f"fwd_{m}m") for m in minutes))


def signal_features(feat: DataFrame, sig: DataFrame, trend_of: str, flow_of: str, slope: int = 15, spread: int = 30) -> DataFrame:
    """sig (symbol, day, ts, trigger, signal, …) with what is known at its bar; signals without a later bar that day go.

    cvd_slope is the slope of the cumulated flow over the last bars (3 at least) over their mean volume, realized_vol the
    spread of as many log returns. Two other symbols give context: the return since the open of trend_of and the
    relative volume of flow_of, of their last bar that day up to the signal.
    """
    last = by_symbol().rowsBetween(1 - slope, 0)
    f = feat.withColumns({"_x": F.row_number().over(by_symbol()), "_ret": F.log("close") - F.log(F.lag("close").over(by_day())), "_next": F.lead("ts").over(by_day()), "_open": F.first("open").over(so_far())})
    few = F.count(F.lit(1)).over(last) >= 3
    known = {
        "cvd_slope": F.when(few, F.regr_slope("cum", "_x").over(last) / F.nullif(F.avg("volume").over(last), F.lit(0.0))),
        "vwap_dist": (F.col("close") - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0)),
        "realized_vol": _full(F.stddev_samp, "_ret", spread, count="_ret"),
    }
    f = f.withColumns(known)
    names = ["relvol", "clv_s", "cvd_slope", "vwap_dist", "day_imb", "runup_3d", "min_of_day", "realized_vol"]
    rows = sig.join(f.where("_next IS NOT NULL").select("symbol", "ts", F.col("imb").alias("imb_now"), *names), ["symbol", "ts"])
    # As-of joins read their sides more than once, so these are written.
    rows = staged(rows, "signals")
    context = staged(f.where(F.col("symbol").isin(trend_of, flow_of)).select("symbol", "day", "ts", (F.col("close") / F.col("_open") - 1).alias("trend"), F.col("relvol").alias("flow")), "context")
    trend = context.where(F.col("symbol") == trend_of).select("day", "ts", "trend")
    flow = context.where(F.col("symbol") == flow_of).select("day", "ts", "flow")
    for other, name in ((trend, "trend"), (flow, "flow")):
        rows = asof_join(rows, other, "ts", ["day"], [name])
    kinds = {f"trig_{t.replace('-', '_')}": (F.col("trigger") == t).cast("int") for t in ("accumulation", "opening-rejection", "distribution")}
    return rows.withColumns({**kinds, "side_is_sell": (F.col("signal") == "SELL").cast("int")})
