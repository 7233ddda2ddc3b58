"""As-of and interval joins, event detection, flow, profiles, rules, labels and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf, t_two_sided
from ..functions.text import STOP, same_story, story_tokens
from ..operators.asof import TILE, asof_join, interval_join
from ..operators.changepoint import changepoints, phases
from ..operators.decompose import aligned, explained, market_model, share_left
from ..operators.islands import merge_islands
from ..operators.profile import value_area, volume_buckets, volume_profile
from ..operators.quantiles import crowded, quantiles
from ..operators.ranges import ranked
from ..operators.recurrences import ewm_spread, rolling_median
from ..sources.landed import Settings
from ..sources.market import bars, daily, fine_bars, news, quotes, read, trades
from .queries_core import CLV, RET, RET_S, S, SIGNED, VWAP, D, roll
from .registry import ORACLE_SQL, query, sql, undated
from .ship import ship

r6 = lambda c, name: F.round(c, 6).alias(name)

# --- as-of and interval joins


@query("jn1_asof_backward", "SELECT t.event_id, t.price, q.bid, q.ask FROM {trades} AS t ASOF LEFT JOIN {quotes} AS q ON t.symbol = q.symbol AND t.ts >= q.ts")
def _(spark: SparkSession, d: str) -> DataFrame:
    return asof_join(trades(spark, d), quotes(spark, d), "ts", ["symbol"], ["bid", "ask"]).select("event_id", "price", "bid", "ask")


@query("jn2_minutes_since", "SELECT t.event_id, round(CASE WHEN n.ts IS NULL THEN 1e4 ELSE least(1e4, (epoch_us(t.ts) - epoch_us(n.ts)) / 6e7) END, 4) AS minutes FROM {trades} AS t ASOF LEFT JOIN (SELECT ts FROM {news} WHERE source_type = 'press_release') AS n ON t.ts >= n.ts")
def _(spark, d):
    n = news(spark, d).where("source_type = 'press_release'").select("ts", F.col("ts").alias("seen"))
    t = asof_join(trades(spark, d), n, "ts", [], ["seen"])  # no key: one series, in slices of time
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.select("event_id", F.round(F.coalesce(F.least(F.lit(1e4), (us("ts") - us("seen")) / 6e7), F.lit(1e4)), 4).alias("minutes"))


@query("jn3_asof_forward", "SELECT t.event_id, q.bid FROM {trades} AS t ASOF LEFT JOIN {quotes} AS q ON t.symbol = q.symbol AND t.ts <= q.ts")
def _(spark, d):
    return asof_join(trades(spark, d), quotes(spark, d), "ts", ["symbol"], ["bid"], "forward").select("event_id", "bid")


@query("jn4_forward_price", "SELECT t.symbol, t.ts, q.close AS later FROM (SELECT *, ts + INTERVAL 3 HOUR AS due FROM {bars}) AS t ASOF LEFT JOIN {bars} AS q ON t.symbol = q.symbol AND t.day = q.day AND t.due >= q.ts")
def _(spark, d):
    b = bars(spark, d)
    left = b.select("symbol", "day", F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts"))
    return asof_join(left, b, "ts", ["symbol", "day"], ["close"]).select("symbol", F.col("at").alias("ts"), F.col("close").alias("later"))


@query("jn5_context", "SELECT n.news_id, b.close FROM {news} AS n ASOF LEFT JOIN (SELECT * FROM {bars} WHERE symbol = 'view') AS b ON n.day = b.day AND n.ts >= b.ts")
def _(spark, d):
    return asof_join(news(spark, d), bars(spark, d).where("symbol = 'view'"), "ts", ["day"], ["close"]).select("news_id", "close")


@query("jn10_interval_join", "SELECT t.event_id, n.news_id FROM {trades} AS t JOIN {news} AS n ON n.ts BETWEEN t.ts - INTERVAL 45 MINUTE AND t.ts + INTERVAL 10 MINUTE")
def _(spark, d):
    e = trades(spark, d).select("event_id", (F.col("ts") - F.expr("INTERVAL 45 MINUTES")).alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("stop"))
    return interval_join(e, news(spark, d).select("news_id", "ts"), "start", "stop", "ts", 3600, tile=TILE).select("event_id", "news_id")


sql("jn19_purge", "WITH test AS (SELECT min(ts) - INTERVAL '2' HOUR AS lo, max(ts) + INTERVAL '2' HOUR AS hi FROM {trades} WHERE day = DATE '2024-01-15') SELECT t.event_id FROM {trades} AS t CROSS JOIN test WHERE NOT (t.ts + INTERVAL '90' MINUTE >= test.lo AND t.ts <= test.hi)")

LEE = "CASE WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 WHEN price > (bid + ask) / 2 THEN 1 WHEN price < (bid + ask) / 2 THEN -1 ELSE 0 END"


@query("ed26_lee_ready", f"SELECT event_id, CASE WHEN bid IS NULL THEN NULL ELSE CAST({LEE} AS DOUBLE) END AS side FROM (SELECT t.event_id, t.price, q.bid, q.ask FROM {{trades}} AS t ASOF LEFT JOIN {{quotes}} AS q ON t.symbol = q.symbol AND t.ts >= q.ts) AS x")
def _(spark, d):
    t = asof_join(trades(spark, d), quotes(spark, d), "ts", ["symbol"], ["bid", "ask"])
    return t.select("event_id", F.when(F.col("bid").isNotNull(), F.expr(LEE).cast("double")).alias("side"))


# --- robust baselines and detection

_MAD = f"""r AS (SELECT *, {RET} AS ret FROM {{bars}}),
m AS (SELECT symbol, tod, median(abs(ret)) AS rm, median(CAST(volume AS DOUBLE)) AS vm FROM r GROUP BY symbol, tod),
s AS (SELECT r.symbol, r.tod, m.rm, m.vm, median(abs(abs(r.ret) - m.rm)) AS rmad, median(abs(r.volume - m.vm)) AS vmad FROM r JOIN m ON r.symbol = m.symbol AND r.tod = m.tod GROUP BY r.symbol, r.tod, m.rm, m.vm),
g AS (SELECT symbol, 0.1 * median(rm) + 1e-6 AS rfloor, greatest(0.05 * median(vm), 1) AS vfloor FROM s GROUP BY symbol),
base AS (SELECT s.symbol, s.tod, s.rm, s.vm, greatest(s.rmad, g.rfloor) AS rmad, greatest(s.vmad, g.vfloor) AS vmad FROM s JOIN g ON s.symbol = g.symbol),
z AS (SELECT r.symbol, r.day, r.ts, r.ret, (abs(r.ret) - b.rm) / (1.4826 * b.rmad) AS z_ret, (r.volume - b.vm) / (1.4826 * b.vmad) AS z_vol FROM r LEFT JOIN base AS b ON r.symbol = b.symbol AND r.tod = b.tod)"""


def baseline(b: DataFrame, most: int | None = None) -> DataFrame:
    """(symbol, tod, rm, vm, rmad, vmad, rfloor, vfloor) of bars with `ret`: medians and median deviations by time of day,
    and a symbol's least deviations. Exact whatever the history: no task holds the values of a large group."""
    by = ["symbol", "tod"]
    heavy = crowded(b, by, most)
    middle = quantiles(b, by, {"rm": (F.abs("ret"), 0.5), "vm": (F.col("volume"), 0.5)}, most, heavy)
    off = b.join(middle, by)
    spread = quantiles(off, by, {"rmad": (F.abs(F.abs("ret") - F.col("rm")), 0.5), "vmad": (F.abs(F.col("volume") - F.col("vm")), 0.5)}, most, heavy)
    s = middle.join(spread, by)
    floors = s.groupBy("symbol").agg((0.1 * F.median("rm") + 1e-6).alias("rfloor"), F.greatest(0.05 * F.median("vm"), F.lit(1)).alias("vfloor"))  # a row a time of day
    return s.join(floors, "symbol")


def _returns(spark, d):
    return bars(spark, d).selectExpr("*", f"{RET} AS ret")


def _baseline(spark, d):
    s = baseline(_returns(spark, d))
    return s.select("symbol", "tod", "rm", "vm", F.greatest("rmad", "rfloor").alias("rmad"), F.greatest("vmad", "vfloor").alias("vmad"))


def _zscored(spark, d):
    b = _returns(spark, d).join(_baseline(spark, d), ["symbol", "tod"], "left")
    z = lambda x, m, s: (x - F.col(m)) / (1.4826 * F.col(s))
    return b.select("symbol", "day", "ts", "ret", z(F.abs("ret"), "rm", "rmad").alias("z_ret"), z(F.col("volume"), "vm", "vmad").alias("z_vol"))


@query("ag2_mad", f"WITH {_MAD} SELECT symbol, tod, round(rmad, 6) AS absret_mad, round(vmad, 6) AS vol_mad FROM s")
def _(spark, d):
    return baseline(_returns(spark, d)).select("symbol", "tod", r6(F.col("rmad"), "absret_mad"), r6(F.col("vmad"), "vol_mad"))


@query("ag3_mad_floors", f"WITH {_MAD} SELECT symbol, round(rfloor, 6) AS ret_floor, round(vfloor, 6) AS vol_floor FROM g")
def _(spark, d):
    return baseline(_returns(spark, d)).select("symbol", r6(F.col("rfloor"), "ret_floor"), r6(F.col("vfloor"), "vol_floor")).distinct()


@query("ed1_baseline", f"WITH {_MAD} SELECT symbol, tod, round(rm, 6) AS absret_med, round(rmad, 6) AS absret_mad, vm AS vol_med, round(vmad, 6) AS vol_mad FROM base")
def _(spark, d):
    return _baseline(spark, d).select("symbol", "tod", r6(F.col("rm"), "absret_med"), r6(F.col("rmad"), "absret_mad"), F.col("vm").alias("vol_med"), r6(F.col("vmad"), "vol_mad"))


@query("ed2_seasonal_z", f"WITH {_MAD} SELECT symbol, ts, round(z_ret, 6) AS z_ret, round(sign(ret) * z_ret, 6) AS z_signed, round(z_vol, 6) AS z_vol FROM z")
def _(spark, d):
    return _zscored(spark, d).select("symbol", "ts", r6(F.col("z_ret"), "z_ret"), r6(F.signum("ret") * F.col("z_ret"), "z_signed"), r6(F.col("z_vol"), "z_vol"))


@query("ed3_triggers", f"WITH {_MAD} SELECT symbol, ts FROM z WHERE z_ret >= 2 OR (z_vol >= 2.5 AND z_ret >= 1)")
def _(spark, d):
    return _zscored(spark, d).where("z_ret >= 2 OR (z_vol >= 2.5 AND z_ret >= 1)").select("symbol", "ts")


sql("ma2_robust_z", "WITH m AS (SELECT symbol, median(close) AS med FROM {bars} GROUP BY symbol), k AS (SELECT b.symbol, b.ts, b.close, m.med, median(abs(b.close - m.med)) OVER (PARTITION BY b.symbol) AS mad FROM {bars} AS b JOIN m ON b.symbol = m.symbol) SELECT symbol, ts, round((close - med) / (1.4826 * mad), 6) AS z FROM k")

_ISLANDS = """, t AS (SELECT * FROM z WHERE z_ret >= 2 OR (z_vol >= 2.5 AND z_ret >= 1)),
k AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts)) > 7200000000 OR lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM t),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, day ORDER BY ts) AS island FROM k)"""


def _spikes(spark, d):
    hits = _zscored(spark, d).where("z_ret >= 2 OR (z_vol >= 2.5 AND z_ret >= 1)")
    return merge_islands(hits, ["symbol", "day"], "ts", 7200)


@query("ed4_merge_triggers", f"WITH {_MAD}{_ISLANDS} SELECT symbol, CAST(min(day) AS VARCHAR) AS day, CAST(island AS BIGINT) AS island, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY symbol, i.day, island")
def _(spark, d):
    return undated(_spikes(spark, d).groupBy("symbol", "day", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query("ed7_spike_events", f"WITH {_MAD}{_ISLANDS} SELECT symbol, 'E' || strftime(min(ts), '%m%d-%H%M') AS event_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars, round(sum(ret) * 100, 4) AS magnitude_pct, round(max(z_ret), 4) AS peak_z, round(max(z_vol), 4) AS peak_vol_z, CASE WHEN sum(ret) >= 0 THEN 'up' ELSE 'down' END AS direction FROM i GROUP BY symbol, day, island")
def _(spark, d):
    out = _spikes(spark, d).groupBy("symbol", "day", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"), F.sum("ret").alias("r"), F.round(F.max("z_ret"), 4).alias("peak_z"), F.round(F.max("z_vol"), 4).alias("peak_vol_z"))
    return out.select("symbol", F.concat(F.lit("E"), F.date_format("first_ts", "MMdd-HHmm")).alias("event_id"), "first_ts", "last_ts", "n_bars", F.round(F.col("r") * 100, 4).alias("magnitude_pct"), "peak_z", "peak_vol_z", F.when(F.col("r") >= 0, "up").otherwise("down").alias("direction"))




#: Of the spread of daily returns: how far a price strays from its average price, for hourly bars that jump about (2 for finer ones).
DRIFT_SIGMAS = 0.5


@query(
    "ed8_vwap_drift",
    f"""WITH {_MAD}{_ISLANDS}, sp AS (SELECT symbol, day, min(ts) AS a, max(ts) AS b FROM i GROUP BY symbol, day, island),
    dv AS (SELECT symbol, day, ts, (close - {VWAP}) / ({VWAP}) AS dev FROM {{bars}}), v AS (SELECT * FROM dv JOIN z USING (symbol, day, ts)),
    w AS (SELECT symbol, day, max(abs(dev)) AS top, arg_min(ts, ROW(-abs(dev), ts)) AS peak_ts, arg_min(dev, ROW(-abs(dev), ts)) AS peak_dev FROM v WHERE dev IS NOT NULL GROUP BY symbol, day),
    dl AS (SELECT symbol, stddev_samp(ln(close) - ln(pc)) AS sd FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM (SELECT symbol, day, arg_max(close, ts) AS close FROM {{bars}} GROUP BY symbol, day) AS c) AS p GROUP BY symbol),
    o AS (SELECT w.* FROM w JOIN dl USING (symbol) WHERE w.top >= {DRIFT_SIGMAS} * dl.sd AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.symbol = w.symbol AND sp.day = w.day AND w.peak_ts BETWEEN sp.a AND sp.b)),
    e AS (SELECT o.symbol, o.day, o.top, o.peak_dev, min(v.ts) AS first_ts, max(v.ts) AS last_ts FROM o JOIN v ON v.symbol = o.symbol AND v.day = o.day AND abs(v.dev) >= o.top / 2 GROUP BY ALL)
    SELECT e.symbol, 'D' || strftime(e.first_ts, '%m%d-%H%M') AS event_id, e.first_ts, e.last_ts, CASE WHEN e.peak_dev > 0 THEN 'up' ELSE 'down' END AS direction, round(sum(v.ret) * 100, 4) AS magnitude_pct, round(max(v.z_ret), 4) AS peak_z, round(max(e.top), 6) AS peak
    FROM e JOIN v ON v.symbol = e.symbol AND v.day = e.day AND v.ts BETWEEN e.first_ts AND e.last_ts GROUP BY e.symbol, e.first_ts, e.last_ts, e.peak_dev""",
)
def _(spark, d):
    return vwap_drift(spark, d)


def vwap_drift(spark, d, sigmas: float = DRIFT_SIGMAS) -> DataFrame:
    """Days on which the price strays from its average price by `sigmas` daily spreads at a time that no spike covers: from
    the first to the last bar at half the largest distance or more. One window a day; the rest are aggregates by day."""
    day = ["symbol", "day"]
    b = bars(spark, d)
    v = b.selectExpr("symbol", "day", "ts", f"(close - {VWAP}) / ({VWAP}) AS dev").join(_zscored(spark, d), [*day, "ts"])
    spikes = _spikes(spark, d).groupBy(*day, "island").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spans = spikes.groupBy(*day).agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # those of a day
    far = F.struct((-F.abs("dev")).alias("d"), "ts", "dev")
    top = v.where("dev IS NOT NULL").groupBy(*day).agg(F.min(far).alias("top"))
    closes = b.groupBy(*day).agg(F.max_by("close", "ts").alias("close"))
    moves = closes.withColumn("r", F.log("close") - F.log(F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))))
    limits = moves.groupBy("symbol").agg(F.stddev_samp("r").alias("sd"))
    open_ = top.join(limits, "symbol").where(-F.col("top.d") >= sigmas * F.col("sd")).join(spans, day, "left")
    open_ = open_.where(~F.coalesce(F.exists("spans", lambda x: F.col("top.ts").between(x["a"], x["b"])), F.lit(False))).drop("spans", "sd")
    near = v.join(open_, day)
    ends = near.where(F.abs("dev") >= -F.col("top.d") / 2).groupBy(*day).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    inside = near.join(ends, day).where(F.col("ts").between(F.col("first_ts"), F.col("last_ts")))
    out = inside.groupBy("symbol", "first_ts", "last_ts").agg(F.sum("ret").alias("move"), F.max("z_ret").alias("z"), F.first("top").alias("top"))
    return out.select("symbol", F.concat(F.lit("D"), F.date_format("first_ts", "MMdd-HHmm")).alias("event_id"), "first_ts", "last_ts", F.when(F.col("top.dev") > 0, "up").otherwise("down").alias("direction"), F.round(F.col("move") * 100, 4).alias("magnitude_pct"), F.round("z", 4).alias("peak_z"), r6(-F.col("top.d"), "peak"))


@query("sc16_settings", f"WITH {_MAD} SELECT symbol, count(*) FILTER (WHERE z_ret >= 2.5 OR (z_vol >= 5.0 AND z_ret >= 2.0)) AS triggers FROM z GROUP BY symbol")
def _(spark, d):
    """Triggers under settings that override some defaults; names that are unknown are ignored."""
    s = Settings.from_dict({"ret_z": 2.5, "unknown": 1})
    hit = (F.col("z_ret") >= s.ret_z) | ((F.col("z_vol") >= s.vol_z) & (F.col("z_ret") >= s.vol_z_ret_min))
    return _zscored(spark, d).groupBy("symbol").agg(F.count_if(hit).alias("triggers"))


sql("ed9_gap_events", "WITH g AS (SELECT symbol, day, ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS gap FROM {daily}), s AS (SELECT symbol, stddev_samp(gap) AS sd FROM g GROUP BY symbol) SELECT g.symbol, g.day, round(gap / sd, 6) AS z FROM g JOIN s ON g.symbol = s.symbol WHERE abs(gap) / sd >= 2.5")
sql("ed10_day_events", "WITH g AS (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS cc FROM {daily}), s AS (SELECT symbol, stddev_samp(cc) AS sd FROM g GROUP BY symbol) SELECT g.symbol, g.day, round(cc / sd, 6) AS z FROM g JOIN s ON g.symbol = s.symbol WHERE abs(cc) / sd >= 2.0")
sql("so4_union_event_kinds", "WITH g AS (SELECT symbol, day, ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS gap, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS cc FROM {daily}) SELECT symbol, CAST(day AS STRING) AS at, 'gap' AS kind FROM g WHERE abs(gap) > 2 UNION ALL SELECT symbol, CAST(day AS STRING) AS at, 'day' AS kind FROM g WHERE abs(cc) > 2")
sql("ed17_cross_asset", f"WITH r AS (SELECT symbol, ts, {RET_S} AS ret FROM {{bars}}) SELECT a.symbol, a.ts, count(CASE WHEN sign(b.ret) = sign(a.ret) AND abs(b.ret) > 0.003 THEN 1 END) >= 2 AS sector_wide FROM r AS a JOIN r AS b ON a.ts = b.ts AND a.symbol <> b.symbol WHERE a.ret IS NOT NULL GROUP BY a.symbol, a.ts")


# --- the market's part

#: The symbols that stand for the market, and the day before which models are fitted.
REGRESSORS, FITTED_UNTIL = ("purchase", "view"), "2024-01-20"
#: rx: returns beside those of the two regressors; fi: the least squares of each symbol, by determinants.
_MODEL_SQL = f"""rx AS (SELECT a.symbol, a.day, a.ts, a.ret AS y, b.ret AS x1, c.ret AS x2 FROM {{source}} AS a JOIN {{source}} AS b ON a.ts = b.ts AND b.symbol = '{REGRESSORS[0]}' JOIN {{source}} AS c ON a.ts = c.ts AND c.symbol = '{REGRESSORS[1]}'
    WHERE a.symbol NOT IN {REGRESSORS} AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND c.ret IS NOT NULL),
fq AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_samp(y, x1) AS sy1, covar_samp(y, x2) AS sy2, var_samp(x1) AS s11, var_samp(x2) AS s22, covar_samp(x1, x2) AS s12, var_samp(y) AS syy FROM rx WHERE day < DATE '{FITTED_UNTIL}' GROUP BY symbol),
fb AS (SELECT *, CASE WHEN n >= 4 THEN (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) END AS b1, CASE WHEN n >= 4 THEN (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) END AS b2 FROM fq),
fi AS (SELECT symbol, n, b1, b2, my - b1 * m1 - b2 * m2 AS alpha, (b1 * sy1 + b2 * sy2) / syy AS r2 FROM fb)"""
MARKET_SQL = _MODEL_SQL.replace("{source}", "z")
_OWN_SQL = f"r AS (SELECT symbol, day, ts, {RET} AS ret FROM {{bars}}), " + _MODEL_SQL.replace("{source}", "r")


def fitted_market(spark, d) -> tuple[DataFrame, DataFrame]:
    """Aligned returns of all symbols, and each one's model from the days before FITTED_UNTIL."""
    rows = aligned(_returns(spark, d), REGRESSORS, ["day"])
    return rows, market_model(rows.where(F.col("day") < F.lit(FITTED_UNTIL).cast("date")), ["symbol"], len(REGRESSORS))


@query("ag23_market_model", f"WITH {_OWN_SQL} SELECT symbol, n, round(b1, 6) AS beta1, round(b2, 6) AS beta2, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM fi")
def _(spark, d):
    model = fitted_market(spark, d)[1]
    return model.select("symbol", "n", *(r6(F.get("betas", F.lit(i)), f"beta{i + 1}") for i in range(len(REGRESSORS))), r6(F.col("alpha"), "alpha"), r6(F.col("r2"), "r2"))


@query("ag24_idio_share", f"WITH {_OWN_SQL}, w AS (SELECT x.symbol, x.day, sum(y) AS act, sum(alpha + b1 * x1 + b2 * x2) AS pred FROM rx AS x JOIN fi USING (symbol) GROUP BY x.symbol, x.day) SELECT symbol, CAST(day AS VARCHAR) AS day, round(act * 100, 4) AS actual_pct, round(pred * 100, 4) AS market_pct, round(CASE WHEN pred IS NULL OR abs(act) < 1e-9 THEN NULL WHEN sign(act) <> sign(pred) THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - pred / act)) END, 6) AS share FROM w")
def _(spark, d):
    days = explained(*fitted_market(spark, d)).groupBy("symbol", "day").agg(F.sum("y").alias("act"), F.sum("market").alias("pred"))
    pct = lambda c, name: F.round(F.col(c) * 100, 4).alias(name)
    return undated(days.select("symbol", "day", pct("act", "actual_pct"), pct("pred", "market_pct"), r6(share_left(F.col("act"), F.col("pred")), "share")))


sql("ed21_phase_label", "SELECT symbol, day, concat(CASE WHEN r >= 1.0 THEN 'surge' WHEN r >= 0.35 THEN 'rise' WHEN r <= -1.0 THEN 'slide' WHEN r <= -0.35 THEN 'drift down' ELSE 'range' END, CASE WHEN f >= 0.3 THEN ' on buying' WHEN f <= -0.3 THEN ' on selling' ELSE '' END) AS label FROM (SELECT symbol, day, ln(max_by(close, ts) / min_by(open, ts)) AS r, sum(sign(close - open) * volume) / nullif(sum(volume), 0) AS f FROM {bars} GROUP BY symbol, day) AS d")
_FIRST = f"f AS (SELECT *, row_number() OVER ({D}) AS k FROM {{bars}}), o AS (SELECT symbol, day, min_by(open, ts) AS o, max(high) AS hi, min(low) AS lo, max_by(close, ts) AS c, max(CASE WHEN k <= 5 AND low < fo AND high > fo THEN 1 ELSE 0 END) AS straddles, avg(CASE WHEN k <= 5 THEN close - open END) AS bias, min(CASE WHEN k <= 15 THEN low END) AS low15, max(CASE WHEN k <= 3 THEN high END) AS ib_hi, min(CASE WHEN k <= 3 THEN low END) AS ib_lo FROM (SELECT f.*, first_value(open) OVER ({D}) AS fo FROM f) AS f GROUP BY symbol, day)"
sql("ed22_opening_type", f"WITH {_FIRST} SELECT symbol, day, CASE WHEN straddles = 0 AND bias > 0 AND hi > 1.002 * o THEN 'drive up' WHEN straddles = 0 AND bias < 0 AND lo < 0.998 * o THEN 'drive down' WHEN bias > 0 AND low15 < o THEN 'rejection-reverse' ELSE 'auction' END AS kind FROM o")
sql("ed23_day_type", f"WITH {_FIRST} SELECT symbol, day, CASE WHEN abs(c - o) / nullif(hi - lo, 0) > 0.7 AND (c >= hi - 0.15 * (hi - lo) OR c <= lo + 0.15 * (hi - lo)) THEN 'trend' WHEN abs(c - o) / nullif(hi - lo, 0) > 0.45 THEN 'normal variation' ELSE 'balanced' END AS kind FROM o")
sql("ed24_initial_balance", f"WITH {_FIRST} SELECT symbol, day, ib_hi, ib_lo, hi > ib_hi AS up_extension, lo < ib_lo AS down_extension FROM o")
sql("ed25_open_challenge", f"WITH {_FIRST}, p AS (SELECT symbol, day, max(CASE WHEN tod < '09:30' THEN high END) AS pre, max(CASE WHEN tod BETWEEN '09:30' AND '12:00' THEN high END) AS pop FROM {{bars}} GROUP BY symbol, day) SELECT symbol, day, pre, pop, pop > pre AS challenged FROM p")
bars_tick = f"sign(close - lag(close) OVER ({D})) * volume"
sql("ed27_tick_rule", f"SELECT symbol, ts, CAST(coalesce({bars_tick}, 0) AS DOUBLE) AS signed_reset, CAST({SIGNED} AS DOUBLE) AS signed_through FROM {{bars}}")

# --- flow, profile, microstructure

_PHI_SQL = "(0.5 * (1 + sign(x) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-(abs(x) / sqrt(2)) * (abs(x) / sqrt(2))))))"
_BVC_SQL = f"b0 AS (SELECT *, {RET} AS ret FROM {{bars}}), b1 AS (SELECT *, ret / greatest(stddev_samp(ret) OVER (PARTITION BY symbol), 1e-9) AS x FROM b0), b2 AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2)) AS t FROM b1), bvc AS (SELECT *, coalesce({_PHI_SQL}, 0.5) AS buy FROM b2)"


def _bulk(spark, d):
    ret = bars(spark, d).selectExpr("*", f"{RET} AS ret")
    sd = F.greatest(F.stddev_samp("ret").over(Window.partitionBy("symbol")), F.lit(1e-9))
    return ret.withColumn("buy", F.coalesce(norm_cdf(F.col("ret") / sd), F.lit(0.5)))


@query("ma5_normal_cdf", f"WITH {_BVC_SQL} SELECT symbol, ts, round(buy, 6) AS buy_share, round(buy * volume, 4) AS buy_volume FROM bvc")
def _(spark, d):
    return _bulk(spark, d).select("symbol", "ts", r6(F.col("buy"), "buy_share"), F.round(F.col("buy") * F.col("volume"), 4).alias("buy_volume"))


_VPIN_SQL = f"WITH {_BVC_SQL}, c AS (SELECT *, sum(volume) OVER ({S} ROWS UNBOUNDED PRECEDING) AS c1 FROM bvc WHERE volume > 0), e AS (SELECT symbol, ts, buy, c1, c1 - volume AS c0, unnest(generate_series(CAST(floor((c1 - volume) / 500.0) AS BIGINT), CAST(ceil(c1 / 500.0) AS BIGINT) - 1)) AS bucket FROM c), p AS (SELECT *, least(c1, (bucket + 1) * 500.0) - greatest(c0, bucket * 500.0) AS part FROM e), v AS (SELECT symbol, bucket, max(ts) AS ts, abs(sum(part * (2 * buy - 1)) / 500.0) AS imbalance FROM p GROUP BY symbol, bucket HAVING sum(part) >= 500 - 1e-6)"


@query("ag25_vpin_buckets", _VPIN_SQL + " SELECT symbol, bucket, ts, round(imbalance, 5) AS imbalance FROM v")
def _(spark, d):
    return volume_buckets(_bulk(spark, d), 500.0, "buy").select("symbol", "bucket", "ts", F.round("imbalance", 5).alias("imbalance"))


@query("wn30_vpin", _VPIN_SQL + " SELECT symbol, bucket, CASE WHEN count(*) OVER w >= 10 THEN round(avg(imbalance) OVER w, 5) END AS vpin FROM v WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 49 PRECEDING)")
def _(spark, d):
    over = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(-49, 0)
    return volume_buckets(_bulk(spark, d), 500.0, "buy").select("symbol", "bucket", F.when(F.count("*").over(over) >= 10, F.round(F.avg("imbalance").over(over), 5)).alias("vpin"))


_PROFILE_SQL = "pr AS (SELECT symbol, day, bin, sum(v) AS volume, sum(d) AS delta FROM (SELECT symbol, day, unnest(generate_series(CAST(floor(low / 20) AS BIGINT), CAST(floor(high / 20) AS BIGINT))) AS bin, volume / (floor(high / 20) - floor(low / 20) + 1) AS v, sign(close - open) * volume / (floor(high / 20) - floor(low / 20) + 1) AS d FROM {bars}) AS x GROUP BY symbol, day, bin)"


def _profile(spark, d):
    return volume_profile(bars(spark, d), 20)


@query("ag12_volume_profile", f"WITH {_PROFILE_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, bin, round(volume, 5) AS volume, round(delta, 5) AS delta FROM pr")
def _(spark, d):
    return undated(_profile(spark, d).select("symbol", "day", "bin", F.round("volume", 5).alias("volume"), F.round("delta", 5).alias("delta")))


_POC_SQL = f"WITH {_PROFILE_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY round(volume, 6) DESC, bin) AS rn FROM pr)"


@query("ag13_poc", f"{_POC_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, bin AS poc FROM q WHERE rn = 1")
def _(spark, d):
    order = Window.partitionBy("symbol", "day").orderBy(F.desc(F.round("volume", 6)), "bin")
    return undated(_profile(spark, d).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("symbol", "day", F.col("bin").alias("poc")))


@query("ag15_high_volume_nodes", f"{_POC_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, bin, CAST(rn AS BIGINT) AS place FROM q WHERE rn <= 3")
def _(spark, d):
    order = Window.partitionBy("symbol", "day").orderBy(F.desc(F.round("volume", 6)), "bin")
    return undated(_profile(spark, d).withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("symbol", "day", "bin", F.col("rn").cast("long").alias("place")))


@query("wn38_poc_migration", f"{_POC_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, CAST(sign(bin - lag(bin) OVER (PARTITION BY symbol ORDER BY day)) AS DOUBLE) AS moved FROM q WHERE rn = 1")
def _(spark, d):
    area = value_area(_profile(spark, d))
    return undated(area.select("symbol", "day", F.signum(F.col("poc") - F.lag("poc").over(Window.partitionBy("symbol").orderBy("day"))).cast("double").alias("moved")))


@query("ag16_naked_poc", f"{_POC_SQL}, p AS (SELECT symbol, day, bin FROM q WHERE rn = 1), h AS (SELECT symbol, max(day) AS last FROM p GROUP BY symbol), t AS (SELECT b.symbol, max(b.high) AS high FROM {{bars}} AS b JOIN h ON b.symbol = h.symbol AND b.day = h.last GROUP BY b.symbol) SELECT p.symbol, CAST(p.day AS VARCHAR) AS day, p.bin * 20 + 10 AS price FROM p JOIN h ON p.symbol = h.symbol JOIN t ON p.symbol = t.symbol WHERE p.day < h.last AND p.bin * 20 + 10 > t.high - 200")
def _(spark, d):
    b = bars(spark, d)
    area = value_area(volume_profile(b, 20)).select("symbol", "day", (F.col("poc") * 20 + 10).alias("price"))
    last = b.groupBy("symbol").agg(F.max(F.struct("day", "high")).alias("m")).select("symbol", F.col("m.day").alias("last"), F.col("m.high").alias("top"))  # a row a symbol
    return undated(area.join(last, "symbol").where((F.col("day") < F.col("last")) & (F.col("price") > F.col("top") - 200)).select("symbol", "day", "price"))


@query(
    "ag14_value_area",
    f"""WITH RECURSIVE_ {_PROFILE_SQL}, v AS (SELECT symbol, day, list(bin ORDER BY bin) AS bins, list(round(volume, 6) ORDER BY bin) AS vol FROM pr GROUP BY symbol, day),
    s AS (SELECT symbol, day, vol, list_sum(vol) AS total, list_position(vol, list_max(vol)) AS lo, list_position(vol, list_max(vol)) AS hi, list_max(vol) AS got, 0 AS step FROM v
      UNION ALL SELECT symbol, day, vol, total, CASE WHEN up >= down THEN lo ELSE lo - 1 END, CASE WHEN up >= down THEN hi + 1 ELSE hi END, got + greatest(up, down), step + 1
      FROM (SELECT *, coalesce(vol[hi + 1], -1) AS up, CASE WHEN lo > 1 THEN vol[lo - 1] ELSE -1 END AS down FROM s WHERE got < total * 0.7) AS n WHERE up >= 0 OR down >= 0),
    e AS (SELECT symbol, day, arg_max(lo, step) AS lo, arg_max(hi, step) AS hi FROM s GROUP BY symbol, day)
    SELECT v.symbol, CAST(v.day AS VARCHAR) AS day, bins[list_position(vol, list_max(vol))] AS poc, bins[lo] AS val, bins[hi] AS vah FROM v JOIN e ON v.symbol = e.symbol AND v.day = e.day""",
)
def _(spark, d):
    return undated(value_area(_profile(spark, d)))


@query("wn37_area_relation", f"SELECT symbol, day, CASE WHEN val > ph THEN 'above' WHEN vah < pl THEN 'below' WHEN pl IS NOT NULL THEN 'overlapping' END AS relation FROM (SELECT *, lag(val) OVER (PARTITION BY symbol ORDER BY day) AS pl, lag(vah) OVER (PARTITION BY symbol ORDER BY day) AS ph FROM ({ORACLE_SQL['ag14_value_area']}) AS a) AS b")
def _(spark, d):
    order = Window.partitionBy("symbol").orderBy("day")
    area = value_area(_profile(spark, d)).withColumns({"pl": F.lag("val").over(order), "ph": F.lag("vah").over(order)})
    return undated(area.select("symbol", "day", F.when(F.col("val") > F.col("ph"), "above").when(F.col("vah") < F.col("pl"), "below").when(F.col("pl").isNotNull(), "overlapping").alias("relation")))


# --- text

_TOKENS_SQL = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('" + "', '".join(STOP) + "')), lambda w: substring(w, 1, 6))))"


@query("st4_story_tokens", f"SELECT conv_id, turn, array_to_string({_TOKENS_SQL}, ' ') AS tokens FROM {{conversations}}")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.array_sort(story_tokens("text"))).alias("tokens"))


_STORY_SQL = f"WITH k AS (SELECT item_id, {_TOKENS_SQL} AS w FROM {{benchmark}}) SELECT a.item_id AS a, b.item_id AS b, CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / CAST(least(len(a.w), len(b.w)) AS DOUBLE) >= 0.5 ELSE false END AS same FROM k AS a JOIN k AS b ON b.item_id = a.item_id + 1"


@query("st5_same_story", _STORY_SQL)
def _(spark, d):
    k = read(spark, d, "benchmark").select("item_id", story_tokens("text").alias("w"))
    other = k.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("w").alias("v"))
    return k.join(other, "item_id").select(F.col("item_id").alias("a"), "b", same_story(F.col("w"), F.col("v")).alias("same"))


sql("so6_token_overlap", "SELECT a.item_id, CAST(size(array_intersect(split(a.text, ' '), split(b.text, ' '))) AS BIGINT) AS n FROM {benchmark} AS a JOIN {benchmark} AS b ON b.item_id = a.item_id + 1", "SELECT a.item_id, CAST(len(list_distinct(list_intersect(string_split(a.text, ' '), string_split(b.text, ' ')))) AS BIGINT) AS n FROM {benchmark} AS a JOIN {benchmark} AS b ON b.item_id = a.item_id + 1")
sql("st7_numbers", "SELECT doc_id, regexp_extract(text, '([0-9][0-9,][0-9,][0-9,][0-9,]+)', 1) AS number FROM {documents} WHERE rlike(text, '[0-9][0-9,][0-9,][0-9,][0-9,]+')")

# --- recurrences


#: An exponentially weighted spread step by step: weights, their squares, values and squares decay at each row.
EWM_SQL = """WITH RECURSIVE_ r AS (SELECT symbol, ts, {ret} AS x FROM {{bars}}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM r),
u AS (SELECT symbol, ts, k, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1 END AS w, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1 END AS w2, coalesce(x, 0.0::DOUBLE) AS s, coalesce(x * x, 0.0::DOUBLE) AS q, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS c FROM n WHERE k = 1
  UNION ALL SELECT n.symbol, n.ts, n.k, u.w * {keep} + CASE WHEN x IS NULL THEN 0 ELSE 1 END, u.w2 * {keep} * {keep} + CASE WHEN x IS NULL THEN 0 ELSE 1 END, u.s * {keep} + coalesce(x, 0), u.q * {keep} + coalesce(x * x, 0), u.c + CASE WHEN x IS NULL THEN 0 ELSE 1 END FROM u JOIN n ON n.symbol = u.symbol AND n.k = u.k + 1)
SELECT symbol, ts, CASE WHEN c >= {least} THEN round(sqrt((q / w - (s / w) * (s / w)) * w * w / (w * w - w2)), 6) END AS sigma FROM u"""


@query("wn24_ewm_std", EWM_SQL.format(ret=RET, keep=f"({1 - 2 / 61!r}::DOUBLE)", least=10))
def _(spark, d):
    out = ewm_spread(bars(spark, d).selectExpr("symbol", "ts", f"{RET} AS ret"), ["symbol"], "ts", "ret", 60, 10)
    return out.select("symbol", "ts", r6(F.col("sigma"), "sigma"))


@query("wn28_rolling_median", "SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN count(volume) OVER w >= 60 THEN median(volume) OVER w END AS med FROM {daily} WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING)")
def _(spark, d):
    return undated(rolling_median(daily(spark, d), ["symbol"], "day", "volume", 60, 60, "med"))


_EDGE = f"e0 AS (SELECT symbol, day, ts, close > {VWAP} AND volume > 80 AS up FROM {{bars}}), e AS (SELECT symbol, day, ts FROM (SELECT *, up AND NOT coalesce(lag(up) OVER ({S}), false) AS edge FROM e0) AS x WHERE edge)"


@query("ml1_cusum", f"""WITH RECURSIVE_ r AS (SELECT symbol, day, ts, {RET} AS ret FROM {{bars}}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS k FROM r WHERE ret IS NOT NULL),
u AS (SELECT *, greatest(0, ret) AS up, least(0, ret) AS down FROM n WHERE k = 1 UNION ALL
    SELECT n.*, greatest(0, CASE WHEN u.up >= 1.5 OR u.down <= -1.5 THEN 0 ELSE u.up END + n.ret), least(0, CASE WHEN u.up >= 1.5 OR u.down <= -1.5 THEN 0 ELSE u.down END + n.ret) FROM u JOIN n ON n.symbol = u.symbol AND n.day = u.day AND n.k = u.k + 1)
SELECT symbol, ts FROM u WHERE up >= 1.5 OR down <= -1.5""")
def _(spark, d):
    ret = bars(spark, d).selectExpr("symbol", "day", "ts", f"{RET} AS ret").where("ret IS NOT NULL")
    h = 1.5
    items = F.sort_array(F.collect_list(F.struct("ts", "ret")))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<timestamp_ntz>").alias("hits"))

    def step(s, x):
        up, down = F.greatest(F.lit(0.0), s["up"] + x["ret"]), F.least(F.lit(0.0), s["down"] + x["ret"])
        hit = (up >= h) | (down <= -h)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(s["hits"], F.array(x["ts"]))).otherwise(s["hits"]).alias("hits"))

    folded = ret.groupBy("symbol", "day").agg(F.aggregate(items, zero, step)["hits"].alias("hits"))
    return folded.select("symbol", F.explode("hits").alias("ts"))


@query("ed5_changepoints")
def _(spark, d):
    """Where returns, or their rolling spread, change within a day of quarter-hour bars."""
    rows = fine_bars(spark, d).selectExpr("symbol", "day", "ts", f"{RET} AS ret")
    return undated(changepoints(rows, ["symbol", "day"], "ts", "ret"))


@query("ed6_phases")
def _(spark, d):
    return undated(phases(fine_bars(spark, d), ["symbol", "day"], "ts", "close", 10))


# --- rules, outcomes, labels


def auc(label: Column, rank: Column) -> Column:
    """The area under the curve from ranks (ties shared) of the scores: the share of pairs in order."""
    yes, no = F.count_if(label == 1), F.count_if(label == 0)
    return (F.sum(F.when(label == 1, rank)) - yes * (yes + 1) / 2) / (yes * no)


sql("sb6_daily_rules", "WITH f AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS pc, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS pl, avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) AS v20, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) AS clv FROM {daily}) SELECT symbol, day, coalesce(close > pc AND clv >= 0 AND volume / v20 >= 1.15, false) AS buy, coalesce(open >= pc AND close < open AND clv <= 0 AND volume / v20 >= 1.15, false) AS reversal, coalesce(close < pl AND volume / v20 >= 1.15, false) AS breakdown FROM f")
sql("sb7_daily_forward", "SELECT symbol, day, round(lead(close, 1) OVER (PARTITION BY symbol ORDER BY day) / close - 1, 6) AS f1, round(lead(close, 3) OVER (PARTITION BY symbol ORDER BY day) / close - 1, 6) AS f3, round(lead(close, 5) OVER (PARTITION BY symbol ORDER BY day) / close - 1, 6) AS f5 FROM {daily}")
#: Minutes of the windows that are counted in bars, and the bars' own length: the least time between two of a day.
_BAR_MIN = "(SELECT symbol, min(gap) AS bar FROM (SELECT symbol, (micros(ts) - micros(lagged)) / 60000000 AS gap FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) AS lagged FROM {frame}) AS l WHERE lagged IS NOT NULL) AS g GROUP BY symbol) AS b"
sql("sb12_scaled_params", "SELECT b.symbol, p.m, CAST(greatest(1, bround(p.m / CAST(b.bar AS DOUBLE), 0)) AS BIGINT) AS bars FROM " + _BAR_MIN.replace("{frame}", "{fine_bars}") + " CROSS JOIN (VALUES (30), (10), (50), (15)) AS p(m)")
sql("tsk6_bars_of_minutes", "SELECT b.symbol, p.minutes, CAST(greatest(1, bround(p.minutes / CAST(b.bar AS DOUBLE), 0)) AS BIGINT) AS bars FROM " + _BAR_MIN.replace("{frame}", "{bars}") + " CROSS JOIN (VALUES (30), (90), (240), (600)) AS p(minutes)")
sql("sb19_next_open", f"SELECT symbol, ts, lead(open) OVER ({D}) AS entry FROM {{bars}}")
@query("ml12_auc", "WITH s AS (SELECT l.quality, CAST(length(d.text) AS DOUBLE) AS x FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / CAST(2 AS DOUBLE) AS r FROM s) SELECT round((sum(CASE WHEN quality = 1 THEN r END) - count(CASE WHEN quality = 1 THEN 1 END) * (count(CASE WHEN quality = 1 THEN 1 END) + 1) / CAST(2 AS DOUBLE)) / (count(CASE WHEN quality = 1 THEN 1 END) * count(CASE WHEN quality = 0 THEN 1 END)), 6) AS auc FROM k")
def _(spark, d):
    rows = read(spark, d, "labels").select("doc_id", "quality").join(read(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("x")), "doc_id")
    return ranked(rows, "x", name="r").agg(F.round(auc(F.col("quality"), F.col("r")), 6).alias("auc"))


sql("ml17_leakage_probe", f"SELECT symbol, count(a) AS through, count(b) AS alone, count(CASE WHEN a IS NOT NULL AND b IS NULL THEN 1 END) AS bleeding FROM (SELECT symbol, {roll('avg', 10, 'volume')} AS a, {roll('avg', 10, 'volume', D)} AS b FROM {{bars}}) AS x GROUP BY symbol")
sql("ml18_calibration", f"SELECT symbol, round(corr(sv, ret), 6) AS r, round(regr_slope(ret, sv) * 1000, 6) AS slope, count(*) AS n FROM (SELECT symbol, {RET_S} AS ret, {SIGNED} AS sv FROM {{bars}}) AS b WHERE ret IS NOT NULL GROUP BY symbol")
sql("ma13_tail", "SELECT symbol, day, round(r / sd, 6) AS sigmas FROM (SELECT symbol, day, ln(close / open) AS r, stddev_samp(ln(close / open)) OVER (PARTITION BY symbol) AS sd FROM {daily}) AS x")


@query("ma6_t_p_value")
def _(spark, d):
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_two_sided(a, b - 1) for a, b in zip(t, n, strict=True)])

    ret = ship(spark) and bars(spark, d).selectExpr("symbol", f"{RET} AS ret")
    g = ret.groupBy("symbol").agg((F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("ret")))).alias("t"), F.count("ret").alias("n"))
    return g.select("symbol", "n", r6(F.col("t"), "t"), r6(p("t", "n"), "p"))
