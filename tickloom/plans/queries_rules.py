"""Signal rules with their outcomes, labels and uniqueness; the SQL twins are written from the definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import signals as rules
from ..operators.intervals import overlaps, uniqueness
from ..operators.labels import first_touch, meta_labels
from ..operators.models import SHARES, picked
from ..operators.quantiles import quantiles
from ..operators.recurrences import ema, numbered
from ..operators.signals import Rules
from ..sources.market import bars, daily, resample, ticks, trades
from ..sources.sinks import write_events
from ..sources.stage import shared_dir, staged
from .registry import query, undated

#: The rules for hourly bars of a day that starts at midnight.
P = Rules(
    imb_window=5, relvol_fast=3, relvol_slow=10, relvol_thresh=0.9, clv_smooth=3, open_from_min=60, open_window_min=720, open_high_min=540,
    below_vwap_bars=4, reclaim_bars=5, cooldown_min=240, buy_cutoff_min=1260, runup_gate=0.5, bar_min=60, open_at_min=0,
)
SOON = "12:00"
HORIZONS = (60, 120, 180)
COSTS = (0.0, 0.07, 0.13)

CORE = ["symbol", "ts"]


def features_sql(p: Rules, source: str = "{bars}") -> str:
    """CTEs up to `x`, the features with the gates."""
    roll = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    full = lambda agg, n: f"CASE WHEN k >= {n} THEN {agg} OVER {roll(n)} END"
    rested = f"NOT coalesce(runup > {p.runup_gate}, false)" if p.runup_gate is not None else "true"
    context = "(close < pv OR pv IS NULL)" if p.prior_vwap_gate else "true"
    gap = "gap" if p.gap_gate else "true"
    return f"""fv AS (SELECT b.*, hour(ts) * 60 + minute(ts) - {p.open_at_min} AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, row_number() OVER d AS i,
    CAST(coalesce(sign(close - lag(close) OVER d), 0) * volume AS DOUBLE) AS sv, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) AS clv,
    sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS vwap, max(high) OVER d AS top
    FROM {source} AS b WINDOW d AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fw AS (SELECT *, coalesce(close > vwap, false) AS above, {full('sum(sv)', p.imb_window)} / nullif({full('sum(volume)', p.imb_window)}, 0) AS imb,
    {full('avg(volume)', p.relvol_fast)} / nullif({full('avg(volume)', p.relvol_slow)}, 0) AS relvol, {full('avg(clv)', p.clv_smooth)} AS clv_s,
    sum(sv) OVER d AS cum, sum(sv) OVER d / nullif(sum(volume) OVER d, 0) AS day_imb, max(CASE WHEN high >= top THEN m END) OVER d AS hod
    FROM fv WINDOW d AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, i - coalesce(max(CASE WHEN above THEN i END) OVER d, 0) AS streak, cum >= max(cum) OVER d AS fresh,
    k < {p.reclaim_bars} OR max(CASE WHEN high >= vwap AND NOT above THEN 1 ELSE 0 END) OVER {roll(p.reclaim_bars)} = 1 AS failed
    FROM fw WINDOW d AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fd AS (SELECT symbol, day, coalesce(o >= lag(c) OVER e, false) AS gap, lag(v) OVER e AS pv, lag(c) OVER e / lag(c, 4) OVER e - 1 AS runup
    FROM (SELECT symbol, day, arg_min(open, ts) AS o, arg_max(close, ts) AS c, arg_max(vwap, ts) AS v FROM fv GROUP BY symbol, day) AS q WINDOW e AS (PARTITION BY symbol ORDER BY day)),
x AS (SELECT fx.*, gap, pv, runup,
    coalesce(m >= {p.imb_window * p.bar_min} AND m <= {p.buy_cutoff_min} AND {rested} AND above AND relvol >= {p.relvol_thresh} AND clv_s > 0 AND fresh, false) AS g_buy,
    coalesce(m BETWEEN {p.open_from_min} AND {p.open_window_min} AND hod <= {p.open_high_min} AND {gap} AND {context} AND NOT above AND relvol >= {p.relvol_thresh}, false) AS g_open,
    coalesce(streak >= {p.below_vwap_bars} AND clv_s < 0, false) AS g_dist
    FROM fx JOIN fd USING (symbol, day))"""


def signals_sql(p: Rules, source: str = "{bars}", grid: str | None = None) -> str:
    """CTEs up to `sig`, the signals that both sweeps keep; grid: pairs (bt, st) as a VALUES list."""
    t, u = ("bt, st, ", "AND a.bt = n.bt AND a.st = n.st ") if grid else ("", "")
    bt, st = ("bt", "st") if grid else (str(p.buy_thresh), str(p.sell_thresh))
    trial = f"CROSS JOIN (VALUES {grid}) AS g(bt, st)" if grid else ""
    gap = f"INTERVAL {p.cooldown_min} MINUTE"

    def sweep(name: str, source: str, by: str, same: str) -> str:
        return f"""{name}n AS (SELECT *, row_number() OVER (PARTITION BY {t}symbol, day, {by} ORDER BY ts, trigger) AS nr FROM {source}),
{name} AS (SELECT *, ts AS held, true AS fired FROM {name}n WHERE nr = 1 UNION ALL
    SELECT n.*, CASE WHEN n.ts >= a.held + {gap} THEN n.ts ELSE a.held END, n.ts >= a.held + {gap} FROM {name} AS a JOIN {name}n AS n ON n.symbol = a.symbol AND n.day = a.day AND n.{by} = a.{by} {u}AND n.nr = a.nr + 1)"""

    return f"""{features_sql(p, source)},
flag AS (SELECT *, coalesce(g_buy AND imb >= {bt}, false) AS f1, coalesce(g_open AND day_imb <= {st}, false) AS f2, coalesce(g_dist AND imb <= {st} AND (failed OR day_imb <= {st}), false) AS f3 FROM x {trial}),
was AS (SELECT *, coalesce(lag(f1) OVER w, false) AS w1, coalesce(lag(f2) OVER w, false) AS w2, coalesce(lag(f3) OVER w, false) AS w3 FROM flag WINDOW w AS (PARTITION BY {t}symbol ORDER BY ts)),
edge AS (SELECT {t}symbol, day, ts, 'accumulation' AS trigger, 'BUY' AS signal, close AS price, imb FROM was WHERE f1 AND NOT w1
    UNION ALL SELECT {t}symbol, day, ts, 'opening-rejection', 'SELL', close, imb FROM was WHERE f2 AND NOT w2
    UNION ALL SELECT {t}symbol, day, ts, 'distribution', 'SELL', close, imb FROM was WHERE f3 AND NOT w3),
{sweep('p1', 'edge', 'trigger', '')},
kept AS (SELECT {t}symbol, day, ts, trigger, signal, price, imb FROM p1 WHERE fired),
{sweep('p2', 'kept', 'signal', '')},
sig AS (SELECT {t}symbol, day, ts, trigger, signal, price, imb FROM p2 WHERE fired)"""


LATER_SQL = """lat AS (SELECT s.*, b.ts AS bar_ts, b.high, b.low, b.close, b.vwap, (b.close / s.price - 1) * 100 * (CASE WHEN s.signal = 'BUY' THEN 1 ELSE -1 END) AS move
    FROM sig AS s JOIN fv AS b ON b.symbol = s.symbol AND b.day = s.day AND b.ts > s.ts),
out1 AS (SELECT *, move >= {target} AS won, CASE WHEN signal = 'BUY' THEN close < vwap ELSE close > vwap END AS crossed FROM lat),
outs AS (SELECT symbol, ts, signal, trigger, max(move) AS mfe, min(move) AS mae, arg_max(move, bar_ts) AS to_close, min(bar_ts) FILTER (WHERE won) AS t, min(bar_ts) FILTER (WHERE crossed) AS s,
    arg_min(move, bar_ts) FILTER (WHERE crossed) AS at_cross FROM out1 GROUP BY symbol, ts, signal, trigger)""".replace("{target}", str(P.target_pct))
EXIT_SQL = "CASE WHEN t IS NOT NULL AND (s IS NULL OR t <= s) THEN 'target' WHEN s IS NOT NULL THEN 'vwap-stop' ELSE 'close' END"
MANAGED_SQL = f"CASE WHEN t IS NOT NULL AND (s IS NULL OR t <= s) THEN {P.target_pct} WHEN s IS NOT NULL THEN at_cross ELSE to_close END"


def feat(spark: SparkSession, d: str, p: Rules = P) -> DataFrame:
    return rules.features(bars(spark, d), p)


def both(spark: SparkSession, d: str, p: Rules = P) -> tuple[DataFrame, DataFrame]:
    f = feat(spark, d, p)
    return f, rules.signals(f, p)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("sb1_features", f"WITH {features_sql(P)} SELECT symbol, ts, round(imb, 6) AS imb, round(relvol, 6) AS relvol, round(clv_s, 6) AS clv_s, round(day_imb, 6) AS day_imb, CAST(streak AS BIGINT) AS streak, CAST(hod AS BIGINT) AS hod_min, failed AS failed_reclaim, gap AS gap_up, round(pv, 6) AS prior_vwap, round(runup, 6) AS runup_3d FROM x")
def _(spark, d):
    return feat(spark, d).select(*CORE, *r6("imb", "relvol", "clv_s", "day_imb"), F.col("streak").cast("long").alias("streak"), F.col("hod_min").cast("long").alias("hod_min"), "failed_reclaim", "gap_up", *r6("prior_vwap", "runup_3d"))


def _raw(trigger: str):
    def run(spark, d):
        f = feat(spark, d).withColumns(rules.gates(P))
        return f.where(rules.holds(trigger, F.lit(P.buy_thresh), F.lit(P.sell_thresh))).select(*CORE)

    return run


for _name, _trigger, _flag in (("sb2_buy_rule", "accumulation", f"g_buy AND imb >= {P.buy_thresh}"), ("sb3_sell_opening", "opening-rejection", f"g_open AND day_imb <= {P.sell_thresh}"), ("sb4_sell_distribution", "distribution", f"g_dist AND imb <= {P.sell_thresh} AND (failed OR day_imb <= {P.sell_thresh})")):
    query(_name, f"WITH {features_sql(P)} SELECT symbol, ts FROM x WHERE {_flag}")(_raw(_trigger))


@query("sb5_cooldown", f"WITH RECURSIVE_ {signals_sql(P)} SELECT symbol, ts, signal, trigger, round(price, 6) AS price FROM sig")
def _(spark, d):
    return both(spark, d)[1].select(*CORE, "signal", "trigger", *r6("price"))


@query("sb8_forward_returns", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL} SELECT s.symbol, s.ts, s.signal, " + ", ".join(f"round(coalesce((SELECT arg_max(l.move, l.bar_ts) FROM lat AS l WHERE l.symbol = s.symbol AND l.ts = s.ts AND l.signal = s.signal AND l.bar_ts <= s.ts + INTERVAL {m} MINUTE), 0), 6) AS fwd_{m}m" for m in HORIZONS) + " FROM sig AS s")
def _(spark, d):
    return rules.forward(*both(spark, d), HORIZONS).select(*CORE, "signal", *r6(*(f"fwd_{m}m" for m in HORIZONS)))


@query("sb9_managed_exit", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL} SELECT symbol, ts, signal, trigger, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(to_close, 6) AS to_close, round({MANAGED_SQL}, 6) AS managed, {EXIT_SQL} AS exit FROM outs")
def _(spark, d):
    return rules.outcomes(*both(spark, d), P.target_pct).select(*CORE, "signal", "trigger", *r6("mfe", "mae", "to_close", "managed"), "exit")


@query("sb10_capture", f"WITH RECURSIVE_ {signals_sql(P)}, days AS (SELECT symbol, count(DISTINCT day) AS days FROM {{bars}} GROUP BY symbol) SELECT symbol, CAST(day AS VARCHAR) AS day, signal, min(ts) AS first_ts, strftime(min(ts), '%H:%M') <= '{SOON}' AS in_time, round(any_value(rate), 6) AS per_day FROM sig JOIN (SELECT symbol, count(*) / any_value(days) AS rate FROM sig JOIN days USING (symbol) GROUP BY symbol) AS r USING (symbol) GROUP BY symbol, day, signal")
def _(spark, d):
    f, sig = both(spark, d)
    days = f.groupBy("symbol").agg(F.count_distinct("day").alias("days"))
    rate = sig.groupBy("symbol").agg(F.count("*").alias("n")).join(days, "symbol").select("symbol", F.round(F.col("n") / F.col("days"), 6).alias("per_day"))
    first = sig.groupBy("symbol", "day", "signal").agg(F.min("ts").alias("first_ts"))
    return undated(first.withColumn("in_time", F.date_format("first_ts", "HH:mm") <= SOON).join(rate, "symbol"))


GRID = [(b, -s) for b in (0.15, 0.20, 0.25, 0.30) for s in (0.15, 0.20, 0.25, 0.30)]
GRID_SQL = ", ".join(f"(CAST({b} AS DOUBLE), CAST({s} AS DOUBLE))" for b, s in GRID)


@query(
    "sb11_tuning_grid",
    f"""WITH RECURSIVE_ {signals_sql(P, grid=GRID_SQL)},
    moves AS (SELECT symbol, day, arg_max(close, ts) / arg_min(open, ts) - 1 AS r, count(*) AS n FROM {{bars}} GROUP BY symbol, day),
    aim AS (SELECT symbol, arg_max(day, (r, day)) AS best, arg_min(day, (r, day)) AS worst, count(*) AS days FROM moves GROUP BY symbol),
    hit AS (SELECT a.symbol, g.bt, g.st, a.days, count(s.ts) AS n, coalesce(min(strftime(s.ts, '%H:%M')) FILTER (WHERE s.signal = 'BUY' AND s.day = a.best) <= '{SOON}', false) AS b, coalesce(min(strftime(s.ts, '%H:%M')) FILTER (WHERE s.signal = 'SELL' AND s.day = a.worst) <= '{SOON}', false) AS w
      FROM aim AS a CROSS JOIN (VALUES {GRID_SQL}) AS g(bt, st) LEFT JOIN sig AS s ON s.symbol = a.symbol AND s.bt = g.bt AND s.st = g.st GROUP BY a.symbol, g.bt, g.st, a.days),
    sc AS (SELECT *, 2 * CAST(b AS INT) + 2 * CAST(w AS INT) - least(n / days, 4) / 2 AS score FROM hit)
    SELECT symbol, bt AS buy_thresh, st AS sell_thresh, n, round(score, 6) AS score, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 2) DESC, bt = 0.2 DESC, st = -0.3 DESC, bt, st) = 1 AS chosen FROM sc""",
)
def _(spark, d):
    grid = spark.createDataFrame(GRID, "buy_thresh double, sell_thresh double")
    f = feat(spark, d)
    sig = rules.signals(f, P, grid)
    moves = bars(spark, d).groupBy("symbol", F.col("day").alias("on")).agg((F.max_by("close", "ts") / F.min_by("open", "ts") - 1).alias("r"))
    aim = moves.groupBy("symbol").agg(F.max_by("on", F.struct("r", "on")).alias("best"), F.min_by("on", F.struct("r", "on")).alias("worst"), F.count("*").alias("days"))
    keys = ["symbol", "buy_thresh", "sell_thresh"]
    aim = aim.crossJoin(F.broadcast(grid))  # sixteen rows
    first = lambda kind, day: F.coalesce(F.min(F.when((F.col("signal") == kind) & (F.col("day") == F.col(day)), F.date_format("ts", "HH:mm"))) <= SOON, F.lit(False)).cast("int")
    hit = aim.join(sig, keys, "left").groupBy(*keys, "days").agg(F.count("ts").alias("n"), first("BUY", "best").alias("b"), first("SELL", "worst").alias("w"))
    score = 2 * F.col("b") + 2 * F.col("w") - F.least(F.col("n") / F.col("days"), F.lit(4.0)) / 2
    hit = hit.withColumn("score", F.round(score, 6))
    order = Window.partitionBy("symbol").orderBy(F.desc(F.round("score", 2)), F.desc(F.col("buy_thresh") == 0.2), F.desc(F.col("sell_thresh") == -0.3), "buy_thresh", "sell_thresh")  # sixteen rows
    return hit.select(*keys, "n", "score", (F.row_number().over(order) == 1).alias("chosen"))


FOUR_SQL = """(SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, CAST(time_bucket(INTERVAL '4 hours', ts) AS DATE) AS day, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(size) AS BIGINT) AS volume FROM {ticks} GROUP BY 1, 2, 3)"""
P4 = P.scaled(240)


def _counted(source: str, p: Rules, label: str) -> str:
    return f"(WITH RECURSIVE {signals_sql(p, source)} SELECT '{label}' AS timeframe, symbol, signal, count(*) AS n, min(ts) AS first_ts FROM sig GROUP BY symbol, signal)"


@query("sb13_timeframes", f"SELECT * FROM {_counted('{bars}', P, '1 hour')} AS a UNION ALL SELECT * FROM {_counted(FOUR_SQL, P4, '4 hours')} AS b")
def _(spark, d):
    out = None
    for label, p in (("1 hour", P), ("4 hours", P4)):
        sig = rules.signals(rules.features(resample(ticks(spark, d), label), p), p)
        one = sig.groupBy(F.lit(label).alias("timeframe"), "symbol", "signal").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
        out = one if out is None else out.unionByName(one)
    return out


PE = P.earlier()


@query("sb14_rule_versions", f"SELECT symbol, ts, signal, now.ts IS NOT NULL AS tightened, old.ts IS NOT NULL AS plain FROM (WITH RECURSIVE {signals_sql(P)} SELECT symbol, ts, signal FROM sig) AS now FULL JOIN (WITH RECURSIVE {signals_sql(PE)} SELECT symbol, ts, signal FROM sig) AS old USING (symbol, ts, signal)")
def _(spark, d):
    keys = ["symbol", "ts", "signal"]
    now = both(spark, d)[1].select(*keys, F.lit(True).alias("tightened"))
    old = both(spark, d, PE)[1].select(*keys, F.lit(True).alias("plain"))
    return now.join(old, keys, "full").na.fill(False, ["tightened", "plain"])


@query("sb15_oos_split", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL} SELECT CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'oos' ELSE 'baseline' END AS sample, signal, count(*) AS n, round(avg({MANAGED_SQL}), 6) AS mean, round(avg(CAST({MANAGED_SQL} > 0 AS INT)), 6) AS win FROM outs GROUP BY 1, 2")
def _(spark, d):
    out = rules.outcomes(*both(spark, d), P.target_pct).withColumn("sample", F.when(F.col("day") >= F.lit("2024-01-20").cast("date"), "oos").otherwise("baseline"))
    return out.groupBy("sample", "signal").agg(F.count("*").alias("n"), F.round(F.avg("managed"), 6).alias("mean"), F.round(F.avg((F.col("managed") > 0).cast("int")), 6).alias("win"))


# --- the absorption sale and its short-side outcomes

WICK, REJECT, NEAR_TOP, WEAK, LOOK, APART = 0.4, 1.2, 0.999, 1.0, 10, 240
ABSORBED_SQL = f"""a0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 0) AS rv0, sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS vwap, max(high) OVER d AS top
    FROM {{bars}} WINDOW d AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a1 AS (SELECT *, CASE WHEN k >= 10 THEN rv0 END AS rv FROM a0),
a2 AS (SELECT *, max(CASE WHEN rv >= {REJECT} AND coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) >= {WICK} AND high >= top * {NEAR_TOP} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts ROWS {LOOK - 1} PRECEDING) AS recent FROM a1),
a3 AS (SELECT *, coalesce(recent = 1 AND rv >= {WEAK} AND close < vwap AND close < open, false) AS sell FROM a2),
a4 AS (SELECT *, sell AND NOT coalesce(lag(sell) OVER (PARTITION BY symbol ORDER BY ts), false) AS edge FROM a3)"""
SHORT_SQL = f"""{ABSORBED_SQL}, sn AS (SELECT symbol, day, ts, close, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS nr FROM a4 WHERE edge),
sw AS (SELECT *, ts AS held, true AS fired FROM sn WHERE nr = 1 UNION ALL SELECT n.*, CASE WHEN n.ts >= a.held + INTERVAL {APART} MINUTE THEN n.ts ELSE a.held END, n.ts >= a.held + INTERVAL {APART} MINUTE FROM sw AS a JOIN sn AS n ON n.symbol = a.symbol AND n.day = a.day AND n.nr = a.nr + 1),
sl AS (SELECT s.symbol, s.day, s.ts, s.close AS entry, b.ts AS bar_ts, b.high, b.low, b.close, (s.close - b.close) / s.close * 100 AS gain FROM (SELECT * FROM sw WHERE fired) AS s JOIN a4 AS b ON b.symbol = s.symbol AND b.day = s.day AND b.ts > s.ts)"""


def absorbed(spark: SparkSession, d: str) -> DataFrame:
    """Bars with sell (rejected near the day's high, then weak below the average price) and edge."""
    symbol, day = rules.by_symbol(), rules.by_day()
    rv = rules._full(F.avg, "volume", 10)
    b = bars(spark, d).withColumns({"rv": F.col("volume") / F.nullif(rv, F.lit(0.0)), "vwap": F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).over(rules.so_far()) / F.nullif(F.sum("volume").over(rules.so_far()), F.lit(0)), "top": F.max("high").over(rules.so_far())})
    wick = F.coalesce((F.col("high") - F.greatest("open", "close")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    reject = F.coalesce((F.col("rv") >= REJECT) & (wick >= WICK) & (F.col("high") >= F.col("top") * NEAR_TOP), F.lit(False)).cast("int")
    b = b.withColumn("recent", F.max(reject).over(day.rowsBetween(1 - LOOK, 0)) == 1)
    b = b.withColumn("sell", F.coalesce(F.col("recent") & (F.col("rv") >= WEAK) & (F.col("close") < F.col("vwap")) & (F.col("close") < F.col("open")), F.lit(False)))
    return b.withColumn("edge", F.col("sell") & ~F.coalesce(F.lag("sell").over(symbol), F.lit(False)))


def shorts(spark: SparkSession, d: str) -> DataFrame:
    """Each kept sale with the later bars of its day; gain is a short's, in per cent; stop the high of the last LOOK bars."""
    b = absorbed(spark, d).withColumn("stop", F.max("high").over(rules.by_day().rowsBetween(1 - LOOK, 0)))
    kept = rules.cooled(b.where("edge").select("symbol", "day", "ts", F.col("close").alias("entry"), "stop"), ["symbol", "day"], APART)
    path = b.select("symbol", "day", F.col("ts").alias("bar_ts"), "high", "low", "close")
    return kept.join(path, ["symbol", "day"]).where("bar_ts > ts").withColumn("gain", (F.col("entry") - F.col("close")) / F.col("entry") * 100)


@query("sb16_absorption_sell", f"WITH {ABSORBED_SQL} SELECT symbol, ts, edge FROM a4 WHERE sell")
def _(spark, d):
    return absorbed(spark, d).where("sell").select(*CORE, "edge")


@query("sb17_short_backtest", f"WITH RECURSIVE_ {SHORT_SQL} SELECT symbol, ts, round(max(gain), 6) AS mfe, round(min(gain), 6) AS mae, round(arg_max(gain, bar_ts), 6) AS eod, round(arg_max(gain, bar_ts) FILTER (WHERE bar_ts <= ts + INTERVAL 60 MINUTE), 6) AS fwd60, round(arg_max(gain, bar_ts) FILTER (WHERE bar_ts <= ts + INTERVAL 120 MINUTE), 6) AS fwd120 FROM sl GROUP BY symbol, ts")
def _(spark, d):
    near = lambda m: F.round(F.max_by("gain", F.when(F.col("bar_ts") <= F.col("ts") + F.expr(f"INTERVAL {m} MINUTES"), F.col("bar_ts"))), 6).alias(f"fwd{m}")
    return shorts(spark, d).groupBy(*CORE).agg(F.round(F.max("gain"), 6).alias("mfe"), F.round(F.min("gain"), 6).alias("mae"), F.round(F.max_by("gain", "bar_ts"), 6).alias("eod"), near(60), near(120))


@query("sb18_stop_managed", f"WITH RECURSIVE_ {SHORT_SQL}, lv AS (SELECT l.*, (SELECT max(b.high) FROM (SELECT high FROM a4 AS q WHERE q.symbol = l.symbol AND q.day = l.day AND q.ts <= l.ts ORDER BY q.ts DESC LIMIT {LOOK}) AS b) AS stop FROM sl AS l), o AS (SELECT symbol, ts, any_value(entry) AS entry, any_value(stop) AS stop, min(bar_ts) FILTER (WHERE high >= stop) AS s, min(bar_ts) FILTER (WHERE low <= entry * (1 - {P.target_pct} / 100)) AS t, arg_max(gain, bar_ts) AS eod FROM lv GROUP BY symbol, ts) SELECT symbol, ts, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'close' END AS outcome, round(CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN (entry - stop) / entry * 100 WHEN t IS NOT NULL THEN {P.target_pct} ELSE eod END, 6) AS managed FROM o")
def _(spark, d):
    stopped, won = F.col("high") >= F.col("stop"), F.col("low") <= F.col("entry") * (1 - P.target_pct / 100)
    first = F.min(F.when(stopped | won, F.struct(F.col("bar_ts").alias("at"), stopped.alias("stopped"))))
    out = shorts(spark, d).groupBy(*CORE, "entry", "stop").agg(first.alias("f"), F.max_by("gain", "bar_ts").alias("eod"))
    managed = F.when(F.col("f").isNull(), F.col("eod")).when(F.col("f")["stopped"], (F.col("entry") - F.col("stop")) / F.col("entry") * 100).otherwise(P.target_pct)
    return out.select(*CORE, F.when(F.col("f").isNull(), "close").when(F.col("f")["stopped"], "stop").otherwise("target").alias("outcome"), F.round(managed, 6).alias("managed"))


@query("sb20_cost_sensitivity", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL} SELECT cost, round(avg({MANAGED_SQL} - cost), 6) AS net, count(*) AS n FROM outs CROSS JOIN (VALUES {', '.join(f'(CAST({c} AS DOUBLE))' for c in COSTS)}) AS v(cost) GROUP BY cost")
def _(spark, d):
    costs = spark.createDataFrame([(c,) for c in COSTS], "cost double")
    out = rules.outcomes(*both(spark, d), P.target_pct).crossJoin(F.broadcast(costs))  # three rows
    return out.groupBy("cost").agg(F.round(F.avg(F.col("managed") - F.col("cost")), 6).alias("net"), F.count("*").alias("n"))


# --- labels, overlaps, uniqueness

WIDTH, AHEAD, COST_BPS, K_BARRIER, MOST, COST_RT = 2.0, 10, 6.0, 0.5, 60, 0.0007
EVENTS_SQL = """e0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM {bars}),
ev AS (SELECT *, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END AS sigma FROM e0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING))"""
TOUCH_SQL = f"""{EVENTS_SQL},
tj AS (SELECT a.symbol, a.day, a.ts, a.pos, a.close, a.sigma, min(b.pos) FILTER (WHERE b.high >= a.close * exp({WIDTH} * a.sigma) OR b.low <= a.close * exp(-{WIDTH} * a.sigma)) AS hit, max(b.pos) AS last
    FROM ev AS a LEFT JOIN ev AS b ON b.symbol = a.symbol AND b.day = a.day AND b.pos > a.pos AND b.pos <= a.pos + {AHEAD} WHERE a.sigma > 0 AND {WIDTH} * a.sigma * 1e4 >= {COST_BPS} GROUP BY a.symbol, a.day, a.ts, a.pos, a.close, a.sigma),
tl AS (SELECT t.symbol, t.day, t.ts, t.pos, coalesce(t.hit, t.last, t.pos) AS touch, ln(e.close / t.close) AS ret, CASE WHEN t.hit IS NULL THEN CASE WHEN abs(ln(e.close / t.close)) < t.sigma / 2 THEN 0 ELSE sign(ln(e.close / t.close)) END WHEN e.high >= t.close * exp({WIDTH} * t.sigma) THEN 1 ELSE -1 END AS label
    FROM tj AS t JOIN ev AS e ON e.symbol = t.symbol AND e.pos = coalesce(t.hit, t.last, t.pos))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Bars with pos and sigma, the spread of the last ten log returns."""
    w = rules.by_symbol().rowsBetween(-9, 0)
    b = bars(spark, d).withColumns({"pos": F.row_number().over(rules.by_symbol()), "ret": F.log(F.col("close") / F.lag("close").over(rules.by_symbol()))})
    return b.withColumn("sigma", F.when(F.count("ret").over(w) >= 10, F.stddev_samp("ret").over(w)))


def touches(spark: SparkSession, d: str) -> DataFrame:
    return first_touch(events(spark, d), WIDTH, AHEAD, COST_BPS)


@query("ml2_triple_barrier", f"WITH {TOUCH_SQL} SELECT symbol, ts, CAST(label AS INT) AS label, CAST(touch - pos AS BIGINT) AS bars, round(ret, 6) AS ret FROM tl")
def _(spark, d):
    return touches(spark, d).select(*CORE, F.col("label").cast("int").alias("label"), (F.col("touch") - F.col("pos")).cast("long").alias("bars"), *r6("ret"))


@query(
    "ml3_triple_barrier_entry",
    f"""WITH RECURSIVE_ {signals_sql(P)}, {EVENTS_SQL},
    en AS (SELECT s.symbol, s.day, s.ts, s.signal, v.sigma, v.pos + 1 AS entry_pos, n.open AS entry, CASE WHEN s.signal = 'BUY' THEN 1 ELSE -1 END AS sg, least({MOST}, (SELECT max(q.pos) FROM ev AS q WHERE q.symbol = s.symbol AND q.day = s.day) - v.pos - 1) AS h
      FROM sig AS s JOIN ev AS v ON v.symbol = s.symbol AND v.ts = s.ts JOIN ev AS n ON n.symbol = s.symbol AND n.pos = v.pos + 1 AND n.day = s.day WHERE v.sigma > 0),
    ba AS (SELECT *, {K_BARRIER} * sigma * sqrt(h) AS w FROM en WHERE h >= 1),
    tr AS (SELECT a.symbol, a.ts, a.signal, a.w, a.sg, a.entry, a.entry_pos, a.h, min(b.pos * 2 + CASE WHEN (CASE WHEN a.sg = 1 THEN b.low <= a.entry * (1 - a.w) ELSE b.high >= a.entry * (1 + a.w) END) THEN 0 ELSE 1 END)
        FILTER (WHERE b.low <= a.entry * (1 - a.w) OR b.high >= a.entry * (1 + a.w)) AS hit
      FROM ba AS a JOIN ev AS b ON b.symbol = a.symbol AND b.pos > a.entry_pos AND b.pos <= a.entry_pos + a.h GROUP BY ALL),
    ne AS (SELECT t.*, CASE WHEN hit IS NULL THEN 'vertical' WHEN hit % 2 = 0 THEN 'stop' ELSE 'target' END AS outcome, CASE WHEN hit IS NULL THEN t.sg * (e.close / t.entry - 1) WHEN hit % 2 = 0 THEN -t.w ELSE t.w END - {COST_RT} AS net FROM tr AS t JOIN ev AS e ON e.symbol = t.symbol AND e.pos = t.entry_pos + t.h)
    SELECT symbol, ts, signal, outcome, round(net, 6) AS net, CAST(net > 0 AS INT) AS meta FROM ne""",
)
def _(spark, d):
    sig = both(spark, d)[1].select("symbol", "day", "ts", "signal").join(events(spark, d).select("symbol", "ts", "sigma"), CORE)
    path = bars(spark, d).select("symbol", "day", F.struct(F.col("ts").alias("at"), "open", "high", "low", "close").alias("bar"))
    rows = sig.join(path, ["symbol", "day"]).where("bar.at > ts").groupBy("symbol", "ts", "signal", "sigma").agg(F.sort_array(F.collect_list("bar")).alias("path"))
    return meta_labels(rows, K_BARRIER, MOST, COST_RT).select(*CORE, "signal", F.col("hit").alias("outcome"), *r6("net"), "meta")


UNIQUE_SQL = f"""{TOUCH_SQL}, uc AS (SELECT b.symbol, b.pos, count(*) AS c FROM ev AS b JOIN tl AS s ON s.symbol = b.symbol AND b.pos BETWEEN s.pos AND s.touch GROUP BY b.symbol, b.pos),
uq AS (SELECT s.symbol, s.ts, avg(CAST(1 AS DOUBLE) / uc.c) AS uniq FROM tl AS s JOIN uc ON uc.symbol = s.symbol AND uc.pos BETWEEN s.pos AND s.touch GROUP BY s.symbol, s.ts)"""


def unique(spark: SparkSession, d: str) -> DataFrame:
    return uniqueness(events(spark, d).select("symbol", "day", "pos"), touches(spark, d).withColumnRenamed("touch", "stop"))


@query("ml4_sample_weights", f"WITH {UNIQUE_SQL}, wt AS (SELECT *, uniq * (0.5 + 0.5 * (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1)) AS w FROM uq) SELECT symbol, ts, round(w / avg(w) OVER (PARTITION BY symbol), 6) AS weight FROM wt")
def _(spark, d):
    return sample_weights(staged(unique(spark, d), "uniqueness")).select(*CORE, *r6("weight"))


def sample_weights(rows: DataFrame) -> DataFrame:
    """rows (symbol, ts, uniqueness) with weight: uniqueness times a share that grows from a half to one with the place in
    time, over the symbol's mean. Places are counted in slices of time; sizes and means are a row a symbol."""
    rows = numbered(rows, ["symbol"], "ts")
    rows = rows.join(rows.groupBy("symbol").agg(F.greatest(F.max("_n"), F.lit(1)).alias("_last")), "symbol")
    rows = rows.withColumn("_w", F.col("uniqueness") * (0.5 + 0.5 * F.col("_n") / F.col("_last")))
    mean = rows.groupBy("symbol").agg(F.avg("_w").alias("_mean"))
    return rows.join(mean, "symbol").withColumn("weight", F.col("_w") / F.col("_mean")).drop("_n", "_last", "_w", "_mean")


@query("ml5_average_uniqueness", f"WITH {UNIQUE_SQL} SELECT symbol, ts, round(uniq, 6) AS uniqueness FROM uq")
def _(spark, d):
    return unique(spark, d).select(*CORE, *r6("uniqueness"))


def _open(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("symbol", "day", "event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("b"))


_OPEN_SQL = "e AS (SELECT symbol, day, event_id, ts AS a, ts + INTERVAL 90 MINUTE AS b FROM {trades})"


@query("jn18_label_overlap", f"WITH {_OPEN_SQL} SELECT x.symbol, x.event_id, count(*) AS concurrency FROM e AS x JOIN e AS y ON x.symbol = y.symbol AND y.a <= x.b AND y.b >= x.a GROUP BY x.symbol, x.event_id")
def _(spark, d):
    return overlaps(_open(spark, d), ["symbol"], "event_id", "a", "b").withColumnRenamed("n", "concurrency")


@query("ma11_uniqueness", f"WITH {_OPEN_SQL}, c AS (SELECT x.symbol, x.event_id, count(*) AS n FROM e AS x JOIN e AS y ON x.symbol = y.symbol AND x.day = y.day AND y.a <= x.b AND y.b >= x.a GROUP BY x.symbol, x.event_id) SELECT symbol, round(avg(CAST(1 AS DOUBLE) / n), 6) AS uniqueness FROM c GROUP BY symbol")
def _(spark, d):
    return overlaps(_open(spark, d), ["symbol", "day"], "event_id", "a", "b").groupBy("symbol").agg(F.round(F.avg(1 / F.col("n")), 6).alias("uniqueness"))


# --- exponential averages of whole series

EMA_SQL = "WITH RECURSIVE_ r AS (SELECT symbol, {t}, close, row_number() OVER (PARTITION BY symbol ORDER BY {t}) AS k FROM {{{f}}}), e AS (SELECT symbol, {t}, k, close AS ema FROM r WHERE k = 1 UNION ALL SELECT r.symbol, r.{t}, r.k, e.ema * (1 - CAST({a} AS DOUBLE)) + r.close * {a} FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1) SELECT symbol, {o}, round(ema, 4) AS ema FROM e"


@query("wn23_ema", EMA_SQL.format(t="day", f="daily", a=2 / 11, o="CAST(day AS VARCHAR) AS day"))
def _(spark, d):
    return undated(ema(daily(spark, d), ["symbol"], "day", "close", 10).select("symbol", "day", F.round("ema", 4).alias("ema")))


@query("tsk4_exp_average", EMA_SQL.format(t="ts", f="bars", a=2 / 22, o="ts"))
def _(spark, d):
    return ema(bars(spark, d), ["symbol"], "ts", "close", 21).select(*CORE, F.round("ema", 4).alias("ema"))


# --- a strategy that is long, short or flat

FLAT_MIN = 1320
EXITS_SQL = f"""lx AS (SELECT symbol, day, ts, signal, price, min(bar_ts) FILTER (WHERE move >= {P.target_pct} OR (CASE WHEN signal = 'BUY' THEN close < vwap ELSE close > vwap END) OR hour(bar_ts) * 60 + minute(bar_ts) >= {FLAT_MIN}) AS hit, max(bar_ts) AS last FROM lat GROUP BY symbol, day, ts, signal, price),
ox AS (SELECT *, coalesce(hit, last) AS out_ts, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, signal) AS nr FROM lx),
po AS (SELECT *, out_ts AS busy, true AS fired FROM ox WHERE nr = 1 UNION ALL SELECT n.*, CASE WHEN n.ts >= a.busy THEN n.out_ts ELSE a.busy END, n.ts >= a.busy FROM po AS a JOIN ox AS n ON n.symbol = a.symbol AND n.day = a.day AND n.nr = a.nr + 1)"""


@query("tsk10_strategy_orders", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL}, {EXITS_SQL} SELECT symbol, ts AS entry_ts, signal, round(price, 6) AS price, out_ts AS exit_ts FROM po WHERE fired")
def _(spark, d):
    crossed = F.when(F.col("signal") == "BUY", F.col("bar_close") < F.col("bar_vwap")).otherwise(F.col("bar_close") > F.col("bar_vwap"))
    flat = F.hour("bar_ts") * 60 + F.minute("bar_ts") >= FLAT_MIN
    gone = (F.col("move") >= P.target_pct) | crossed | flat
    ends = rules.later(*both(spark, d)).groupBy("symbol", "day", "ts", "signal", "price").agg(F.coalesce(F.min(F.when(gone, F.col("bar_ts"))), F.max("bar_ts")).alias("exit_ts"))
    # A fold over a day's signals: one is taken only when the last position is closed.
    rows = ends.groupBy("symbol", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "signal", "price", "exit_ts"))).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda a, x: F.when((F.size(a) == 0) | (x["ts"] >= F.element_at(a, -1)["exit_ts"]), F.concat(a, F.array(x))).otherwise(a))
    return rows.select("symbol", F.inline(kept)).select("symbol", F.col("ts").alias("entry_ts"), "signal", *r6("price"), "exit_ts")


# --- tables made of the signals

LOOSE = P.loosened()
#: Symbols that give a signal its context, and the bars of its two measures.
TREND, FLOW, SLOPE, SPREAD = "view", "purchase", 15, 5


@query("tsk9_loosened_rules", f"WITH RECURSIVE_ {signals_sql(LOOSE)} SELECT symbol, ts, trigger, signal FROM sig")
def _(spark, d):
    return both(spark, d, LOOSE)[1].select(*CORE, "trigger", "signal")


@query("tsk15_alerts", f"WITH RECURSIVE_ {signals_sql(P)} SELECT signal || ' ' || symbol || ': ' || trigger AS alert, ts FROM sig")
def _(spark, d):
    return both(spark, d)[1].select(F.concat("signal", F.lit(" "), "symbol", F.lit(": "), "trigger").alias("alert"), "ts")


@query("sk2_event_table", f"WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL}, mg AS (SELECT symbol, ts, signal, trigger, mfe, mae, {MANAGED_SQL} AS managed FROM outs) SELECT symbol, ts, signal, trigger, round(price, 4) AS price, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(managed, 6) AS managed FROM sig LEFT JOIN mg USING (symbol, ts, signal, trigger)")
def _(spark, d):
    """Signals with their outcomes as a Parquet table by symbol, as written and read again."""
    f, sig = both(spark, d)
    keys = ["symbol", "ts", "signal", "trigger"]
    rows = sig.join(rules.outcomes(f, sig, P.target_pct).select(*keys, "mfe", "mae", "managed"), keys, "left").select(*keys, F.round("price", 4).alias("price"), *r6("mfe", "mae", "managed"))
    path = f"{shared_dir(spark)}/stages/events-{uuid.uuid4().hex}"
    write_events(rows, path, ["symbol"])
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns)


_MATRIX = ("relvol", "clv_s", "cvd_slope", "vwap_dist", "imb", "day_imb", "runup_3d", "realized_vol", "trend", "flow")


@query(
    "ml6_feature_matrix",
    f"""WITH RECURSIVE_ {signals_sql(P)},
    xr AS (SELECT *, ln(close) - ln(lag(close) OVER d) AS lr, lead(ts) OVER d AS nx, first_value(open) OVER d AS dopen FROM x WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
    xs AS (SELECT *, CASE WHEN k >= 3 THEN regr_slope(cum, k) OVER w / nullif(avg(volume) OVER w, 0) END AS cvd_slope, CASE WHEN count(lr) OVER v >= {SPREAD} THEN stddev_samp(lr) OVER v END AS rv, close / dopen - 1 AS since
      FROM xr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {SLOPE - 1} PRECEDING), v AS (PARTITION BY symbol ORDER BY ts ROWS {SPREAD - 1} PRECEDING))
    SELECT s.symbol, s.ts, CAST(s.signal = 'SELL' AS INT) AS side_is_sell, CAST(s.trigger = 'accumulation' AS INT) AS trig_accumulation, CAST(s.trigger = 'opening-rejection' AS INT) AS trig_opening_rejection, CAST(s.trigger = 'distribution' AS INT) AS trig_distribution, CAST(f.m AS BIGINT) AS min_of_day,
      round(f.relvol, 6) AS relvol, round(f.clv_s, 6) AS clv_s, round(f.cvd_slope, 6) AS cvd_slope, round((f.close - f.vwap) / f.vwap, 6) AS vwap_dist, round(f.imb, 6) AS imb, round(f.day_imb, 6) AS day_imb, round(f.runup, 6) AS runup_3d, round(f.rv, 6) AS realized_vol, round(t.since, 6) AS trend, round(w.relvol, 6) AS flow
    FROM sig AS s JOIN xs AS f ON f.symbol = s.symbol AND f.ts = s.ts AND f.nx IS NOT NULL
      ASOF LEFT JOIN (SELECT day, ts, since FROM xs WHERE symbol = '{TREND}') AS t ON t.day = s.day AND s.ts >= t.ts
      ASOF LEFT JOIN (SELECT day, ts, relvol FROM xs WHERE symbol = '{FLOW}') AS w ON w.day = s.day AND s.ts >= w.ts""",
)
def _(spark, d):
    rows = rules.signal_features(*both(spark, d), TREND, FLOW, SLOPE, SPREAD).drop("imb").withColumnRenamed("imb_now", "imb")
    return rows.select(*CORE, "side_is_sell", "trig_accumulation", "trig_opening_rejection", "trig_distribution", F.col("min_of_day").cast("long").alias("min_of_day"), *r6(*_MATRIX))


_SCORED_SQL = f"{TOUCH_SQL}, {features_sql(P)}"


@query("ml13_meta_target", f"WITH {_SCORED_SQL} SELECT symbol, ts, CAST(coalesce(sign(tl.label) = CASE WHEN x.imb = 0 THEN 1 ELSE sign(x.imb) END, false) AS INT) AS meta FROM tl JOIN x USING (symbol, ts)")
def _(spark, d):
    """Whether the side that the flow points to is the one that its barrier label gives; no flow points to none."""
    rows = touches(spark, d).select(*CORE, "label").join(feat(spark, d).select(*CORE, "imb"), CORE)
    primary = F.when(F.col("imb") == 0, 1.0).otherwise(F.signum("imb"))
    return rows.select(*CORE, F.coalesce(F.signum("label") == primary, F.lit(False)).cast("int").alias("meta"))


COST = 0.0007


@query(
    "ml11_threshold_pick",
    f"""WITH {_SCORED_SQL}, sc AS (SELECT symbol, round(x.imb, 6) AS p, tl.ret - {COST} AS net FROM tl JOIN x USING (symbol, ts) WHERE x.imb IS NOT NULL),
    qs AS (SELECT symbol, count(*) AS n, unnest(quantile_cont(p, {SHARES})) AS cut FROM sc GROUP BY symbol),
    tk AS (SELECT DISTINCT symbol, n, round(cut, 6) AS cut FROM qs),
    be AS (SELECT tk.symbol, tk.cut, avg(sc.net) AS mean FROM tk JOIN sc ON sc.symbol = tk.symbol AND sc.p >= tk.cut GROUP BY tk.symbol, tk.cut, tk.n HAVING count(*) >= greatest(3, 0.15 * tk.n))
    SELECT symbol, coalesce(max(cut), 0.5) AS cut FROM (SELECT DISTINCT symbol FROM sc) AS s LEFT JOIN (SELECT symbol, cut FROM be QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, cut) = 1) AS b USING (symbol) GROUP BY symbol""",
)
def _(spark, d):
    """For each symbol the cut of the flow, of 17 exact quantiles, above which labelled bars earn most."""
    rows = touches(spark, d).select(*CORE, "ret").join(feat(spark, d).select(*CORE, "imb"), CORE).where("imb IS NOT NULL")
    rows = rows.select("symbol", F.round("imb", 6).alias("p"), (F.col("ret") - COST).alias("net"))
    cuts = quantiles(rows, ["symbol"], {f"q{i}": (F.col("p"), share) for i, share in enumerate(SHARES)})
    cuts = cuts.select("symbol", F.array(*(F.round(f"q{i}", 6) for i in range(len(SHARES)))).alias("cuts"))
    return picked(rows, ["symbol"], "p", "net", cuts)


SMALL_GRID = (0.2, 0.25, 0.3, 0.35)


@query("jn20_grid", f"WITH {features_sql(P)} SELECT b.t AS buy, -s.t AS sell, count(*) FILTER (WHERE g_buy AND imb >= b.t) AS n_buy, count(*) FILTER (WHERE g_open AND day_imb <= -s.t) AS n_sell FROM x CROSS JOIN (SELECT unnest([CAST({SMALL_GRID[0]} AS DOUBLE), {', '.join(map(str, SMALL_GRID[1:]))}]) AS t) AS b CROSS JOIN (SELECT unnest([CAST({SMALL_GRID[0]} AS DOUBLE), {', '.join(map(str, SMALL_GRID[1:]))}]) AS t) AS s GROUP BY b.t, s.t")
def _(spark, d):
    """How many bars each pair of thresholds of a small grid lets through; the grid is a table that meets every bar."""
    one = spark.createDataFrame([(t,) for t in SMALL_GRID], "t double")
    grid = one.select(F.col("t").alias("buy")).crossJoin(one.select((-F.col("t")).alias("sell")))  # the pairs
    rows = feat(spark, d).withColumns(rules.gates(P)).select("accumulation", F.col("opening-rejection").alias("opening"), "imb", "day_imb").where("accumulation OR opening")
    hits = rows.crossJoin(F.broadcast(grid)).groupBy("buy", "sell").agg(F.count_if(F.col("accumulation") & (F.col("imb") >= F.col("buy"))).alias("n_buy"), F.count_if(F.col("opening") & (F.col("day_imb") <= F.col("sell"))).alias("n_sell"))
    return grid.join(hits, ["buy", "sell"], "left").na.fill(0)
