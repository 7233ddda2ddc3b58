"""Scans, projections, joins, aggregates, windows, top-k, sets and scalar functions.

The texts are Spark SQL over frames; Catalyst prunes and pushes into the scans. D and S are the
day-anchored and the continuous orders of a symbol's bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..operators.ranges import in_slice, ranked, with_edges
from ..sources.market import resample, ticks
from ..sources.stage import staged
from .registry import frame, query, sql

#: Bar lengths.
RULES = ("1 minute", "5 minutes", "15 minutes", "30 minutes", "1 hour", "1 day")

D = "PARTITION BY symbol, day ORDER BY ts"
S = "PARTITION BY symbol ORDER BY ts"


def roll(agg: str, n: int, x: str, part: str = S, least: int | None = None, second: str = "") -> str:
    """agg(x) over the last n rows, NULL until `least` (n) values are there, as rolling frames are defined."""
    over = f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    args = f"{x}, {second}" if second else x
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {agg}({args}) {over} END"


RET = f"ln(close) - ln(lag(close) OVER ({D}))"
RET_S = f"ln(close) - ln(lag(close) OVER ({S}))"
SIGNED = f"coalesce(sign(close - lag(close) OVER ({S})), 0) * volume"
CLV = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
VWAP = f"sum((high + low + close) / 3 * volume) OVER ({D} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({D} ROWS UNBOUNDED PRECEDING), 0)"
KEYS = "symbol, ts"


def bars(name: str, *exprs: str, frame: str = "bars", first: str = "", keys: str = KEYS) -> None:
    """A projection of a frame; `first` is an inner projection that adds columns."""
    source = f"(SELECT *, {first} FROM {{{frame}}}) AS b" if first else f"{{{frame}}}"
    sql(name, f"SELECT {keys}, {', '.join(exprs)} FROM {source}")


# --- scans
sql("sc4_bar_frame", "SELECT symbol, ts, open, high, low, close, volume, CASE WHEN tod < '09:30' THEN 'pre' WHEN tod <= '15:59' THEN 'regular' ELSE 'post' END AS session FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY open) AS rn FROM {bars}) AS b WHERE rn = 1")
sql("sc5_weekdays", "SELECT day FROM (SELECT explode(sequence(lo, hi, INTERVAL 1 DAY)) AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM {bars}) AS b) AS d WHERE weekday(day) < 5", "SELECT day FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM {bars}) AS b) AS d WHERE isodow(day) < 6")
sql("sc6_range_scan", "SELECT symbol, ts, close FROM {bars} WHERE ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'", "SELECT symbol, ts, close FROM {bars} WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'")
sql("sc7_daily_scan", "SELECT symbol, day, open, high, low, close, volume FROM {daily}")
sql("sc11_consolidate", "SELECT DISTINCT symbol, ts, close FROM {bars} WHERE tod BETWEEN '09:30' AND '15:59'")
sql("sc12_tick_scan", "SELECT event_id, symbol, ts, price, size FROM {ticks}")
sql("sc15_union_scan", "SELECT symbol, ts, max(price) AS price FROM (SELECT symbol, ts, price FROM {ticks} WHERE size >= 20 UNION ALL SELECT symbol, ts, price FROM {ticks} WHERE size < 40) AS u GROUP BY symbol, ts")

# --- projections, filters, predicates, dedup
bars("pf1_session", "CASE WHEN tod < '09:30' THEN 'pre' WHEN tod <= '15:59' THEN 'regular' ELSE 'post' END AS session")
sql("pf2_rth", "SELECT symbol, ts, close FROM {bars} WHERE tod BETWEEN '09:30' AND '15:59'")
sql("pf3_dedup_first", "SELECT symbol, user_id, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, user_id ORDER BY ts) AS rn FROM {ticks}) AS t WHERE rn = 1")
sql("pf4_time_slice", "SELECT symbol, ts, close FROM {bars} WHERE tod BETWEEN '10:00' AND '12:00'")
sql("pf5_day_slice", "SELECT symbol, ts, close FROM {bars} WHERE day = DATE '2024-01-10'")
bars("pf6_composite_rule", "coalesce(close > vwap AND r3 > 0.01 AND volume > 50, false) AS fires, coalesce(NOT (r3 > 0.1), true) AS not_run_up", first=f"{VWAP} AS vwap, close / lag(close, 3) OVER ({S}) - 1 AS r3")
bars("pf7_first_bar", f"row_number() OVER ({D}) = 1 AS is_first")
sql("pf8_quote_sanity", "SELECT symbol, ts, bid, ask FROM {quotes} WHERE bid > 0 AND ask > 0 AND ask >= bid")
sql("pf9_action_filter", "SELECT event_id, ts, value FROM {events} WHERE event_type = 'purchase'")
sql("pf10_economic_rows", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM {orders} WHERE o_orderstatus IN ('F', 'O') AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR rlike(o_orderpriority, '(?i)medium'))")
sql("pf11_first_truthy", "SELECT news_id, coalesce(nullif(CASE WHEN news_id % 2 = 0 THEN '' ELSE source_type END, ''), nullif(source_type, 'economic'), 'none') AS kind FROM {news}")
bars("pf12_clip", "CASE WHEN close IS NULL THEN NULL ELSE greatest(100.0, least(close, 400.0)) END AS clipped")
bars("pf13_zero_to_null", "round((close - low) / nullif(high - low, 0), 6) AS place")
bars("pf14_inf_to_null", "CASE WHEN abs(x) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE round(x, 6) END AS x", first="CASE WHEN high = low THEN CAST('Infinity' AS DOUBLE) ELSE close / (high - low) END AS x")


@query("pf15_winsorise", "SELECT symbol, ts, round(greatest(lo, least(close, hi)), 6) AS close FROM {bars} CROSS JOIN (SELECT quantile_cont(close, 0.02) AS lo, quantile_cont(close, 0.98) AS hi FROM {bars}) AS q")
def _(spark, d):
    b = frame(spark, d, "bars").select("symbol", "ts", "close")
    ends = quantiles(b, [], {"lo": (F.col("close"), 0.02), "hi": (F.col("close"), 0.98)})
    return b.crossJoin(F.broadcast(ends)).select("symbol", "ts", F.round(F.greatest("lo", F.least("close", "hi")), 6).alias("close"))  # one row


sql("pf16_tod_band", "SELECT symbol, ts, volume FROM {bars} WHERE tod >= '09:30' AND tod < '11:00'")
bars("pf17_sample_flag", "CASE WHEN day >= DATE '2024-01-20' THEN 'oos' ELSE 'baseline' END AS sample")
sql("pf18_news_timeline", "SELECT day, news_id, source_type, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS rn FROM {news} WHERE relevance >= 0.25 AND source_type IN ('press_release', 'analyst', 'stock_news', 'economic')) AS n WHERE rn <= 14")
sql("pf19_warm_up", f"SELECT symbol, ts, CAST(bar AS BIGINT) AS bar FROM (SELECT *, row_number() OVER ({D}) AS bar FROM {{bars}}) AS b WHERE bar <= 5")

# --- joins
sql("jn6_baseline_join", "SELECT b.symbol, b.ts, round(b.volume - m.med, 6) AS above FROM {bars} AS b LEFT JOIN (SELECT symbol, tod, median(CAST(volume AS DOUBLE)) AS med FROM {bars} GROUP BY symbol, tod) AS m ON b.symbol = m.symbol AND b.tod = m.tod")
sql("jn7_time_alignment", f"WITH r AS (SELECT symbol, ts, {RET_S} AS ret FROM {{bars}}) SELECT a.ts, round(a.ret, 6) AS click, round(b.ret, 6) AS purchase, round(c.ret, 6) AS view FROM r AS a JOIN r AS b ON a.ts = b.ts JOIN r AS c ON a.ts = c.ts WHERE a.symbol = 'click' AND b.symbol = 'purchase' AND c.symbol = 'view' AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND c.ret IS NOT NULL")
sql("jn8_left_align", "SELECT a.ts, a.close, b.close AS other FROM {bars} AS a LEFT JOIN (SELECT ts, close FROM {bars} WHERE symbol = 'view') AS b ON a.ts = b.ts WHERE a.symbol = 'click'")
sql("jn9_day_map", "WITH d AS (SELECT symbol, day, max_by(close, ts) AS last FROM {bars} GROUP BY symbol, day), p AS (SELECT symbol, day, lag(last) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM d) SELECT b.symbol, b.ts, p.prev AS prev_close FROM {bars} AS b LEFT JOIN p ON b.symbol = p.symbol AND b.day = p.day")
sql("jn14_anti_day_side", "SELECT a.event_id FROM {trades} AS a LEFT ANTI JOIN {quotes} AS b ON a.symbol = b.symbol AND a.day = b.day AND hour(a.ts) = hour(b.ts)", "SELECT a.event_id FROM {trades} AS a ANTI JOIN {quotes} AS b ON a.symbol = b.symbol AND a.day = b.day AND hour(a.ts) = hour(b.ts)")
sql("jn15_kept_signals", "SELECT t.event_id FROM {trades} AS t LEFT SEMI JOIN {quotes} AS q ON t.symbol = q.symbol AND t.day = q.day", "SELECT t.event_id FROM {trades} AS t SEMI JOIN {quotes} AS q ON t.symbol = q.symbol AND t.day = q.day")
bars("jn16_offsets", f"lag(close, 5) OVER ({S}) AS before, lead(close, 5) OVER ({S}) AS after")
sql("jn17_key_semi", "SELECT b.symbol, b.ts FROM {bars} AS b WHERE b.day IN (SELECT day FROM {ticks} GROUP BY day HAVING max(price) > 490)")
bars("jn21_bleed_join", "round(whole, 6) AS whole, round(alone, 6) AS alone, whole IS NOT NULL AND alone IS NULL AS bleeds", first=f"{roll('avg', 5, 'close')} AS whole, {roll('avg', 5, 'close', D)} AS alone")

# --- aggregates


@query("ag1_tod_median", f"SELECT symbol, tod, median(CAST(volume AS DOUBLE)) AS vol_med, round(median(abs(ret)), 6) AS absret_med FROM (SELECT *, {RET} AS ret FROM {{bars}}) AS b GROUP BY symbol, tod")
def _(spark, d):
    b = frame(spark, d, "bars").selectExpr("symbol", "tod", "volume", f"{RET} AS ret")
    out = quantiles(b, ["symbol", "tod"], {"vol_med": (F.col("volume"), 0.5), "absret_med": (F.abs("ret"), 0.5)})
    return out.withColumn("absret_med", F.round("absret_med", 6))


@query("ag4_ohlcv", " UNION ALL ".join(f"SELECT '{r}' AS rule, symbol, time_bucket(INTERVAL '{r}', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(size) AS BIGINT) AS volume FROM {{ticks}} GROUP BY 2, 3" for r in RULES))
def _(spark, d):
    out = None
    for rule in RULES:
        one = resample(ticks(spark, d), rule).select(F.lit(rule).alias("rule"), "symbol", "ts", "open", "high", "low", "close", "volume")
        out = one if out is None else out.unionByName(one)
    return out


sql("ag5_signed_bars", "SELECT symbol, tod, day, CAST(sum(sign(close - open) * volume) AS DOUBLE) AS signed, CAST(sum(volume) AS BIGINT) AS volume FROM {bars} GROUP BY symbol, tod, day")
sql("ag6_quote_imbalance", "SELECT symbol, day, round(avg((bid_size - ask_size) / CAST(nullif(bid_size + ask_size, 0) AS DOUBLE)), 6) AS imbalance FROM {quotes} GROUP BY symbol, day")
sql("ag7_block_delta", "SELECT symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT) AS block, CAST(sum(volume) AS BIGINT) AS volume, max_by(close, ts) AS last FROM {bars} GROUP BY symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT)")
sql("ag8_amihud", "SELECT symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT) AS block, round(abs(ln(max_by(close, ts) / min_by(open, ts))) / nullif(sum(volume) * max_by(close, ts), 0) * 1e9, 4) AS illiquidity FROM {bars} GROUP BY symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT)")
sql("ag9_regime_blocks", f"SELECT symbol, day, CAST(floor(hour(ts) / 12) AS BIGINT) AS block, CASE WHEN count(ret) > 1 THEN round(stddev_samp(ret), 6) END AS rv, round(avg(abs(ret)), 6) AS absret FROM (SELECT *, {RET} AS ret FROM {{bars}}) AS b GROUP BY symbol, day, CAST(floor(hour(ts) / 12) AS BIGINT)")
sql("ag10_volume_clock", "SELECT symbol, tod, round(avg(share), 6) AS share FROM (SELECT symbol, tod, volume / CAST(nullif(sum(volume) OVER (PARTITION BY symbol, day), 0) AS DOUBLE) AS share FROM {bars}) AS b GROUP BY symbol, tod")
sql("ag11_volume_at_price", "SELECT symbol, price, CAST(volume AS BIGINT) AS volume FROM (SELECT symbol, bround(close / 2, 0) * 2 AS price, sum(volume) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY sum(volume) DESC, bround(close / 2, 0) * 2) AS rn FROM {bars} GROUP BY symbol, bround(close / 2, 0) * 2) AS v WHERE rn <= 3")
sql("ag17_session_summary", "SELECT symbol, day, min_by(open, ts) AS open, max_by(close, ts) AS close, max(high) AS high, min(low) AS low, max_by(ts, (high, -hour(ts))) AS high_ts, CAST(sum(volume) AS BIGINT) AS volume FROM {bars} GROUP BY symbol, day", "SELECT symbol, day, arg_min(open, ts) AS open, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low, min(ts) FILTER (WHERE high = top) AS high_ts, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT *, max(high) OVER (PARTITION BY symbol, day) AS top FROM {bars}) AS b GROUP BY symbol, day")
sql("ag18_vwap_share_crosses", f"WITH v AS (SELECT *, close > {VWAP} AS above FROM {{bars}}), c AS (SELECT *, above IS DISTINCT FROM lag(above) OVER ({D}) AS crossed FROM v) SELECT symbol, day, round(avg(CAST(above AS INT)), 6) AS share_above, CAST(sum(CAST(crossed AS INT)) AS BIGINT) AS crosses FROM c GROUP BY symbol, day")
sql("ag19_event_flow", f"WITH f AS (SELECT *, {SIGNED} AS sv, {CLV} AS clv FROM {{bars}}), e AS (SELECT n.news_id, sum(f.sv) / greatest(sum(f.volume), 1) AS imb, avg(f.clv) AS clv FROM {{news}} AS n JOIN f ON f.day = n.day AND f.ts BETWEEN n.ts - INTERVAL '65' MINUTE AND n.ts + INTERVAL '65' MINUTE GROUP BY n.news_id) SELECT news_id, round(imb, 6) AS imbalance, round(clv, 6) AS mean_clv, CASE WHEN imb >= 0.35 THEN 'aggressive buying' WHEN imb <= -0.35 THEN 'aggressive selling' ELSE 'two-sided' END AS flow FROM e")
sql("ag21_phase_stats", f"WITH f AS (SELECT *, CASE WHEN tod < '08:00' THEN 'early' WHEN tod < '16:00' THEN 'middle' ELSE 'late' END AS phase, {SIGNED} AS sv, {VWAP} AS vwap FROM {{bars}}) SELECT symbol, day, phase, round(ln(max_by(close, ts) / min_by(open, ts)), 6) AS ret, CAST(sum(volume) AS BIGINT) AS volume, round(sum(sv) / greatest(sum(volume), 1), 6) AS imbalance, round(avg(CAST(close > vwap AS INT)), 6) AS above, max(high) AS hi, min(low) AS lo FROM f GROUP BY symbol, day, phase")
sql("ag22_kyles_lambda", f"WITH r AS (SELECT symbol, {RET_S} AS ret, {SIGNED} AS sv FROM {{bars}}), s AS (SELECT symbol, ret * 1e4 AS y, sv / 1e3 AS x FROM r WHERE ret IS NOT NULL), g AS (SELECT symbol, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM s GROUP BY symbol) SELECT symbol, n, round(sxy / greatest(sxx, 1e-12), 4) AS lambda, round(sxy / greatest(sxx, 1e-12) / sqrt((syy - sxy * sxy / sxx) / greatest(n - 2, 1) / sxx), 4) AS t FROM g WHERE n >= 15")
sql("ag26_robust_volume_z", "WITH m AS (SELECT symbol, median(volume) AS med FROM {daily} GROUP BY symbol), d AS (SELECT a.symbol, m.med, median(abs(a.volume - m.med)) AS mad FROM {daily} AS a JOIN m ON a.symbol = m.symbol GROUP BY a.symbol, m.med) SELECT a.symbol, a.day, round((a.volume - d.med) / greatest(1.4826 * d.mad, 1), 6) AS z FROM {daily} AS a JOIN d ON a.symbol = d.symbol")
sql("ag27_close_share", "SELECT symbol, day, round(sum(CASE WHEN tod >= '15:00' AND tod < '16:00' THEN volume ELSE 0 END) / CAST(nullif(sum(volume), 0) AS DOUBLE), 6) AS share FROM {bars} GROUP BY symbol, day")
sql("ag28_filing_sweep", "SELECT o_custkey, count(CASE WHEN o_orderdate BETWEEN lo AND hi THEN 1 END) AS in_window, count(CASE WHEN o_orderdate > hi THEN 1 END) AS filed_after, max(o_orderdate) AS last FROM {orders} CROSS JOIN (SELECT min(o_orderdate) + INTERVAL '300' DAY AS lo, min(o_orderdate) + INTERVAL '900' DAY AS hi FROM {orders}) AS w GROUP BY o_custkey")
sql("ag29_percentile_of_score", "SELECT symbol, round(avg(CAST(close <= 250 AS INT)), 6) AS pct FROM {bars} GROUP BY symbol")
sql("ag30_quantile", "SELECT symbol, round(percentile(close, 0.9), 6) AS p90, round(percentile(close, 0.95), 6) AS p95 FROM {bars} GROUP BY symbol")


@query("ag31_time_weighted", "WITH q AS (SELECT symbol, (bid_size - ask_size) / CAST(nullif(bid_size + ask_size, 0) AS DOUBLE) AS imb, least(5.0, greatest(0.0, (epoch_us(nx) - epoch_us(ts)) / 1e6)) AS dt FROM (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM {quotes}) AS x WHERE nx IS NOT NULL) SELECT symbol, round(sum(imb * dt) / nullif(sum(dt), 0), 6) AS imbalance, round(sum(CASE WHEN imb < 0 THEN dt ELSE 0 END) / nullif(sum(dt), 0), 6) AS ask_heavy FROM q GROUP BY symbol")
def _(spark, d):
    q = with_edges(frame(spark, d, "quotes"), ["symbol"], "ts", ["ts"], back=False)
    nx = F.lead("ts").over(in_slice(["symbol"], "ts", back=False))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    imb = (F.col("bid_size") - F.col("ask_size")) / F.nullif((F.col("bid_size") + F.col("ask_size")).cast("double"), F.lit(0.0))
    q = q.withColumn("nx", nx).where("NOT _edge AND nx IS NOT NULL").select("symbol", imb.alias("imb"), F.least(F.lit(5.0), F.greatest(F.lit(0.0), (us("nx") - us("ts")) / 1e6)).alias("dt"))
    share = lambda x: F.round(F.sum(x) / F.nullif(F.sum("dt"), F.lit(0.0)), 6)
    return q.groupBy("symbol").agg(share(F.col("imb") * F.col("dt")).alias("imbalance"), share(F.when(F.col("imb") < 0, F.col("dt")).otherwise(0.0)).alias("ask_heavy"))


sql("ag32_depth_imbalance", "SELECT vec_id, round((b - a) / nullif(b + a, 0), 4) AS imbalance FROM (SELECT vec_id, aggregate(slice(embedding, 1, 10), CAST(0 AS DOUBLE), (s, x) -> s + abs(CAST(x AS DOUBLE))) AS b, aggregate(slice(embedding, 11, 10), CAST(0 AS DOUBLE), (s, x) -> s + abs(CAST(x AS DOUBLE))) AS a FROM {embeddings}) AS e", "SELECT vec_id, round((b - a) / nullif(b + a, 0), 4) AS imbalance FROM (SELECT vec_id, list_sum(list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE)))) AS b, list_sum(list_transform(embedding[11:20], lambda x: abs(CAST(x AS DOUBLE)))) AS a FROM {embeddings}) AS e")
sql("ag33_pearson", "SELECT symbol, CASE WHEN stddev_samp(volume) > 0 AND stddev_samp(high - low) > 0 THEN round(corr(volume, high - low), 6) END AS r FROM {bars} GROUP BY symbol")


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rho): the correlation of ranks, ties shared; no task ranks a whole group."""
    both = staged(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b), "ranked")  # read several times
    both = ranked(ranked(both, a, by, name="_ra"), b, by, name="_rb")
    return both.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"))


@query("ag34_spearman", "WITH k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY high - low) + (count(*) OVER (PARTITION BY symbol, high - low) - 1) / 2.0 AS b FROM {bars}) SELECT symbol, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS rho FROM k GROUP BY symbol")
def _(spark, d):
    rows = frame(spark, d, "bars").select("symbol", F.col("volume").cast("double").alias("volume"), (F.col("high") - F.col("low")).alias("range"))
    return spearman(rows, ["symbol"], "volume", "range").select("symbol", F.round("rho", 6).alias("rho"))


sql("ag35_sign_agreement", f"SELECT symbol, round(avg(CAST(sign(ret) = sign(close - open) AS INT)), 6) AS agreement FROM (SELECT *, {RET} AS ret FROM {{bars}}) AS b WHERE ret IS NOT NULL GROUP BY symbol")
sql("ag36_t_statistic", f"SELECT symbol, count(ret) AS n, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 6) AS t FROM (SELECT *, {RET} AS ret FROM {{bars}}) AS b GROUP BY symbol")
sql("ag37_win_summary", f"SELECT symbol, tod, count(fwd) AS n, round(avg(CAST(fwd > 0 AS INT)), 6) AS win, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS med FROM (SELECT *, lead(close) OVER ({D}) / close - 1 AS fwd FROM {{bars}}) AS b WHERE fwd IS NOT NULL GROUP BY symbol, tod")
sql("ag38_distinct_days", "SELECT symbol, count(DISTINCT day) AS days, count(*) AS n FROM {ticks} GROUP BY symbol")
sql("ag39_value_counts", "SELECT source_type, year(ts) AS y, count(*) AS n FROM {news} GROUP BY source_type, year(ts)", "SELECT source_type, CAST(year(ts) AS INT) AS y, count(*) AS n FROM {news} GROUP BY source_type, year(ts)")
sql("ag40_rate_per_day", "SELECT symbol, round(count(*) / CAST(count(DISTINCT day) AS DOUBLE), 6) AS rate FROM {ticks} GROUP BY symbol")
sql("ag41_concentration", f"WITH f AS (SELECT symbol, ts, abs(lead(close) OVER ({D}) - close) AS pnl FROM {{bars}}), k AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC NULLS LAST, ts) AS rn FROM f) SELECT symbol, round(sum(CASE WHEN rn <= 2 THEN pnl END) / nullif(sum(pnl), 0), 6) AS top2 FROM k GROUP BY symbol")
sql("ag42_prev_session", "WITH d AS (SELECT symbol, day, max_by(close, ts) AS last FROM {bars} GROUP BY symbol, day) SELECT symbol, day, lag(last) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM d")
sql("ag44_scale_factor", f"SELECT symbol, CASE WHEN count(*) >= 10 THEN round(regr_slope(ret, x), 6) END AS scale FROM (SELECT symbol, {RET_S} AS ret, (close - open) / open AS x FROM {{bars}}) AS b WHERE ret IS NOT NULL GROUP BY symbol")
sql("ag45_overnight_split", "SELECT symbol, day, round(ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY day)), 6) AS overnight, round(ln(close / open), 6) AS intraday FROM {daily}")
sql("ag46_reconciliation", "WITH a AS (SELECT symbol, day, max_by(close, ts) / min_by(open, ts) - 1 AS r FROM {bars} GROUP BY symbol, day), b AS (SELECT symbol, day, max_by(price, ts) / min_by(price, ts) - 1 AS r FROM {ticks} GROUP BY symbol, day) SELECT a.symbol, a.day, round((a.r - b.r) * 100, 6) AS diff_pp, abs(a.r - b.r) * 100 > 0.6 AS flagged FROM a JOIN b ON a.symbol = b.symbol AND a.day = b.day")
sql("ag47_first_hours_share", f"SELECT symbol, day, round(sum(CASE WHEN tod < '06:00' THEN sv ELSE 0 END) / nullif(sum(sv), 0), 6) AS share, round(sum(sv) / nullif(sum(volume), 0), 6) AS net FROM (SELECT *, {SIGNED} AS sv FROM {{bars}}) AS b GROUP BY symbol, day")

# --- windows
bars("wn1_log_return", f"round({RET}, 6) AS ret, round({RET_S}, 6) AS ret_continuous")
bars("wn2_pct_change", f"round(close / lag(close) OVER ({S}) - 1, 6) AS r1, round(close / lag(close, 5) OVER ({S}) - 1, 6) AS r5")
bars("wn3_anchored_vwap", f"round({VWAP}, 6) AS vwap")
bars("wn4_flow_imbalance", f"round({roll('sum', 30, 'sv')} / nullif({roll('sum', 30, 'volume')}, 0), 6) AS imb30", first=f"{SIGNED} AS sv")
bars("wn5_relative_volume", f"round({roll('avg', 10, 'volume')} / nullif({roll('avg', 50, 'volume')}, 0), 6) AS relvol")
bars("wn6_volume_ratio", f"round(volume / nullif({roll('avg', 50, 'volume')}, 0), 6) AS ratio")
bars("wn7_smoothed_clv", f"round({roll('avg', 10, 'clv')}, 6) AS clv10", first=f"{CLV} AS clv")
bars("wn8_rolling_std", f"round({roll('stddev_samp', 20, 'ret')}, 6) AS rv20", first=f"{RET} AS ret")
bars("wn9_volume_z", f"round((volume - {roll('avg', 30, 'volume')}) / nullif({roll('stddev_samp', 30, 'volume')}, 0), 6) AS z")
bars("wn10_absorption", f"round({roll('avg', 5, 'z')} / ({roll('avg', 5, 'ar')} * 100 + 0.02), 6) AS absorption", first=f"volume / 50.0 AS z, abs({RET}) AS ar")
bars("wn11_rolling_slope", f"round({roll('covar_samp', 30, 'ret', second='sv')} / nullif({roll('var_samp', 30, 'sv')}, 0) * {roll('avg', 30, 'av')}, 6) AS kyle", first=f"{RET_S} AS ret, CASE WHEN lag(close) OVER ({S}) IS NOT NULL THEN {SIGNED} END AS sv, CASE WHEN lag(close) OVER ({S}) IS NOT NULL THEN abs({SIGNED}) END AS av")
sql("wn12_delta_slope", f"WITH c AS (SELECT *, {SIGNED} AS sv FROM {{bars}}), d AS (SELECT *, sum(sv) OVER ({S} ROWS UNBOUNDED PRECEDING) AS cum, CAST(row_number() OVER ({S}) AS DOUBLE) AS k FROM c) SELECT symbol, ts, CASE WHEN count(cum) OVER ({S} ROWS 14 PRECEDING) >= 3 THEN round(covar_samp(cum, k) OVER ({S} ROWS 14 PRECEDING) / var_samp(k) OVER ({S} ROWS 14 PRECEDING) / nullif(avg(volume) OVER ({S} ROWS 14 PRECEDING), 0), 6) END AS slope FROM d")
bars("wn13_cum_delta", f"CAST(sum(sv) OVER ({D} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum, max(cum0) OVER ({D} ROWS UNBOUNDED PRECEDING) AS cum_max", first=f"{SIGNED} AS sv, CAST(volume AS DOUBLE) AS cum0")
bars("wn14_day_imbalance", f"round(sum(sv) OVER ({D} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({D} ROWS UNBOUNDED PRECEDING), 0), 6) AS day_imb", first=f"{SIGNED} AS sv")
bars("wn15_running_high", f"max(high) OVER ({D} ROWS UNBOUNDED PRECEDING) AS day_high")
sql("wn16_high_touch", f"WITH h AS (SELECT *, max(high) OVER ({D} ROWS UNBOUNDED PRECEDING) AS top, hour(ts) * 60 AS m FROM {{bars}}) SELECT symbol, ts, CAST(max(CASE WHEN high >= top THEN m END) OVER ({D} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS touched FROM h")
sql("wn17_streak", f"WITH v AS (SELECT *, close < {VWAP} AS below FROM {{bars}}), g AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER ({D} ROWS UNBOUNDED PRECEDING) AS island FROM v) SELECT symbol, ts, CAST(sum(CASE WHEN below THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day, island ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g")
bars("wn18_failed_reclaim", f"CASE WHEN row_number() OVER ({S}) < 10 THEN true ELSE max(CAST(high > vwap AND close < vwap AS INT)) OVER ({S} ROWS 9 PRECEDING) = 1 END AS failed", first=f"{VWAP} AS vwap")
bars("wn19_recent_rejection", f"max(CAST(high - greatest(open, close) >= 0.4 * (high - low) AND high > low AS INT)) OVER ({D} ROWS 9 PRECEDING) = 1 AS rejected")
sql("wn20_prior_session", f"WITH v AS (SELECT *, {VWAP} AS vwap FROM {{bars}}), d AS (SELECT symbol, day, max_by(close, ts) AS c, max_by(vwap, ts) AS v FROM v GROUP BY symbol, day), p AS (SELECT symbol, day, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS pc, lag(v) OVER (PARTITION BY symbol ORDER BY day) AS pv FROM d) SELECT b.symbol, b.ts, p.pc AS prior_close, round(p.pv, 6) AS prior_vwap FROM {{bars}} AS b JOIN p ON b.symbol = p.symbol AND b.day = p.day")
sql("wn21_gap_up", "WITH d AS (SELECT symbol, day, min_by(open, ts) AS o, max_by(close, ts) AS c FROM {bars} GROUP BY symbol, day) SELECT symbol, day, coalesce(o >= lag(c) OVER (PARTITION BY symbol ORDER BY day), false) AS gap_up FROM d")
sql("wn22_run_up", "SELECT symbol, day, round(lag(close, 1) OVER (PARTITION BY symbol ORDER BY day) / lag(close, 4) OVER (PARTITION BY symbol ORDER BY day) - 1, 6) AS runup FROM {daily}")
bars("wn25_expanding_std", f"CASE WHEN count(ret) OVER ({D} ROWS UNBOUNDED PRECEDING) >= 5 THEN round(stddev_samp(ret) OVER ({D} ROWS UNBOUNDED PRECEDING), 6) END AS std", first=f"{RET} AS ret")
bars("wn26_atr", f"round({roll('avg', 14, 'high - low')}, 6) AS atr, round((high - low) / nullif({roll('avg', 14, 'high - low')}, 0), 6) AS expansion")
bars("wn27_sma_distance", f"round(close / {roll('avg', 50, 'close')} - 1, 6) AS d50, round(close / {roll('avg', 200, 'close')} - 1, 6) AS d200", frame="daily", keys="symbol, day")
bars("wn29_time_rolling", "round(avg(imb) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 6) AS mean_1h", frame="quotes", first="micros(ts) AS us, CAST(bid_size - ask_size AS DOUBLE) AS imb")
bars("wn31_lead_diff", "round((micros(nx) - micros(ts)) / 1e6, 6) AS seconds", frame="quotes", first="lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx")
bars("wn32_edge", f"high_vol AND NOT coalesce(lag(high_vol) OVER ({S}), false) AS edge", first="volume > 150 AS high_vol")
bars("wn33_time_decay", "round(CAST(0.5 AS DOUBLE) + CAST(k - 1 AS DOUBLE) / (2 * nullif(n - 1, 0)), 6) AS weight", frame="trades", keys="event_id", first="row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY symbol) AS n")
bars("wn34_bar_ordinal", f"CAST(row_number() OVER ({D}) - 1 AS BIGINT) AS bar")
bars("wn35_gap_returns", "round(ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY day)), 6) AS gap, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)), 6) AS cc", frame="daily", keys="symbol, day")
bars("wn36_cumulative_path", f"round(sum(ret) OVER ({D} ROWS UNBOUNDED PRECEDING), 6) AS path", first=f"coalesce({RET}, 0) AS ret")
bars("wn39_smoothed_change", f"round({roll('avg', 15, 'sv')}, 6) AS smooth", first=f"{SIGNED} AS sv")

# --- top-k and sets
sql("tk1_top5_candidates", "SELECT day, news_id, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY relevance DESC, news_id) AS rn FROM {news}) AS n WHERE rn <= 5")
sql("tk2_union_of_tops", f"WITH r AS (SELECT symbol, ts, day, volume, abs({RET}) AS ar FROM {{bars}}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ar DESC NULLS LAST, ts) AS a, row_number() OVER (PARTITION BY symbol, day ORDER BY volume DESC, ts) AS b FROM r) SELECT symbol, ts FROM k WHERE a <= 5 UNION SELECT symbol, ts FROM k WHERE b <= 3")
sql("tk3_best_trial", "SELECT symbol, tod, total FROM (SELECT symbol, tod, CAST(sum(volume) AS BIGINT) AS total FROM {bars} GROUP BY symbol, tod) AS t ORDER BY total DESC, tod = '10:00' DESC, symbol, tod LIMIT 1")
sql("tk4_best_of_first3", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol, year(day), quarter(day) ORDER BY day) AS rn FROM {daily}), t AS (SELECT symbol, day, volume, row_number() OVER (PARTITION BY symbol, year(day), quarter(day) ORDER BY volume DESC, day) AS best FROM k WHERE rn <= 3) SELECT symbol, day, volume FROM t WHERE best = 1")
sql("tk5_first_k", f"SELECT symbol, ts, open FROM (SELECT *, row_number() OVER ({D}) AS rn FROM {{bars}}) AS b WHERE rn <= 5")
sql("tk6_sorted", "SELECT news_id, ts FROM {news} ORDER BY ts")
sql("tk7_heaviest_blocks", "WITH b AS (SELECT symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT) AS block, sum(sign(close - open) * volume) AS delta FROM {bars} GROUP BY symbol, day, CAST(floor(hour(ts) / 4) AS BIGINT)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY delta DESC, block) AS hi, row_number() OVER (PARTITION BY symbol, day ORDER BY delta, block) AS lo FROM b) SELECT symbol, day, max(CASE WHEN hi = 1 THEN block END) AS buy_block, max(CASE WHEN lo = 1 THEN block END) AS sell_block FROM k GROUP BY symbol, day")
sql("tk8_press_first", "SELECT day, news_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY source_type <> 'press_release', ts NULLS LAST) AS rn FROM {news}) AS n WHERE rn = 1")
sql("tk9_first_k_headlines", "SELECT news_id, ts FROM {news} ORDER BY ts LIMIT 8")
sql("tk10_sorted_desc", "SELECT source_type, round(avg(relevance), 6) AS importance FROM {news} GROUP BY source_type ORDER BY importance DESC")
sql("tk11_tail", "SELECT symbol, ts, close FROM {bars} ORDER BY ts DESC, symbol LIMIT 20")
sql("tk12_first_wins", "SELECT source_type, quarter, news_id FROM (SELECT *, quarter(ts) AS quarter, row_number() OVER (PARTITION BY source_type, quarter(ts) ORDER BY ts) AS rn FROM {news}) AS n WHERE rn = 1", "SELECT source_type, CAST(quarter AS INT) AS quarter, news_id FROM (SELECT *, quarter(ts) AS quarter, row_number() OVER (PARTITION BY source_type, quarter(ts) ORDER BY ts) AS rn FROM {news}) AS n WHERE rn = 1")
sql("so1_union_dedup", "SELECT symbol, ts, min(close) AS close FROM (SELECT symbol, ts, close FROM {bars} WHERE tod <= '12:00' UNION ALL SELECT symbol, ts, close FROM {bars} WHERE tod >= '10:00') AS u GROUP BY symbol, ts")
sql("so2_union_sources", "SELECT news_id AS id, ts, source_type FROM {news} UNION ALL SELECT event_id, ts, 'trade' FROM {trades}")
sql("so3_union_triggers", "SELECT symbol, ts, 'BUY' AS signal FROM {bars} WHERE close > open AND volume > 150 UNION ALL SELECT symbol, ts, 'SELL' AS signal FROM {bars} WHERE close < open AND volume > 150")
sql("so5_distinct_union", "SELECT day FROM {news} UNION SELECT day FROM {trades}")
sql("so7_difference", "SELECT day, symbol FROM {trades} EXCEPT SELECT day, symbol FROM {quotes} WHERE ask > 250")

# --- scalar functions
bars("ma1_math", "round(ln(close), 6) AS l, round(exp(close / 1000), 6) AS e, round(sqrt(close), 6) AS s, abs(close - open) AS a, CAST(coalesce(sign(close - open), 0) AS DOUBLE) AS g")
bars("ma3_clv", f"round({CLV}, 6) AS clv")
bars("ma4_wicks", "high - greatest(open, close) AS upper, least(open, close) - low AS lower, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS share")
bars("ma7_decay", "round(exp(-(relevance * 60) / greatest(45 / 3, 15)), 6) AS decay", frame="news", keys="news_id")
bars("ma8_half_even", "bround(close, 0) AS even, round(close, 0) AS up")
bars("ma9_bin_edges", "CAST(least(999, greatest(0, floor(close / 0.5))) AS BIGINT) AS bin")
sql("ma10_linear_fit", "SELECT symbol, round(regr_slope(close, volume), 6) AS slope, round(regr_intercept(close, volume), 6) AS intercept FROM {bars} GROUP BY symbol")
bars("ma12_confidence", "round(0.45 * least(relevance, 1) + 0.20 * 0.5 + 0.20 * (1 - relevance) + 0.15 * relevance, 3) AS confidence", frame="news", keys="news_id")
bars("dt3_session_open", "CAST(day AS TIMESTAMP_NTZ) + INTERVAL '570' MINUTE AS session_open", frame="news", keys="news_id")
from .registry import ORACLE_SQL, with_frames  # noqa: E402

ORACLE_SQL["dt3_session_open"] = with_frames("SELECT news_id, CAST(day AS TIMESTAMP) + INTERVAL '570' MINUTE AS session_open FROM {news}")
sql("dt4_formats", "SELECT news_id, date_format(ts, 'HH:mm') AS tod, concat('E', date_format(ts, 'MMdd-HHmm')) AS event_id FROM {news}", "SELECT news_id, strftime(ts, '%H:%M') AS tod, 'E' || strftime(ts, '%m%d-%H%M') AS event_id FROM {news}")
bars("dt5_effective_lead", "round((micros(ts) - 34200000000 - micros(d0)) / 6e7, 4) AS minutes_after_open", frame="news", keys="news_id", first="CAST(day AS TIMESTAMP) AS d0")
bars("dt6_seconds_between", f"round((micros(ts) - micros(pt)) / 1e6, 6) AS seconds", frame="trades", keys="event_id", first="lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS pt")
sql("dt7_after_close", "SELECT news_id, CASE WHEN hour(ts) >= 16 THEN date_add(day, 1) ELSE day END AS effective FROM {news}")
sql("dt8_quarter", "SELECT o_orderkey, concat(CAST(year(o_orderdate) AS STRING), 'Q', CAST(quarter(o_orderdate) AS STRING)) AS quarter FROM {orders}")
sql("dt9_precise", "SELECT news_id, NOT (hour(ts) = 0 AND minute(ts) = 0) AS precise FROM {news}")
sql("dt10_baseline_start", "SELECT symbol, max(day) - INTERVAL '13' DAY AS start FROM {bars} GROUP BY symbol", "SELECT symbol, CAST(max(day) - INTERVAL '13' DAY AS DATE) AS start FROM {bars} GROUP BY symbol")
sql("st1_strings", "SELECT conv_id, turn, lower(trim(substring(text, 1, 150))) AS head, concat(role, ': ', substring(text, 1, 30)) AS line FROM {conversations}")
sql("st2_ellipsis", "SELECT conv_id, turn, CASE WHEN length(text) > 70 THEN concat(substring(text, 1, 69), '…') ELSE text END AS short FROM {conversations}")
sql("st6_pr_regex", "SELECT conv_id, turn, rlike(lower(text), '(the|and) .?.?.?.?(tion|ing)') AS hit FROM {conversations}")
sql("st9_prefix", "SELECT conv_id, turn, startswith(text, 'The') AS the FROM {conversations}")
sql("st10_sha1_prefix", "SELECT conv_id, turn, substring(sha1(concat(role, '|', text)), 1, 16) AS key FROM {conversations}")
sql("st11_bar_art", "SELECT symbol, day, repeat('#', CAST(floor(least(40, sum(volume) / 100)) AS INT)) AS art FROM {bars} GROUP BY symbol, day")
sql("ar6_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")
sql("ar7_pivot", "SELECT day, CAST(sum(CASE WHEN symbol = 'click' THEN volume END) AS BIGINT) AS click, CAST(sum(CASE WHEN symbol = 'view' THEN volume END) AS BIGINT) AS view FROM {bars} GROUP BY day")
sql("ar8_one_hot", "SELECT news_id, CASE WHEN source_type = 'analyst' THEN 1 ELSE 0 END AS is_analyst, CASE WHEN source_type = 'economic' THEN 1 ELSE 0 END AS is_economic FROM {news}")
