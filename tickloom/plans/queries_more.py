"""Landed sources, sinks, model layer, nulls and the bar-stream study operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models
from ..operators.intervals import running
from ..operators.islands import spaced
from ..operators.ranges import sliced
from ..sources.landed import cache_key, capabilities, first_pages
from ..sources.market import bars, daily, news, read, trades
from .queries_core import CLV, RET, S, SIGNED, VWAP, D, roll
from .queries_events import _EDGE
from .registry import query, sql, undated


@query("sc1_cache_key", "SELECT c_custkey, 'seg-' || replace(lower(c_mktsegment), ' ', '-') || '__' || substring(sha1('{\"endpoint\":\"seg/' || lower(c_mktsegment) || '\",\"params\":\"' || c_custkey || '\"}'), 1, 16) || '.json' AS file FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("seg/"), F.lower("c_mktsegment")).alias("e"), F.col("c_custkey").cast("string").alias("p"))
    return c.select("c_custkey", cache_key(F.col("e"), F.col("p")).alias("file"))


@query("sc2_capabilities", "SELECT o_orderpriority AS endpoint, NOT bool_or(o_custkey % 500 IN (402, 403)) AS available FROM orders GROUP BY 1")
def _(spark, d):
    return capabilities(read(spark, d, "orders").select(F.col("o_orderpriority").alias("endpoint"), (F.col("o_custkey") % 500).alias("status")))


@query("sc3_throttled_schedule", "SELECT event_id, symbol, round((row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) * CAST(0.3 AS DOUBLE), 1) AS earliest_s FROM {trades}")
def _(spark, d):
    t = sliced(trades(spark, d).select("event_id", "symbol", "ts"), ["symbol"], "ts").withColumn("n", F.lit(1).cast("long"))
    n = running(t, ["symbol"], F.col("_slot"), ["ts", "event_id"], ["n"])
    return n.select("event_id", "symbol", F.round((F.col("n") - 1) * 0.3, 1).alias("earliest_s"))


@query("sc8_paged_scan", "WITH p AS (SELECT conv_id, turn, turn AS page FROM conversations), c AS (SELECT page, count(*) AS n FROM p GROUP BY page) SELECT conv_id, turn FROM p WHERE page <= coalesce((SELECT min(page) FROM c WHERE n < 400), 1000000)")
def _(spark, d):
    return first_pages(read(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("page")), "page", 400).drop("page")


sql("sc9_single_shot", "SELECT s_suppkey AS id, s_name AS name, 'insider' AS source_type FROM {supplier}")
sql("sc10_backfill_days", "SELECT symbol, CAST(day AS STRING) AS part, count(*) AS n_rows FROM {ticks} GROUP BY symbol, CAST(day AS STRING)")
sql("sc13_fetch_if_absent", "SELECT DISTINCT t.day FROM {ticks} AS t LEFT ANTI JOIN (SELECT DISTINCT day FROM {quotes} WHERE ask > 500) AS q ON t.day = q.day", "SELECT DISTINCT CAST(t.day AS VARCHAR) AS day FROM {ticks} AS t ANTI JOIN (SELECT DISTINCT day FROM {quotes} WHERE ask > 500) AS q ON t.day = q.day")
from .registry import ORACLE_SQL, with_frames  # noqa: E402

ORACLE_SQL["sc13_fetch_if_absent"] = with_frames("SELECT DISTINCT CAST(t.day AS VARCHAR) AS day FROM {ticks} AS t ANTI JOIN (SELECT DISTINCT day FROM {quotes} WHERE ask > 500) AS q ON t.day = q.day")
sql("sc14_extended_hours", "SELECT symbol, ts, close FROM {bars} WHERE tod < '09:30' OR tod > '15:59'")


sql("sk5_chart_series", f"SELECT symbol, ts, close, round({VWAP}, 6) AS vwap FROM {{bars}}")
sql("sk6_dashboard_series", f"SELECT symbol, ts, open, high, low, close, volume, round({VWAP}, 6) AS vwap FROM {{bars}}")

sql("dt1_parse", "SELECT conv_id, turn, try_to_timestamp(substring(text, 1, 10)) IS NULL AS unparsed FROM {conversations}", "SELECT conv_id, turn, TRY_CAST(substring(text, 1, 10) AS TIMESTAMP) IS NULL AS unparsed FROM {conversations}")
sql("dt2_time_zone", "SELECT event_id, convert_timezone('UTC', 'America/New_York', ts) AS local FROM {trades}", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM {trades}")
sql("dt11_business_days", "SELECT symbol, count(*) AS n FROM (SELECT symbol, explode(sequence(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT symbol, min(day) AS lo, max(day) AS hi FROM {daily} GROUP BY symbol) AS r) AS x WHERE weekday(d) < 5 GROUP BY symbol", "SELECT symbol, count(*) AS n FROM (SELECT symbol, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM (SELECT symbol, min(day) AS lo, max(day) AS hi FROM {daily} GROUP BY symbol) AS r) AS x WHERE isodow(d) < 6 GROUP BY symbol")


def _grouped(spark, d):
    return news(spark, d).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("ts", "news_id", "relevance"))).alias("rows"))


def _lists(expression: str) -> str:
    return with_frames("SELECT CAST(day AS VARCHAR) AS day, " + expression + " FROM (SELECT day, list(struct_pack(ts := ts, news_id := news_id, relevance := relevance) ORDER BY ts, news_id) AS rows FROM {news} GROUP BY day) AS n")


query("ar1_nested_access")(lambda spark, d: undated(_grouped(spark, d).select("day", F.col("rows")[0]["news_id"].alias("first_id"))))
ORACLE_SQL["ar1_nested_access"] = _lists("rows[1].news_id AS first_id")
query("ar2_append_note")(lambda spark, d: undated(_grouped(spark, d).select("day", F.size(F.array_append(F.transform("rows", lambda x: x["news_id"]), F.lit(-1).cast("long"))).cast("long").alias("n"))))
ORACLE_SQL["ar2_append_note"] = _lists("CAST(len(rows) + 1 AS BIGINT) AS n")
query("ar3_slice")(lambda spark, d: undated(_grouped(spark, d).select("day", F.concat_ws(",", F.transform(F.slice("rows", 1, 5), lambda x: x["news_id"].cast("string"))).alias("ids"))))
ORACLE_SQL["ar3_slice"] = _lists("array_to_string(list_transform(rows[1:5], lambda x: x.news_id), ',') AS ids")
query("ar4_filter")(lambda spark, d: undated(_grouped(spark, d).select("day", F.size(F.filter("rows", lambda x: x["relevance"] > 0.5)).cast("long").alias("n"))))
ORACLE_SQL["ar4_filter"] = _lists("CAST(len(list_filter(rows, lambda x: x.relevance > 0.5)) AS BIGINT) AS n")


@query("ar5_override", "SELECT symbol, max(hour(ts) * 60 + minute(ts)) AS cutoff, CAST(30 AS BIGINT) AS cooldown FROM {bars} GROUP BY symbol")
def _(spark, d):
    """Parameters of each symbol: defaults, and over them what its bars say (the last minute of its days)."""
    defaults = F.create_map(F.lit("cooldown"), F.lit(30).cast("long"), F.lit("cutoff"), F.lit(330).cast("long"))
    own = bars(spark, d).groupBy("symbol").agg(F.max(F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("last")).withColumn("own", F.create_map(F.lit("cutoff"), "last"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key("own", k)), "own")
    return own.withColumn("m", merged).select("symbol", F.col("m")["cutoff"].alias("cutoff"), F.col("m")["cooldown"].alias("cooldown"))


# --- models and nulls


@query("ed28_regimes")
def _(spark, d):
    blocks = bars(spark, d).selectExpr("*", f"{RET} AS ret").groupBy("symbol", "day").agg(F.stddev_samp("ret").alias("rv"), F.avg(F.abs("ret")).alias("absret"), F.avg("volume").alias("volume")).na.drop()
    return undated(models.regimes(blocks, ["rv", "absret", "volume"]))


# --- bar-stream study operators

#: The session of the study's bars, in hours.
OPEN_HOUR, CLOSE_HOUR = 9, 16


@query(
    "tsk1_recurrence",
    f"""WITH RECURSIVE_ b AS (SELECT symbol, day, ts, high, low, close, volume, hour(ts) >= {OPEN_HOUR} AND hour(ts) < {CLOSE_HOUR} AS live, hour(ts) * 60 + minute(ts) - {OPEN_HOUR * 60} AS m, row_number() OVER w AS k, lag(close) OVER w AS pc FROM {{bars}} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    n AS (SELECT *, live AND (NOT coalesce(lag(live) OVER w, false) OR day <> lag(day) OVER w) AS fresh FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    f AS (SELECT *, CAST(CASE WHEN NOT live OR fresh THEN 0 ELSE coalesce(sign(close - pc), 0) * volume END AS DOUBLE) AS sv, CAST((high + low + close) / 3 * volume AS DOUBLE) AS pv FROM n),
    u AS (SELECT symbol, ts, k, sv AS cum, sv AS cum_high, CAST(high AS DOUBLE) AS day_high, CAST(CASE WHEN live THEN m ELSE 0 END AS BIGINT) AS hod_min, pv AS spv, CAST(volume AS DOUBLE) AS sv_, CAST(CASE WHEN live AND NOT fresh AND close <= pv / volume THEN 1 ELSE 0 END AS BIGINT) AS below FROM f WHERE k = 1
      UNION ALL SELECT f.symbol, f.ts, f.k, CASE WHEN NOT live THEN u.cum WHEN fresh THEN f.sv ELSE u.cum + f.sv END, CASE WHEN NOT live THEN u.cum_high WHEN fresh THEN f.sv ELSE greatest(u.cum_high, u.cum + f.sv) END,
        CASE WHEN NOT live THEN u.day_high WHEN fresh THEN high ELSE greatest(u.day_high, high) END, CASE WHEN NOT live THEN u.hod_min WHEN fresh OR high >= u.day_high THEN m ELSE u.hod_min END,
        CASE WHEN NOT live THEN u.spv WHEN fresh THEN pv ELSE u.spv + pv END, CASE WHEN NOT live THEN u.sv_ WHEN fresh THEN volume ELSE u.sv_ + volume END,
        CASE WHEN NOT live OR fresh OR close > (u.spv + pv) / (u.sv_ + volume) THEN 0 ELSE u.below + 1 END FROM u JOIN f ON f.symbol = u.symbol AND f.k = u.k + 1)
    SELECT symbol, ts, cum, cum_high, day_high, hod_min, below FROM u""",
)
def _(spark, d):
    """Values that refer to themselves a bar ago: kept outside the session, begun anew with each, else added up, raised or
    counted. As a session has a number, each is a running aggregate within it, and what is kept is its last value."""
    through = Window.partitionBy("symbol").orderBy("ts")
    b = bars(spark, d).withColumns({"live": (F.hour("ts") >= OPEN_HOUR) & (F.hour("ts") < CLOSE_HOUR), "m": F.hour("ts") * 60 + F.minute("ts") - OPEN_HOUR * 60, "pc": F.lag("close").over(through)})
    fresh = F.col("live") & (~F.coalesce(F.lag("live").over(through), F.lit(False)) | (F.col("day") != F.lag("day").over(through)))
    b = b.withColumn("fresh", fresh).withColumn("session", F.sum(F.col("fresh").cast("int")).over(through.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    live = lambda x: F.when(F.col("live"), x)
    b = b.withColumns({"sv": F.when(F.col("live") & ~F.col("fresh"), F.coalesce(F.signum(F.col("close") - F.col("pc")), F.lit(0.0)) * F.col("volume")).otherwise(0.0), "first_high": F.first("high").over(through.rowsBetween(Window.unboundedPreceding, 0))})
    b = b.withColumns({"cum": F.sum("sv").over(run), "day_high": F.coalesce(F.max(live(F.col("high"))).over(run), "first_high"), "vwap": F.sum(live((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))).over(run) / F.nullif(F.sum(live(F.col("volume"))).over(run), F.lit(0))})
    raised = live(F.when(F.col("fresh") | (F.col("high") >= F.col("day_high")), F.col("m")))
    b = b.withColumns({"cum_high": F.max("cum").over(run), "hod_min": F.coalesce(F.last(raised, ignorenulls=True).over(run), F.lit(0)).cast("long"), "stop": (~F.col("live") | F.col("fresh") | F.coalesce(F.col("close") > F.col("vwap"), F.lit(False))).cast("int")})
    b = b.withColumn("island", F.sum("stop").over(run))
    streak = Window.partitionBy("symbol", "session", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("symbol", "ts", "cum", "cum_high", "day_high", "hod_min", F.sum(1 - F.col("stop")).over(streak).alias("below"))

sql("tsk2_lag_lead", f"SELECT symbol, ts, lag(close, 2) OVER ({S}) AS back2, lead(open) OVER ({S}) AS next_open FROM {{bars}}")
sql("tsk3_bounded", f"SELECT symbol, ts, max(high) OVER ({S} ROWS 9 PRECEDING) AS highest, min(low) OVER ({S} ROWS 9 PRECEDING) AS lowest, round({roll('avg', 10, 'close')}, 6) AS mean, CAST(sum(volume) OVER ({S} ROWS 9 PRECEDING) AS BIGINT) AS total FROM {{bars}}")


sql("tsk5_time_gates", "SELECT symbol, ts, hour(ts) * 3600 >= 34200 AND hour(ts) * 3600 < 57600 AS in_session FROM {bars}")
sql("tsk7_session_chain", "SELECT symbol, day, round(lag(close, 1) OVER (PARTITION BY symbol ORDER BY day) / lag(close, 3) OVER (PARTITION BY symbol ORDER BY day) - 1, 6) AS runup3 FROM {daily}")


#: Bars between two signals, counted through the days.
APART = 6


@query(
    "tsk8_edge_cooldown",
    f"""WITH RECURSIVE_ b AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM {{bars}}), {_EDGE},
    n AS (SELECT e.symbol, e.ts, b.pos, row_number() OVER (PARTITION BY e.symbol ORDER BY e.ts) AS k FROM e JOIN b ON b.symbol = e.symbol AND b.ts = e.ts),
    s AS (SELECT *, pos AS held, true AS fired FROM n WHERE k = 1 UNION ALL SELECT n.*, CASE WHEN n.pos - s.held >= {APART} THEN n.pos ELSE s.held END, n.pos - s.held >= {APART} FROM s JOIN n ON n.symbol = s.symbol AND n.k = s.k + 1)
    SELECT symbol, ts FROM s WHERE fired""",
)
def _(spark, d):
    order = Window.partitionBy("symbol").orderBy("ts")
    b = bars(spark, d).withColumn("pos", F.row_number().over(order))
    edges = spark.sql(f"WITH {_EDGE.replace('{bars}', '{b}')} SELECT e.symbol, e.ts, b.pos FROM e JOIN {{b}} AS b ON b.symbol = e.symbol AND b.ts = e.ts", b=b)
    return spaced(edges, "symbol", "pos", APART).select("symbol", "ts")


sql("tsk11_delta_divergence", f"WITH c AS (SELECT *, sum({CLV} * volume) OVER ({D} ROWS UNBOUNDED PRECEDING) AS cvd FROM {{bars}}) SELECT symbol, ts, round(cvd, 4) AS cvd, low < min(low) OVER ({D} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND cvd > min(cvd) OVER ({D} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bull FROM c".replace(" AS bull", " IS TRUE AS bull"))
sql("tsk12_footprint_score", f"SELECT symbol, ts, round({roll('sum', 10, 'demand')} - {roll('sum', 10, 'supply')}, 4) AS score FROM (SELECT *, CASE WHEN close > open THEN volume * CAST(1 AS DOUBLE) ELSE 0 END AS demand, CASE WHEN close < open THEN volume * CAST(1 AS DOUBLE) ELSE 0 END AS supply FROM {{bars}}) AS b")
sql("tsk13_absorption_bars", f"SELECT symbol, ts, coalesce(volume >= 2 * ({roll('avg', 10, 'volume')}) AND abs(close - open) <= 0.3 * (high - low), false) AS absorbed FROM {{bars}}")
sql("tsk14_daily_panel", "SELECT symbol, day, close > open AS up, round(volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING), 0), 6) AS relvol FROM {daily}")
