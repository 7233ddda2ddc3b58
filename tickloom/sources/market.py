"""Market frames over the driver's tables: ticks, bars, daily bars, quotes, trades, news.

Each builder only declares a plan: scans read the columns they need and filters reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import ranked


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a price: symbol, ts, day, price, size, tick."""
    e = read(spark, sf_dir, "events").where("value > 0")
    size = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("event_type").alias("symbol"), "ts", F.to_date("ts").alias("day"), "user_id", F.col("value").alias("price"), size.alias("size"))


def resample(trades: DataFrame, rule: str = "1 hour") -> DataFrame:
    """OHLCV bars, left-closed and left-labelled; empty bins give no bar.

    One shuffle on (symbol, bin); the aggregates combine map-side.
    """
    at = F.window("ts", rule)["start"].cast("timestamp_ntz").alias("ts")
    bars = trades.groupBy("symbol", at).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("symbol", "ts", F.to_date("ts").alias("day"), F.date_format("ts", "HH:mm").alias("tod"), "open", "high", "low", "close", "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(ticks(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the line items by return flag; opening and closing prices are means of low and high line numbers."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"))
    price = F.col("cents") / F.col("quantity") / 100

    def mean(which):
        # Sums of whole cents and whole lots are exact in any order.
        part = F.sum(F.when(which, F.col("cents"))) / F.sum(F.when(which, F.col("quantity"))) / 100
        return F.coalesce(part, F.sum("cents") / F.sum("quantity") / 100)

    out = rows.groupBy("symbol", "day").agg(mean(F.col("n") <= 2).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), mean(F.col("n") >= 4).alias("close"), F.sum("quantity").alias("volume"))
    return out.select("symbol", "day", F.col("day").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as top-of-book quotes of eight symbols."""
    e = read(spark, sf_dir, "events").where("event_type = 'click' AND value > 0")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("user_id") % 8).alias("symbol"), "ts", F.to_date("ts").alias("day"), (F.col("value") - 1).alias("bid"), (F.col("value") + 1).alias("ask"), (k + 1).alias("bid_size"), (100 - k % 100).alias("ask_size"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trades of eight symbols."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 0")
    return e.select("event_id", (F.col("user_id") % 8).alias("symbol"), "ts", F.to_date("ts").alias("day"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and signups as timed catalysts."""
    kind = F.when(F.col("event_type") == "signup", "press_release").when(F.col("event_id") % 5 == 0, "analyst").when(F.col("event_id") % 5 == 1, "stock_news").when(F.col("event_id") % 5 == 2, "economic").when(F.col("event_id") % 5 == 3, "general_news").otherwise("insider")
    e = read(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    return e.select(F.col("event_id").alias("news_id"), "ts", F.to_date("ts").alias("day"), kind.alias("source_type"), (F.col("value") / 500).alias("relevance"))


def fine_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(ticks(spark, sf_dir), "15 minutes")


def catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with a headline, taken from the items of `benchmark` in turn: all of them, by their place among the ids."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 80).alias("headline"), F.col("text").alias("body"))
    # Places by ranges of ids; the number of items comes along.
    items = ranked(items, "item_id", name="place").select((F.col("place") - 1).cast("long").alias("place"), "headline", "body")
    n = items.agg(F.count("*").alias("n"))
    turn = news(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("place", F.col("news_id") % F.col("n"))  # one row
    return turn.join(items, "place").drop("place", "n")


FRAMES = {"fine_bars": fine_bars, "catalysts": catalysts, "ticks": ticks, "bars": bars, "daily": daily, "quotes": quotes, "trades": trades, "news": news}

#: The same frames in DuckDB SQL.
FRAMES_SQL = {
    "ticks": "SELECT event_id, event_type AS symbol, ts, CAST(ts AS DATE) AS day, user_id, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events WHERE value > 0",
    "bars": """SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, CAST(time_bucket(INTERVAL '1 hour', ts) AS DATE) AS day, strftime(time_bucket(INTERVAL '1 hour', ts), '%H:%M') AS tod,
      arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks AS t GROUP BY 1, 2, 3, 4""",
    "daily": """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
      coalesce(CAST(sum(cents) FILTER (WHERE l_linenumber <= 2) AS DOUBLE) / (sum(l_quantity) FILTER (WHERE l_linenumber <= 2)) / 100, CAST(sum(cents) AS DOUBLE) / sum(l_quantity) / 100) AS open,
      max(cents / l_quantity / 100) AS high, min(cents / l_quantity / 100) AS low,
      coalesce(CAST(sum(cents) FILTER (WHERE l_linenumber >= 4) AS DOUBLE) / (sum(l_quantity) FILTER (WHERE l_linenumber >= 4)) / 100, CAST(sum(cents) AS DOUBLE) / sum(l_quantity) / 100) AS close, sum(l_quantity) AS volume
      FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) AS l GROUP BY 1, 2, 3""",
    "quotes": "SELECT user_id % 8 AS symbol, ts, CAST(ts AS DATE) AS day, value - 1 AS bid, value + 1 AS ask, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS bid_size, 100 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 100 AS ask_size FROM events WHERE event_type = 'click' AND value > 0",
    "trades": "SELECT event_id, user_id % 8 AS symbol, ts, CAST(ts AS DATE) AS day, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events WHERE event_type = 'purchase' AND value > 0",
    "news": "SELECT event_id AS news_id, ts, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'signup' THEN 'press_release' WHEN event_id % 5 = 0 THEN 'analyst' WHEN event_id % 5 = 1 THEN 'stock_news' WHEN event_id % 5 = 2 THEN 'economic' WHEN event_id % 5 = 3 THEN 'general_news' ELSE 'insider' END AS source_type, value / 500 AS relevance FROM events WHERE event_type IN ('error', 'signup')",
}
FRAMES_SQL["fine_bars"] = FRAMES_SQL["bars"].replace("1 hour", "15 minutes")
FRAMES_SQL["catalysts"] = "SELECT n.*, substring(b.text, 1, 80) AS headline, b.text AS body FROM news AS n JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark) AS b ON b.place = n.news_id % (SELECT count(*) FROM benchmark)"
NEEDS = {"bars": ["ticks"], "fine_bars": ["ticks"], "catalysts": ["news"]}
