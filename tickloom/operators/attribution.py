"""Events and the catalysts that may have caused them: alignment and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEXICON, SOURCE_WEIGHTS, relevance, same_story, story_tokens
from .asof import interval_join

#: The shares of the parts of a confidence.
WEIGHTS = {"alignment": 0.45, "idio_consistency": 0.20, "timing_precision": 0.20, "uniqueness": 0.15}
#: Scores of a catalyst after the start, and what is left of one without a precise time.
AFTER, IMPRECISE = 0.45, 0.6
KEEP = 5


def minutes(later: Column, sooner: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(sooner.cast("timestamp"))) / 6e7


def lead(published: Column, start: Column, open_minute: int = 570) -> Column:
    """Minutes a catalyst was out before the event, counted from the session's open if published before it."""
    opened = (F.to_date(start).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(open_minute))).cast("timestamp_ntz")
    return minutes(start, F.when((published < opened) & (opened <= start), opened).otherwise(published))


def align(events: DataFrame, catalysts: DataFrame, pre: float = 45, post: float = 10, lexicon=LEXICON, weights=None, open_minute: int = 570) -> DataFrame:
    """The KEEP best catalysts of each event, numbered by `place`, with relevance, time_score, lead and score.

    events is (event, first_ts, last_ts, up, …), catalysts (news_id, ts, source_type, headline, body,
    precise). Pairs are met on time buckets: a catalyst counts from `pre` minutes before an
    event's start to `post` after its end; later than the start it scores AFTER, before it its
    score decays with the lead. Catalysts without relevance or of an unknown source drop out.
    """
    span = lambda m: F.make_dt_interval(mins=F.lit(m).cast("int"))
    wide = events.withColumns({"_from": (F.col("first_ts") - span(pre)).cast("timestamp_ntz"), "_to": (F.col("last_ts") + span(post)).cast("timestamp_ntz")})
    pairs = interval_join(wide, catalysts, "_from", "_to", "ts", 3600).drop("_from", "_to")
    ahead = lead(F.col("ts"), F.col("first_ts"), open_minute)
    score = F.when(F.col("ts") <= F.col("first_ts"), F.exp(-ahead / max(pre / 3, 15.0))).otherwise(AFTER) * F.when(F.col("precise"), 1.0).otherwise(IMPRECISE)
    weight = F.coalesce(*(F.when(F.col("source_type") == s, w) for s, w in (weights or SOURCE_WEIGHTS).items()))
    text = F.concat_ws(" ", "headline", F.substring("body", 1, 1500))
    pairs = pairs.withColumns({"relevance": relevance(text, F.when(F.col("up"), 1).otherwise(-1), lexicon), "time_score": score, "lead": ahead, "tokens": story_tokens("headline")})
    pairs = pairs.withColumn("score", weight * F.col("relevance") * F.col("time_score")).where("score > 0")
    order = Window.partitionBy("event").orderBy(F.desc(F.round("score", 9)), "news_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= KEEP)


def confidence(aligned: DataFrame, events: DataFrame) -> DataFrame:
    """events (event, idio_share, …) with confidence, 0 to 1, from their aligned catalysts.

    Rewrites of the best catalyst's story corroborate it, another story competes with it. The
    idiosyncratic share speaks for the stock's own news and against economic ones; 0.5 if unknown.
    """
    item = F.struct("place", "score", "tokens", "lead", "precise", "source_type")
    found = aligned.groupBy("event").agg(F.sort_array(F.collect_list(item)).alias("c"))  # KEEP rows at most
    rows = events.join(found, "event", "left")
    best = F.get("c", F.lit(0))
    others = F.slice("c", 2, KEEP)
    same = lambda x: same_story(best["tokens"], x["tokens"])
    rival = F.get(F.filter(others, lambda x: ~same(x)), F.lit(0))
    agree = F.size(F.filter(others, same))
    ahead, precise = best["lead"], best["precise"]
    timing = F.when(ahead.between(0, 30) & precise, 1.0).when(ahead.between(0, 120), 0.7).when(ahead < 0, 0.4).otherwise(0.5)
    timing = F.when(precise, timing).otherwise(F.least(timing, F.lit(0.5)))
    own = F.when(F.col("idio_share").isNull(), 0.5).when(best["source_type"] == "economic", 1 - F.col("idio_share")).otherwise(F.col("idio_share"))
    parts = {
        "alignment": F.when(best.isNull(), 0.0).otherwise(F.least(F.lit(1.0), best["score"] + 0.05 * agree)),
        "idio_consistency": own,
        "timing_precision": F.when(best.isNull(), 0.0).otherwise(timing),
        "uniqueness": F.when(best.isNull(), 0.0).when(rival.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rival["score"] / best["score"]))),
    }
    total = sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("confidence", F.round(total, 3)).drop("c")


def onset(events: DataFrame, fine: DataFrame, pad: int = 30) -> DataFrame:
    """events (event, symbol, day, first_ts, last_ts) with onset: the first of the fine triggers (symbol,
    day, ts) from pad minutes before to pad after, if it is earlier than the start."""
    near = events.join(fine.select("symbol", "day", F.col("ts").alias("at")), ["symbol", "day"])
    near = near.where((minutes(F.col("first_ts"), F.col("at")) <= pad) & (minutes(F.col("at"), F.col("last_ts")) <= pad))
    first = near.groupBy("event").agg(F.min("at").alias("at"))
    return events.join(first, "event", "left").withColumn("onset", F.least("first_ts", "at")).drop("at")
