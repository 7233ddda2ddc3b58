"""Models on labelled bars, walk-forward tests and nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models
from ..operators import signals as rules
from ..operators.asof import asof_join
from ..operators.boosting import Plan
from ..operators.ranges import in_slice, with_edges
from ..sources.market import bars, quotes, trades
from ..sources.stage import staged
from .queries_rules import LATER_SQL, P, both, feat, features_sql, signals_sql, touches, unique
from .registry import query

X = ("imb", "relvol", "clv_s", "day_imb")
KEYS = ("symbol", "ts")
COST = 0.0007
HOURS = 3600.0


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled bars: features, label (-1, 0, 1), ret, start and stop (seconds), weight; a written stage, as every pass reads them."""
    touched = touches(spark, d).select("symbol", "day", "pos", "ts", "label", "ret", "touch")
    weights = unique(spark, d).select("symbol", "ts", F.col("uniqueness").alias("weight"))
    rows = feat(spark, d).select("symbol", "ts", *X).join(touched, ["symbol", "ts"]).join(weights, ["symbol", "ts"])
    start = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    rows = rows.withColumns({"start": start, "stop": start + (F.col("touch") - F.col("pos")) * HOURS, "up": (F.col("label") == 1).cast("double"), "net": F.col("ret") - COST})
    return staged(rows.drop("pos", "touch"), "labelled")


EMBARGO = 20 * HOURS


def split(spark: SparkSession, d: str) -> tuple[DataFrame, list[models.Fold]]:
    """Labelled bars with the last three tenths of their time as the test fold."""
    rows = models.folds(labelled(spark, d), "start", 1, 0.7)
    return rows, models.walk_folds(rows, [1], "up", "start", "stop", EMBARGO)


@query("ml7_boosted_trees")
def _(spark, d):
    """Three classes at once, and the expected return; missing features have a side of their own in each split."""
    rows, some = split(spark, d)
    if not some:
        return rows.limit(0).select("symbol", "ts", "label", *(F.lit(0.0).alias(c) for c in ("p_down", "p_flat", "p_up", "expected")))
    rows = rows.withColumn("class", F.col("label") + 1)
    out = models.fitted(rows, some, X, "class", Plan(classes=3), "weight").score(rows.where(some[0].test), "p")
    out = models.fitted(rows, some, X, "ret", Plan(classes=0), "weight").score(out, "e")
    return out.select("symbol", "ts", "label", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("p_down", "p_flat", "p_up"))), F.get("e", F.lit(0)).alias("expected"))


@query("ml8_permutation_importance")
def _(spark, d):
    rows, some = split(spark, d)
    if not some:
        return spark.createDataFrame([], "feature string, importance double")
    return models.permutation_importance(models.fitted(rows, some, X, "up", Plan(), "weight"), rows.where(some[0].test), KEYS, X, "up")


def walk(rows: DataFrame, numbers: list[int], least_train: int = 40, least_test: int = 1) -> DataFrame:
    """(fold, symbol, ts, label, ret, net, p, cut, taken) of each test fold. All folds' models are fitted together."""
    some = models.walk_folds(rows, numbers, "up", "start", "stop", EMBARGO, least_train, least_test)
    keep = ["fold", "symbol", "ts", "label", "ret", "net"]
    if not some:
        return rows.limit(0).select(*keep, F.lit(0.0).alias("p"), F.lit(0.0).alias("cut"), F.lit(False).alias("taken"))
    return models.taken(rows, some, models.fitted(rows, some, X, "up", Plan(), "weight"), keep, "net").select(*keep, "p", "cut", "taken")


FOLDS = [1, 2, 3]


@query("ml9_walk_forward")
def _(spark, d):
    return walk(models.folds(labelled(spark, d), "start", len(FOLDS)), FOLDS)


def pooled(tested: DataFrame) -> DataFrame:
    """One row: what the models of all folds take, against taking all; net returns in per cent, t of their mean."""
    c, took = F.col, F.col("taken")
    mean = lambda x: F.round(F.avg(x) * 100, 4)
    won = lambda x: F.round(F.avg((x > 0).cast("int")), 3)
    net = F.when(took, c("net"))
    t = F.avg(net) / F.nullif(F.stddev_samp(net) / F.sqrt(F.count(net)), F.lit(0.0))
    return tested.agg(
        F.count("*").alias("n_tested"), mean("net").alias("take_all_net_pct"), won(c("net")).alias("take_all_precision"), F.count(net).alias("n_taken"), mean(net).alias("net_pct"),
        F.round(F.avg(F.when(took, (c("label") == 1).cast("int"))), 3).alias("precision"), F.round((F.avg(net) - F.avg("net")) * 100, 4).alias("lift_pct"), F.when(F.count(net) > 2, F.round(t, 3)).alias("t"),
    )


@query("ml20_pooled_summary")
def _(spark, d):
    return pooled(walk(models.folds(labelled(spark, d), "start", len(FOLDS)), FOLDS))


#: Periods before the first one tested, and the least rows to train and to test.
LEAST_PERIODS, LEAST_TRAIN, LEAST_TEST = 3, 200, 20


@query("ml10_walk_forward_quarters")
def _(spark, d):
    """Calendar quarters; where the bars span too few of them for a test, months, then weeks."""
    rows = labelled(spark, d)
    counts = rows.agg(*(F.count_distinct(F.date_trunc(p, "ts")) for p in PERIODS)).first()
    period = next((p for p, n in zip(PERIODS, counts, strict=True) if n > LEAST_PERIODS), PERIODS[-1])
    dated = rows.withColumn("period", F.date_trunc(period, "ts"))
    number = dated.select("period").distinct().withColumn("fold", F.row_number().over(Window.orderBy("period")) - 1)  # calendar periods
    n = counts[PERIODS.index(period)]
    return walk(dated.join(F.broadcast(number), "period").drop("period"), list(range(LEAST_PERIODS, n)), LEAST_TRAIN, LEAST_TEST)


PERIODS = ("quarter", "month", "week")
NULL_DRAWS = 200


@query("ml14_label_null")
def _(spark, d):
    """(draw, mean): the net of what the models of ml9 take when they are fitted on labels dealt anew; draw -1 is the real one."""
    rows = models.folds(labelled(spark, d), "start", len(FOLDS))
    some = models.walk_folds(rows, FOLDS, "up", "start", "stop", EMBARGO, 40)
    if not some:
        return spark.createDataFrame([], "draw int, n long, mean double")
    labels = models.dealt(rows, KEYS, "up", NULL_DRAWS)
    model = models.fitted(rows, some, X, "up", Plan(), "weight", F.concat(F.array("up"), labels))
    out = models.taken(rows, some, model, ["net"], "net").withColumn("draw", F.floor(F.col("model") / len(some)).cast("int") - 1)
    return out.groupBy("draw").agg(F.count_if("taken").alias("n"), F.avg(F.when(F.col("taken"), F.col("net"))).alias("mean"))


BLOCK_DRAWS, BLOCK = 200, 64


@query(
    "ml15_block_null",
    f"""WITH {features_sql(P)}, nv AS (SELECT symbol, ts, coalesce(imb > 0.2, false) AS taken, lead(close) OVER (PARTITION BY symbol, day ORDER BY ts) / close - 1 AS ret FROM x),
    nn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM nv WHERE ret IS NOT NULL), nb AS (SELECT symbol, n // {BLOCK} AS b, n % {BLOCK} AS i, taken, ret FROM nn),
    de AS (SELECT g.draw, d.symbol, d.b, row_number() OVER (PARTITION BY d.symbol, g.draw ORDER BY md5(g.draw || '|' || d.symbol || '|' || d.b), d.b) - 1 AS t FROM (SELECT DISTINCT symbol, b FROM nb) AS d CROSS JOIN (SELECT unnest(range({BLOCK_DRAWS})) AS draw) AS g)
    SELECT de.draw, round(avg(r.ret), 6) AS mean FROM nb AS m JOIN de ON de.symbol = m.symbol AND de.b = m.b JOIN nb AS r ON r.symbol = m.symbol AND r.b = de.t AND r.i = m.i WHERE m.taken GROUP BY de.draw""",
)
def _(spark, d):
    rows = feat(spark, d).withColumn("ret", F.lead("close").over(rules.by_day()) / F.col("close") - 1)
    values = rows.select("symbol", "ts", F.coalesce(F.col("imb") > 0.2, F.lit(False)).alias("taken"), "ret").where("ret IS NOT NULL")
    return models.block_null(values, "symbol", "ts", "taken", "ret", BLOCK_DRAWS, BLOCK).withColumn("mean", F.round("mean", 6))


DRAWS = 1000


@query(
    "ml16_random_entry_null",
    f"""WITH RECURSIVE_ {signals_sql(P)}, {LATER_SQL}, ob AS (SELECT symbol, day, close, row_number() OVER d - 1 AS k, count(*) OVER (PARTITION BY symbol, day) - 1 AS n, last_value(close) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM {{bars}} WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
    gr AS (SELECT DISTINCT s.symbol, s.day, s.signal, ob.n FROM sig AS s JOIN ob USING (symbol, day) WHERE ob.n > 0),
    pk AS (SELECT g.draw, gr.*, CAST('0x' || substr(md5(g.draw || '|' || gr.symbol || '|' || gr.day || '|' || gr.signal), 1, 8) AS BIGINT) % gr.n AS k FROM gr CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw) AS g),
    nu AS (SELECT pk.draw, avg((ob.final / ob.close - 1) * 100 * (CASE WHEN pk.signal = 'BUY' THEN 1 ELSE -1 END)) AS mean, count(*) AS n FROM pk JOIN ob ON ob.symbol = pk.symbol AND ob.day = pk.day AND ob.k = pk.k GROUP BY pk.draw)
    SELECT draw, n, round(mean, 6) AS mean, mean >= (SELECT avg(to_close) FROM outs) AS beats FROM nu""",
)
def _(spark, d):
    """Random entries on the days of the signals: a draw is a bar's place in its day, met by an equi-join, so draws cost
    days and not bars."""
    f, sig = both(spark, d)
    observed = rules.outcomes(f, sig, P.target_pct).agg(F.avg("to_close").alias("observed"))
    whole = Window.partitionBy("symbol", "day")
    b = bars(spark, d).select("symbol", "day", "close", (F.row_number().over(rules.by_day()) - 1).cast("long").alias("k"), (F.count("*").over(whole) - 1).alias("n"), F.max_by("close", "ts").over(whole).alias("final"))
    groups = sig.select("symbol", "day", "signal").distinct().join(b.where("k = 0 AND n > 0").select("symbol", "day", "n"), ["symbol", "day"])
    spread = groups.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))))
    drawn = F.conv(F.left(F.md5(F.concat_ws("|", "draw", "symbol", F.col("day").cast("string"), "signal")), F.lit(8)), 16, 10).cast("long")
    moves = spread.withColumn("k", drawn % F.col("n")).join(b.drop("n"), ["symbol", "day", "k"]).withColumn("move", (F.col("final") / F.col("close") - 1) * 100 * rules.side(F.col("signal")))
    null = moves.groupBy("draw").agg(F.count("*").alias("n"), F.avg("move").alias("mean")).crossJoin(F.broadcast(observed))  # one row
    return null.select("draw", "n", F.round("mean", 6).alias("mean"), (F.col("mean") >= F.col("observed")).alias("beats"))


@query(
    "ml19_tick_rule_check",
    """WITH t AS (SELECT t.event_id, t.symbol, t.ts, t.price, t.size, q.bid, q.ask FROM {trades} AS t ASOF LEFT JOIN {quotes} AS q ON t.symbol = q.symbol AND t.ts >= q.ts),
    s AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS hour, size * coalesce(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id)), 0) AS tick,
      size * CASE WHEN bid IS NULL THEN 0 WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 ELSE sign(price - (bid + ask) / 2) END AS lee FROM t),
    h AS (SELECT symbol, hour, CAST(sum(tick) AS DOUBLE) AS tick, CAST(sum(lee) AS DOUBLE) AS lee FROM s GROUP BY symbol, hour)
    SELECT symbol, count(*) AS n, round(corr(tick, lee), 6) AS r, round(avg(CAST(sign(tick) = sign(lee) AS INT)), 6) AS agreement FROM h GROUP BY symbol""",
)
def _(spark, d):
    t = asof_join(trades(spark, d), quotes(spark, d), "ts", ["symbol"], ["bid", "ask"])
    t = with_edges(t, ["symbol"], "ts", ["price"], ["event_id"])
    before = F.lag("price").over(in_slice(["symbol"], "ts", "event_id"))
    lee = F.when(F.col("bid").isNull(), 0).when(F.col("price") >= F.col("ask"), 1).when(F.col("price") <= F.col("bid"), -1).otherwise(F.signum(F.col("price") - (F.col("bid") + F.col("ask")) / 2))
    t = t.withColumns({"tick": F.col("size") * F.coalesce(F.signum(F.col("price") - before), F.lit(0.0)), "lee": F.col("size") * lee})
    h = t.where("NOT _edge").groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("tick").alias("tick"), F.sum("lee").alias("lee"))
    same = (F.signum("tick") == F.signum("lee")).cast("int")
    return h.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.corr("tick", "lee"), 6).alias("r"), F.round(F.avg(same), 6).alias("agreement"))
