"""Catalysts, their alignment with events, and release studies; the SQL twins are written from the definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attribution as at
from ..operators.asof import asof_join, interval_join, unmet
from ..operators.decompose import idio_shares
from ..operators.islands import merge_islands
from ..sources.market import bars, catalysts, daily, fine_bars, news, read, trades
from ..sources.stage import staged
from .queries_core import spearman
from .queries_events import _ISLANDS, _MAD, _TOKENS_SQL, MARKET_SQL, _zscored, fitted_market
from .registry import query, undated

#: The lexicon, with syllables of the test texts as terms of their own.
LEXICON = (*tx.LEXICON, ("tion", 0.8, 1), ("ing", 0.5, -1), ("heit", 0.6, 1), ("the", 0.25, 0), ("ment", 0.7, -1))
PRE, POST, OPEN = 180, 60, 120
MAJOR, BIG, SURE = 4.0, 0.02, 0.70


def lexicon_sql(low: str) -> tuple[str, str]:
    has = lambda t: f"CASE WHEN contains({low}, '{t}') THEN CAST(1 AS DOUBLE) ELSE 0 END"
    return " + ".join(f"{has(t)} * {w}" for t, w, _ in LEXICON), " + ".join(f"{has(t)} * {w * s}" for t, w, s in LEXICON if s)


def relevance_sql(weight: str, lean: str, sign: str) -> str:
    return f"CASE WHEN {weight} = 0 THEN 0 WHEN round(({lean}) * {sign}, 9) > 0 THEN least(1.0, least(1.0, {weight} / 4) * 1.15) WHEN round(({lean}) * {sign}, 9) < 0 THEN least(1.0, {weight} / 4) * 0.75 ELSE least(1.0, {weight} / 4) END"


_W, _L = lexicon_sql("low")
ST3_SQL = f"SELECT conv_id, turn, round({relevance_sql('w', 'l', '1')}, 6) AS score FROM (SELECT conv_id, turn, {_W} AS w, {_L} AS l FROM (SELECT conv_id, turn, lower(substring(text, 1, 1500)) AS low FROM {{conversations}}) AS c) AS r"


@query("st3_lexicon_relevance", ST3_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(tx.relevance("text", 1, LEXICON), 6).alias("score"))


@query("ag43_lexicon_score", f"WITH t(term, weight, direction) AS (VALUES {', '.join(f'({t!r}, CAST({w} AS DOUBLE), {s})' for t, w, s in LEXICON)}) SELECT b.item_id, round(sum(t.weight), 6) AS weight, round(sum(t.weight * t.direction), 6) AS lean, count(*) AS terms FROM {{benchmark}} AS b JOIN t ON contains(lower(substring(b.text, 1, 1500)), t.term) GROUP BY b.item_id")
def _(spark, d):
    terms = spark.createDataFrame(list(LEXICON), "term string, weight double, direction int")
    text = read(spark, d, "benchmark").select("item_id", F.lower(F.substring("text", 1, 1500)).alias("low"))
    hits = text.join(F.broadcast(terms), F.contains("low", "term"))  # the lexicon's rows
    return hits.groupBy("item_id").agg(F.round(F.sum("weight"), 6).alias("weight"), F.round(F.sum(F.col("weight") * F.col("direction")), 6).alias("lean"), F.count("*").alias("terms"))


#: Good and bad terms, with syllables of the test texts, and what a text must hold to count.
GOOD, BAD, GATE = (*tx.BEAT_TERMS, "tion"), (*tx.MISS_TERMS, "heit", "eau"), "en"


@query("st8_verdict", f"SELECT conv_id, CASE WHEN b > 0 AND m > 0 THEN 'mixed' WHEN b > 0 THEN 'beat' WHEN m > 0 THEN 'miss' ELSE 'unknown' END AS verdict FROM (SELECT conv_id, sum(CASE WHEN contains(low, '{GATE}') AND (" + " OR ".join(f"contains(low, '{t}')" for t in GOOD) + f") THEN 1 ELSE 0 END) AS b, sum(CASE WHEN contains(low, '{GATE}') AND (" + " OR ".join(f"contains(low, '{t}')" for t in BAD) + ") THEN 1 ELSE 0 END) AS m FROM (SELECT conv_id, lower(text) AS low FROM {conversations}) AS c GROUP BY conv_id) AS v")
def _(spark, d):
    gated = F.contains(F.lower("text"), F.lit(GATE))
    n = lambda terms: F.count_if(gated & tx.contains_any(F.col("text"), terms))
    return read(spark, d, "conversations").groupBy("conv_id").agg(tx.verdict(n(GOOD), n(BAD)).alias("verdict"))


# --- interval joins on time buckets


def _around(rows: DataFrame, before: int, after: int) -> DataFrame:
    span = lambda m: F.expr(f"INTERVAL {m} MINUTES")
    return rows.withColumns({"lo": (F.col("ts") - span(before)).cast("timestamp_ntz"), "hi": (F.col("ts") + span(after)).cast("timestamp_ntz")})


@query("jn11_window_bars", "SELECT n.news_id, count(*) AS n_bars, CAST(sum(b.volume) AS BIGINT) AS volume FROM {news} AS n JOIN {bars} AS b ON b.day = n.day AND b.ts BETWEEN n.ts - INTERVAL '65' MINUTE AND n.ts + INTERVAL '5' MINUTE GROUP BY n.news_id")
def _(spark, d):
    n = _around(news(spark, d).select("news_id", "day", "ts"), 65, 5).drop("ts")
    pairs = interval_join(n, bars(spark, d).select(F.col("ts").alias("at"), "volume", F.col("day").alias("on")), "lo", "hi", "at", 3600).where("day = on")
    return pairs.groupBy("news_id").agg(F.count("*").alias("n_bars"), F.sum("volume").alias("volume"))


@query("jn12_proximity_count", "SELECT a.news_id, count(b.news_id) AS near FROM {news} AS a LEFT JOIN {news} AS b ON a.day = b.day AND b.source_type = 'press_release' AND b.ts BETWEEN a.ts - INTERVAL '1800' SECOND AND a.ts + INTERVAL '1800' SECOND GROUP BY a.news_id")
def _(spark, d):
    n = news(spark, d).select("news_id", "day", "ts", "source_type")
    press = n.where("source_type = 'press_release'").select(F.col("ts").alias("at"), F.col("day").alias("on"))
    near = interval_join(_around(n, 30, 30), press, "lo", "hi", "at", 3600).where("day = on").groupBy("news_id").agg(F.count("*").alias("near"))
    return n.select("news_id").join(near, "news_id", "left").na.fill(0, ["near"])


@query("jn13_not_covered", "SELECT n.news_id FROM {news} AS n WHERE NOT EXISTS (SELECT 1 FROM {trades} AS t WHERE t.day = n.day AND t.ts BETWEEN n.ts - INTERVAL '10' MINUTE AND n.ts + INTERVAL '10' MINUTE)")
def _(spark, d):
    n = _around(news(spark, d).select("news_id", "day", "ts"), 10, 10)
    return unmet(n, trades(spark, d).select("day", F.col("ts").alias("at")), "lo", "hi", "at", 1200, ["day"]).select("news_id")


@query("ag20_event_sums", f"WITH {_MAD} SELECT n.news_id, round(sum(z.ret), 6) AS ret, round(max(z.z_ret), 6) AS peak_z, round(max(z.z_vol), 6) AS peak_vol_z FROM {{news}} AS n JOIN z ON z.day = n.day AND z.ts BETWEEN n.ts - INTERVAL '60' MINUTE AND n.ts GROUP BY n.news_id")
def _(spark, d):
    n = _around(news(spark, d).select("news_id", "day", "ts"), 60, 0).drop("ts")
    z = _zscored(spark, d).select(F.col("ts").alias("at"), F.col("day").alias("on"), "ret", "z_ret", "z_vol")
    r = lambda c, name: F.round(c, 6).alias(name)
    return interval_join(n, z, "lo", "hi", "at", 3600).where("day = on").groupBy("news_id").agg(r(F.sum("ret"), "ret"), r(F.max("z_ret"), "peak_z"), r(F.max("z_vol"), "peak_vol_z"))


# --- events, catalysts, confidence

#: Events in SQL: merged triggers, with their move and the market's part of it over a window that begins a bar early.
EVENTS_SQL = f"""{_MAD}{_ISLANDS},
{MARKET_SQL},
e0 AS (SELECT i.symbol || ' ' || strftime(min(i.ts), '%m%d-%H%M') AS event, i.symbol, i.day, min(i.ts) AS first_ts, max(i.ts) AS last_ts, sum(i.ret) AS move, max(i.z_ret) AS peak, sum(i.ret) >= 0 AS up FROM i GROUP BY i.symbol, i.day, i.island),
wi AS (SELECT e0.event, sum(x.y) AS actual, sum(f.alpha + f.b1 * x.x1 + f.b2 * x.x2) AS market FROM e0 JOIN rx AS x ON x.symbol = e0.symbol AND x.ts BETWEEN e0.first_ts - INTERVAL 1 HOUR AND e0.last_ts JOIN fi AS f ON f.symbol = x.symbol GROUP BY e0.event),
ev AS (SELECT e0.*, wi.actual, wi.market FROM e0 LEFT JOIN wi USING (event))"""


def _events(spark, d) -> DataFrame:
    z = _zscored(spark, d)
    hits = merge_islands(z.where("z_ret >= 2 OR (z_vol >= 2.5 AND z_ret >= 1)"), ["symbol", "day"], "ts", 7200)
    found = hits.groupBy("symbol", "day", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("ret").alias("move"), F.max("z_ret").alias("peak"))
    found = found.drop("island").withColumns({"event": F.concat_ws(" ", "symbol", F.date_format("first_ts", "MMdd-HHmm")), "up": F.coalesce(F.col("move") >= 0, F.lit(False))})
    return staged(found, "events")  # read by several joins


def _catalysts(spark, d) -> DataFrame:
    return catalysts(spark, d).withColumn("precise", (F.hour("ts") != 0) | (F.minute("ts") != 0)).drop("relevance", "day")


def _aligned(spark, d, events: DataFrame | None = None) -> DataFrame:
    events = _events(spark, d) if events is None else events
    return at.align(events.select("event", "first_ts", "last_ts", "up"), _catalysts(spark, d), PRE, POST, LEXICON, open_minute=OPEN)


_WEIGHT_SQL = "CASE source_type " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in tx.SOURCE_WEIGHTS.items()) + " END"
ALIGN_SQL = f"""{EVENTS_SQL},
ct AS (SELECT *, hour(ts) <> 0 OR minute(ts) <> 0 AS precise, {_TOKENS_SQL.replace('text', 'headline')} AS tokens, {_W} AS w, {_L} AS l FROM (SELECT *, lower(substring(headline || ' ' || substring(body, 1, 1500), 1, 1500)) AS low FROM {{catalysts}}) AS c),
pr AS (SELECT e.event, c.news_id, c.ts, c.source_type, c.precise, c.tokens, e.first_ts, {relevance_sql('w', 'l', 'CASE WHEN e.up THEN 1 ELSE -1 END')} AS rel,
    (epoch_us(e.first_ts) - epoch_us(CASE WHEN c.ts < CAST(CAST(e.first_ts AS DATE) AS TIMESTAMP) + INTERVAL {OPEN} MINUTE AND CAST(CAST(e.first_ts AS DATE) AS TIMESTAMP) + INTERVAL {OPEN} MINUTE <= e.first_ts THEN CAST(CAST(e.first_ts AS DATE) AS TIMESTAMP) + INTERVAL {OPEN} MINUTE ELSE c.ts END)) / 6e7 AS lead
    FROM ev AS e JOIN ct AS c ON c.ts BETWEEN e.first_ts - INTERVAL {PRE} MINUTE AND e.last_ts + INTERVAL {POST} MINUTE),
ps AS (SELECT *, CASE WHEN ts <= first_ts THEN exp(-lead / {max(PRE / 3, 15.0)}) ELSE {at.AFTER} END * CASE WHEN precise THEN 1 ELSE {at.IMPRECISE} END AS tscore FROM pr),
pk AS (SELECT *, {_WEIGHT_SQL} * rel * tscore AS score FROM ps),
al AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(score, 9) DESC, news_id) AS place FROM pk WHERE score > 0 QUALIFY place <= {at.KEEP})"""
_SAME_SQL = "(len(o.tokens) > 0 AND len(b.tokens) > 0 AND len(list_intersect(o.tokens, b.tokens)) >= 0.5 * least(len(o.tokens), len(b.tokens)))"
CONFIDENCE_SQL = f"""{ALIGN_SQL},
be AS (SELECT * FROM al WHERE place = 1),
ot AS (SELECT b.event, count(*) FILTER (WHERE {_SAME_SQL}) AS agree, arg_min(o.score, o.place) FILTER (WHERE NOT {_SAME_SQL}) AS rival FROM be AS b JOIN al AS o ON o.event = b.event AND o.place > 1 GROUP BY b.event),
pa AS (SELECT ev.*, CASE WHEN market IS NULL OR abs(actual) < 1e-9 THEN NULL WHEN sign(actual) <> sign(market) THEN 1 ELSE greatest(0, least(1, 1 - market / actual)) END AS idio,
    b.score, b.lead, b.precise, b.source_type, coalesce(agree, 0) AS agree, rival FROM ev LEFT JOIN be AS b USING (event) LEFT JOIN ot USING (event)),
co AS (SELECT *, round(0.45 * CASE WHEN score IS NULL THEN 0 ELSE least(1, score + 0.05 * agree) END
    + 0.20 * CASE WHEN idio IS NULL THEN 0.5 WHEN source_type = 'economic' THEN 1 - idio ELSE idio END
    + 0.20 * CASE WHEN score IS NULL THEN 0 WHEN precise THEN CASE WHEN lead BETWEEN 0 AND 30 THEN 1 WHEN lead BETWEEN 0 AND 120 THEN 0.7 WHEN lead < 0 THEN 0.4 ELSE 0.5 END ELSE CASE WHEN lead < 0 THEN 0.4 ELSE 0.5 END END
    + 0.15 * CASE WHEN score IS NULL THEN 0 WHEN rival IS NULL THEN 1 ELSE greatest(0, least(1, 1 - rival / score)) END, 3) AS confidence FROM pa)"""


@query("ed13_normalise", "SELECT news_id, source_type, ts, precise, coalesce(nullif(trim(headline), ''), nullif(left(body, 40), '')) AS headline FROM (SELECT *, hour(ts) <> 0 OR minute(ts) <> 0 AS precise FROM {catalysts} WHERE source_type <> 'economic' UNION ALL SELECT *, hour(ts) <> 0 OR minute(ts) <> 0 AS precise FROM {catalysts} WHERE source_type = 'economic' AND (coalesce(relevance >= 0.33, false) OR regexp_matches(lower(headline), 'cpi|fed|tion'))) AS c WHERE ts IS NOT NULL")
def _(spark, d):
    c = catalysts(spark, d).withColumn("precise", (F.hour("ts") != 0) | (F.minute("ts") != 0)).where("ts IS NOT NULL")
    matters = F.coalesce(F.col("relevance") >= 0.33, F.lit(False)) | F.lower("headline").rlike("cpi|fed|tion")
    first = F.coalesce(F.nullif(F.trim("headline"), F.lit("")), F.nullif(F.left("body", F.lit(40)), F.lit("")))
    return c.where((F.col("source_type") != "economic") | matters).select("news_id", "source_type", "ts", "precise", first.alias("headline"))


@query("ed14_time_score", f"WITH {ALIGN_SQL} SELECT event, news_id, round(tscore, 6) AS time_score, round(lead, 4) AS lead FROM al")
def _(spark, d):
    return _aligned(spark, d).select("event", "news_id", F.round("time_score", 6).alias("time_score"), F.round("lead", 4).alias("lead"))


@query("ed15_alignment", f"WITH {ALIGN_SQL} SELECT event, news_id, round(rel, 6) AS relevance, round(score, 6) AS score, place FROM al")
def _(spark, d):
    return _aligned(spark, d).select("event", "news_id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """The aligned catalysts, written, and the events with their confidence."""
    events = _events(spark, d)
    aligned = staged(_aligned(spark, d, events), "aligned")
    return aligned, at.confidence(aligned, idio_shares(events, *fitted_market(spark, d), 3600))


def _confident(spark, d) -> DataFrame:
    return _judged(spark, d)[1]


@query("ed16_confidence", f"WITH {CONFIDENCE_SQL} SELECT event, round(idio, 6) AS idio_share, confidence FROM co")
def _(spark, d):
    return _confident(spark, d).select("event", F.round("idio_share", 6).alias("idio_share"), "confidence")


OPEN_SQL = f"{CONFIDENCE_SQL}, un AS (SELECT * FROM co WHERE (peak >= {MAJOR} OR abs(move) >= {BIG}) AND confidence < {SURE})"


def _unresolved(spark, d) -> DataFrame:
    return _confident(spark, d).where(((F.col("peak") >= MAJOR) | (F.abs("move") >= BIG)) & (F.col("confidence") < SURE))


@query("ed12_unresolved", f"WITH {OPEN_SQL} SELECT event, first_ts, confidence FROM un")
def _(spark, d):
    return _unresolved(spark, d).select("event", "first_ts", "confidence")


_FINE = _MAD.replace("{bars}", "{fine_bars}")


@query(
    "ed11_onset",
    f"""WITH {OPEN_SQL}, fr AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)) AS ret FROM {{fine_bars}}),
    fm AS (SELECT symbol, tod, median(abs(ret)) AS m FROM fr GROUP BY symbol, tod),
    fs AS (SELECT symbol, tod, any_value(m) AS m, median(abs(abs(ret) - m)) AS mad FROM fr JOIN fm USING (symbol, tod) GROUP BY symbol, tod),
    fl AS (SELECT symbol, 0.1 * median(m) + 1e-6 AS least FROM fs GROUP BY symbol),
    ft AS (SELECT fr.symbol, fr.day, fr.ts FROM fr JOIN fs USING (symbol, tod) JOIN fl USING (symbol) WHERE (abs(fr.ret) - fs.m) / (1.4826 * greatest(fs.mad, fl.least)) >= 3)
    SELECT u.event, u.first_ts, least(u.first_ts, min(ft.ts)) AS onset FROM un AS u LEFT JOIN ft ON ft.symbol = u.symbol AND ft.day = u.day AND ft.ts BETWEEN u.first_ts - INTERVAL 30 MINUTE AND u.last_ts + INTERVAL 30 MINUTE GROUP BY u.event, u.first_ts""",
)
def _(spark, d):
    fine = spark.sql(f"WITH {_FINE} SELECT symbol, day, ts FROM z WHERE z_ret >= 3", fine_bars=fine_bars(spark, d))
    return at.onset(_unresolved(spark, d), fine).select("event", "first_ts", "onset")


# --- releases

RELEASE, FIGURE, EXACT = r"(the|and).{0,40}(tion|ing)", r"en[^0-9]{0,40}([0-9][0-9,]{4,})", r"([0-9]{4,6})"


@query(
    "ed18_release_check",
    f"""WITH t AS (SELECT doc_id, source, lang, text, substring(text, 1, 80) AS head FROM {{documents}}),
    h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id) AS rn FROM t WHERE regexp_matches(lower(head), '{RELEASE}')),
    r AS (SELECT source, list(doc_id ORDER BY doc_id)[1:8] AS ids FROM t WHERE contains(lower(head), 'tion') GROUP BY source),
    x AS (SELECT source, min(CAST(regexp_extract(text, '{EXACT}', 1) AS BIGINT)) AS exact FROM t WHERE regexp_matches(substring(text, 1, 1000), '{EXACT}') GROUP BY source)
    SELECT h.source, h.doc_id, h.head AS headline, nullif(replace(regexp_extract(substring(h.head || chr(10) || substring(h.text, 1, 3000), 1, 3081), '{FIGURE}', 1), ',', ''), '') AS figure, CAST(x.exact AS VARCHAR) AS exact, array_to_string(r.ids, ',') AS reactions FROM h LEFT JOIN r USING (source) LEFT JOIN x USING (source) WHERE rn = 1""",
)
def _(spark, d):
    t = read(spark, d, "documents").select("doc_id", "source", "lang", "text", F.substring("text", 1, 80).alias("head"))
    order = F.struct((F.col("lang") != "en").alias("o"), "doc_id", "head", F.substring("text", 1, 3000).alias("text"))
    h = t.where(F.lower("head").rlike(RELEASE)).groupBy("source").agg(F.min(order).alias("h"))
    # Eight of each source are kept by a map-side top, not by collecting all.
    rank = Window.partitionBy("source").orderBy("doc_id")
    r = t.where(F.contains(F.lower("head"), F.lit("tion"))).select("source", "doc_id").withColumn("rn", F.row_number().over(rank)).where("rn <= 8")
    r = r.groupBy("source").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string"))).alias("reactions"))
    x = t.where(F.substring("text", 1, 1000).rlike(EXACT)).groupBy("source").agg(F.min(F.regexp_extract("text", EXACT, 1).cast("long")).alias("exact"))
    figure = F.regexp_replace(F.regexp_extract(F.concat_ws("\n", F.col("h.head"), F.col("h.text")), FIGURE, 1), ",", "")
    out = h.join(r, "source", "left").join(x, "source", "left")
    return out.select("source", F.col("h.doc_id").alias("doc_id"), F.col("h.head").alias("headline"), F.when(figure != "", figure).alias("figure"), F.col("exact").cast("string").alias("exact"), "reactions")


#: Orders that stand for announcements: one in so many.
ANNOUNCED = 499
STUDY_SQL = f"""q AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN count(volume) OVER v >= 60 THEN median(volume) OVER v END AS med,
    row_number() OVER (PARTITION BY symbol, year(day), month(day) ORDER BY day) AS k, CASE month(day) WHEN 1 THEN CAST(year(day) - 1 AS VARCHAR) || '-Q4' ELSE CAST(year(day) AS VARCHAR) || '-Q' || CAST((month(day) - 1) // 3 AS VARCHAR) END AS quarter
    FROM {{daily}} WINDOW w AS (PARTITION BY symbol ORDER BY day), v AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING)),
pr AS (SELECT CASE month(o) WHEN 1 THEN CAST(year(o) - 1 AS VARCHAR) || '-Q4' ELSE CAST(year(o) AS VARCHAR) || '-Q' || CAST((month(o) - 1) // 3 AS VARCHAR) END AS quarter, min(o) AS o FROM (SELECT CAST(o_orderdate AS DATE) AS o FROM {{orders}} WHERE o_orderkey % {ANNOUNCED} = 0) AS a WHERE month(o) IN (1, 4, 7, 10) GROUP BY 1),
cand AS (SELECT symbol, quarter, arg_max(day, (volume / med, -epoch(day))) FILTER (WHERE med IS NOT NULL) AS vol_day FROM q WHERE k <= 3 AND month(day) IN (1, 4, 7, 10) GROUP BY symbol, quarter),
pick AS (SELECT c.symbol, c.quarter, CASE WHEN pr.o IS NOT NULL THEN 'pr' ELSE 'volume-inferred' END AS how, coalesce(pr.o, c.vol_day) AS wanted FROM cand AS c LEFT JOIN pr USING (quarter)),
snap AS (SELECT p.*, (SELECT min(q.day) FROM q WHERE q.symbol = p.symbol AND q.day >= p.wanted) AS rel FROM pick AS p WHERE wanted IS NOT NULL),
st AS (SELECT s.symbol, s.quarter, s.how, q.day, q.i, q.open AS o0, q.close AS c0, b.close AS c1, e.close AS c6, f.close AS n1, g.close AS n5 FROM snap AS s JOIN q ON q.symbol = s.symbol AND q.day = s.rel JOIN q AS b ON b.symbol = s.symbol AND b.i = q.i - 1 JOIN q AS e ON e.symbol = s.symbol AND e.i = q.i - 6
    LEFT JOIN q AS f ON f.symbol = s.symbol AND f.i = q.i + 1 LEFT JOIN q AS g ON g.symbol = s.symbol AND g.i = least(q.i + 5, q.n))"""


def quarter_of(day: str) -> Column:
    """The quarter that ended before a release in January, April, July or October."""
    y, m = F.year(day), F.month(day)
    return F.when(m == 1, F.concat((y - 1).cast("string"), F.lit("-Q4"))).otherwise(F.concat(y.cast("string"), F.lit("-Q"), F.floor((m - 1) / 3).cast("string")))


def study(spark: SparkSession, d: str) -> DataFrame:
    """A row a symbol and quarter: its release day (announced, else the busiest of the first three
    trading days) and the returns around it."""
    by = Window.partitionBy("symbol").orderBy("day")
    lagged = lambda c, k: F.lag(c, k).over(by)
    last60 = F.array_sort(F.collect_list("volume").over(by.rowsBetween(-59, 0)))
    q = daily(spark, d).withColumns(
        {"c1": lagged("close", 1), "c6": lagged("close", 6), "n1": F.lead("close", 1).over(by), "n5": F.last("close").over(by.rowsBetween(0, 5)), "last60": last60, "k": F.row_number().over(Window.partitionBy("symbol", F.year("day"), F.month("day")).orderBy("day"))}
    )
    med = F.when(F.size("last60") == 60, (F.element_at("last60", 30) + F.element_at("last60", 31)) / 2)
    first = q.where("k <= 3 AND month(day) IN (1, 4, 7, 10)").withColumns({"ratio": F.col("volume") / med, "quarter": quarter_of("day")})
    cand = first.groupBy("symbol", "quarter").agg(F.max_by("day", F.when(F.col("ratio").isNotNull(), F.struct("ratio", (-F.datediff("day", F.lit("1970-01-01"))).alias("d")))).alias("busy"))
    said = read(spark, d, "orders").where(F.col("o_orderkey") % ANNOUNCED == 0).select(F.to_date("o_orderdate").alias("o")).where("month(o) IN (1, 4, 7, 10)")
    said = said.groupBy(quarter_of("o").alias("quarter")).agg(F.min("o").alias("o"))
    pick = cand.join(said, "quarter", "left").withColumns({"how": F.when(F.col("o").isNotNull(), "pr").otherwise("volume-inferred"), "day": F.coalesce("o", "busy")}).where("day IS NOT NULL")
    values = q.select("symbol", "day", F.col("day").alias("rel"), "open", "close", "c1", "c6", "n1", "n5")
    return asof_join(pick.select("symbol", "quarter", "how", "day"), values, "day", ["symbol"], ["rel", "open", "close", "c1", "c6", "n1", "n5"], "forward").where("rel IS NOT NULL AND c6 IS NOT NULL")


@query("ed19_release_study", f"WITH {STUDY_SQL} SELECT symbol, quarter, how, CAST(day AS VARCHAR) AS day, round(c1 / c6 - 1, 6) AS run_up_5d, round(c0 / o0 - 1, 6) AS reaction_oc, round(c0 / c1 - 1, 6) AS reaction_cc, round(n1 / c0 - 1, 6) AS post_1d, round(CASE WHEN n1 IS NOT NULL THEN n5 / c0 - 1 END, 6) AS post_5d, c1 / c6 - 1 > 0.05 AND c0 / c1 - 1 < 0 AS fade FROM st")
def _(spark, d):
    r = lambda c, name: F.round(c, 6).alias(name)
    run, cc = F.col("c1") / F.col("c6") - 1, F.col("close") / F.col("c1") - 1
    return study(spark, d).select("symbol", "quarter", "how", F.col("rel").cast("string").alias("day"), r(run, "run_up_5d"), r(F.col("close") / F.col("open") - 1, "reaction_oc"), r(cc, "reaction_cc"), r(F.col("n1") / F.col("close") - 1, "post_1d"), r(F.when(F.col("n1").isNotNull(), F.col("n5") / F.col("close") - 1), "post_5d"), ((run > 0.05) & (cc < 0)).alias("fade"))


@query(
    "ed20_study_summary",
    f"""WITH {STUDY_SQL}, rq AS (SELECT symbol, quarter, c1 / c6 - 1 AS ru, c0 / c1 - 1 AS cc FROM st WHERE c1 / c6 IS NOT NULL AND c0 / c1 IS NOT NULL),
    rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY ru) + (count(*) OVER (PARTITION BY symbol, ru) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY cc) + (count(*) OVER (PARTITION BY symbol, cc) - 1) / 2.0 AS b, max(quarter) OVER (PARTITION BY symbol) AS focus FROM rq),
    fo AS (SELECT symbol, max(ru) AS fru, max(cc) AS fcc FROM rk WHERE quarter = focus GROUP BY symbol)
    SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN corr(ru, cc) END, 3) AS pearson_r, round(CASE WHEN count(*) >= 4 THEN corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) END, 3) AS spearman_r, round(avg(CAST(cc < 0 AS INT)), 3) AS red, round(avg(CASE WHEN ru > 0.05 THEN CAST(cc < 0 AS INT) END), 3) AS red_after_run_up,
      count(*) FILTER (WHERE ru > 0.05) AS n_run_up, round(avg(CAST(ru <= fru AS INT)), 3) AS run_up_percentile, round(avg(CAST(cc <= fcc AS INT)), 3) AS reaction_percentile FROM rk JOIN fo USING (symbol) GROUP BY symbol""",
)
def _(spark, d):
    """Of the identified releases of each symbol: base rates, correlations from four releases on, and where the last quarter's
    run-up and reaction stand among all."""
    rows = study(spark, d).select("symbol", "quarter", (F.col("c1") / F.col("c6") - 1).alias("ru"), (F.col("close") / F.col("c1") - 1).alias("cc")).where("ru IS NOT NULL AND cc IS NOT NULL")
    return summary(staged(rows, "releases"))


def summary(rows: DataFrame) -> DataFrame:
    """The summary of releases (symbol, quarter, ru, cc), one a quarter; ties share ranks."""
    focus = rows.groupBy("symbol").agg(F.max_by(F.struct("ru", "cc"), "quarter").alias("f"))
    red, big = (F.col("cc") < 0).cast("int"), F.col("ru") > 0.05
    enough = lambda x: F.round(F.when(F.count("*") >= 4, x), 3)
    share = lambda x, name: F.round(F.avg(x), 3).alias(name)
    facts = rows.join(focus, "symbol").groupBy("symbol").agg(
        F.count("*").alias("n"), enough(F.corr("ru", "cc")).alias("pearson_r"), share(red, "red"), share(F.when(big, red), "red_after_run_up"), F.count_if(big).alias("n_run_up"),
        share((F.col("ru") <= F.col("f.ru")).cast("int"), "run_up_percentile"), share((F.col("cc") <= F.col("f.cc")).cast("int"), "reaction_percentile"),
    )
    ranks = spearman(rows, ["symbol"], "ru", "cc").select("symbol", "rho")
    return facts.join(ranks, "symbol", "left").withColumn("spearman_r", F.when(F.col("n") >= 4, F.round("rho", 3))).drop("rho")


# --- documents and reports of events

#: Ties are put up in either engine by a little more than half.
FIXED = "CAST(CAST(floor(({0}) * 10000 + 0.500001) / 10000 AS DECIMAL(18, 4)) AS VARCHAR)"


def fixed(c: str | Column) -> Column:
    """A number with four digits, as text."""
    value = F.col(c) if isinstance(c, str) else c
    return (F.floor(value * 10000 + 0.500001) / 10000).cast("decimal(18,4)").cast("string")


@query("sk1_events_json", f"""WITH {CONFIDENCE_SQL}, js AS (SELECT event, string_agg(chr(123) || '"news_id":' || news_id || ',"source":"' || source_type || '","score":"' || {FIXED.format('score')} || '"' || chr(125), ',' ORDER BY place) AS items FROM al GROUP BY event)
SELECT event, chr(123) || '"event":"' || event || '","move":"' || {FIXED.format('move')} || '","peak_z":"' || {FIXED.format('peak')} || '","confidence":"' || {FIXED.format('confidence')} || '","attributions":[' || coalesce(items, '') || ']' || chr(125) AS json FROM co LEFT JOIN js USING (event)""")
def _(spark, d):
    aligned, judged = _judged(spark, d)
    item = F.struct("place", F.struct("news_id", F.col("source_type").alias("source"), fixed("score").alias("score")).alias("x"))
    items = aligned.groupBy("event").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("attributions"))
    rows = judged.join(items, "event", "left")
    found = F.coalesce("attributions", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("news_id"), F.lit("").alias("source"), F.lit("").alias("score"))), lambda _: F.lit(False)))
    return rows.select("event", F.to_json(F.struct("event", fixed("move").alias("move"), fixed("peak").alias("peak_z"), fixed("confidence").alias("confidence"), found.alias("attributions"))).alias("json"))


@query("sk3_result_document", f"""WITH {CONFIDENCE_SQL} SELECT symbol, chr(123) || '"events":' || count(*) || ',"mean_confidence":"' || {FIXED.format('avg(confidence)')} || '","unresolved":' || count(*) FILTER (WHERE (peak >= {MAJOR} OR abs(move) >= {BIG}) AND confidence < {SURE}) || chr(125) AS document FROM co GROUP BY symbol""")
def _(spark, d):
    open_ = ((F.col("peak") >= MAJOR) | (F.abs("move") >= BIG)) & (F.col("confidence") < SURE)
    rows = _confident(spark, d).groupBy("symbol").agg(F.count("*").alias("events"), fixed(F.avg("confidence")).alias("mean_confidence"), F.count_if(F.coalesce(open_, F.lit(False))).alias("unresolved"))
    return rows.select("symbol", F.to_json(F.struct("events", "mean_confidence", "unresolved")).alias("document"))


@query("sk4_report_rows", f"""WITH {CONFIDENCE_SQL} SELECT event, '| ' || event || ' | ' || CASE WHEN up THEN 'up' ELSE 'down' END || ' | ' || {FIXED.format('move * 100')} || ' | ' || coalesce(source_type, '-') || ' | ' || {FIXED.format('confidence')} || ' |' AS line FROM co""")
def _(spark, d):
    aligned, judged = _judged(spark, d)
    rows = judged.join(aligned.where("place = 1").select("event", "source_type"), "event", "left")
    cells = [F.col("event"), F.when(F.col("up"), "up").otherwise("down"), fixed(F.col("move") * 100), F.coalesce("source_type", F.lit("-")), fixed("confidence")]
    return rows.select("event", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


_SHARES = "SELECT symbol, avg(CAST(close > open AS INT)) AS up, corr(sign(close - open) * volume, ln(close / open)) AS flow, max(volume) / avg(volume) AS peak FROM {bars} WHERE volume > 0 GROUP BY symbol"


@query("sk7_verdicts", f"SELECT symbol, concat(symbol, CASE WHEN up >= 0.55 THEN ': buyers held most bars' WHEN up <= 0.45 THEN ': sellers held most bars' ELSE ': neither side held most bars' END, CASE WHEN flow >= 0.3 THEN ', price went with the flow' WHEN flow <= -0.3 THEN ', price went against the flow' ELSE ', price and flow were loosely tied' END, CASE WHEN peak >= 5 THEN ', with a burst of volume.' ELSE ', without a burst of volume.' END) AS verdict FROM ({_SHARES}) AS s")
def _(spark, d):
    b = bars(spark, d).where("volume > 0").groupBy("symbol").agg(
        F.avg((F.col("close") > F.col("open")).cast("int")).alias("up"), F.corr(F.signum(F.col("close") - F.col("open")) * F.col("volume"), F.log(F.col("close") / F.col("open"))).alias("flow"), (F.max("volume") / F.avg("volume")).alias("peak")
    )
    held = F.when(F.col("up") >= 0.55, ": buyers held most bars").when(F.col("up") <= 0.45, ": sellers held most bars").otherwise(": neither side held most bars")
    tied = F.when(F.col("flow") >= 0.3, ", price went with the flow").when(F.col("flow") <= -0.3, ", price went against the flow").otherwise(", price and flow were loosely tied")
    return b.select("symbol", F.concat("symbol", held, tied, F.when(F.col("peak") >= 5, ", with a burst of volume.").otherwise(", without a burst of volume.")).alias("verdict"))
