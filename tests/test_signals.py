"""Signal rules, labels and overlaps on planted tapes and against plain loops."""

import datetime as dt
import random

import pytest

from tickloom.operators import signals as rules
from tickloom.operators.intervals import overlaps, uniqueness
from tickloom.operators.labels import first_touch, meta_labels
from tickloom.operators.models import block_null, cuts, folds, shuffled, thresholds
from tickloom.operators.signals import Rules
from tickloom.sources.market import resample

OPEN = dt.datetime(2024, 3, 4, 9, 30)
BARS = "symbol string, day date, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def tape(day, moves, start=100.0, volume=lambda i: 1000):
    """One-minute bars of a day whose closes move by these amounts."""
    rows, price = [], start
    for i, m in enumerate(moves):
        ts = OPEN + dt.timedelta(days=day, minutes=i)
        close = price + m
        rows.append(("s", ts.date(), ts, price, max(price, close) + 0.01, min(price, close) - 0.01, close, volume(i)))
        price = close
    return rows, price


@pytest.fixture(scope="module")
def planted(spark):
    """A quiet day, then one that is bought from minute 60 on, then one that opens higher and is sold."""
    r = random.Random(3)
    quiet = [r.choice([-0.02, 0.02]) for _ in range(120)]
    one, at = tape(0, quiet)
    two, at = tape(1, quiet[:60] + [0.05] * 40 + quiet[:20], at, lambda i: 1000 if i < 60 or i > 100 else 4000)
    three, _ = tape(2, [0.02] * 5 + [-0.3] * 30 + quiet[:20], at + 1, lambda i: 1000 if i < 5 else 3000)
    return spark.createDataFrame(one + two + three, BARS).repartition(3)


def fired(bars, p):
    return sorted((r["ts"], r["signal"], r["trigger"]) for r in rules.signals(rules.features(bars, p), p).collect())


def test_planted_rules_fire_and_gates_hold(planted):
    p = Rules()
    got = fired(planted, p)
    day = lambda k: (OPEN + dt.timedelta(days=k)).date()
    assert not [g for g in got if g[0].date() == day(0)]
    buys = [g for g in got if g[1] == "BUY"]
    assert buys and all(g[0].date() == day(1) and g[0] >= OPEN + dt.timedelta(days=1, minutes=60) for g in buys)
    sells = [g for g in got if g[1] == "SELL" and g[0].date() == day(2)]
    assert {g[2] for g in sells} == {"opening-rejection", "distribution"} and sells[0][2] == "opening-rejection"
    for a, b in zip(got, got[1:], strict=False):
        assert a[1] != b[1] or (b[0] - a[0]).total_seconds() >= 30 * 60 or a[0].date() != b[0].date()
    # No buying after the cut-off, none after a run-up, and no opening sale above the last session's average.
    assert not [g for g in fired(planted, Rules(buy_cutoff_min=59)) if g[1] == "BUY"]
    assert not [g for g in fired(planted, Rules(open_high_min=0)) if g[2] == "opening-rejection"]
    assert len(fired(planted, Rules(cooldown_min=1))) >= len(got)


def test_scaled_windows():
    five = Rules().scaled(5)
    assert (five.imb_window, five.relvol_fast, five.relvol_slow, five.below_vwap_bars, five.cooldown_min) == (6, 2, 10, 3, 30)
    assert Rules().scaled(60).relvol_fast == 1


def test_signals_on_five_minute_bars(spark, planted):
    ticks = planted.selectExpr("symbol", "ts", "close AS price", "volume AS size")
    p = Rules().scaled(5)
    got = {r["signal"] for r in rules.signals(rules.features(resample(ticks, "5 minutes"), p), p).collect()}
    assert got <= {"BUY", "SELL"} and got


def test_outcomes_equal_a_loop(planted):
    p = Rules()
    feat = rules.features(planted, p).cache()
    sig = rules.signals(feat, p).cache()
    bars = sorted((r.asDict() for r in feat.collect()), key=lambda r: r["ts"])
    got = {(r["ts"], r["signal"]): r for r in rules.outcomes(feat, sig, 0.3).collect()}
    near = {(r["ts"], r["signal"]): r for r in rules.forward(feat, sig, (15,)).collect()}
    for s in sig.collect():
        sign = 1 if s["signal"] == "BUY" else -1
        path = [(b, (b["close"] / s["price"] - 1) * 100 * sign) for b in bars if b["day"] == s["day"] and b["ts"] > s["ts"]]
        exit_, managed = "close", path[-1][1]
        for b, move in path:
            if move >= 0.3:
                exit_, managed = "target", 0.3
                break
            if (b["close"] < b["vwap"]) if sign == 1 else (b["close"] > b["vwap"]):
                exit_, managed = "vwap-stop", move
                break
        r = got[s["ts"], s["signal"]]
        assert (r["exit"], r["managed"]) == (exit_, pytest.approx(managed)) and r["mfe"] == pytest.approx(max(m for _, m in path))
        soon = [m for b, m in path if b["ts"] <= s["ts"] + dt.timedelta(minutes=15)]
        assert near[s["ts"], s["signal"]]["fwd_15m"] == pytest.approx(soon[-1] if soon else 0)


def test_first_touch_equals_a_loop(spark):
    r = random.Random(8)
    rows = []
    for day in range(4):
        price = 100.0
        for i in range(40):
            new = price * (1 + r.gauss(0, 0.004))
            rows.append(("s", (OPEN + dt.timedelta(days=day)).date(), OPEN + dt.timedelta(days=day, minutes=i), len(rows) + 1, max(price, new) * 1.001, min(price, new) * 0.999, new, r.choice([0.004, 0.0001, None])))
            price = new
    frame = spark.createDataFrame(rows, "symbol string, day date, ts timestamp_ntz, pos int, high double, low double, close double, sigma double").repartition(3)
    got = {x["pos"]: (x["label"], x["touch"], x["ret"]) for x in first_touch(frame, 2.0, 10, 6.0).collect()}
    import math

    for _, day, _, pos, _, _, close, sigma in rows:
        if sigma is None or 2 * sigma * 1e4 < 6:
            assert pos not in got
            continue
        label = end = None
        for x in rows[pos : pos + 10]:
            if x[1] != day:
                break
            end = x
            if x[4] >= close * math.exp(2 * sigma):
                label = 1
            elif x[5] <= close * math.exp(-2 * sigma):
                label = -1
            if label:
                break
        end = end or rows[pos - 1]
        ret = math.log(end[6] / close)
        if label is None:
            label = 0 if abs(ret) < sigma / 2 else (1 if ret > 0 else -1)
        assert got[pos] == (label, end[3], pytest.approx(ret))


def test_meta_labels(spark):
    bar = lambda *x: tuple(map(float, x))
    rows = [
        ("stop wins a tie", "BUY", 0.1, [bar(100.0, 100, 100, 100), bar(100.0, 150, 50, 100)]),
        ("target", "SELL", 0.1, [bar(100.0, 100, 100, 100), bar(100.0, 101, 80, 85)]),
        ("vertical", "BUY", 0.1, [bar(100.0, 100, 100, 100), bar(100.0, 101, 99, 100.5)]),
        ("entry bar does not count", "BUY", 0.1, [bar(100.0, 150, 50, 100), bar(100.0, 101, 99, 99.0)]),
        ("too late", "BUY", 0.1, [bar(100.0, 100, 100, 100)]),
        ("no spread", "BUY", None, [bar(100.0, 100, 100, 100), bar(100.0, 101, 99, 99.0)]),
    ]
    frame = spark.createDataFrame(rows, "name string, signal string, sigma double, path array<struct<open:double,high:double,low:double,close:double>>")
    got = {r["name"]: (r["hit"], round(r["net"], 6), r["meta"]) for r in meta_labels(frame, 1.0, 60, 0.001).collect()}
    assert got == {"stop wins a tie": ("stop", -0.101, 0), "target": ("target", 0.099, 1), "vertical": ("vertical", 0.004, 1), "entry bar does not count": ("vertical", -0.011, 0)}


def test_overlaps_and_uniqueness_equal_loops(spark):
    r = random.Random(2)
    rows = []
    for i in range(150):
        a = OPEN + dt.timedelta(minutes=r.randint(0, 4000))
        rows.append((r.choice("ab"), i, a, a + dt.timedelta(minutes=r.choice([0, 5, 90, 2000]))))
    got = {x["id"]: x["n"] for x in overlaps(spark.createDataFrame(rows, "symbol string, id int, a timestamp_ntz, b timestamp_ntz").repartition(3), ["symbol"], "id", "a", "b").collect()}
    for s, i, a, b in rows:
        assert got[i] == sum(t == s and c <= b and d >= a for t, _, c, d in rows)
    day = OPEN.date()
    bars = spark.createDataFrame([("s", day, p) for p in range(1, 60)], "symbol string, day date, pos int")
    spans = [("s", day, p, min(59, p + r.randint(0, 9)), k) for k, p in enumerate(r.randint(1, 59) for _ in range(40))]
    out = {x["k"]: x["uniqueness"] for x in uniqueness(bars, spark.createDataFrame(spans, "symbol string, day date, pos int, stop int, k int")).collect()}
    open_ = [sum(p <= x <= q for _, _, p, q, _ in spans) for x in range(61)]
    for _, _, p, q, k in spans:
        assert out[k] == pytest.approx(sum(1 / open_[x] for x in range(p, q + 1)) / (q - p + 1))


def test_shuffles_and_nulls(spark):
    rows = spark.createDataFrame([(i, float(i), i % 2 == 0) for i in range(500)], "id long, x double, taken boolean").repartition(3)
    got = {r["id"]: r["x"] for r in shuffled(rows, ["id"], "x", 1).collect()}
    assert sorted(got.values()) == [float(i) for i in range(500)] and sum(got[i] == i for i in got) < 30
    again = {r["id"]: r["x"] for r in shuffled(rows.repartition(2), ["id"], "x", 1).collect()}
    assert again == got
    from pyspark.sql import functions as F

    null = block_null(rows.withColumn("s", F.lit("s")), "s", "id", "taken", "x", 20, 16).collect()
    assert len(null) == 20 and all(240 < r["mean"] < 260 for r in null)
    cut = folds(rows, "x", 4)
    n = {r["fold"]: r["count"] for r in cut.groupBy("fold").count().collect()}
    assert sorted(n) == [0, 1, 2, 3, 4] and abs(n[0] - 150) < 5 and abs(n[4] - 87) < 5
    picked = thresholds(rows.selectExpr("1 AS g", "CAST(x AS DOUBLE) AS p", "CASE WHEN x > 300 THEN 1.0 ELSE -1.0 END AS net"), ["g"], "p", "net").first()["cut"]
    assert picked >= 300 and cuts(rows, "x", [0.5])[0] == pytest.approx(249.5, abs=2)


def test_grids_are_their_own():
    """A query's grid is read when it runs, so no later one may have its name."""
    from tickloom.plans import queries_rules as q

    assert len(q.GRID) == 16 and all(len(pair) == 2 for pair in q.GRID)
    assert f"{q.GRID[0][0]} AS DOUBLE), CAST({q.GRID[0][1]} AS DOUBLE)" in q.GRID_SQL
