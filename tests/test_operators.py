"""Operators on made frames: planted signals, brute force and invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.stats import norm_cdf, t_two_sided
from tickloom.operators.asof import asof_join, interval_join
from tickloom.operators.islands import cooldown, merge_islands, spaced
from tickloom.operators.recurrences import ema
from tickloom.operators.profile import value_area, volume_buckets, volume_profile
from tickloom.plans import queries_events
from tickloom.sources.market import resample

T0 = dt.datetime(2024, 1, 2, 9, 30)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(1)
    left = [(i, r.randint(0, 2), at(r.randint(0, 300))) for i in range(200)]
    right = [(r.randint(0, 2), at(r.randint(0, 300)), float(i)) for i in range(150)]
    return left, right, spark.createDataFrame(left, "id long, symbol long, ts timestamp_ntz"), spark.createDataFrame(right, "symbol long, ts timestamp_ntz, bid double")


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_equals_brute_force(sides, direction):
    left, right, l, q = sides
    got = {r["id"]: r["bid"] for r in asof_join(l, q, "ts", ["symbol"], ["bid"], direction).collect()}
    for i, s, t in left:
        rows = [(x[1], x[2]) for x in right if x[0] == s and (x[1] <= t if direction == "backward" else x[1] >= t)]
        assert got[i] == ((max(rows) if direction == "backward" else min(rows))[1] if rows else None)


def test_asof_null_time_and_empty_right(sides, spark):
    _, _, l, q = sides
    odd = l.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert asof_join(odd, q, "ts", ["symbol"], ["bid"]).collect()[0]["bid"] is None
    assert asof_join(l, q.where("bid < 0"), "ts", ["symbol"], ["bid"]).where("bid IS NULL").count() == 200


def test_interval_join_equals_brute_force(sides):
    left, right, l, q = sides
    e = l.select("id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 7 MINUTES")).alias("stop"))
    got = sorted((r["id"], r["bid"]) for r in interval_join(e, q, "start", "stop", "ts", 300).collect())
    assert got == sorted((i, b) for i, _, t in left for _, u, b in right if t <= u <= t + dt.timedelta(minutes=7))


def test_islands_and_cooldown(spark):
    r = random.Random(2)
    times = sorted(r.sample(range(400), 60))
    frame = spark.createDataFrame([("s", at(m)) for m in times], "symbol string, ts timestamp_ntz")
    expected, n = [], 0
    for i, m in enumerate(times):
        n += i == 0 or m - times[i - 1] > 15
        expected.append(n)
    assert [x["island"] for x in merge_islands(frame, ["symbol"], "ts", 900).orderBy("ts").collect()] == expected
    kept = []
    for m in times:
        if not kept or m - kept[-1] >= 30:
            kept.append(m)
    assert [x["ts"] for x in cooldown(frame, ["symbol"], "ts", 1800).orderBy("ts").collect()] == [at(m) for m in kept]


def bars_of(spark, rows):
    return spark.createDataFrame([("s", at(i), T0.date(), *map(float, x[:4]), int(x[4])) for i, x in enumerate(rows)], "symbol string, ts timestamp_ntz, day date, open double, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def tape(spark):
    r, p, rows = random.Random(3), 100.0, []
    for _ in range(300):
        q = p * math.exp(r.gauss(0, 0.002))
        rows.append((p, max(p, q) + 0.05, min(p, q) - 0.05, q, r.randint(0, 500)))
        p = q
    return rows, bars_of(spark, rows)


def test_profile_conserves_volume_and_value_area_is_greedy(tape):
    rows, b = tape
    bins = sorted((r["bin"], round(r["volume"], 6)) for r in volume_profile(b, 0.5).collect())
    assert sum(v for _, v in bins) == pytest.approx(sum(x[4] for x in rows), abs=1e-3)
    vol = [v for _, v in bins]
    lo = hi = vol.index(max(vol))
    while sum(vol[lo : hi + 1]) < 0.7 * sum(vol):
        up, down = vol[hi + 1] if hi + 1 < len(vol) else -1, vol[lo - 1] if lo else -1
        if up >= down:
            hi += 1
        else:
            lo -= 1
    got = value_area(volume_profile(b, 0.5)).collect()[0]
    assert (got["poc"], got["val"], got["vah"]) == (bins[vol.index(max(vol))][0], bins[lo][0], bins[hi][0])


def test_volume_buckets_equal_the_filling_loop(tape):
    rows, b = tape
    size, fill, imb, expected = 1000.0, 0.0, 0.0, []
    for i, x in enumerate(rows):
        share, left = (1.0 if x[3] > x[0] else 0.0), float(x[4])
        while left > 1e-9:
            take = min(left, size - fill)
            fill, imb, left = fill + take, imb + take * (2 * share - 1), left - take
            if fill >= size - 1e-9:
                expected.append((abs(imb) / size, at(i)))
                fill = imb = 0.0
    got = volume_buckets(b.withColumn("buy", (F.col("close") > F.col("open")).cast("double")), size, "buy").orderBy("bucket").collect()
    assert [(pytest.approx(r["imbalance"]), r["ts"]) for r in got] == expected


def test_distributions(spark):
    xs = np.linspace(-5, 5, 41)
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / 2**0.5))) < 2e-7 for r in got)
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-5) and t_two_sided(0.0, 5) == 1.0
    assert t_two_sided(1.959964, 1e6) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("span", [1.5, 3, 40])
def test_ema_is_the_recurrence(spark, span):
    r = random.Random(4)
    rows = [(s, i, r.uniform(1, 9)) for s, n in (("a", 1200), ("b", 1)) for i in range(n)]
    got = {(x["symbol"], x["day"]): x["ema"] for x in ema(spark.createDataFrame(rows, "symbol string, day int, close double").repartition(3), ["symbol"], "day", "close", span).collect()}
    a, last = 2 / (span + 1), {}
    for s, i, v in rows:
        last[s] = v if s not in last else last[s] * (1 - a) + v * a
        assert got[s, i] == pytest.approx(last[s], rel=1e-12)


def test_spaced_is_a_sweep(spark):
    r = random.Random(6)
    rows = sorted({(s, r.randint(0, 400)) for s in "ab" for _ in range(120)})
    kept, last = [], {}
    for s, p in rows:
        if s not in last or p - last[s] >= 5:
            last[s] = p
            kept.append((s, p))
    got = spaced(spark.createDataFrame(rows, "symbol string, pos int"), "symbol", "pos", 5).collect()
    assert sorted((x["symbol"], x["pos"]) for x in got) == kept


def test_resample(spark):
    rows = [("s", at(m), float(p), 1) for m, p in ((0, 5), (1, 9), (4, 2), (5, 7))]
    got = resample(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, size long"), "5 minutes").orderBy("ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(5, 9, 2, 2, 3), (7, 7, 7, 7, 1)]


def test_a_planted_spike_is_found_and_noise_is_quiet(spark):
    def panel(spike):
        r, rows = random.Random(5), []
        for day in range(12):
            p = 100.0
            for k in range(40):
                move, volume = r.gauss(0, 0.0012), int(1000 * math.exp(r.gauss(0, 0.2)))
                if spike and day == 11 and k == 20:
                    move, volume = -0.03, volume * 12
                q = p * math.exp(move)
                rows.append(("s", T0 + dt.timedelta(days=day, minutes=5 * k), p, max(p, q), min(p, q), q, volume))
                p = q
        frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
        frame = frame.withColumns({"day": F.to_date("ts"), "tod": F.date_format("ts", "HH:mm")})
        z = spark.sql(f"WITH {queries_events._MAD} SELECT * FROM z", bars=frame)
        return z.where("z_ret >= 6").collect()

    hits = panel(True)
    assert [h["ts"] for h in hits if h["z_vol"] > 5] == [T0 + dt.timedelta(days=11, minutes=100)]
    assert not [h for h in panel(False) if h["z_vol"] > 5]
