"""Joins, ranks, quantiles and recurrences on groups that are cut into small slices, against plain versions."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quantiles as q
from tickloom.operators import ranges, recurrences
from tickloom.operators.asof import asof_join, interval_join, unmet
from tickloom.operators.changepoint import breaks, changepoints, pair_median, phases, segments
from tickloom.plans.catalog import ORACLE_SQL, QUERIES

T0 = dt.datetime(2024, 1, 2, 9, 30)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def tape(spark):
    """A burst of one symbol, other days thinly, null keys and times, ties."""
    r = random.Random(1)
    when = lambda: at(r.choice([r.randint(0, 90), r.randint(0, 400_000), 50]))
    left = [(i, r.choice([0, 0, 0, 1, None]), when()) for i in range(400)] + [(400, 0, None)]
    right = [(r.choice([0, 0, 0, 1, None]), when(), float(i)) for i in range(300)] + [(0, None, -1.0)]
    return left, right, spark.createDataFrame(left, "id long, symbol long, ts timestamp_ntz"), spark.createDataFrame(right, "symbol long, ts timestamp_ntz, bid double")


@pytest.mark.parametrize("most", [2_000_000, 20])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("by", [["symbol"], []])
def test_asof_over_range_edges(tape, by, direction, most):
    left, right, l, r = tape
    found = asof_join(l, (r if by else r.drop("symbol")).withColumn("seen", F.col("ts")), "ts", by, ["bid", "seen"], direction, most).collect()
    got = {x["id"]: (x["seen"], x["bid"]) for x in found}
    assert len(found) == len(left)
    for i, s, t in left:
        rows = [(x[1], x[2]) for x in right if t and x[1] and (not by or x[0] == s) and (x[1] <= t if direction == "backward" else x[1] >= t)]
        want = (max if direction == "backward" else min)(rows) if rows else (None, None)
        assert got[i][0] == want[0] and (got[i][1] == want[1] or (direction == "backward" and got[i][1] == max(b for a, b in rows if a == want[0])))


@pytest.mark.parametrize("most", [2_000_000, 20])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_carries_its_frames(tape, direction, most):
    # A frame that starts at the row, up to the slice's end, is gone through again for each row.
    plan = asof_join(tape[2], tape[3], "ts", ["symbol"], ["bid"], direction, most)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_slices_are_bounded(tape):
    cut = ranges.sliced(tape[2], ["symbol"], "ts", 20).where("ts IS NOT NULL")
    crowded = cut.groupBy("symbol", "_slot").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times")).where("n > 20").collect()
    assert all(x["times"] == 1 for x in crowded)


def test_previous_row_over_edges(tape):
    left, _, l, _ = tape
    rows = ranges.with_edges(l.where("ts IS NOT NULL"), ["symbol"], "ts", ["id"], ["id"], most=20)
    got = {x["id"]: x["before"] for x in rows.withColumn("before", F.lag("id").over(ranges.in_slice(["symbol"], "ts", "id"))).where("NOT _edge").collect()}
    for s in (0, 1, None):
        ordered = [i for _, i in sorted((t, i) for i, k, t in left if k == s and t)]
        assert [got[i] for i in ordered] == [None, *ordered[:-1]]


@pytest.mark.parametrize("crowd", [200_000, 5])
def test_interval_join_of_a_burst(tape, crowd):
    left, right, l, r = tape
    e = l.select("id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 7 SECONDS")).alias("stop"))
    got = sorted((x["id"], x["bid"]) for x in interval_join(e, r, "start", "stop", "ts", 3600, crowd=crowd).collect())
    assert got == sorted((i, b) for i, _, t in left for _, u, b in right if t and u and t <= u <= t + dt.timedelta(seconds=7))


def test_crowded_buckets_are_cut(spark):
    rows = spark.range(3000).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 1.0)).cast("timestamp_ntz").alias("ts"), "id")
    e = rows.select("id", F.col("ts").alias("start"), F.col("ts").alias("stop"))
    plan = interval_join(e, rows.select("ts"), "start", "stop", "ts", 86_400, crowd=100)
    assert plan.count() == 3000


@pytest.mark.parametrize("crowd, tile", [(5, None), (None, 50)])
def test_cut_buckets_do_not_overlap(spark, crowd, tile):
    r = spark.range(1200).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 1.0)).cast("timestamp_ntz").alias("ts"), "id")
    e = r.select(F.col("id").alias("event"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 400 SECONDS")).alias("stop"))
    pairs = interval_join(e, r, "start", "stop", "ts", 190, crowd=crowd, tile=tile).select("event", "id")
    assert pairs.count() == pairs.distinct().count() == sum(min(401, 1200 - i) for i in range(1200))


def test_many_pairs_take_little_room(spark, tmp_path):
    """20,000 news of an hour in no order of time, 300 trades: 5 million pairs, in two bytes or more where each names them all."""
    ts = (F.lit(T0) + F.make_dt_interval(secs=F.pmod(F.col("id") * 7919, F.lit(3600)) * 1.0)).cast("timestamp_ntz")
    e = spark.range(20_300).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit(1).alias("user_id"), F.when(F.col("id") < 300, "purchase").otherwise("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["jn10_interval_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert pairs == con.execute(f"SELECT count(*) FROM ({ORACLE_SQL['jn10_interval_join']})").fetchall()[0][0] > 3_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < pairs / 2


def test_many_pairs_are_dealt_to_many_tasks(tape):
    left, right, l, r = tape
    e = l.select("id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("stop"))
    found = interval_join(e, r, "start", "stop", "ts", 60, tile=50, share=500)
    assert found.rdd.getNumPartitions() > 4
    assert sorted((x["id"], x["bid"]) for x in found.collect()) == sorted((i, b) for i, _, t in left for _, u, b in right if t and u and t <= u <= t + dt.timedelta(seconds=90))


@pytest.mark.parametrize("by", [[], ["symbol"]])
@pytest.mark.parametrize("span", [1, 7, 3600])
def test_unmet_equals_brute_force(tape, span, by):
    left, right, l, r = tape
    e = l.withColumn("stop", F.col("ts") + F.expr(f"INTERVAL {span} SECONDS"))
    found = unmet(e, r.select("symbol", F.col("ts").alias("at")), "ts", "stop", "at", span, by)
    span = dt.timedelta(seconds=span)
    meets = lambda s, t: any(u and t <= u <= t + span and (not by or s is not None and s == k) for k, u, _ in right)
    assert sorted(x["id"] for x in found.collect()) == [i for i, s, t in left if t is None or not meets(s, t)]


def test_not_covered_on_odd_rows(spark, tmp_path):
    """News 10 minutes from a trade or a microsecond more, across midnight, without a time, twice under one id."""
    midnight, us = dt.datetime(2024, 1, 3), dt.timedelta(microseconds=1)
    trade = [midnight, midnight + dt.timedelta(hours=1), midnight + dt.timedelta(hours=24, minutes=-5), midnight + dt.timedelta(hours=2, minutes=20)]
    off = [dt.timedelta(minutes=m) + k * us for m in (-20, -10, -3, 0, 3, 10, 20) for k in (-1, 0, 1)]
    seen = [t + o for t in trade for o in off] + [None]
    rows = [(i % 60, t, 1, "error", 1.0, None) for i, t in enumerate(seen)] + [(1000 + i, t, 1, "purchase", 1.0, None) for i, t in enumerate([*trade, None])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["jn13_not_covered"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(x["news_id"] for x in found.collect()) == sorted(x for x, in con.execute(ORACLE_SQL["jn13_not_covered"]).fetchall())
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") < 3  # one, named twice where it is adapted


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_share_ties(spark, by):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 20)), r.random() * 1e6])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, x double")
    found = ranges.ranked(frame, "x", by, parts=7)
    got = {x["id"]: x["rank"] for x in found.collect()}
    for k in ("a", "b", None) if by else ("all",):
        part = pd.Series({i: x for i, g, x in rows if not by or g == k}, dtype=float)
        for i, want in part.rank().items():
            assert got[i] == want if want == want else got[i] is None
    if not by:
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [100_000, 10, 60])
def test_quantiles_are_exact(spark, most):
    r = random.Random(4)
    draw = {"a": lambda: r.gauss(0, 1), "b": lambda: float(r.randint(0, 3)), "c": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300), "d": lambda: None, None: lambda: 5.0}
    rows = [(g, f()) for g, f in draw.items() for _ in range(r.choice([1, 37, 200]) if g != "a" else 400)]
    frame = spark.createDataFrame(rows, "g string, x double")
    for by in (["g"], []):
        found = q.quantiles(frame, by, {"lo": (F.col("x"), 0.02), "mid": (F.col("x"), 0.5), "hi": (F.abs("x"), 0.98)}, most).collect()
        assert len(found) == (len(draw) if by else 1)
        for x in found:
            v = np.array([y for g, y in rows if y is not None and (not by or g == x["g"])])
            for name, share, w in (("lo", 0.02, v), ("mid", 0.5, v), ("hi", 0.98, abs(v))):
                assert (x[name] is None) if not len(v) else x[name] == pytest.approx(np.quantile(w, share), rel=1e-12)


@pytest.mark.parametrize("block", [None, 7])
def test_weighted_spread_equals_pandas(spark, block):
    r = random.Random(5)
    rows = [(s, at(60 * i * (1 + 300 * (i > 200))), None if r.random() < (0.1 if s else 0.97) else r.gauss(0.5, 1)) for s in (0, 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "s long, ts timestamp_ntz, x double")
    for backfill in (False, True):
        got = recurrences.ewm_spread(frame, ["s"], "ts", "x", 20, 5, backfill=backfill, block=block, most=50).toPandas()
        for s in (0, 1):
            want = pd.Series([x for k, _, x in rows if k == s], dtype=float).ewm(span=20, min_periods=5).std()
            want = want.bfill() if backfill else want
            mine = got[got["s"] == s].sort_values("ts")["sigma"].to_numpy(float)
            np.testing.assert_allclose(mine, want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("window", [1, 2, 60, 500])
def test_rolling_median_equals_pandas(spark, window):
    r = random.Random(6)
    rows = [(s, at(60 * i), r.choice([None, float(r.randint(0, 9)), r.random()])) for s in (0, 1) for i in range(900)]
    got = recurrences.rolling_median(spark.createDataFrame(rows, "s long, ts timestamp_ntz, x double"), ["s"], "ts", "x", window, max(1, window // 2), block=100).toPandas()
    for s in (0, 1):
        want = pd.Series([x for k, _, x in rows if k == s], dtype=float).rolling(window, min_periods=max(1, window // 2)).median()
        np.testing.assert_allclose(got[got["s"] == s].sort_values("ts")["median"].to_numpy(float), want.to_numpy())


def kernel(x):
    gap = np.square(x[:, None] - x[None, :])
    middle = np.median(gap[np.triu_indices(len(x), 1)])
    k = np.exp(-np.clip(gap / (middle or 1.0), 0.01, 100))
    np.fill_diagonal(k, 1.0)
    return k


def least_cost(x, penalty, least, jump):
    """The cheapest cut, over all allowed ends."""
    k, n = kernel(x), len(x)
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    marks = [0, *(e for e in range(jump, n, jump) if e >= least), n]
    best = {0: -penalty}
    for b in marks[1:]:
        able = [best[a] + cost(a, b) + penalty for a in marks if a in best and b - a >= least]
        if able:
            best[b] = min(able)
    return best[n]


@pytest.mark.parametrize("seed", range(6))
def test_segments_cost_least(seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(m, 1, r.integers(8, 40)) for m in r.choice([0, 2, 5], 5)])
    if seed == 5:
        x = np.round(x)
    least, jump, penalty = int(r.integers(2, 9)), int(r.choice([1, 5])), float(r.choice([1.0, 4.0]))
    k = kernel(x)
    ends = segments(x, penalty, least, jump)
    assert ends[-1] == len(x) and all(b - a >= least for a, b in zip([0, *ends], ends, strict=False))
    total = sum((b - a) - k[a:b, a:b].sum() / (b - a) for a, b in zip([0, *ends], ends, strict=False)) + penalty * (len(ends) - 1)
    assert total == pytest.approx(least_cost(x, penalty, least, jump), abs=1e-9)


@pytest.mark.parametrize("n", [2, 3, 10, 11, 200])
def test_pair_median(n):
    x = np.round(np.random.default_rng(n).normal(0, 1, n), 1 if n > 100 else 9)
    gap = np.square(x[:, None] - x[None, :])[np.triu_indices(n, 1)]
    assert pair_median(x) == pytest.approx(np.median(gap), abs=1e-12)


def test_planted_breaks(spark):
    r = np.random.default_rng(7)
    level = np.concatenate([r.normal(0, 0.2, 40), r.normal(3, 0.2, 30), r.normal(0, 0.2, 30)])
    wide = np.concatenate([r.normal(0, 0.05, 50), r.normal(0, 2, 50)])
    assert breaks(level, 6) == [40, 70] and breaks(level[:17], 6) == []
    rows = [("a", at(300 * i), float(v)) for i, v in enumerate(level)] + [("b", at(300 * i), float(v)) for i, v in enumerate(wide)] + [("c", at(300 * i), float(i)) for i in range(10)]
    found = changepoints(spark.createDataFrame(rows, "s string, ts timestamp_ntz, x double"), ["s"], "ts", "x").collect()
    assert {(x["s"], x["ts"]) for x in found if x["series"] == "level" and x["s"] == "a"} == {("a", at(300 * 39)), ("a", at(300 * 69))}
    assert any(x["s"] == "b" and x["series"] == "spread" and abs((x["ts"] - at(300 * 50)).total_seconds()) <= 1800 for x in found)
    assert not any(x["s"] == "c" for x in found)


def test_phases(spark):
    r = np.random.default_rng(8)
    price = 100 * np.exp(np.concatenate([r.normal(0, 0.001, 60), r.normal(0.05, 0.001, 60), r.normal(-0.05, 0.001, 60)]))
    rows = [("a", at(60 * i), float(p)) for i, p in enumerate(price)] + [("flat", at(60 * i), 5.0) for i in range(50)] + [("short", at(0), 1.0)]
    found = phases(spark.createDataFrame(rows, "s string, ts timestamp_ntz, p double"), ["s"], "ts", "p", 20).orderBy("s", "phase").collect()
    mine = [(x["first_ts"], x["last_ts"]) for x in found if x["s"] == "a"]
    assert mine == [(at(0), at(60 * 59)), (at(60 * 59), at(60 * 119)), (at(60 * 119), at(60 * 179))]
    assert [x["s"] for x in found if x["s"] != "a"] == ["flat", "short"]
