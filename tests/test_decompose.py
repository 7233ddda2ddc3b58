"""The market model against plain least squares, shares of a move, release summaries and pooled folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.decompose import aligned, idio_shares, market_model, share_left
from tickloom.plans.queries_attribution import summary
from tickloom.plans.queries_models import pooled

T0 = dt.datetime(2024, 1, 2, 9, 30)


@pytest.mark.parametrize("names", [["m"], ["m", "n"], ["m", "n", "o"]])
def test_models_equal_least_squares(spark, names):
    r = np.random.default_rng(1)
    factors = {x: r.normal(0, 1, 300) for x in ("m", "n", "o")}
    own = {s: 0.1 * k + sum((k + 1) * 0.3 * factors[x] for x in ("m", "n")) + r.normal(0, 0.2, 300) for k, s in enumerate("ab")}
    rows = [(s, T0 + dt.timedelta(minutes=i), None if s == "a" and i % 17 == 0 or s == "n" and i % 23 == 0 else float(v)) for s, xs in {**factors, **own}.items() for i, v in enumerate(xs)]
    rows += [("few", T0, 1.0), ("few", T0 + dt.timedelta(minutes=1), 2.0)]
    both = aligned(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), names)
    got = {x["symbol"]: x for x in market_model(both, ["symbol"], len(names)).collect()}
    for s in "ab":
        keep = [i for i in range(300) if not (s == "a" and i % 17 == 0) and not ("n" in names and i % 23 == 0)]
        x, y = np.column_stack([np.ones(len(keep)), *(factors[n][keep] for n in names)]), own[s][keep]
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert got[s]["n"] == len(keep) and got[s]["alpha"] == pytest.approx(beta[0], abs=1e-9) and got[s]["betas"] == pytest.approx(beta[1:], abs=1e-9)
        assert got[s]["r2"] == pytest.approx(1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert got["few"]["betas"] is None


def test_dependent_regressors_have_a_solution(spark):
    rows = [(1, float(i % 7), [float(i), 2.0 * i]) for i in range(50)]
    x = market_model(spark.createDataFrame(rows, "g long, y double, x array<double>"), ["g"], 2).first()
    assert x["betas"][1] == pytest.approx(2 * x["betas"][0]) and 0 <= x["r2"] <= 1


def test_share_of_a_move(spark):
    cases = [(2.0, 0.5, 0.75), (2.0, -0.5, 1.0), (-2.0, -5.0, 0.0), (0.0, 1.0, None), (1.0, None, None), (1.0, 0.0, 1.0)]
    frame = spark.createDataFrame([(i, a, m) for i, (a, m, _) in enumerate(cases)], "i long, a double, m double")
    got = {x["i"]: x["s"] for x in frame.select("i", share_left(F.col("a"), F.col("m")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [pytest.approx(w) if w is not None else None for _, _, w in cases]


def test_shares_over_windows(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([("a", at(5 * i), float(i), [1.0]) for i in range(10)], "symbol string, ts timestamp_ntz, y double, x array<double>")
    model = spark.createDataFrame([("a", 0.5, [0.5])], "symbol string, alpha double, betas array<double>")
    events = spark.createDataFrame([("one", "a", at(10), at(20)), ("none", "b", at(10), at(20))], "event string, symbol string, first_ts timestamp_ntz, last_ts timestamp_ntz")
    got = {x["event"]: x for x in idio_shares(events, rows, model, 300).collect()}
    assert got["one"]["actual"] == 1 + 2 + 3 + 4 and got["one"]["market"] == 4.0 and got["one"]["idio_share"] == pytest.approx(0.6)
    assert got["none"]["idio_share"] is None


def test_release_summary(spark):
    rows = [("s", "2025-Q3", 0.08, -0.04), ("s", "2025-Q4", -0.02, 0.03), ("s", "2026-Q1", 0.01, 0.01), ("s", "2026-Q2", 0.13, -0.08), ("t", "2026-Q2", 0.01, 0.02)]
    got = {x["symbol"]: x for x in summary(spark.createDataFrame(rows, "symbol string, quarter string, ru double, cc double")).collect()}
    s, t = got["s"], got["t"]
    assert (s["n"], s["red"], s["red_after_run_up"], s["n_run_up"], s["run_up_percentile"], s["reaction_percentile"]) == (4, 0.5, 1.0, 2, 1.0, 0.25)
    assert s["spearman_r"] == -1.0 and s["pearson_r"] < -0.9
    assert t["pearson_r"] is None and t["spearman_r"] is None and t["red_after_run_up"] is None and t["run_up_percentile"] == 1.0


def test_pooled_folds(spark):
    rows = [(1, 0.02, True), (-1, -0.01, True), (1, 0.03, True), (0, -0.02, False)]
    x = pooled(spark.createDataFrame(rows, "label int, net double, taken boolean")).first()
    net = np.array([0.02, -0.01, 0.03])
    assert (x["n_tested"], x["n_taken"], x["take_all_net_pct"], x["take_all_precision"], x["precision"]) == (4, 3, 0.5, 0.5, 0.667)
    assert x["net_pct"] == round(net.mean() * 100, 4) and x["lift_pct"] == pytest.approx(net.mean() * 100 - 0.5, abs=1e-4) and x["t"] == round(net.mean() / (net.std(ddof=1) / 3**0.5), 3)
