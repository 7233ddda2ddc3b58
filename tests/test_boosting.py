"""Boosting against a plain booster, folds and nulls on made rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.operators.boosting import Plan, fit


def plain(x, y, w, plan, edges):
    """The same trees, row by row: lists of (feature, cut, missing to the left) by node, and leaves."""
    outputs = max(1, plan.classes)
    code = [[0 if math.isnan(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r)] for r in x]
    margin = [[0.0] * outputs for _ in x]

    def probabilities(m):
        if plan.classes == 0:
            return m
        if plan.classes == 1:
            return [1 / (1 + math.exp(-m[0]))]
        e = [math.exp(v - max(m)) for v in m]
        return [v / sum(e) for v in e]

    for _ in range(plan.trees):
        p = [probabilities(m) for m in margin]
        for k in range(outputs):
            g = [w[i] * (p[i][k] - (y[i] if plan.classes < 2 else y[i] == k)) for i in range(len(x))]
            h = [w[i] * (p[i][k] * (1 - p[i][k]) if plan.classes else 1.0) for i in range(len(x))]

            def grow(rows, depth):
                G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
                best = None
                for f in range(len(x[0])):
                    for cut in range(1, plan.bins + 1):
                        for missing in (False, True):
                            left = [i for i in rows if (code[i][f] <= cut if code[i][f] else missing)]
                            n = len(left)
                            if n < plan.least or len(rows) - n < plan.least:
                                continue
                            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                            gain = gl**2 / (hl + plan.l2) + (G - gl) ** 2 / (H - hl + plan.l2) - G**2 / (H + plan.l2)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, left)
                if depth == 0 or best is None:
                    for i in rows:
                        margin[i][k] += -plan.rate * G / (H + plan.l2)
                    return
                inside = set(best[1])
                grow(best[1], depth - 1)
                grow([i for i in rows if i not in inside], depth - 1)

            grow(list(range(len(x))), plan.depth)
    return [probabilities(m) for m in margin]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(1)
    rows = []
    for i in range(160):
        a, b = r.gauss(0, 1), r.choice([0.0, 1.0, 2.0])
        seen = None if r.random() < 0.2 else a
        c = (a > 0.3) + (a > 0.3 and b > 0.5)
        rows.append((i, seen, b, float(c if r.random() < 0.9 else r.randint(0, 2)), r.uniform(0.5, 2)))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, y double, w double").repartition(3)


@pytest.mark.parametrize("classes", [0, 1, 3])
def test_trees_equal_a_plain_booster(made, classes):
    rows, frame = made
    plan = Plan(classes=classes, trees=3, depth=2, least=8, bins=6)
    y = F.when(F.col("y") > 0, 1.0).otherwise(0.0) if classes == 1 else F.col("y")
    model = fit(frame.withColumn("labels", F.array(y)), ["a", "b"], "labels", plan, "w")
    got = {x["id"]: x["p"] for x in model.score(frame, "p").collect()}
    values = [[math.nan if a is None else a, b] for _, a, b, _, _ in rows]
    target = [float(r[3] > 0) if classes == 1 else r[3] for r in rows]
    want = plain(values, target, [r[4] for r in rows], plan, model.edges)
    for (i, *_), p in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(p, abs=1e-9)


def test_three_classes_beat_pairs_out_of_sample(spark):
    r = random.Random(2)
    rows = []
    for i in range(900):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        c = 2 if a > 0.5 else 0 if b > 0 else 1
        rows.append((i, None if r.random() < 0.15 else a, b, float(c)))
    frame = spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(2)
    train, test = frame.where("id < 600"), frame.where("id >= 600")
    plan = Plan(classes=3, trees=15, least=10)
    three = fit(train.withColumn("l", F.array("y")), ["a", "b"], "l", plan).score(test, "p").collect()
    one = fit(train.withColumn("l", F.array(*((F.col("y") == k).cast("double") for k in range(3)))), ["a", "b"], "l", Plan(classes=1, trees=15, least=10)).score(test, "p").collect()
    loss = lambda found: -np.mean([math.log(max(1e-9, x["p"][int(x["y"])] / sum(x["p"]))) for x in found])
    assert loss(three) < loss(one) + 0.02 and loss(three) < 0.8
    assert np.mean([int(np.argmax(x["p"])) == x["y"] for x in three]) > 0.8


def test_models_are_fitted_apart_and_stop_by_themselves(spark):
    r = random.Random(3)
    rows = [(i, r.gauss(0, 1), i >= 150) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, a double, late boolean").withColumn("y", (F.col("a") > 0).cast("double"))
    plan = Plan(trees=8, least=10, patience=2)
    alone = fit(frame.withColumn("l", F.array("y")), ["a"], "l", plan).score(frame, "p")
    noise = (F.xxhash64("id") % 2 == 0).cast("double")
    together = fit(frame.withColumns({"l": F.array("y", noise, F.when(F.col("id") < 100, F.col("y"))), "t": F.array(F.lit(False), F.col("late"), F.lit(False))}), ["a"], "l", plan, None, "t")
    got = {x["id"]: x["p"] for x in together.score(frame, "p").collect()}
    assert all(got[x["id"]][0] == pytest.approx(x["p"][0], abs=1e-9) for x in alone.collect())
    # The second model learns nothing of use, so it stops: its later trees add nothing.
    assert not together.trees[-1][3][1].any() and together.trees[-1][3][0].any()
    assert fit(frame.limit(0).withColumn("l", F.array("y")), ["a"], "l", plan).models == 0


def test_walk_and_null(spark):
    r = random.Random(4)
    rows = [(i, float(i), float(i + 2), r.gauss(0, 1)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, start double, stop double, a double").withColumns({"up": (F.col("a") > 0).cast("double"), "net": F.when(F.col("a") > 0, 0.01).otherwise(-0.01)})
    frame = models.folds(frame, "start", 2)
    some = models.walk_folds(frame, [1, 2], "up", "start", "stop", 5.0)
    assert [f.number for f in some] == [1, 2]
    for f in some:
        lo, hi = frame.where(f.test).agg(F.min("start"), F.max("stop")).first()
        assert frame.where(f.train & ~((F.col("stop") < lo - 5) | (F.col("start") > hi + 5))).count() == 0 < frame.where(f.late).count() < frame.where(f.train).count() / 3
    plan = Plan(trees=5)
    labels = models.dealt(frame, ["id"], "up", 30)
    counts = frame.select(F.posexplode(labels).alias("draw", "y")).groupBy("draw").agg(F.sum("y").alias("n")).collect()
    assert len(counts) == 30 and all(abs(x["n"] - frame.agg(F.sum("up")).first()[0]) <= 1 for x in counts)
    model = models.fitted(frame, some, ["a"], "up", plan, None, F.concat(F.array("up"), labels))
    out = models.taken(frame, some, model, ["id"], "net").withColumn("draw", F.floor(F.col("model") / 2) - 1)
    means = {x["draw"]: x["m"] or 0.0 for x in out.groupBy("draw").agg(F.avg(F.when(F.col("taken"), F.col("net"))).alias("m")).collect()}
    assert means[-1] == pytest.approx(0.01) and sum(m < 0.005 for d, m in means.items() if d >= 0) > 20
    again = {(x["id"], x["model"]): x["p"] for x in models.taken(frame, some, models.fitted(frame, some, ["a"], "up", plan), ["id"], "net").collect()}
    both = {(x["id"], x["model"]): x["p"] for x in out.where("draw = -1").collect()}
    assert again == pytest.approx(both)


def test_threshold_is_the_best_of_those_that_take_enough(spark):
    r = random.Random(5)
    rows = [(g, r.random(), r.gauss(0, 1)) for g in ("a", "b") for _ in range(100)] + [("few", 0.5, 1.0)]
    frame = spark.createDataFrame(rows, "g string, p double, net double")
    cuts = {g: [float(np.quantile([p for k, p, _ in rows if k == g], s)) for s in models.SHARES] for g in ("a", "b", "few")}
    table = spark.createDataFrame(list(cuts.items()), "g string, cuts array<double>")
    got = {x["g"]: x["cut"] for x in models.picked(frame, ["g"], "p", "net", table).collect()}
    for g in ("a", "b"):
        mean = {c: np.mean(v) for c in cuts[g] if len(v := [n for k, p, n in rows if k == g and p >= c]) >= 15}
        assert got[g] == max(mean, key=lambda c: (mean[c], -c))
    assert got["few"] == 0.5
