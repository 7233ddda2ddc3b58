"""Model layer: clusters, boosted trees, purged walk-forward folds, importance and nulls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Ensemble, Plan, fit

#: Rows that one task deals out in a shuffle of values.
BUCKET = 50_000


def regimes(blocks: DataFrame, features: Sequence[str], k: int = 4, order: str = "rv") -> DataFrame:
    """blocks with `regime` 0..k-1: K-means on standardised features, numbered by ascending mean of `order`."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), KMeans(featuresCol="_x", predictionCol="_c", k=k, seed=7)]
    out = Pipeline(stages=stages).fit(blocks).transform(blocks)
    rank = out.groupBy("_c").agg(F.avg(order).alias("m")).withColumn("regime", F.row_number().over(Window.orderBy("m")) - 1)  # k rows
    return out.join(F.broadcast(rank.select("_c", "regime")), "_c").drop("_raw", "_x", "_c")


def cuts(events: DataFrame, at: str, shares: Sequence[float]) -> list:
    """The values of `at` below which these shares of the rows lie, as a few numbers."""
    return events.agg(F.percentile_approx(at, F.array(*map(F.lit, shares)), 10_000)).first()[0] or []


def folds(events: DataFrame, at: str, n: int, initial: float = 0.3) -> DataFrame:
    """events with `fold`: 0 for the first `initial` share by `at` (a number), then n blocks of equal shares.

    Blocks end between values of `at`; no window over all rows."""
    ends = cuts(events, at, [initial + (1 - initial) * k / n for k in range(n)])
    fold = F.lit(0)
    for end in ends:
        fold = fold + (F.col(at) > end).cast("int")
    return events.withColumn("fold", fold)


def purged(events: DataFrame, fold: int, start: str, stop: str, embargo: float) -> DataFrame:
    """Earlier folds' rows whose label interval keeps `embargo` off the test fold's span."""
    span = events.where(F.col("fold") == fold).agg(F.min(start).alias("_lo"), F.max(stop).alias("_hi"))
    rows = events.where(F.col("fold") < fold).crossJoin(F.broadcast(span))  # one row
    return rows.where((F.col(stop) < F.col("_lo") - embargo) | (F.col(start) > F.col("_hi") + embargo)).drop("_lo", "_hi")


@dataclass(frozen=True)
class Fold:
    """One model of a walk-forward: which rows it is fitted on, which of them are late, which it is tested on."""

    number: int
    train: Column
    late: Column
    test: Column


def walk_folds(rows: DataFrame, numbers: Sequence[int], label: str, start: str, stop: str, embargo: float, least_train: int = 1, least_test: int = 1) -> list[Fold]:
    """The folds (of a column `fold`) that can be tested: trained on earlier folds' rows whose label interval keeps
    `embargo` off the test span, if there are enough rows and two labels. late is the last fifth of the training time.
    Two aggregates over the rows, whatever the number of folds."""
    spans = {r["fold"]: r for r in rows.groupBy("fold").agg(F.min(start).alias("lo"), F.max(stop).alias("hi"), F.count("*").alias("n")).collect()}  # a row a fold
    tried = [k for k in numbers if k in spans and spans[k]["n"] >= least_test]
    train = {k: F.coalesce((F.col("fold") < k) & ((F.col(stop) < spans[k]["lo"] - embargo) | (F.col(start) > spans[k]["hi"] + embargo)), F.lit(False)) for k in tried}
    if not tried:
        return []
    facts = [x for k in tried for x in (F.count_if(train[k]), F.percentile_approx(F.when(train[k], F.col(start)), 0.8, 10_000), F.min(F.when(train[k], F.col(label))), F.max(F.when(train[k], F.col(label))))]
    found = rows.agg(*facts).first()
    out = []
    for i, k in enumerate(tried):
        n, cut, lo, hi = found[4 * i : 4 * i + 4]
        if n >= least_train and lo != hi:
            out.append(Fold(k, train[k], train[k] & (F.col(start) > cut), F.col("fold") == k))
    return out


def fitted(rows: DataFrame, some: Sequence[Fold], features: Sequence[str], label: str, plan: Plan, weight: str | None = None, draws: Column | None = None) -> Ensemble:
    """One model a fold, all fitted together; with draws, an array of labels, one a draw and fold (draw by draw)."""
    labels = F.transform(draws if draws is not None else F.array(F.col(label)), lambda y: F.array(*(F.when(f.train, y.cast("double")) for f in some)))
    late = F.transform(draws if draws is not None else F.array(F.lit(0)), lambda _: F.array(*(f.late for f in some)))
    return fit(rows.withColumns({"_labels": F.flatten(labels), "_late": F.flatten(late)}), features, "_labels", plan, weight, "_late")


def judged(rows: DataFrame, some: Sequence[Fold], model: Ensemble, keep: Sequence[str]) -> DataFrame:
    """(keep, model, p, late): each row's probability by the models that it is late for or tests. Rows times the models concerned."""
    per = len(some)
    scores = model.score(rows, "_p")
    roles = F.array(*(F.when(f.late, F.lit(True)).when(f.test, F.lit(False)) for f in some))
    every = scores.select(*keep, "_p", roles.alias("_roles")).select(*keep, "_roles", F.posexplode("_p").alias("model", "p"))
    return every.withColumn("late", F.get("_roles", F.col("model") % per)).where("late IS NOT NULL").drop("_roles")


SHARES = [0.1 + 0.8 * i / 16 for i in range(17)]


def picked(late: DataFrame, by: Sequence[str], p: str, net: str, cuts: DataFrame, least: int = 3, share: float = 0.15) -> DataFrame:
    """(by, cut): of the cuts (by, cuts: an array) the one above which the mean net is best, the lowest of equals; `least`
    rows and `share` of all must be left, else 0.5. One aggregate for all groups."""
    rows = late.join(F.broadcast(cuts), list(by)) if by else late.crossJoin(F.broadcast(cuts))  # a row a model
    above = [F.col(p) >= F.get("cuts", F.lit(i)) for i in range(len(SHARES))]
    sums = [x for i, a in enumerate(above) for x in (F.count_if(a).alias(f"_n{i}"), F.avg(F.when(a, F.col(net))).alias(f"_m{i}"))]
    found = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.first("cuts").alias("cuts"), *sums)
    enough = F.greatest(F.lit(float(least)), share * F.col("_n"))
    able = [F.when(F.col(f"_n{i}") >= enough, F.struct(F.col(f"_m{i}").alias("mean"), (-F.get("cuts", F.lit(i))).alias("cut"))) for i in range(len(SHARES))]
    best = F.array_max(F.array_compact(F.array(*able)))
    return found.select(*by, F.coalesce(-best["cut"], F.lit(0.5)).alias("cut"))


def thresholds(late: DataFrame, by: Sequence[str], p: str, net: str) -> DataFrame:
    """picked from 17 quantiles of p, approximate ones, from the tenth to the ninetieth per cent."""
    return picked(late, by, p, net, late.groupBy(*by).agg(F.percentile_approx(p, F.array(*map(F.lit, SHARES)), 10_000).alias("cuts")))


def taken(rows: DataFrame, some: Sequence[Fold], model: Ensemble, keep: Sequence[str], net: str) -> DataFrame:
    """(model, keep, p, cut, taken) of the test rows: each model's threshold is picked on its late rows."""
    every = judged(rows, some, model, list(dict.fromkeys([*keep, net])))
    cut = thresholds(every.where("late"), ["model"], "p", net)
    return every.where("NOT late").join(cut, "model").withColumn("taken", F.col("p") >= F.col("cut")).drop("late")


def dealt(rows: DataFrame, keys: Sequence[str], label: str, draws: int) -> Column:
    """An array of labels (0 and 1), one a draw: those of all rows dealt anew among them.

    As labels are 0 and 1, a deal is which rows get a 1: those with the least hashes of (draw, keys), as many as there are ones.
    The cuts come from one aggregate (to a 10,000th of the rows).
    """
    numbers = list(range(draws))
    drawn = lambda k: F.xxhash64(F.lit(k), *keys)
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    ends = rows.agg(F.array(*(F.percentile_approx(drawn(k), share, 10_000) for k in numbers))).first()[0]
    return F.array(*((drawn(k) <= F.lit(e)).cast("double") if e is not None else F.lit(0.0) for k, e in zip(numbers, ends, strict=True)))


def shuffled(rows: DataFrame, keys: Sequence[str], column: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """rows with the column's values dealt anew among them, within each group of `by`.

    Each row sends its value to a bucket and takes one from another, both drawn by hash, so a task
    deals BUCKET rows at most on average. A bucket short of values gives some twice.
    """
    n = rows.count() // BUCKET + 1
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *by, *keys)
    at = lambda salt: F.pmod(draw(salt), F.lit(n))
    order = lambda salt: Window.partitionBy(*by, "_b").orderBy(draw(salt + "o"), *keys)
    given = rows.withColumn("_b", at("from")).select(*by, "_b", F.col(column).alias("_given"), F.row_number().over(order("from")).alias("_k"))
    sizes = given.groupBy(*by, "_b").agg(F.max("_k").alias("_n"))
    taker = rows.drop(column).withColumn("_b", at("to") if n > 1 else F.lit(0).cast("long"))
    taker = taker.withColumn("_r", F.row_number().over(order("to"))).join(sizes, [*by, "_b"]).withColumn("_k", F.pmod(F.col("_r") - 1, F.col("_n")) + 1)
    out = taker.join(given, [*by, "_b", "_k"]).withColumnRenamed("_given", column)
    return out.select(*rows.columns)


def permutation_importance(model: Ensemble, rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, repeats: int = 10) -> DataFrame:
    """(feature, importance): the mean drop in accuracy when the feature is dealt anew among the rows."""
    correct = lambda p: F.avg(((F.get(p, F.lit(0)) > 0.5).cast("double") == F.col(label)).cast("double"))
    base = model.score(rows, "_p").agg(correct("_p").alias("base"))
    every = rows.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    out = None
    for f in features:
        one = model.score(shuffled(every, keys, f, 7, ["_repeat"]), "_p").agg(F.lit(f).alias("feature"), correct("_p").alias("dealt"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(base)).select("feature", F.coalesce(F.col("base") - F.col("dealt"), F.lit(0.0)).alias("importance"))  # one row


def block_null(values: DataFrame, by: str, order: str, taken: str, net: str, draws: int, block: int) -> DataFrame:
    """(draw, mean): the mean net at the taken places after each group's blocks of rows change places.

    values has by, order, taken, net. Blocks are numbered within the group; a draw deals their
    numbers anew, and rows are moved by a join on (group, block, place), so it is the number of
    blocks, not of rows, that a window sees. A short last block moves the rows it has.
    """
    spark = values.sparkSession
    number = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = values.withColumn("_n", number).select(by, F.floor(F.col("_n") / block).alias("_b"), (F.col("_n") % block).alias("_i"), taken, net)
    blocks = rows.select(by, "_b").distinct().crossJoin(F.broadcast(spark.range(draws).withColumnRenamed("id", "draw")))  # draws, a parameter
    dealt = blocks.withColumn("_to", F.row_number().over(Window.partitionBy(by, "draw").orderBy(F.md5(F.concat_ws("|", "draw", by, "_b")), "_b")) - 1)
    moved = rows.where(taken).select(by, "_b", "_i").join(dealt, [by, "_b"]).join(rows.select(by, F.col("_b").alias("_to"), "_i", net), [by, "_to", "_i"])
    return moved.groupBy("draw").agg(F.avg(net).alias("mean"))
