"""Histogram gradient boosting of many models at once.

Features are cut into bins once. A level of a tree needs, for each model, class, node, feature and bin, the sums of
gradients, second derivatives and rows; these add up over tasks, so one pass over the rows grows one level of
the trees of all models: folds of a walk-forward test, or draws of a null, cost no passes of their own. A model's
training rows are those that have a label for it. Missing values have a bin of their own and go to the
side that gains more. Margins are written with the rows every few trees, and each task runs the trees since then,
so the work is linear in the trees and a lost executor costs tasks.

What is sent to the driver is bounded by models x classes x nodes x features x bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..sources.stage import staged

#: Models whose sums are one row of a task's result.
CHUNK = 64
#: Numbers of a task's working arrays.
CELLS = 2_000_000
#: Trees after which margins are written.
KEPT = 5


@dataclass(frozen=True)
class Plan:
    """How trees are grown. classes: 1 for labels 0 and 1, 3 and more for labels from 0, 0 for a number."""

    classes: int = 1
    trees: int = 20
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    least: int = 20
    bins: int = 32
    #: Trees without a better loss on the late rows after which a model stops.
    patience: int = 10

    @property
    def outputs(self) -> int:
        return max(1, self.classes)


@dataclass
class Ensemble:
    """Trees of many models: arrays by (model x class, place in the tree)."""

    plan: Plan
    features: tuple[str, ...]
    edges: list[np.ndarray]
    models: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of features: 0 for a missing one."""
        out = np.zeros(values.shape, np.int64)
        for f, edge in enumerate(self.edges):
            known = ~np.isnan(values[:, f])
            out[known, f] = 1 + np.searchsorted(edge, values[known, f], "left")
        return out

    def margins(self, codes: np.ndarray, base: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Sums of leaf values by (row, model x class): of the trees from `since` on, and base."""
        out = np.zeros((len(codes), self.models * self.plan.outputs)) if base is None else base.copy()
        for tree in self.trees[since:]:
            out += leaf(codes, tree[:3], self.plan.depth, tree[3])
        return out

    def predict(self, codes: np.ndarray, base: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Probabilities, or numbers, by (row, model, class)."""
        return link(self.margins(codes, base, since).reshape(len(codes), self.models, -1), self.plan.classes)

    def score(self, rows: DataFrame, name: str = "p") -> DataFrame:
        """rows with an array of all models' probabilities (or numbers), class by class."""

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            step = max(1, CELLS // (self.models * self.plan.outputs))
            for batch in batches:
                found = []
                for at in range(0, len(batch), step):
                    values = np.array([list(x) for x in batch[at : at + step]], dtype=float)
                    found += list(self.predict(self.codes(values)).reshape(len(values), -1))
                yield pd.Series(found, dtype=object)

        ship(rows.sparkSession)
        return rows.withColumn(name, run(inputs(self.features)))


def inputs(features: Sequence[str]) -> Column:
    return F.array(*(F.col(f).cast("double") for f in features))


def link(margins: np.ndarray, classes: int) -> np.ndarray:
    if classes == 0:
        return margins
    if classes == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def leaf(codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], levels: int, values: np.ndarray | None = None) -> np.ndarray:
    """Each row's node after so many levels, by (row, model x class), or the value there."""
    feature, cut, missing = tree
    columns = np.ascontiguousarray(codes.T)
    absent, most = columns == 0, columns.max(initial=0)
    out = np.zeros((len(feature), len(codes)), np.int64 if values is None else float)
    for m in range(len(feature)):
        if values is not None and not values[m].any():
            continue  # a model that has stopped
        node = np.zeros(len(codes), np.int8)
        for level in range(levels):
            right = np.zeros(len(codes), bool)
            for k in range(2**level):
                at = 2**level - 1 + k
                f = feature[m, at]
                if cut[m, at] < most or not missing[m, at]:
                    above = columns[f] > cut[m, at]
                    right |= (node == k) & (above if missing[m, at] else above | absent[f])
            node = 2 * node + right
        out[m] = node if values is None else values[m][node]
    return out.T


def slopes(p: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and second derivatives by (row, model, class), and losses by (row, model)."""
    if classes == 0:
        off = p - y[:, :, None]
        return off, np.ones_like(p), 0.5 * off[:, :, 0] ** 2
    if classes == 1:
        q = np.clip(p[:, :, 0], 1e-12, 1 - 1e-12)
        return p - y[:, :, None], p * (1 - p), -np.where(y > 0.5, np.log(q), np.log(1 - q))
    hot = y[:, :, None] == np.arange(classes)
    return p - hot, p * (1 - p), -np.log(np.clip(np.where(hot, p, 0).sum(2), 1e-12, 1))


def sums(model: Ensemble, tree: tuple[np.ndarray, np.ndarray, np.ndarray], level: int, codes: np.ndarray, y: np.ndarray, late: np.ndarray, weight: np.ndarray, base: np.ndarray | None = None, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sums by model x class, node, feature, bin; losses and weights of late rows by model) of some rows."""
    outputs, nodes, bins = model.plan.outputs, 2**level, model.plan.bins + 1
    n, width = len(codes), model.models * outputs
    g, h, loss = slopes(model.predict(codes, base, since), np.nan_to_num(y), model.plan.classes)
    known = ~np.isnan(y)
    fitted = (known & ~late).repeat(outputs, axis=1)
    w = weight[:, None] * fitted
    g, h = g.reshape(n, width) * w, h.reshape(n, width) * w
    place = np.arange(width) * nodes + leaf(codes, tree, level)
    found = np.zeros((width, nodes, len(model.features), bins, 3))
    for f in range(len(model.features)):
        at = (place * bins + codes[:, f : f + 1]).ravel()
        for k, x in enumerate((g, h, fitted)):
            found[:, :, f, :, k] = np.bincount(at, x.ravel(), width * nodes * bins).reshape(width, nodes, bins)
    tested = (known & late) * weight[:, None]
    return found, np.stack([(loss * tested).sum(0), tested.sum(0)], 1)


def choose(found: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """The best split of each (model x class, node): feature, last bin to the left, whether missing values go left;
    and (gradient, second derivative) of the left and the right side. A node without a gain keeps all to the left."""
    total = found[:, :, 0].sum(2)  # any feature's bins add up to the node
    below = np.cumsum(found[:, :, :, 1:], axis=3)  # by the last bin to the left, missing values apart
    lost = found[:, :, :, :1]
    left = np.stack([below, below + lost], 4)  # missing to the right, to the left
    right = total[:, :, None, None, None] - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + plan.l2)
    gain = value(left) + value(right) - value(total)[:, :, None, None, None]
    able = (left[..., 2] >= plan.least) & (right[..., 2] >= plan.least)
    gain = np.where(able, gain, -np.inf)
    width, nodes, features, bins, _ = gain.shape
    best = gain.reshape(width, nodes, -1).argmax(2)
    f, b, m = np.unravel_index(best, (features, bins, 2))
    i, j = np.ogrid[:width, :nodes]
    split = gain[i, j, f, b, m] > 1e-9
    sides = np.stack([left[i, j, f, b, m, :2], right[i, j, f, b, m, :2]], 2)
    whole = np.stack([total[..., :2], np.zeros_like(total[..., :2])], 2)
    return np.where(split, f, 0), np.where(split, b + 1, plan.bins + 1), np.where(split, m == 1, True), np.where(split[..., None, None], sides, whole), split


def fit(rows: DataFrame, features: Sequence[str], labels: str, plan: Plan, weight: str | None = None, late: str | None = None) -> Ensemble:
    """Models of rows with an array `labels`: a row is fitted by those models for which it has a label (0 and up, or a number).

    late, an array of booleans, marks rows that a model only tests its loss on, to stop early. Bins are approximate
    quantiles of the features over all rows, so they tell a model nothing of labels. Rows may be none.
    """
    ship(rows.sparkSession)
    shares = F.array(*(F.lit((k + 1) / plan.bins) for k in range(plan.bins - 1)))
    found = rows.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000) for f in features), F.max(F.size(labels))).first()
    model = Ensemble(plan, tuple(features), [np.unique(np.array(x or [], float)) for x in found[:-1]], found[-1] or 0)
    if not model.models:
        return model
    table = rows.select(inputs(features).alias("x"), F.col(labels).cast("array<double>").alias("y"), F.coalesce(F.col(weight) if weight else F.lit(1.0), F.lit(0.0)).cast("double").alias("w"), F.transform(F.col(late), lambda t: F.coalesce(t, F.lit(False))).alias("late") if late else F.array().cast("array<boolean>").alias("late"), F.array().cast("array<double>").alias("m"))
    table, since = staged(table, "boosting"), 0
    going, best, stale = np.ones(model.models, bool), np.full(model.models, np.inf), np.zeros(model.models, int)
    for _ in range(plan.trees):
        width, places = model.models * plan.outputs, 2**plan.depth - 1
        feature, cut, missing = np.zeros((width, places), np.int64), np.full((width, places), plan.bins + 1), np.ones((width, places), bool)
        sides = np.zeros((width, 1, 2, 2))
        for level in range(plan.depth):
            hist, loss = gathered(table, model, (feature, cut, missing), level, since)
            if level == 0 and late:
                with np.errstate(invalid="ignore", divide="ignore"):
                    now = np.where(loss[:, 1] > 0, loss[:, 0] / loss[:, 1], -np.inf)
                stale = np.where(now < best - 1e-7, 0, stale + (loss[:, 1] > 0))
                best, going = np.minimum(best, now), going & (stale < plan.patience)
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            feature[:, at], cut[:, at], missing[:, at], sides, split = choose(hist, plan)
            if level == 0 and not (split[:, 0] & going.repeat(plan.outputs)).any():
                return model
        g, h = sides.reshape(width, 2**plan.depth, 2).transpose(2, 0, 1)
        value = -plan.rate * g / (h + plan.l2) * going.repeat(plan.outputs)[:, None]
        model.trees.append((feature, cut, missing, value))
        if len(model.trees) - since == KEPT and len(model.trees) < plan.trees:
            table, since = with_margins(table, model, since), len(model.trees)
    return model


def grid(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix; null is NaN."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def parts_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def with_margins(table: DataFrame, model: Ensemble, since: int) -> DataFrame:
    """The table with the margins of all trees so far, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, model.models * model.plan.outputs):
            m = model.margins(model.codes(grid(part, "x")), grid(part, "m") if since else None, since)
            at = part.schema.get_field_index("m")
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            yield part.set_column(at, part.schema.field(at), column.cast(part.schema.field(at).type))

    return staged(table.mapInArrow(run, table.schema), "margins")


def gathered(table: DataFrame, model: Ensemble, tree: tuple[np.ndarray, np.ndarray, np.ndarray], level: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """sums over a whole table (x, y, w, late, m): added up in each task, then by chunks of models."""
    shape = (model.models * model.plan.outputs, 2**level, len(model.features), model.plan.bins + 1, 3)
    chunks = [slice(a, min(a + CHUNK, model.models)) for a in range(0, model.models, CHUNK)]
    wide = lambda s: slice(s.start * model.plan.outputs, s.stop * model.plan.outputs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, loss = np.zeros(shape), np.zeros((model.models, 2))
        for part in parts_of(batches, shape[0]):
            y, late = grid(part, "y"), grid(part, "late").astype(bool)
            late = late if late.size else np.zeros(y.shape, bool)
            some, more = sums(model, tree, level, model.codes(grid(part, "x")), y, late, part.column("w").to_numpy(), grid(part, "m") if since else None, since)
            hist += some
            loss += more
        if hist.any() or loss.any():
            blobs = [np.concatenate([hist[wide(s)].ravel(), loss[s].ravel()]).tobytes() for s in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "sums"])

    def join(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in group.column("sums").to_pylist())
        return pa.table({"chunk": group.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    hist, loss = np.zeros(shape), np.zeros((model.models, 2))
    for r in table.mapInArrow(add, "chunk int, sums binary").groupBy("chunk").applyInArrow(join, "chunk int, sums binary").collect():
        s, x = chunks[r["chunk"]], np.frombuffer(r["sums"], float)
        loss[s] = x[-2 * (s.stop - s.start) :].reshape(-1, 2)
        hist[wide(s)] = x[: -2 * (s.stop - s.start)].reshape(-1, *shape[1:])
    return hist, loss
