"""A market model for every symbol: returns regressed on those of other symbols, and the share of a move that it leaves open."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .asof import interval_join


def aligned(returns: DataFrame, regressors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(symbol, ts, keep, y, x): each symbol's return with an array of those of the regressors at its time.

    Times at which one of them has no return drop out, and so do the regressors themselves. One equi-join on time with a
    table of one row a time.
    """
    side = returns.where(F.col("symbol").isin(*regressors)).groupBy("ts").agg(F.array(*(F.max(F.when(F.col("symbol") == r, F.col("ret"))) for r in regressors)).alias("x"))
    side = side.where(~F.exists("x", lambda v: v.isNull()))
    own = returns.where(~F.col("symbol").isin(*regressors) & F.col("ret").isNotNull())
    return own.join(side, "ts").select("symbol", "ts", *keep, F.col("ret").alias("y"), "x")


def market_model(rows: DataFrame, by: Sequence[str], regressors: int) -> DataFrame:
    """(by, n, alpha, betas, r2) of least squares of y on the array x, for every group; null r2 without spread.

    Means and covariances of all pairs come from one aggregate, combined before the shuffle, so a group of any length is
    one row; only those rows are solved. Groups of under regressors + 2 rows get nulls; regressors that depend on each other
    get the solution of least length.
    """
    ship(rows.sparkSession)
    x = [F.get("x", F.lit(i)) for i in range(regressors)]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pairs = F.array(*(zero(F.covar_samp(a, b)) for a in x for b in x))
    facts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_my"), F.array(*(F.avg(a) for a in x)).alias("_mx"), pairs.alias("_xx"), F.array(*(zero(F.covar_samp(a, "y")) for a in x)).alias("_xy"), F.var_samp("y").alias("_yy")
    )

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(np.array(a, float).reshape(regressors, -1), hermitian=True) @ np.array(b, float) for a, b in zip(xx, xy, strict=True)], dtype=object)

    fit = facts.withColumn("betas", F.when(F.col("n") >= regressors + 2, solved("_xx", "_xy")))
    return fit.select(*by, "n", (F.col("_my") - dot("betas", "_mx")).alias("alpha"), "betas", (dot("betas", "_xy") / F.nullif(F.col("_yy"), F.lit(0.0))).alias("r2"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def share_left(actual: Column, market: Column) -> Column:
    """The share of a move that the market's part leaves open, 0 to 1: all of it if they point apart, null without a move or a model."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - market / actual))
    return F.when(market.isNotNull() & (F.abs(actual) >= 1e-9), F.when(F.signum(market) != F.signum(actual), 1.0).otherwise(share))


def explained(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (symbol, …, y, x) with `market`: what the symbol's model gives."""
    return rows.join(model.select("symbol", "alpha", "betas"), "symbol").withColumn("market", F.col("alpha") + dot("betas", "x")).drop("alpha", "betas")


def idio_shares(events: DataFrame, rows: DataFrame, model: DataFrame, pad_seconds: int, width: int = 3600) -> DataFrame:
    """events (event, symbol, first_ts, last_ts) with actual, market and idio_share over each window.

    Windows begin pad_seconds early, so that one of a single bar has a return; rows are aligned ones. Null where the
    symbol has no model or the window no row.
    """
    wide = events.select("event", "symbol", (F.col("first_ts") - F.make_dt_interval(secs=F.lit(float(pad_seconds)))).cast("timestamp_ntz").alias("since"), F.col("last_ts").alias("until"))
    inside = interval_join(wide, explained(rows, model).select("symbol", "ts", "y", "market"), "since", "until", "ts", width, ["symbol"])
    sums = inside.groupBy("event").agg(F.sum("y").alias("actual"), F.sum("market").alias("market"))
    return events.join(sums, "event", "left").withColumn("idio_share", share_left(F.col("actual"), F.col("market")))
