"""Returns, calendar filling, compounding and drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: str, start: int | None = None, end: int = 0):
    window = Window.partitionBy(key).orderBy("dt")
    return window.rowsBetween(Window.unboundedPreceding if start is None else start, end)


def simple_returns(prices: DataFrame, key: str = "asset") -> DataFrame:
    """(key, dt, r): price over the row before, less one; a key's first row has none."""
    before = F.lag("price").over(Window.partitionBy(key).orderBy("dt"))
    return prices.select(key, "dt", (F.col("price") / before - 1).alias("r")).where("r is not null")


def on_calendar(prices: DataFrame) -> DataFrame:
    """(asset, dt, price) with a row for every date of any asset; missing prices are null."""
    dates = prices.select("dt").distinct()
    assets = prices.select("asset").distinct()
    return assets.join(F.broadcast(dates)).join(prices, ["asset", "dt"], "left")


def fill_forward(panel: DataFrame, value: str = "price") -> DataFrame:
    return panel.withColumn(value, F.last(value, ignorenulls=True).over(by("asset")))


def fill_backward(panel: DataFrame, value: str = "price") -> DataFrame:
    ahead = Window.partitionBy("asset").orderBy("dt").rowsBetween(0, Window.unboundedFollowing)
    return panel.withColumn(value, F.first(value, ignorenulls=True).over(ahead))


def excess_returns(returns: DataFrame, rates: DataFrame) -> DataFrame:
    return returns.join(F.broadcast(rates), "dt", "left").withColumn("r", F.col("r") - F.coalesce("rf", F.lit(0.0))).drop("rf")


def growth(r: Column, window) -> Column:
    """Product of 1 + r over a window; null from a total loss on."""
    return F.exp(F.sum(F.log(1 + r)).over(window))


def cumulative(returns: DataFrame, key: str = "asset") -> DataFrame:
    return returns.withColumn("value", growth(F.col("r"), by(key)))


def drawdowns(returns: DataFrame, key: str = "asset") -> DataFrame:
    """(key, dt, r, value, peak, drawdown): fall of the compounded value below its running maximum."""
    grown = cumulative(returns, key).withColumn("peak", F.max("value").over(by(key)))
    return grown.withColumn("drawdown", F.col("value") / F.col("peak") - 1)


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(strategy, dt, r): sum of weight times return; missing returns are skipped."""
    joined = returns.join(F.broadcast(weights), "asset")
    return joined.groupBy("strategy", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def levered(returns: DataFrame, rates: DataFrame, leverage: float) -> DataFrame:
    """Returns at a leverage, the borrowed part paid at the risk-free rate."""
    joined = returns.join(F.broadcast(rates), "dt", "left")
    return joined.withColumn("r", F.col("r") * leverage + F.coalesce("rf", F.lit(0.0)) * (1 - leverage)).drop("rf")


def carried_weights(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """(asset, dt, w) on every date: the weight of the last rebalance on or before it. An as-of join through a
    union and a window, so neither side is broadcast."""
    grid = dates.select("dt").distinct().join(F.broadcast(weights.select("asset").distinct()))
    both = weights.select("asset", "dt", "w", F.lit(0).alias("kind")).unionByName(grid.select("asset", "dt", F.lit(None).cast("double").alias("w"), F.lit(1).alias("kind")))
    order = Window.partitionBy("asset").orderBy("dt", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("w", F.last("w", ignorenulls=True).over(order)).where("kind = 1 and w is not null").select("asset", "dt", "w")
