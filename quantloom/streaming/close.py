"""Closing prices of a stream of ticks. An addition: the batch operators have no continuous counterpart elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closing_prices(ticks: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(asset, start, price): last price of each asset in each window of event time. ``ticks`` (asset, ts, price)
    may be a stream; ticks later than ``late`` behind the newest are dropped, which bounds the state."""
    grouped = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", every).alias("w"))
    return grouped.agg(F.max(F.struct("ts", "price")).alias("last")).select("asset", F.col("w.start").alias("start"), F.col("last.price").alias("price"))
