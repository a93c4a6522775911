"""Saved results of strategies by fold: written once a run, loaded, renamed, and joined with others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_runs, write_by_fold


def save_results(returns: DataFrame, weights: DataFrame, path: str) -> None:
    """Returns (cv, strategy, dt, r) and weights (cv, strategy, asset, w) below ``path``, a folder for each strategy and fold."""
    write_by_fold(returns.select("strategy", "cv", "dt", "r"), f"{path}/returns", "strategy", "cv")
    write_by_fold(weights.select("strategy", "cv", "asset", "w"), f"{path}/weights", "strategy", "cv")


def renamed(frame: DataFrame, names: dict[str, str], column: str = "strategy") -> DataFrame:
    """``frame`` with values of ``column`` replaced by ``names``; two that then coincide raise, as they would be mixed."""
    if len(set(names.values())) < len(names):
        raise ValueError(f"several names become one: {names}")
    taken = frame.where(F.col(column).isin(list(names.values())) & ~F.col(column).isin(list(names))).select(column).first() if names else None
    if taken:
        raise ValueError(f"{taken[0]} is there already")
    return frame.replace(names, subset=[column]) if names else frame


def load_results(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(returns, weights) as ``save_results`` takes them, strategies renamed. Keys are in folders' names, so a filter on
    strategy or fold reads their files only."""
    returns, weights = (read_runs(spark, f"{path}/{part}").withColumn("strategy", F.col("strategy").cast("string")) for part in ("returns", "weights"))
    return renamed(returns, names or {}), renamed(weights, names or {})


def with_external(returns: DataFrame, other: DataFrame) -> DataFrame:
    """Returns of saved strategies and of others (strategy, dt, r), such as a benchmark's, on the dates that any saved
    strategy has; the fold of those is the earliest with the date."""
    dates = returns.groupBy("dt").agg(F.min("cv").alias("cv"))
    return returns.select("strategy", "cv", "dt", "r").unionByName(other.join(dates, "dt").select("strategy", "cv", "dt", "r"))


def missing_dates(returns: DataFrame) -> DataFrame:
    """(strategy, first, last, n, missing): the dates of each strategy and how many it lacks of those that any has."""
    every = returns.agg(F.count_distinct("dt").alias("all"))
    own = returns.groupBy("strategy").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count_distinct("dt").alias("n"))
    return own.join(F.broadcast(every)).select("strategy", "first", "last", "n", (F.col("all") - F.col("n")).alias("missing"))
