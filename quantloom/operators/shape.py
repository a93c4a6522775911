"""Filters, alignments and small transforms of dated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(series: DataFrame, n: int, value: str = "r", key: str = "asset") -> DataFrame:
    """``series`` with ``mean`` of the last ``n`` rows of a key; null before there are as many."""
    back = Window.partitionBy(key).orderBy("dt").rowsBetween(1 - n, 0)
    return series.withColumn("mean", F.when(F.count(value).over(back) == n, F.avg(value).over(back)))


def trimmed(series: DataFrame, low: float = 0.05, high: float = 0.95, value: str = "r", key: str = "asset") -> DataFrame:
    """Rows of ``series`` between two exact quantiles of their key, both ends in."""
    cut = series.groupBy(key).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("cut"))
    return series.join(cut, key).where(F.col(value).between(F.col("cut")[0], F.col("cut")[1])).drop("cut")


def first_rows(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` of each combination of ``keys``, as one aggregate."""
    rest = [c for c in frame.columns if c not in (*keys, *order)]
    first = frame.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return first.select(*keys, "row.*").select(frame.columns)


def without_last(frame: DataFrame, key: str) -> DataFrame:
    """All rows but the last date of each key."""
    last = frame.groupBy(key).agg(F.max("dt").alias("last"))
    return frame.join(last, key).where("dt < last").drop("last")


def aligned(left: DataFrame, right: DataFrame, on: str = "dt") -> DataFrame:
    """Full outer join on the date: every date of either side once."""
    return left.join(right, on, "full")


def newer(frame: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows dated after the last date of their key in ``seen``; all rows of a key not seen yet."""
    last = seen.groupBy(key).agg(F.max("dt").alias("last"))
    return frame.join(last, key, "left").where("last is null or dt > last").drop("last")


def dates_of_either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dt").union(b.select("dt")).distinct()


def dates_of_first_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dt").subtract(b.select("dt"))


def columns_where(frame: DataFrame, test: Callable[[str], bool], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and those whose name passes a test."""
    return frame.select([c for c in frame.columns if c in keep or test(c)])


def hour_in_week(ts: Column) -> Column:
    """Place in the week as a sine: 0 at Monday midnight, a full turn in 168 hours."""
    return F.round(F.sin((24 * F.weekday(ts) + F.hour(ts)) * (2 * 3.141592653589793 / 168)), 4)


def checked_folds(folds: DataFrame) -> DataFrame:
    """``folds`` if each has start < val_start < test_start < end; raises otherwise. Folds are few."""
    wrong = folds.where(~((F.col("start") < F.col("val_start")) & (F.col("val_start") < F.col("test_start")) & (F.col("test_start") < F.col("end"))))
    bad = [r["cv"] for r in wrong.select("cv").collect()]
    if bad:
        raise ValueError(f"dates of folds {bad} are not in order")
    return folds


def averaged(weights: DataFrame, over: str = "run") -> DataFrame:
    """(asset, w): mean weight over all runs; an asset missing from a run weighs nothing there."""
    runs = weights.agg(F.countDistinct(over).alias("runs"))
    total = weights.groupBy("asset").agg(F.sum("w").alias("total"))
    return total.join(F.broadcast(runs)).select("asset", (F.col("total") / F.col("runs")).alias("w"))


def balance(returns: DataFrame, capital: float = 1000.0, fee: float = 0.0002) -> DataFrame:
    """(strategy, dt, balance): capital less the cost of buying, compounded by the returns."""
    so_far = Window.partitionBy("strategy").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select("strategy", "dt", (capital * (1 - fee) * F.exp(F.sum(F.log(1 + F.col("r"))).over(so_far))).alias("balance"))


def covariance_accuracy(split: DataFrame) -> DataFrame:
    """(cv, l1, sign): distance of the test covariances from the train ones over the latter's size, and the share
    of pairs (both ways, and each asset with itself) whose signs agree."""
    rows = split.where("split in ('train', 'test')")
    x, y = rows.select("cv", "split", "dt", F.col("asset").alias("a"), F.col("r").alias("x")), rows.select("cv", "split", "dt", F.col("asset").alias("b"), F.col("r").alias("y"))
    pairs = x.join(y, ["cv", "split", "dt"]).where("a <= b").groupBy("cv", "a", "b").agg(*[F.covar_samp(F.when(F.col("split") == s, F.col("x")), F.when(F.col("split") == s, F.col("y"))).alias(s) for s in ("train", "test")])
    times = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    both = pairs.where("train is not null and test is not null").withColumn("times", times)
    same = (F.signum("train") == F.signum("test")).cast("int")
    return both.groupBy("cv").agg((F.sum(F.col("times") * F.abs(F.col("test") - F.col("train"))) / F.sum(F.col("times") * F.abs("train"))).alias("l1"), (F.sum(F.col("times") * same) / F.sum("times")).alias("sign"))
