"""Trend of the spread between two value-at-risk forecasts, and signals from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize


def rolling_trend(series: DataFrame, window: int, key: str = "asset", inclusive: bool = False) -> DataFrame:
    """``series`` with ``beta`` and ``alpha`` of the line through the ``window`` rows before each row (with
    ``inclusive``: the last of them is the row itself), their
    places counted 1 to ``window``; null before there are as many."""
    order = Window.partitionBy(key).orderBy("dt")
    numbered = series.withColumn("rn", F.row_number().over(order))
    past = order.rowsBetween(1 - window, 0) if inclusive else order.rowsBetween(-window, -1)
    beta = F.regr_slope("spread", "rn").over(past)
    full = F.count("spread").over(past) == window
    fitted = numbered.withColumn("beta", F.when(full, beta)).withColumn("mean", F.avg("spread").over(past))
    return fitted.withColumn("alpha", F.col("mean") - F.col("beta") * (window + 1) / 2).drop("mean", "rn")


def spread_signal(trend: DataFrame, q: float = 1.0, key: str = "asset") -> DataFrame:
    """``label`` 1 where the slope reaches ``q`` times the mean so far of its positive parts, else 0."""
    up = Window.partitionBy(key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    known = trend.where("beta is not null")
    level = F.sum(F.greatest("beta", F.lit(0.0))).over(up) / F.count(F.lit(1)).over(up)
    return known.withColumn("level", level).withColumn("label", (F.round("beta", 12) >= F.round(q * F.col("level"), 12)).cast("int"))


def best_parameters(series: DataFrame, windows: list[int], factors: list[float], key: str = "asset") -> DataFrame:
    """(key, window, q, gain): what would have gained most by standing aside when the label is 1; ties: the
    shortest window, then the smallest factor. The slopes of all windows come from one pass over the series, and
    the factors meet them as rows."""
    order = Window.partitionBy(key).orderBy("dt")
    numbered = series.withColumn("rn", F.row_number().over(order))
    slopes = []
    for window in windows:
        past = order.rowsBetween(-window, -1)
        slope = F.when(F.count("spread").over(past) == window, F.regr_slope("spread", "rn").over(past))
        slopes.append(F.struct(F.lit(window).alias("window"), slope.alias("beta")))
    fitted = numbered.select(key, "dt", "r", F.array(*slopes).alias("slopes"))
    trend = fitted.select(key, "dt", "r", F.explode("slopes").alias("t")).select(key, "dt", "r", "t.window", "t.beta").where("beta is not null")
    up = Window.partitionBy(key, "window").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.greatest("beta", F.lit(0.0))).over(up) / F.count(F.lit(1)).over(up)
    grid = trend.withColumn("level", level).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in factors])))
    label = (F.round("beta", 12) >= F.round(F.col("q") * F.col("level"), 12)).cast("double")
    gains = grid.groupBy(key, "window", "q").agg(F.round(F.sum(-label * F.col("r")), 9).alias("gain"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gain"), "window", "q"))
    return gains.withColumn("k", best).where("k = 1").select(key, "window", "q", "gain")


def forecast_spreads(returns: DataFrame, alphas: dict[float, float], window: int = 12, key: str = "factor") -> DataFrame:
    """(alpha, key, dt, r, spread): how far the historical value at risk of the last ``window`` returns lies from that of a
    normal law with their mean and deviation, at each level of ``alphas`` (level to normal quantile)."""
    w = Window.partitionBy(key).orderBy("dt").rowsBetween(1 - window, 0)
    at = [F.struct(F.lit(a).alias("alpha"), (F.abs(F.percentile("r", F.lit(a)).over(w)) - F.abs(F.avg("r").over(w) + z * F.stddev_samp("r").over(w))).alias("spread")) for a, z in alphas.items()]
    known = returns.select(key, "dt", "r", F.when(F.count("r").over(w) == window, F.array(*at)).alias("at"))
    return known.select(key, "dt", "r", F.explode("at").alias("s")).select("s.alpha", key, "dt", "r", "s.spread")


def _levels(trend: DataFrame, keys: list[str]) -> DataFrame:
    """``trend`` with the mean so far of the slope's positive parts."""
    up = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return trend.withColumn("level", F.sum(F.greatest("beta", F.lit(0.0))).over(up) / F.count(F.lit(1)).over(up))


def fold_spread_signals(series: DataFrame, folds: DataFrame, lags: list[int], step: float = 0.025, steps: int = 801, size: int = 250, key: str = "factor") -> DataFrame:
    """(alpha, cv, key, dt, window, q, beta, level, label) of each fold's test rows of ``series`` (alpha, key, dt, r, spread): label 1
    where the slope over the ``window`` rows before reaches q times the mean since the test's start of its positive parts.

    Window and q are those of ``lags`` and of ``steps`` multiples of ``step`` from 0 that would have gained most, by standing
    aside at label 1, over the last ``size`` rows before the test; ties: the shortest window, then the smallest q. A row's
    label is 1 up to some multiple and 0 beyond it, so rows are added up by that multiple and summed from the
    largest down; they do not meet the multiples one by one."""
    own = ["alpha", key]
    order = Window.partitionBy(*own).orderBy("dt")
    numbered = series.withColumn("rn", F.row_number().over(order))
    slope = lambda p: F.when(F.count("spread").over(order.rowsBetween(-p, -1)) == p, F.regr_slope("spread", "rn").over(order.rowsBetween(-p, -1)))
    fitted = numbered.select(*own, "dt", "rn", "r", F.array(*[F.struct(F.lit(p).alias("window"), slope(p).alias("beta")) for p in lags]).alias("slopes"))
    fitted = materialize(fitted, "slopes")
    spans = F.broadcast(folds.select("cv", "start", "test_start", "end"))
    before = fitted.join(spans, (F.col("dt") >= F.col("start")) & (F.col("dt") < F.col("test_start")))
    turn = F.row_number().over(Window.partitionBy("cv", *own).orderBy(F.desc("dt")))
    recent = before.withColumn("turn", turn).where(F.col("turn") <= size).withColumn("first", F.min("rn").over(Window.partitionBy("cv", *own)))
    train = recent.select("cv", *own, "dt", "r", (F.col("rn") - F.col("first")).alias("place"), F.explode("slopes").alias("s")).select("cv", *own, "dt", "r", "place", "s.window", "s.beta")
    keys = ["cv", *own, "window"]
    known = _levels(train.where("beta is not null and place >= window"), keys)
    reached = lambda k: F.round("beta", 12) >= F.round(k * step * F.col("level"), 12)
    guess = F.least(F.lit(steps - 1), F.floor(F.coalesce(F.col("beta") / F.nullif("level", F.lit(0.0)), F.when(F.col("beta") >= 0, F.lit(float(steps))).otherwise(-1.0)) / step)).cast("int")
    known = known.withColumn("k", F.greatest(guess, F.lit(-1)))
    last = F.when((F.col("k") + 1 < steps) & reached(F.col("k") + 1), F.col("k") + 1).when((F.col("k") < 0) | reached(F.col("k")), F.col("k")).otherwise(F.col("k") - 1)
    cells = known.select(*keys, "r", last.alias("k")).groupBy(*keys, "k").agg(F.sum(-F.col("r")).alias("gain"))
    down = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rising = Window.partitionBy(*keys).orderBy("k")
    # From the multiple after the cell below on, up to its own, a cell and those above it are labelled.
    curve = cells.select(*keys, F.sum("gain").over(down).alias("gain"), "k", F.greatest(F.coalesce(F.lag("k").over(rising), F.lit(-1)), F.lit(-1)).alias("below"))
    inside = curve.where("k >= 0").select(*keys, "gain", (F.col("below") + 1).alias("k"))
    beyond = cells.groupBy(*keys).agg((F.max("k") + 1).alias("k")).where(F.col("k") < steps).select(*keys, F.lit(0.0).alias("gain"), "k")
    options = inside.unionByName(beyond).withColumn("gain", F.round("gain", 9) + F.lit(0.0))
    first = F.row_number().over(Window.partitionBy("cv", *own).orderBy(F.desc("gain"), "window", "k"))
    best = materialize(options.withColumn("turn", first).where("turn = 1").select("cv", *own, "window", (F.col("k") * step).alias("q")), "best-spreads")
    test = fitted.join(spans, (F.col("dt") >= F.col("test_start")) & (F.col("dt") < F.col("end"))).select("cv", *own, "dt", F.explode("slopes").alias("s"))
    rows = test.select("cv", *own, "dt", "s.window", "s.beta").where("beta is not null").join(best, keys)
    label = (F.round("beta", 12) >= F.round(F.col("q") * F.col("level"), 12)).cast("int")
    return _levels(rows, ["cv", *own]).select(*own, "cv", "dt", "window", "q", "beta", "level", label.alias("label"))
