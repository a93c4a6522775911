"""Walk-forward folds, train-only scaling, and the volatility-targeted backtest with costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def fold_rows(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of ``frame`` once for each fold that holds their date, with ``cv`` and ``split`` (train, val, test).
    Folds are few, so the range join is a broadcast of the folds."""
    inside = (F.col("dt") >= F.col("start")) & (F.col("dt") < F.col("end"))
    split = F.when(F.col("dt") < F.col("val_start"), "train").when(F.col("dt") < F.col("test_start"), "val").otherwise("test")
    return frame.join(F.broadcast(folds), inside).withColumn("split", split).drop("start", "val_start", "test_start", "end")


def split_returns(prices: DataFrame, folds: DataFrame) -> DataFrame:
    """Returns inside each split of each fold; the first row of a split has none."""
    order = Window.partitionBy("cv", "split", "asset").orderBy("dt")
    rows = fold_rows(prices, folds)
    return rows.withColumn("r", F.col("price") / F.lag("price").over(order) - 1).where("r is not null").select("cv", "split", "asset", "dt", "r")


def fitted_scaler(split: DataFrame) -> DataFrame:
    """(cv, asset, m, s): each fold's train mean and population deviation; a zero deviation counts as one."""
    fitted = split.where("split = 'train'").groupBy("cv", "asset").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return fitted.select("cv", "asset", "m", F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)).alias("s"))


def unscaled(scaled: DataFrame, scaler: DataFrame) -> DataFrame:
    """Returns from z-scores, by a scaler (cv, asset, m, s) as it was kept."""
    return scaled.join(scaler, ["cv", "asset"]).select("cv", "split", "asset", "dt", (F.col("z") * F.col("s") + F.col("m")).alias("r"))


def standardised(split: DataFrame) -> DataFrame:
    """z-scores by each fold's train mean and population deviation; a zero deviation counts as one."""
    return split.join(fitted_scaler(split), ["cv", "asset"]).select("cv", "split", "asset", "dt", ((F.col("r") - F.col("m")) / F.col("s")).alias("z"))


def prediction_tables(split: DataFrame, predicted: DataFrame, scaler: DataFrame | None = None) -> DataFrame:
    """(cv, asset, dt, truth, prediction, scaled_truth, scaled_prediction) of the test rows of ``split`` that any run of
    ``predicted`` (run, cv, asset, dt, p) predicts: the mean over the runs, plain and in units of each fold's scaler
    (``fitted_scaler`` of the train rows unless given). A missing prediction of a run does not count in the mean."""
    mean = predicted.groupBy("cv", "asset", "dt").agg(F.avg("p").alias("prediction"))
    truth = split.where("split = 'test'").select("cv", "asset", "dt", F.col("r").alias("truth"))
    joined = truth.join(mean, ["cv", "asset", "dt"]).join(fitted_scaler(split) if scaler is None else scaler, ["cv", "asset"])
    scaled = [((F.col(c) - F.col("m")) / F.col("s")).alias(f"scaled_{c}") for c in ("truth", "prediction")]
    return joined.select("cv", "asset", "dt", "truth", "prediction", *scaled)


def prediction_errors(tables: DataFrame) -> DataFrame:
    """(cv, asset, n, mse, scaled_mse, r2): squared errors of ``prediction_tables`` and one minus their sum over that of the
    squared true returns, which are not centred; null where all of these are zero."""
    e, s = F.col("truth") - F.col("prediction"), F.col("scaled_truth") - F.col("scaled_prediction")
    r2 = 1 - ratio(F.sum(e * e), F.sum(F.col("truth") * F.col("truth")))
    return tables.groupBy("cv", "asset").agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(s * s).alias("scaled_mse"), r2.alias("r2"))


def min_max(split: DataFrame) -> DataFrame:
    """Scaled to -1..1 by each fold's train range."""
    fitted = split.where("split = 'train'").groupBy("cv", "asset").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    joined = split.join(fitted, ["cv", "asset"])
    return joined.select("cv", "split", "asset", "dt", (2 * ratio(F.col("r") - F.col("lo"), F.col("hi") - F.col("lo")) - 1).alias("z"))


def drifted(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """(cv, asset, w) of weights (cv, asset, w, from, to) after the prices moved from one date to another."""
    start = prices.select("asset", F.col("dt").alias("from"), F.col("price").alias("p0"))
    stop = prices.select("asset", F.col("dt").alias("to"), F.col("price").alias("p1"))
    moved = weights.join(start, ["asset", "from"]).join(stop, ["asset", "to"]).withColumn("v", F.col("w") / F.col("p0") * F.col("p1"))
    return moved.select("cv", "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("cv"))).alias("w"))


def fold_weights(split: DataFrame) -> DataFrame:
    """(cv, asset, w): inverse-volatility weights from each fold's train returns."""
    sd = split.where("split = 'train'").groupBy("cv", "asset").agg((1 / F.stddev_samp("r")).alias("v"))
    return sd.select("cv", "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("cv"))).alias("w"))


def turnover(weights: DataFrame, before: DataFrame, before_first: float = 0.0) -> DataFrame:
    """(cv, turnover, sspw): sum of absolute changes from what the weights of the fold before had drifted to
    (``before``: cv, asset, w; ``before_first`` of each asset before the first fold), and the sum of squared weights.
    What is no longer held is sold, so both sides count."""
    last = weights.agg(F.max("cv").alias("last"))
    sold = before.join(F.broadcast(last), F.col("cv") < F.col("last")).select((F.col("cv") + 1).alias("cv"), "asset", F.lit(0.0).alias("own"), (-F.col("w")).alias("d"))
    first = Window.partitionBy("asset").orderBy("cv")
    start = F.when((F.row_number().over(first) == 1) & (F.col("cv") == F.min("cv").over(Window.partitionBy(F.lit(0)))), F.lit(before_first)).otherwise(0.0)
    both = weights.select("cv", "asset", F.col("w").alias("own"), (F.col("w") - start).alias("d")).unionByName(sold)
    moves = both.groupBy("cv", "asset").agg(F.sum("own").alias("own"), F.sum("d").alias("d"))
    return moves.groupBy("cv").agg(F.sum(F.abs("d")).alias("turnover"), F.sum(F.col("own") * F.col("own")).alias("sspw"))


def vol_target_backtest(prices: DataFrame, folds: DataFrame, rates: DataFrame, target: float = 0.05, fee: float = 0.0002, period: int = 12, short: int = 20, long: int = 60, weights: DataFrame | None = None, before_first: float = 0.0) -> DataFrame:
    """(cv, dt, leverage, gross, r): test returns of the fold's weights (cv, asset, w; by default inverse to
    volatility), levered to a target volatility.

    Leverage is the target over the larger of two trailing population deviations of the train portfolio;
    trading costs fall on the first test day, on the change from what the weights before had drifted to; what is borrowed pays,
    and what is left over earns, the risk-free rate.
    """
    split = split_returns(prices, folds)
    weights = fold_weights(split) if weights is None else weights
    held = weights.join(F.broadcast(folds.select("cv", F.col("test_start").alias("from"), F.add_months("end", -1).alias("to"))), "cv")
    changes = turnover(weights, drifted(held, prices), before_first)
    daily = split.join(F.broadcast(weights), ["cv", "asset"]).groupBy("cv", "split", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("gross"))
    back = F.row_number().over(Window.partitionBy("cv").orderBy(F.desc("dt")))
    recent = daily.where("split = 'train'").withColumn("back", back)
    vol = F.greatest(F.stddev_pop(F.when(F.col("back") <= short, F.col("gross"))), F.stddev_pop(F.when(F.col("back") <= long, F.col("gross"))))
    lever = recent.groupBy("cv").agg((target / (vol * float(period) ** 0.5)).alias("leverage"))
    first = F.row_number().over(Window.partitionBy("cv").orderBy("dt")) == 1
    test = daily.where("split = 'test'").withColumn("first", first)
    joined = test.join(F.broadcast(lever), "cv").join(F.broadcast(changes), "cv").join(F.broadcast(rates), "dt", "left")
    cost = F.when(F.col("first"), fee * F.col("turnover") * F.col("leverage")).otherwise(0.0)
    financing = F.coalesce("rf", F.lit(0.0)) * (F.col("leverage") - 1)
    return joined.select("cv", "dt", "leverage", "gross", (F.col("leverage") * F.col("gross") - cost - financing).alias("r"))


def fold_strategies(split: DataFrame) -> DataFrame:
    """(cv, strategy, asset, w): even weights (``equal``), and weights inverse to the deviations (``ivol``) and the variances
    (``ivp``) of each fold's train returns. Assets without a deviation get none."""
    sd = split.where("split = 'train'").groupBy("cv", "asset").agg(F.stddev_samp("r").alias("sd")).where("sd > 0")
    raw = sd.select("cv", "asset", F.explode(F.create_map(F.lit("equal"), F.lit(1.0), F.lit("ivol"), 1 / F.col("sd"), F.lit("ivp"), 1 / F.col("sd") / F.col("sd"))).alias("strategy", "v"))
    return raw.select("cv", "strategy", "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("cv", "strategy"))).alias("w"))


def fold_returns(split: DataFrame, weights: DataFrame, part: str = "test") -> DataFrame:
    """(cv, strategy, dt, r) of each fold's weights on one split of its own; missing returns are skipped."""
    joined = split.where(F.col("split") == part).join(weights, ["cv", "asset"])
    return joined.groupBy("cv", "strategy", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
