"""Tail-event hedging: thresholds on event probabilities, signals, hedged returns, and excess statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_grid(probs: DataFrame, points: int = 50, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """(factor, t): evenly spaced from 0 to just above the factor's largest probability."""
    top = probs.groupBy(*keys).agg((F.max("p") + 1e-6).alias("top"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.round(F.col("top") * i / (points - 1), 9))
    return top.select(*keys, F.explode_outer(steps).alias("t"))


def calibrated(probs: DataFrame, points: int = 50, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """(keys, t, err): the threshold whose exceedance rate is nearest the event rate; ties: the smallest. The
    event rate is over all rows, the exceedance rate over those with a probability."""
    joined = probs.join(threshold_grid(probs, points, keys), list(keys))
    rate = F.avg(F.col("y").cast("double"))
    above = F.avg(F.when(F.col("p").isNotNull(), (F.col("p") >= F.col("t")).cast("double")))
    errors = joined.groupBy(*keys, "t").agg(F.round(F.abs(rate - above), 9).alias("err"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("err", "t"))
    return errors.withColumn("k", best).where("k = 1").select(*keys, "t", "err")


def fold_signals(rows: DataFrame) -> DataFrame:
    """(cv, factor, dt, r, p, signal) of each fold's test rows, by the threshold calibrated on its train rows
    alone (rows: cv, split, factor, dt, r, p, y)."""
    thresholds = calibrated(rows.where("split = 'train'"), keys=("cv", "factor"))
    joined = rows.where("split = 'test'").join(thresholds.select("cv", "factor", "t"), ["cv", "factor"])
    return joined.select("cv", "factor", "dt", "r", "p", F.coalesce(F.col("p") < F.col("t"), F.lit(False)).cast("int").alias("signal"))


def shuffled_signals(signals: DataFrame, runs: int, seed: int = 1) -> DataFrame:
    """(run, factor, on, hedged): signals (factor, dt, r, signal) dealt to other dates of their factor at random,
    ``runs`` times: how many stay on, and the return they give. Randomness is a hash of run and date."""
    again = signals.select("factor", "dt", "r", "signal", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    by_date = Window.partitionBy("run", "factor").orderBy("dt")
    by_chance = Window.partitionBy("run", "factor").orderBy(F.xxhash64(F.lit(seed), "run", "factor", "dt"), "dt")
    placed = again.select("run", "factor", "r", "signal", F.row_number().over(by_date).alias("at"), F.row_number().over(by_chance).alias("to"))
    moved = placed.select("run", "factor", F.col("to").alias("at"), F.col("signal").alias("moved"))
    joined = placed.select("run", "factor", "at", "r").join(moved, ["run", "factor", "at"])
    return joined.groupBy("run", "factor").agg(F.sum("moved").alias("on"), F.sum(F.col("moved") * F.col("r")).alias("hedged"))


def excess_gain(probs: DataFrame, points: int = 50) -> DataFrame:
    """(factor, t, gain): the threshold that adds most return by standing aside; ties: the largest. A missing
    probability counts as hedged."""
    joined = probs.join(F.broadcast(threshold_grid(probs, points)), "factor")
    stay = F.coalesce(F.col("p") < F.col("t"), F.lit(False)).cast("double")
    gains = joined.groupBy("factor", "t").agg(F.round(F.sum((stay - 1) * F.col("r")), 9).alias("gain"))
    best = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("gain"), F.desc("t")))
    return gains.withColumn("k", best).where("k = 1").select("factor", "t", "gain")


def roc(probs: DataFrame) -> DataFrame:
    """(factor, p, tpr, fpr) at each distinct probability, from the highest down: running counts of a small
    table with one row for each factor and probability."""
    counts = probs.where("p is not null").groupBy("factor", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    down, whole = Window.partitionBy("factor").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("factor")
    return counts.select("factor", "p", (F.sum("pos").over(down) / F.sum("pos").over(whole)).alias("tpr"), (F.sum("neg").over(down) / F.sum("neg").over(whole)).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """(factor, auc) by trapezoids, from the origin."""
    order = Window.partitionBy("factor").orderBy(F.desc("p"))
    width = F.col("fpr") - F.lag("fpr", 1, 0.0).over(order)
    height = (F.col("tpr") + F.lag("tpr", 1, 0.0).over(order)) / 2
    return curve.select("factor", (width * height).alias("area")).groupBy("factor").agg(F.sum("area").alias("auc"))


def roc_threshold(curve: DataFrame) -> DataFrame:
    """(factor, t, d): the probability nearest the perfect corner; ties: the largest."""
    d = curve.withColumn("d", F.round(F.col("fpr") * F.col("fpr") + (F.col("tpr") - 1) * (F.col("tpr") - 1), 9))
    best = F.row_number().over(Window.partitionBy("factor").orderBy("d", F.desc("p")))
    return d.withColumn("k", best).where("k = 1").select("factor", F.col("p").alias("t"), "d")


def signals(probs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(factor, dt, signal): 1 to stay invested, 0 to hedge; without a probability 0."""
    joined = probs.join(F.broadcast(thresholds.select("factor", "t")), "factor")
    return joined.select("factor", "dt", F.coalesce(F.col("p") < F.col("t"), F.lit(False)).cast("int").alias("signal"))


def hedged_returns(returns: DataFrame, weights: DataFrame, groups: DataFrame, signal: DataFrame) -> DataFrame:
    """(dt, unhedged, hedged): the portfolio with and without the signals of its assets' factors; assets with no
    factor weigh nothing when hedged."""
    joined = returns.join(F.broadcast(weights), "asset").join(F.broadcast(groups), "asset", "left").join(signal, ["factor", "dt"], "left")
    on = F.when(F.col("factor").isNull(), 0).otherwise(F.coalesce("signal", F.lit(0)))
    return joined.groupBy("dt").agg(F.sum(F.col("w") * F.col("r")).alias("unhedged"), F.sum(F.col("w") * on * F.col("r")).alias("hedged"))


def mean_excess(losses: DataFrame, points: int = 100, low: float = 0.9, high: float = 0.999) -> DataFrame:
    """(key, k, u, excess, share): mean of x - u at or above u, and the share there, on a grid of thresholds between
    two quantiles."""
    ends = losses.groupBy("key").agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("q"))
    grid = ends.select("key", "q", F.explode_outer(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    grid = grid.select("key", "k", F.round(F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * F.col("k") / (points - 1), 9).alias("u"))
    joined = losses.join(F.broadcast(grid), "key")
    over = F.col("x") >= F.col("u")
    return joined.groupBy("key", "k", "u").agg(F.avg(F.when(over, F.col("x") - F.col("u"))).alias("excess"), F.avg(over.cast("double")).alias("share"))


def best_thresholds(rows: DataFrame, keys: tuple[str, ...] = ("cv", "factor"), points: int = 50) -> DataFrame:
    """(method, keys, t): the threshold of each of four methods for rows (keys, r, weighted, p, y): ``weighted`` and ``equal`` add
    most to the cumulative return, of the weighted or the mean return ``r`` of a factor's assets, by standing aside where
    p is not below the threshold (ties: the largest); ``calibrated`` has the exceedance rate nearest the event rate (ties:
    the smallest); ``roc`` is the probability nearest the perfect corner of the ROC curve (ties: the largest). Rows
    without a probability are hedged, and have no part in the curve."""
    by = list(keys)
    joined = rows.join(threshold_grid(rows, points, keys), by)
    stay = F.coalesce(F.col("p") < F.col("t"), F.lit(False)).cast("double")
    gain = lambda c: F.round(F.sum((stay - 1) * F.col(c)), 9)
    gains = joined.groupBy(*by, "t").agg(gain("weighted").alias("weighted"), gain("r").alias("equal"))
    best = lambda c: F.max_by("t", F.struct(c, "t")).alias(c)
    excess = gains.groupBy(*by).agg(best("weighted"), best("equal")).select(*by, F.explode(F.create_map(F.lit("weighted"), F.col("weighted"), F.lit("equal"), F.col("equal"))).alias("method", "t"))
    fixed = calibrated(rows, points, keys).select(*by, F.lit("calibrated").alias("method"), "t")
    counts = rows.where("p is not null").groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    share = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(whole), F.lit(0))
    curve = counts.select(*by, "p", share("pos").alias("tpr"), share("neg").alias("fpr"))
    d = F.round(F.col("fpr") * F.col("fpr") + (F.col("tpr") - 1) * (F.col("tpr") - 1), 9)
    corner = curve.groupBy(*by).agg(F.min_by("p", F.when(d.isNotNull(), F.struct(d, -F.col("p")))).alias("t")).select(*by, F.lit("roc").alias("method"), "t")
    return excess.unionByName(fixed).unionByName(corner)
