"""Bootstrap tests of the best of many series, with replicates as rows that name the dates they draw."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log, log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import positive
from ..functions.stats import ratio
from ..sources.storage import dealt, materialize

STATISTICS = ("mean", "sharpe", "drawdown")


def numbered(returns: DataFrame) -> DataFrame:
    """(asset, rn, r): returns (asset, dt, r) with each asset's dates numbered from 0; missing returns have no number."""
    order = Window.partitionBy("asset").orderBy("dt")
    return returns.where("r is not null").select("asset", (F.row_number().over(order) - 1).alias("rn"), "r")


def dates_of_all(rows: DataFrame) -> int:
    """Number of dates of ``rows`` (asset, rn, r); raises unless all assets have the same ones."""
    sizes = [r[0] for r in rows.groupBy("asset").count().select("count").distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] < 3:
        raise ValueError("series need the same dates, and three of them at least")
    return sizes[0]


def autocovariances(rows: DataFrame, lags: int) -> DataFrame:
    """(asset, k, n, cov) of the returns of ``rows`` (asset, rn, r) for each lag k up to ``lags``, divided by the number n of
    returns. Products with all lags are made in one pass over a series in order and added up before they move."""
    whole, order = Window.partitionBy("asset"), Window.partitionBy("asset").orderBy("rn")
    centred = rows.select("asset", "rn", (F.col("r") - F.avg("r").over(whole)).alias("e"))
    products = centred.select("asset", *[(F.col("e") * F.lag("e", k).over(order)).alias(f"p{k}") for k in range(lags + 1)])
    sums = products.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(lags + 1)]).alias("sums"))
    return sums.select("asset", "n", F.posexplode("sums").alias("k", "sum")).select("asset", "k", "n", (F.col("sum") / F.col("n")).alias("cov"))


def block_lengths(rows: DataFrame, n: int) -> DataFrame:
    """(asset, cut, block): mean length of the blocks of a stationary bootstrap that suits each series of ``n`` returns (Politis
    and White 2004, corrected by Patton, Politis and White 2009), and the lag from which on its autocorrelations look
    like noise. Autocovariances up to twice that lag are weighed by a flat-top window. A series that does not move
    has block 1."""
    run = max(5, ceil(sqrt(log10(max(n, 2)))))
    lags, most, noise = min(n - 1, ceil(sqrt(n)) + run), ceil(min(3 * sqrt(n), n / 3)), 2 * sqrt(log10(max(n, 2)) / n)
    order = Window.partitionBy("asset").orderBy("k")
    cov = autocovariances(rows, lags)
    corr = F.abs(ratio(F.col("cov"), F.first("cov").over(order)))
    loud = cov.withColumn("loud", F.coalesce(corr >= noise, F.lit(False)) & (F.col("k") > 0))
    ahead = F.sum(F.when(F.col("loud"), 0).otherwise(1)).over(order.rowsBetween(1, run))
    first = F.min(F.when(F.col("quiet") == run, F.col("k")))
    cut = loud.withColumn("quiet", ahead).groupBy("asset").agg(F.greatest(F.coalesce(first, F.max(F.when(F.col("loud"), F.col("k"))), F.lit(1)), F.lit(1)).alias("cut"))
    reach = F.least(2 * F.col("cut"), F.lit(lags))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - F.col("k") / reach)))
    both = F.when(F.col("k") > 0, 2.0).otherwise(1.0) * weight * F.col("cov")
    sums = cov.join(cut, "asset").groupBy("asset", "cut").agg(F.sum(both).alias("level"), F.sum(both * F.col("k")).alias("slope"))
    best = F.cbrt(F.pow(ratio(F.col("slope"), F.col("level")), F.lit(2)) * n)
    return sums.select("asset", "cut", F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.coalesce(best, F.lit(1.0)))).alias("block"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of what identifies it: the same on any engine and however rows are dealt out."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def resampled_dates(spark: SparkSession, n: int, replicates: int, block: float, seed: int, places: int | None = None) -> DataFrame:
    """(replicate, t, rn): for each of ``places`` (as many as dates if None) t of each replicate the number of the date, of
    n, that is drawn there. Blocks begin anew with
    probability 1 / ``block`` at a date drawn evenly, and go on with the next date, the first one after the last."""
    m = n if places is None else places
    rows = spark.range(replicates * m).select(F.floor(F.col("id") / m).cast("int").alias("replicate"), (F.col("id") % m).cast("int").alias("t"))
    draw = lambda kind: uniform(F.lit(f"{seed}"), F.lit(kind), F.col("replicate").cast("string"), F.col("t").cast("string"))
    begins = (F.col("t") == 0) | (draw("new") < 1 / block)
    flagged = rows.withColumn("from", F.when(begins, F.struct(F.col("t").alias("t"), F.floor(draw("start") * n).cast("int").alias("rn"))))
    known = F.last("from", ignorenulls=True).over(Window.partitionBy("replicate").orderBy("t"))
    return flagged.withColumn("from", known).select("replicate", "t", ((F.col("from.rn") + F.col("t") - F.col("from.t")) % n).alias("rn"))


def statistics(rows: DataFrame, keys: list[str], statistic: str) -> DataFrame:
    """(keys, value) of rows (keys, t, r): mean, mean over deviation, or the largest fall of the compounded value below
    its peak, negative so that more is better. A total loss is a fall of 1."""
    if statistic == "mean":
        return rows.groupBy(*keys).agg(F.avg("r").alias("value"))
    if statistic == "sharpe":
        return rows.groupBy(*keys).agg(ratio(F.avg("r"), F.stddev_samp("r")).alias("value"))
    order = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    level = rows.withColumn("level", F.sum(F.log(F.greatest(1 + F.col("r"), F.lit(1e-300)))).over(order))
    fall = F.exp(F.col("level") - F.max("level").over(order)) - 1
    return level.select(*keys, fall.alias("fall")).groupBy(*keys).agg(F.min("fall").alias("value"))


def superiority(returns: DataFrame, replicates: int = 1000, block: float | None = None, seed: int = 5, statistic: str = "sharpe", benchmark: str | None = None) -> DataFrame:
    """(strategy, statistic, block, p_value, p_spa): the series of ``returns`` (asset, dt, r) that is best by a statistic of
    ``STATISTICS``, less that of the series named ``benchmark`` (less zero without one); the root of the number of dates
    times it; and the chance over stationary bootstraps of the dates that the best of series without any edge would do
    as well (White's reality check), and the same with each series in units of its own deviation over the replicates
    and without those far below (Hansen's test).

    All series must have the same dates; this is checked, as whole dates are drawn. The statistic is computed anew in
    each replicate. Without ``block`` the mean of ``block_lengths`` is taken. A series whose statistic is not known
    counts as zero. Returns stay distributed: the driver gets counts and the block.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"{statistic} is not one of {', '.join(STATISTICS)}")
    spark, rows = returns.sparkSession, materialize(numbered(returns), "numbered-returns")
    n = dates_of_all(rows)
    if block is None:
        block = block_lengths(rows, n).agg(F.avg("block")).first()[0]
    drawn = resampled_dates(spark, n, replicates, block, seed).join(rows, "rn").select("replicate", "t", "asset", "r")

    def edges(values: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, asset, f): what each series has over the benchmark."""
        value = F.coalesce("value", F.lit(0.0))
        if benchmark is None:
            return values.select(*keys, "asset", value.alias("f"))
        base = F.max(F.when(F.col("asset") == benchmark, value)).over(Window.partitionBy(*keys, F.lit(0)))
        return values.select(*keys, "asset", (value - base).alias("f")).where(F.col("asset") != benchmark)

    own = edges(statistics(rows.withColumnRenamed("rn", "t"), ["asset"], statistic), [])
    again = materialize(edges(statistics(drawn, ["replicate", "asset"], statistic), ["replicate"]), "replicates")
    root, far = sqrt(n), sqrt(2 * log(log(max(n, 3))))
    spread = again.groupBy("asset").agg((root * F.stddev_pop("f")).alias("dev"))
    centre = F.when(root * F.col("f") >= -F.col("dev") * far, F.col("f")).otherwise(0.0)
    known = materialize(own.join(spread, "asset").select("asset", "f", "dev", centre.alias("centre")), "edges")
    unit = lambda v: F.coalesce(ratio(root * v, F.col("dev")), F.lit(0.0))
    best = known.agg(F.max_by("asset", F.struct("f", "asset")).alias("strategy"), (root * F.max("f")).alias("statistic"), F.greatest(F.lit(0.0), F.max(unit(F.col("f")))).alias("studentised"))
    tops = again.withColumnRenamed("f", "g").join(known, "asset").groupBy("replicate").agg((root * F.max(F.col("g") - F.col("f"))).alias("top"), F.greatest(F.lit(0.0), F.max(unit(F.col("g") - F.col("centre")))).alias("top_spa"))
    share = lambda a, b: F.avg((F.col(a) > F.col(b)).cast("double"))
    return tops.join(F.broadcast(best)).groupBy("strategy", "statistic").agg(F.lit(float(block)).alias("block"), share("top", "statistic").alias("p_value"), share("top_spa", "studentised").alias("p_spa"))


def monte_carlo(returns: DataFrame, rules: dict[str, Callable[[np.ndarray], np.ndarray]], simulations: int = 250, places: int = 240, block: float = 10, seed: int = 1) -> DataFrame:
    """(sim, strategy, vol, sharpe, var, es, growth, sspw): weights by ``rules`` (from a covariance matrix) fitted on the first
    half of resampled returns (asset, dt, r) and held on the second. Whole dates are drawn in blocks, so that what
    moves together stays together. A simulation's first half is a group of ``places`` / 2 rows an asset; what its weights
    earn is joined and aggregated by Spark."""
    spark, rows = returns.sparkSession, materialize(numbered(returns), "numbered-returns")
    dates = resampled_dates(spark, dates_of_all(rows), simulations, block, seed, places)
    drawn = materialize(dates.join(rows, "rn").select(F.col("replicate").alias("sim"), "t", "asset", "r"), "simulations")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="t", columns="asset", values="r").sort_index()
        cov = positive(np.cov(wide.to_numpy().T))
        return pd.DataFrame({"sim": key[0], "asset": wide.columns, "ws": list(np.column_stack([rule(cov) for rule in rules.values()]))})

    half = places // 2
    first = dealt(drawn.where(F.col("t") < half), "sim")
    weights = materialize(first.groupBy("sim").applyInPandas(fit, "sim int, asset string, ws array<double>"), "simulated-weights")
    w = {name: F.element_at("ws", i + 1) for i, name in enumerate(rules)}
    by_strategy = lambda column: F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(name).alias(column)) for name in rules]))
    earned = drawn.where(F.col("t") >= half).join(weights, ["sim", "asset"]).groupBy("sim", "t").agg(*[F.sum(w[name] * F.col("r")).alias(name) for name in rules])
    held = materialize(earned.select("sim", "t", by_strategy("r").alias("s")).select("sim", "t", "s.*"), "held")
    squares = weights.groupBy("sim").agg(*[F.sum(w[name] * w[name]).alias(name) for name in rules]).select("sim", by_strategy("sspw").alias("s")).select("sim", "s.*")
    keys = ["sim", "strategy"]
    known = held.groupBy(*keys).agg(F.stddev_samp("r").alias("vol"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.05)).alias("q"), F.sum(F.log1p(F.greatest(F.col("r"), F.lit(-0.999999)))).alias("growth"))
    tail = held.join(known.select(*keys, "q"), keys).where("r <= q").groupBy(*keys).agg((-F.avg("r")).alias("es"))
    out = known.join(tail, keys).join(squares, keys)
    return out.select(F.col("sim").cast("long").alias("sim"), "strategy", "vol", ratio(F.col("mean"), F.col("vol")).alias("sharpe"), (-F.col("q")).alias("var"), "es", "growth", "sspw")
