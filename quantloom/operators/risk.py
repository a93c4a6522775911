"""Risk and performance statistics of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95, normal_cdf, normal_quantile, ratio
from .returns import drawdowns


def moments(returns: DataFrame, key: str = "asset") -> DataFrame:
    """(key, n, mean, sd, sd_pop, skew, kurt): kurt is raw; one pass of built-in aggregates."""
    r = F.col("r")
    return returns.groupBy(key).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_pop(r).alias("sd_pop"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))


def tail(returns: DataFrame, level: float = 0.05, key: str = "asset") -> DataFrame:
    """(key, hist_var, hist_es): loss at the exact quantile, and mean loss at or below it."""
    cut = returns.groupBy(key).agg(F.percentile("r", F.lit(level)).alias("q"))
    joined = returns.join(F.broadcast(cut), key)
    return joined.groupBy(key).agg((-F.max("q")).alias("hist_var"), (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("hist_es"))


def worst_drawdown(returns: DataFrame, key: str = "asset") -> DataFrame:
    """(key, mdd, calmar): calmar compares the growth after the first row with the worst drawdown."""
    ends = drawdowns(returns, key).groupBy(key).agg(F.abs(F.min("drawdown")).alias("mdd"), F.max_by("value", "dt").alias("last"), F.min_by("value", "dt").alias("first"))
    return ends.select(key, "mdd", ratio(F.col("last") / F.col("first") - 1, F.col("mdd")).alias("calmar"))


def performance(returns: DataFrame, rates: DataFrame, period: int = 12, gamma: float = 1.0, key: str = "asset") -> DataFrame:
    """One row a series: return, volatility, Sharpe and adjusted Sharpe ratio, certainty equivalent, tail
    losses, drawdown, Calmar ratio, skewness and excess kurtosis."""
    m = moments(returns, key)
    net = returns.join(F.broadcast(rates), "dt", "left").groupBy(key).agg(F.avg(F.col("r") - F.coalesce("rf", F.lit(0.0))).alias("net"))
    joined = m.join(net, key).join(tail(returns, key=key), key).join(worst_drawdown(returns, key), key)
    sr = ratio(F.col("mean"), F.col("sd")) * float(period) ** 0.5
    adjusted = sr * (1 + F.col("skew") / 6 * sr - (F.col("kurt") - 3) / 24 * sr * sr)
    return joined.select(key, "n", (F.col("mean") * period).alias("annual_return"), (F.col("sd") * float(period) ** 0.5).alias("annual_vol"), sr.alias("sharpe"), adjusted.alias("adjusted_sharpe"), (F.col("net") * period - gamma / 2 * F.col("sd") * F.col("sd") * period).alias("ceq"), "hist_var", "hist_es", "mdd", "calmar", "skew", (F.col("kurt") - 3).alias("excess_kurtosis"))


def pair_statistics(returns: DataFrame) -> DataFrame:
    """(a, b, cov, corr, distance) for a <= b over common dates; distance is sqrt((1 - corr) / 2)."""
    x, y = returns.select("dt", F.col("asset").alias("a"), F.col("r").alias("ra")), returns.select("dt", F.col("asset").alias("b"), F.col("r").alias("rb"))
    pairs = x.join(y, "dt").where("a <= b").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.corr("ra", "rb").alias("corr"))
    return pairs.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("corr")) / 2)))


def rank_statistics(returns: DataFrame) -> DataFrame:
    """The same as ``pair_statistics`` for each asset's ranks of its returns: Spearman's correlation where both
    have the same dates."""
    rank = F.rank().over(Window.partitionBy("asset").orderBy("r"))
    return pair_statistics(returns.select("asset", "dt", rank.cast("double").alias("r")))


def codependence(returns: DataFrame, threshold: float = 0.5, percent: int = 5) -> DataFrame:
    """(a, b, gerber, gerber_any, tail) for a <= b over common dates.

    A move counts if it is at least ``threshold`` sample deviations of its asset, up or down. ``gerber`` is the number of dates
    on which both move the same way less those on which they move apart, over the number on which both move;
    ``gerber_any`` is over those on which either moves. ``tail`` is the number of dates on which both are among their lowest
    ``percent`` per cent of returns (rounded up, ties at the edge all in), over the smaller of the two numbers of such
    places. Null where there is nothing to divide by; null returns are left out."""
    own, low = Window.partitionBy("asset"), Window.partitionBy("asset").orderBy("r")
    edge = threshold * F.stddev_samp("r").over(own)
    places = F.floor((F.count("r").over(own) * percent + 99) / 100)
    known = returns.where("r is not null").select("asset", "dt", "r", edge.alias("edge"), places.alias("places"), F.rank().over(low).alias("rank"))
    move = F.when(F.col("r") >= F.col("edge"), 1).when(F.col("r") <= -F.col("edge"), -1).otherwise(0)
    marked = known.select("asset", "dt", move.alias("move"), (F.col("rank") <= F.col("places")).alias("low"), "places")
    x, y = (marked.select("dt", F.col("asset").alias(n), *[F.col(c).alias(c + n) for c in ("move", "low", "places")]) for n in ("a", "b"))
    product = F.col("movea") * F.col("moveb")
    pairs = x.join(y, "dt").where("a <= b").groupBy("a", "b")
    sums = pairs.agg(F.sum(product).alias("net"), F.sum(F.abs(product)).alias("both"), F.count_if((F.col("movea") != 0) | (F.col("moveb") != 0)).alias("any"), F.count_if(F.col("lowa") & F.col("lowb")).alias("low"), F.min(F.least("placesa", "placesb")).alias("places"))
    return sums.select("a", "b", ratio(F.col("net"), F.col("both")).alias("gerber"), ratio(F.col("net"), F.col("any")).alias("gerber_any"), ratio(F.col("low"), F.col("places")).alias("tail"))


def sharpe_inference(returns: DataFrame, benchmark: float = 0.0, key: str = "asset") -> DataFrame:
    """(key, sr, sr_sd, psr, min_trl): standard error of the Sharpe ratio under skew and fat tails, probability
    that it exceeds ``benchmark``, and the length of track record that would show it at 95 %."""
    sr = F.col("sr")
    spread = 1 + 0.5 * sr * sr - F.col("skew") * sr + (F.col("kurt") - 3) / 4 * sr * sr
    m = moments(returns, key).withColumn("sr", ratio(F.col("mean"), F.col("sd"))).withColumn("spread", spread)
    m = m.withColumn("sr_sd", F.sqrt(F.col("spread") / (F.col("n") - 1)))
    gap = sr - benchmark
    return m.select(key, "sr", "sr_sd", normal_cdf(ratio(gap, F.col("sr_sd"))).alias("psr"), (1 + F.col("spread") * F.pow(ratio(F.lit(Z95), gap), F.lit(2.0))).alias("min_trl"))


def volatility_timing(returns: DataFrame, short: int = 22, long: int = 60, key: str = "asset") -> DataFrame:
    """(key, cov): covariance of the return over the day-before volatility with that volatility, where the
    volatility is the larger of two rolling ones."""
    order = Window.partitionBy(key).orderBy("dt")
    rolling = lambda n: F.when(F.count("r").over(order.rowsBetween(1 - n, 0)) == n, F.stddev_samp("r").over(order.rowsBetween(1 - n, 0)))
    vol = F.greatest(F.coalesce(rolling(short), F.lit(0.0)), F.coalesce(rolling(long), F.lit(0.0)))
    rows = returns.withColumn("vol", vol).where("vol > 0").withColumn("before", F.lag("vol").over(order)).where("before is not null")
    return rows.groupBy(key).agg(F.covar_samp(F.col("r") / F.col("before"), F.col("before")).alias("cov"))


def deflated_sharpe(returns: DataFrame, key: str = "asset") -> DataFrame:
    """(key, sr, trials, expected_max, dsr): probability that a Sharpe ratio exceeds the largest one to expect by
    chance from as many trials, the trials counted as independent by their mean correlation."""
    euler = 0.5772156649015329
    m = moments(returns, key).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    corr = pair_statistics(returns.withColumnRenamed(key, "asset")).where("a < b").agg(F.avg("corr").alias("rho"))
    spread = m.agg(F.count(F.lit(1)).alias("series"), F.avg("sr").alias("sr_mean"), F.stddev_samp("sr").alias("sr_dev"))
    trials = F.greatest(F.lit(2.0), F.col("rho") + (1 - F.col("rho")) * F.col("series"))
    t = spread.join(F.broadcast(corr)).withColumn("trials", trials)
    best = F.col("sr_mean") + F.col("sr_dev") * ((1 - euler) * normal_quantile(1 - 1 / F.col("trials")) + euler * normal_quantile(1 - 1 / (F.col("trials") * F.lit(2.718281828459045))))
    t = t.select("trials", best.alias("expected_max"))
    sr = F.col("sr")
    joined = m.join(F.broadcast(t)).withColumn("dev", F.sqrt((1 + 0.5 * sr * sr - F.col("skew") * sr + (F.col("kurt") - 3) / 4 * sr * sr) / (F.col("n") - 1)))
    return joined.select(key, "sr", "trials", "expected_max", normal_cdf(ratio(sr - F.col("expected_max"), F.col("dev"))).alias("dsr"))
