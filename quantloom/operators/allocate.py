"""Closed-form portfolio weights: (strategy, asset, w), each strategy adding up to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(frame: DataFrame, raw: Column, strategy: str) -> DataFrame:
    """``raw`` over its sum; the sum is one small aggregate joined back, not a window over one partition."""
    scored = frame.select("asset", raw.alias("raw"))
    total = scored.agg(F.sum("raw").alias("total"))
    return scored.join(F.broadcast(total)).select(F.lit(strategy).alias("strategy"), "asset", (F.col("raw") / F.col("total")).alias("w"))


def equal(assets: DataFrame) -> DataFrame:
    return normalised(assets.select("asset").distinct(), F.lit(1.0), "equal")


def equal_class(classes: DataFrame) -> DataFrame:
    """The same weight for each class, shared evenly inside."""
    size = F.count(F.lit(1)).over(Window.partitionBy("market"))
    return normalised(classes.select("asset", (1 / size).alias("v")), F.col("v"), "equal_class")


def inverse_risk(returns: DataFrame, power: int) -> DataFrame:
    """power 1: inverse volatility; 2: inverse variance."""
    sd = returns.groupBy("asset").agg(F.stddev_samp("r").alias("sd"))
    return normalised(sd, 1 / F.pow(F.col("sd"), F.lit(float(power))), "ivol" if power == 1 else "ivp")


def parity_shortfall(returns: DataFrame, level: float = 0.05) -> DataFrame:
    """Inverse expected shortfall: the mean return below the quantile."""
    cut = returns.groupBy("asset").agg(F.percentile("r", F.lit(level)).alias("q"))
    es = returns.join(F.broadcast(cut), "asset").groupBy("asset").agg(F.avg(F.when(F.col("r") <= F.col("q"), F.col("r"))).alias("es"))
    return normalised(es, 1 / F.col("es"), "parity_cvar")


def budgeted(returns: DataFrame, budgets: DataFrame, correlation: int) -> DataFrame:
    """Risk budgets (asset, budget) met exactly if all correlations are 1 (b / sd) or 0 (sqrt(b) / sd)."""
    sd = returns.groupBy("asset").agg(F.stddev_samp("r").alias("sd")).join(F.broadcast(budgets), "asset")
    return normalised(sd, (F.col("budget") if correlation else F.sqrt("budget")) / F.col("sd"), f"rb_corr_{correlation}")


def best_factor(loadings: DataFrame, least: float = 0.01) -> DataFrame:
    """(asset, factor, loading): each asset's largest loading where that reaches ``least``; ties: lowest factor."""
    top = loadings.groupBy("asset").agg(F.max(F.struct("loading", (-F.col("factor")).alias("neg"))).alias("top"))
    return top.select("asset", (-F.col("top.neg")).alias("factor"), F.col("top.loading").alias("loading")).where(F.col("loading") >= least)


def cluster_equal(labels: DataFrame) -> DataFrame:
    """The same weight for each cluster (asset, factor), shared evenly inside."""
    size = F.count(F.lit(1)).over(Window.partitionBy("factor"))
    return normalised(labels.select("asset", (1 / size).alias("v")), F.col("v"), "cluster_equal")


def quadratic_forms(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, variance) of weights (group, asset, w): the sum of w_a w_b cov(a, b). Computed as the variance of
    the weighted return, which needs no pairs; dates on which an asset of the group is missing are left out."""
    size = weights.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    daily = returns.join(F.broadcast(weights), "asset").groupBy("group", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count(F.lit(1)).alias("n"))
    return daily.join(F.broadcast(size), "group").where("n = size").groupBy("group").agg(F.var_samp("r").alias("variance"))


def cluster_parity(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Inverse volatility inside each cluster (asset, factor), inverse cluster variance across."""
    sd = returns.groupBy("asset").agg(F.stddev_samp("r").alias("sd")).join(F.broadcast(labels.select("asset", F.col("factor").alias("group"))), "asset")
    inner = sd.select("group", "asset", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(Window.partitionBy("group"))).alias("w"))
    across = quadratic_forms(returns, inner)
    return normalised(inner.join(F.broadcast(across), "group"), F.col("w") / F.col("variance"), "cluster_parity")


def factor_budget(returns: DataFrame, loadings: DataFrame, least: float = 0.01) -> DataFrame:
    """Assets go to the factor of their largest loading with a square of ``least`` or more; inside a factor the
    squared loadings are the risk budgets, across factors the weight is inverse to the factor's volatility."""
    strong = best_factor(loadings.where(F.col("loading") * F.col("loading") >= least))
    square = F.col("loading") * F.col("loading")
    sd = returns.groupBy("asset").agg(F.stddev_pop("r").alias("sd")).join(F.broadcast(strong), "asset")
    raw = sd.select("asset", F.col("factor").alias("group"), (square / F.sum(square).over(Window.partitionBy("factor")) / F.col("sd")).alias("v"))
    inner = raw.select("asset", "group", (F.col("v") / F.sum("v").over(Window.partitionBy("group"))).alias("w"))
    across = quadratic_forms(returns, inner)
    return normalised(inner.join(F.broadcast(across), "group"), F.col("w") / F.sqrt("variance"), "factor_budget")


def concentration(weights: DataFrame) -> DataFrame:
    """(strategy, hhi, bets): normalised Herfindahl index and exponential entropy of the weights."""
    d, square = F.count(F.lit(1)), F.sum(F.col("w") * F.col("w"))
    entropy = F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0))
    return weights.groupBy("strategy").agg(((d * square - 1) / (d - 1)).alias("hhi"), F.exp(entropy).alias("bets"))
