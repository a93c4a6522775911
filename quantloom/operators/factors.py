"""Factor scores, reconstruction and fit of a loading table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(returns: DataFrame, loadings: DataFrame) -> DataFrame:
    """(dt, factor, score): sum of return times loading."""
    return returns.join(F.broadcast(loadings), "asset").groupBy("dt", "factor").agg(F.sum(F.col("r") * F.col("loading")).alias("score"))


def reconstruction(factor_scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """(dt, asset, fit): scores projected back on the assets."""
    return factor_scores.join(F.broadcast(loadings), "factor").groupBy("dt", "asset").agg(F.sum(F.col("score") * F.col("loading")).alias("fit"))


def fit_quality(returns: DataFrame, fitted: DataFrame) -> DataFrame:
    """(asset, r2, rmse): uncentred R squared and root mean squared error."""
    e = F.col("r") - F.col("fit")
    joined = returns.join(fitted, ["dt", "asset"])
    return joined.groupBy("asset").agg((1 - F.sum(e * e) / F.sum(F.col("r") * F.col("r"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))
