"""Risk budgets on scenarios, corner portfolios, diversified and tracking portfolios, a fold and strategy at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.budgets import scenario_budget
from ..functions.critical_line import critical_line, largest_sharpe
from ..functions.programs import diversified_weights, nonnegative_ridge
from ..functions.stats import ratio
from ..sources.storage import dealt
from .grouped import square

MEASURES = ("vol", "es", "cdar")


def _budget(r: np.ndarray, budget: np.ndarray | None, measure: str, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, shares of the risk) for returns, a column an asset. Assets that are short of losses raise."""
    if r.shape[1] == 1:
        return np.ones(1), np.ones(1)
    if measure == "vol":
        cov = K.positive(np.cov(r.T))
        w = K.risk_budget(cov, budget)
        return w, K.risk_shares(cov, w)
    return scenario_budget(r, budget, alpha, measure == "cdar")


def _factor_budget(r: np.ndarray, factor: np.ndarray, loading: np.ndarray, measure: str, alpha: float) -> np.ndarray:
    """Weights of the assets: budgets of squared loadings inside each factor, and even ones over the factors'
    portfolios, all by one measure. Assets without a factor get none."""
    names = [f for f in np.unique(factor) if f >= 0]
    inner = np.zeros((r.shape[1], len(names)))
    for j, f in enumerate(names):
        mine = np.flatnonzero(factor == f)
        inner[mine, j] = _budget(r[:, mine], loading[mine] ** 2, measure, alpha)[0]
    return inner @ _budget(r @ inner, None, measure, alpha)[0]


def scenario_weights(split: DataFrame, labels: DataFrame, window: int = 250, alpha: float = 0.05) -> DataFrame:
    """(cv, strategy, asset, w, share): weights with even shares of expected shortfall (``erc_es``) and of conditional
    drawdown (``erc_cdar``), and by factor for all three measures (``factor_full_vol``, ``_es``, ``_cdar``), with each
    asset's share of the risk (null by factor, where shares are met inside factors and across them).

    ``split`` (cv, split, asset, dt, r) is used with the last ``window`` train dates of each fold; ``labels`` (asset, factor,
    loading) has each asset's factor. Dates on which an asset of the fold is missing are left out. Each fold and
    strategy is a group of ``window`` rows an asset at most. A fold in which some portfolio has no loss in the worst
    share ``alpha`` has null weights for that strategy: budgets have no answer there."""
    train = split.where("split = 'train'").select("cv", "asset", "dt", "r")
    turn = F.dense_rank().over(Window.partitionBy("cv").orderBy(F.desc("dt")))
    dates = train.select("cv", "dt").distinct().withColumn("turn", turn).where(F.col("turn") <= window).drop("turn")
    strategies = F.explode(F.array(*[F.lit(s) for s in ("erc_es", "erc_cdar", *[f"factor_full_{m}" for m in MEASURES])]))
    rows = train.join(dates, ["cv", "dt"]).join(labels.select("asset", "factor", "loading"), "asset", "left").withColumn("strategy", strategies)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="dt", columns="asset", values="r").sort_index().dropna()
        known = rows.drop_duplicates("asset").set_index("asset").loc[wide.columns]
        measure, share = key[1].rpartition("_")[2], np.full(wide.shape[1], np.nan)
        try:
            if key[1].startswith("factor"):
                w = _factor_budget(wide.to_numpy(), known["factor"].fillna(-1).to_numpy(int), known["loading"].to_numpy(float), measure, alpha)
            else:
                w, share = _budget(wide.to_numpy(), None, measure, alpha)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            w = np.full(wide.shape[1], np.nan)
        out = pd.DataFrame({"cv": key[0], "strategy": key[1], "asset": wide.columns, "w": w, "share": share})
        return out.astype({"w": "Float64", "share": "Float64"})

    return dealt(rows, "cv", "strategy").groupBy("cv", "strategy").applyInPandas(solve, "cv int, strategy string, asset string, w double, share double")


def corner_portfolios(covariances: DataFrame, means: DataFrame, high: float = 1.0) -> DataFrame:
    """(cv, corner, slope, asset, w): the corners of each fold's frontier between 0 and ``high``, from the largest mean
    (corner 0, slope null) to the least variance (slope 0), and as corner -1 the portfolio with the largest Sharpe
    ratio, whose ratio stands as slope. ``covariances`` (cv, a, b, cov) and ``means`` (cv, asset, m) as elsewhere."""
    both = covariances.join(means.select("cv", F.col("asset").alias("a"), "m"), ["cv", "a"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        mean, cov = rows.drop_duplicates("a").set_index("a")["m"].loc[names].to_numpy(), K.positive(cov)
        slopes, corners = critical_line(mean, cov, 0.0, max(high, 1 / len(names)))
        best, ratio = largest_sharpe(mean, cov, corners)
        weights, slopes = np.vstack([best, corners]), [ratio, None, *slopes[1:]]
        n = len(names)
        out = pd.DataFrame({"cv": rows["cv"].iat[0], "corner": np.repeat(np.arange(-1, len(corners)), n), "slope": np.repeat(np.array(slopes, float), n), "asset": names * len(weights), "w": weights.ravel()})
        return out.astype({"slope": "Float64"})

    return both.groupBy("cv").applyInPandas(solve, "cv int, corner int, slope double, asset string, w double")


def diversified(covariances: DataFrame, loadings: DataFrame) -> DataFrame:
    """(cv, strategy, asset, w, bets): long-only weights of each fold with the most even risk, by entropy, over principal
    portfolios (``drp``) and over the factors of ``loadings`` (asset, factor, loading) and what lies outside them
    (``drp_factor``), with the number of bets they make."""
    factors = loadings.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("factor", "loading"))).alias("ls"))
    both = covariances.join(factors.select(F.col("asset").alias("a"), F.col("ls.loading").alias("ls")), "a")
    rows = both.withColumn("strategy", F.explode(F.array(F.lit("drp"), F.lit("drp_factor"))))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        own = np.stack(rows.drop_duplicates("a").set_index("a")["ls"].loc[names].to_numpy())
        w, bets = diversified_weights(K.positive(cov), own if key[1] == "drp_factor" else None)
        return pd.DataFrame({"cv": key[0], "strategy": key[1], "asset": names, "w": w, "bets": bets})

    return dealt(rows, "cv", "strategy").groupBy("cv", "strategy").applyInPandas(solve, "cv int, strategy string, asset string, w double, bets double")


def tracking(split: DataFrame, target: DataFrame, penalty: float = 0.05, high: float | None = None) -> DataFrame:
    """(cv, asset, coef): non-negative ridge coefficients, up to ``high``, that make the returns of a ``target`` (dt, y) out of
    those of the assets in the train split of ``split`` (cv, split, asset, dt, r), both less their means. The fit gets
    sums of products of pairs only; dates without a target are left out, and pairs are taken over the dates they share."""
    train = split.where("split = 'train'").join(target, "dt").select("cv", "dt", "asset", "r", "y")
    x, y = (train.select("cv", "dt", F.col("asset").alias(n), F.col("r").alias(v)) for n, v in (("a", "x"), ("b", "z")))
    pairs = x.join(y, ["cv", "dt"]).where("a <= b").groupBy("cv", "a", "b").agg((F.covar_pop("x", "z") * F.count(F.lit(1))).alias("cov"))
    products = train.groupBy("cv", F.col("asset").alias("a")).agg((F.covar_pop("r", "y") * F.count(F.lit(1))).alias("with_target"))
    gram = pairs.unionByName(pairs.where("a < b").select("cv", F.col("b").alias("a"), F.col("a").alias("b"), "cov")).join(products, ["cv", "a"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = square(rows)
        c = rows.drop_duplicates("a").set_index("a")["with_target"].loc[names].to_numpy(float)
        coef = nonnegative_ridge(np.nan_to_num(m), c, penalty, 0.0, np.inf if high is None else high)
        return pd.DataFrame({"cv": rows["cv"].iat[0], "asset": names, "coef": coef})

    return gram.groupBy("cv").applyInPandas(solve, "cv int, asset string, coef double")


def tracking_quality(split: DataFrame, target: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(cv, split, n, r2): share of the target's variance that the tracking portfolio's returns explain in each split, with
    the best constant added; dates on which an asset of the fold is missing are left out."""
    size = coefficients.groupBy("cv").agg(F.count(F.lit(1)).alias("size"))
    held = split.join(coefficients, ["cv", "asset"]).groupBy("cv", "split", "dt").agg(F.sum(F.col("coef") * F.col("r")).alias("fit"), F.count(F.lit(1)).alias("m"))
    both = held.join(size, "cv").where("m = size").join(target, "dt")
    left = F.var_pop(F.col("y") - F.col("fit"))
    return both.groupBy("cv", "split").agg(F.count(F.lit(1)).alias("n"), (1 - ratio(left, F.var_pop("y"))).alias("r2"))
