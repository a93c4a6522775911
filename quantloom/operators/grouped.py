"""Grouped numeric operators: one group of a fold, class or replicate goes to a kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.storage import dealt


def fold_covariances(split: DataFrame) -> DataFrame:
    """(cv, a, b, cov) of each fold's train returns, both ways round."""
    return both_ways(split, F.covar_samp("x", "y"))


def both_ways(split: DataFrame, statistic: Column) -> DataFrame:
    """(cv, a, b, cov) of the train returns x and y of each pair of assets. Pairs are made and aggregated with
    a <= b only, and turned round as the small table they then are."""
    train = split.where("split = 'train'")
    x, y = train.select("cv", "dt", F.col("asset").alias("a"), F.col("r").alias("x")), train.select("cv", "dt", F.col("asset").alias("b"), F.col("r").alias("y"))
    half = x.join(y, ["cv", "dt"]).where("a <= b").groupBy("cv", "a", "b").agg(statistic.alias("cov"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select("cv", "cov", F.explode(ways).alias("p")).select("cv", "p.a", "p.b", "cov")


def square(rows: pd.DataFrame) -> tuple[list, np.ndarray]:
    """Names and the symmetric matrix of a pair table."""
    wide = rows.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
    m = wide.to_numpy(float)
    return list(wide.index), (m + m.T) / 2


def covariance_weights(covariances: DataFrame) -> DataFrame:
    """(cv, strategy, asset, w, risk): hierarchical parity, hierarchical equal risk, equal risk contribution and
    long-only minimum variance for each fold, with each asset's share of the variance."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        cov, out = K.positive(cov), []
        for name, f in (("hrp", K.hierarchical_parity), ("herc", K.hierarchical_equal_risk), ("erc", K.risk_budget), ("min_variance", K.long_only_minimum_variance)):
            w = f(cov)
            out.append(pd.DataFrame({"cv": rows["cv"].iat[0], "strategy": name, "asset": names, "w": w, "risk": K.risk_shares(cov, w)}))
        return pd.concat(out)

    return covariances.groupBy("cv").applyInPandas(solve, "cv int, strategy string, asset string, w double, risk double")


def torsion_bets(covariances: DataFrame, shrink: float = 0.1) -> DataFrame:
    """(cv, bets): effective number of minimum-torsion bets of the equal-weight portfolio. The covariance is
    drawn by ``shrink`` to the mean variance, as a fold may have fewer dates than assets."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        w = np.full(len(names), 1 / len(names))
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / len(cov) * np.eye(len(cov))
        return pd.DataFrame({"cv": [rows["cv"].iat[0]], "bets": [K.effective_bets(cov, w, K.minimum_torsion(cov))]})

    return covariances.groupBy("cv").applyInPandas(solve, "cv int, bets double")


def fold_factors(split: DataFrame, k: int = 4, convex: bool = True, seed: int = 3) -> DataFrame:
    """(cv, asset, factor, loading, loss): nonnegative factor loadings of each fold, from the Gram matrix of its
    train returns; the matrix is a native aggregate, so no group grows with the number of dates."""
    gram = both_ways(split, F.sum(F.col("x") * F.col("y")))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = square(rows)
        labels = K.nearest_groups(m / np.sqrt(np.outer(np.diag(m), np.diag(m))), k, seed)
        if convex:
            _, g, losses = K.convex_factors(m, labels, k)
        else:
            g, losses = K.semi_factors(m, labels, k)
        g = g / np.maximum(np.linalg.norm(g, axis=0), 1e-300)
        return pd.DataFrame({"cv": rows["cv"].iat[0], "asset": np.repeat(names, k), "factor": np.tile(np.arange(k), len(names)), "loading": g.ravel(), "loss": losses[-1]})

    return gram.groupBy("cv").applyInPandas(solve, "cv int, asset string, factor int, loading double, loss double")


def spline_filled(panel: DataFrame) -> DataFrame:
    """(asset, dt, price) with gaps between known prices filled by a quadratic spline over time."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        x = pd.to_datetime(rows["dt"]).to_numpy("datetime64[D]").astype(float)
        y = rows["price"].to_numpy(float)
        known = ~np.isnan(y)
        fitted = K.quadratic_spline(x[known], y[known], x)
        return rows.assign(price=np.where(known, y, fitted))

    return panel.groupBy("asset").applyInPandas(fill, "asset string, dt date, price double")


def rolling_probabilities(returns: DataFrame, key: str = "factor", window: int = 36, least: int = 24) -> DataFrame:
    """(key, dt, p): probability of a loss on the date after each, by a volatility model chosen and fitted anew on
    each date from the last ``window`` returns up to it; null where there are fewer than ``least``. Each date is
    a row with its own returns, so fits are spread over tasks and none sees a later return."""
    back = Window.partitionBy(key).orderBy("dt").rowsBetween(1 - window, 0)
    rows = dealt(returns.select(key, "dt", F.collect_list("r").over(back).alias("past")), key, "dt")

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = [K.next_loss_probability(np.asarray(x, float)) if len(x) >= least else None for x in part["past"]]
            yield pd.DataFrame({key: part[key], "dt": part["dt"], "p": pd.array(p, dtype="Float64")})

    return rows.mapInPandas(fit, f"{key} string, dt date, p double")


def tail_fit(losses: DataFrame, level: float = 0.9, points: int = 65, rounds: int = 6) -> DataFrame:
    """(key, u, n, shape, scale): generalised Pareto law of the excesses over the quantile ``level``, by maximum
    likelihood. For a given ratio of shape to scale the best shape is the mean of log(1 + ratio * x), so the
    likelihood has one unknown; it is searched on a grid that is drawn closer ``rounds`` times. Each round is one
    aggregate over all excesses, and no task gathers those of a key."""
    cut = losses.groupBy("key").agg(F.percentile("x", F.lit(level)).alias("u"))
    over = losses.join(F.broadcast(cut), "key").where("x > u").select("key", "u", (F.col("x") - F.col("u")).alias("e")).persist()
    sums = over.groupBy("key").agg(F.first("u").alias("u"), F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.max("e").alias("top"))
    found = [r.asDict() | {"low": -(1 - 1e-6) / r["top"], "high": 20 / r["mean"]} for r in sums.collect()]
    for _ in range(rounds if found else 0):
        grid = over.sparkSession.createDataFrame([(r["key"], np.linspace(r["low"], r["high"], points).tolist()) for r in found], "key string, at array<double>")
        means = [F.avg(F.log1p(F.element_at("at", i + 1) * F.col("e"))) for i in range(points)]
        rows = {r["key"]: (r["at"], r["means"]) for r in over.join(F.broadcast(grid), "key").groupBy("key").agg(F.first("at").alias("at"), F.array(*means).alias("means")).collect()}
        for r in found:
            at, mean = (np.array(x) for x in rows[r["key"]])
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.where(np.abs(at) * r["mean"] < 1e-9, -np.log(r["mean"]) - 1, -np.log(mean / at) - mean - 1)
            i = int(np.nanargmax(np.where(mean > -1, fit, -np.inf)))  # below -1 the likelihood has no maximum
            r |= {"shape": float(mean[i]), "scale": float(mean[i] / at[i]) if abs(at[i]) * r["mean"] >= 1e-9 else r["mean"]}
            r |= {"low": float(at[max(0, i - 1)]), "high": float(at[min(points - 1, i + 1)])}
    over.unpersist()
    return over.sparkSession.createDataFrame([(r["key"], r["u"], r["n"], r["shape"], r["scale"]) for r in found], "key string, u double, n long, shape double, scale double")


def tail_moments(losses: DataFrame, level: float = 0.9) -> DataFrame:
    """(key, u, shape, scale): the same law from the mean and variance of the excesses; null where they do not vary."""
    cut = losses.groupBy("key").agg(F.percentile("x", F.lit(level)).alias("u"))
    excess = F.col("x") - F.col("u")
    known = losses.join(cut, "key").where("x > u").groupBy("key", "u").agg(F.avg(excess).alias("m"), F.var_samp(excess).alias("v"))
    share = F.col("m") * F.col("m") / F.nullif("v", F.lit(0.0))
    return known.select("key", "u", (0.5 * (1 - share)).alias("shape"), (0.5 * F.col("m") * (1 + share)).alias("scale"))


#: Weights from a covariance matrix, by name.
RULES = {
    "hrp": K.hierarchical_parity,
    "herc": K.hierarchical_equal_risk,
    "erc": K.risk_budget,
    "min_variance": K.long_only_minimum_variance,
    "equal": lambda cov: np.full(len(cov), 1 / len(cov)),
}


def permuted_blocks(returns: DataFrame, length: int = 6, seed: int = 42) -> DataFrame:
    """(asset, dt, r) with each asset's returns moved in whole blocks to other dates, by a keyed hash of the
    block; the dates stay."""
    order = Window.partitionBy("asset").orderBy("dt")
    numbered = returns.withColumn("rn", F.row_number().over(order)).withColumn("block", F.floor((F.col("rn") - 1) / length))
    moved = numbered.withColumn("to", F.row_number().over(Window.partitionBy("asset").orderBy(F.xxhash64(F.lit(seed), "block"), "rn")))
    dates = numbered.select("asset", "dt", F.col("rn").alias("to"))
    return moved.select("asset", "r", "to").join(dates, ["asset", "to"]).select("asset", "dt", "r")


def factor_risk(covariances: DataFrame, loadings: DataFrame) -> DataFrame:
    """(cv, factor, share, bets): variance shares of the equal-weight portfolio by factor (factor -1: outside all
    of them), and the effective number of principal bets."""
    factors = loadings.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("factor", "loading"))).alias("ls"))
    both = covariances.join(F.broadcast(factors.select(F.col("asset").alias("a"), F.col("ls.loading").alias("ls"))), "a")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        w = np.full(len(names), 1 / len(names))
        own = rows.drop_duplicates("a").set_index("a")["ls"].loc[names]
        shares, rest = K.factor_risk(cov, w, np.stack(own.to_numpy()))
        return pd.DataFrame({"cv": rows["cv"].iat[0], "factor": [*range(len(shares)), -1], "share": [*shares, rest], "bets": K.principal_bets(cov, w)})

    return both.groupBy("cv").applyInPandas(solve, "cv int, factor int, share double, bets double")


def frontier(covariances: DataFrame, means: DataFrame, points: int = 10) -> DataFrame:
    """(cv, point, mean, sd): long-only efficient frontier of each fold."""
    both = covariances.join(means.select("cv", F.col("asset").alias("a"), "m"), ["cv", "a"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        mean = rows.drop_duplicates("a").set_index("a")["m"].loc[names].to_numpy()
        _, weights = K.efficient_frontier(mean, cov + 1e-6 * np.trace(cov) / len(cov) * np.eye(len(cov)), points)
        return pd.DataFrame({"cv": rows["cv"].iat[0], "point": range(points), "mean": weights @ mean, "sd": np.sqrt(np.einsum("ij,jk,ik->i", weights, cov, weights))})

    return both.groupBy("cv").applyInPandas(solve, "cv int, point int, mean double, sd double")


def chosen_clusters(curve: DataFrame) -> DataFrame:
    """(rule, k) of a selection curve: the k of the best mean; the least k whose upper band reaches the best lower
    band; and the last k before the mean falls most."""
    whole, by_k = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("k")
    rows = curve.withColumn("best_low", F.max("low").over(whole)).withColumn("drop", F.col("mean") - F.lead("mean").over(by_k))
    picked = rows.agg(F.max_by("k", F.struct("mean", -F.col("k"))).alias("best"), F.min(F.when(F.col("high") >= F.col("best_low"), F.col("k"))).alias("band"), F.max_by("k", F.struct("drop", -F.col("k"))).alias("drop"))
    return picked.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("k")) for n in ("best", "band", "drop")])).alias("r")).select("r.rule", "r.k")
