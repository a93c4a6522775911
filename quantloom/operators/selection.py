"""How many factors: kernel density of the residuals with AIC, the gap statistic, and silhouettes over replicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.storage import dealt, materialize
from .grouped import square


def grams(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, cov): sums of products of each two assets' returns by key, both ways round; pairs are made with a <= b
    only."""
    x, y = (returns.select(*keys, "dt", F.col("asset").alias(n), F.col("r").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    half = x.join(y, [*keys, "dt"]).where("a <= b").groupBy(*keys, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cov"))
    return half.unionByName(half.where("a < b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def standardised(returns: DataFrame, keys: list[str]) -> DataFrame:
    """``returns`` (keys, asset, dt, r) less each asset's mean and in units of its population deviation; assets that do not
    move are left out."""
    whole = Window.partitionBy(*keys, "asset")
    unit = F.nullif(F.stddev_pop("r").over(whole), F.lit(0.0))
    return returns.select(*keys, "asset", "dt", ((F.col("r") - F.avg("r").over(whole)) / unit).alias("r")).where("r is not null")


def factor_fits(returns: DataFrame, keys: list[str], ks: range, seed: int = 3) -> DataFrame:
    """(keys, k, asset, factor, mix, loading): convex factors of each key for each number k of them: a factor's return is the
    sum of the assets' times ``mix``, and an asset's is that of the factors' times ``loading``. Only Gram matrices go
    to the fits, each with one k to a group."""
    rows = grams(returns, keys).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, m = square(rows)
        k = min(int(key[-1]), len(names))
        scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
        mix, loading, _ = K.convex_factors(m, K.nearest_groups(m / np.outer(scale, scale), k, seed), k)
        out = {c: v for c, v in zip([*keys, "k"], key, strict=True)}
        return pd.DataFrame(out | {"asset": np.repeat(names, k), "factor": np.tile(np.arange(k), len(names)), "mix": mix.ravel(), "loading": loading.ravel()})

    types = dict(returns.dtypes)
    columns = ", ".join(f"{c} {types[c]}" for c in keys) + ", k int, asset string, factor int, mix double, loading double"
    return dealt(rows, *keys, "k").groupBy(*keys, "k").applyInPandas(solve, columns)


def mean_residuals(returns: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, dt, e): mean over the assets of what k factors leave of their returns."""
    scores = returns.join(fits, [*keys, "asset"]).groupBy(*keys, "k", "dt", "factor").agg(F.sum(F.col("r") * F.col("mix")).alias("score"))
    # The mean of an asset's fitted return needs only each factor's mean loading.
    mean = fits.groupBy(*keys, "k", "factor").agg(F.sum("loading").alias("load"))
    fitted = scores.join(mean, [*keys, "k", "factor"]).groupBy(*keys, "k", "dt").agg(F.sum(F.col("score") * F.col("load")).alias("fitted"))
    known = returns.groupBy(*keys, "dt").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    return fitted.join(known, [*keys, "dt"]).select(*keys, "k", "dt", ((F.col("r") - F.col("fitted")) / F.col("n")).alias("e"))


def log_sum(terms: Column) -> Column:
    """Logarithm of the sum of the exponentials of an array, taken out of its largest first, so that none overflows and
    not all vanish."""
    top = F.array_max(terms)
    return top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.exp(t - top)))


def kernel_log_density(known: DataFrame, points: DataFrame, key: list[str], bucket: int = 1024) -> DataFrame:
    """``points`` (key, x and others) with ``log_density``: of a kernel estimate from ``known`` (key, x) with exponential
    kernels of the width (3 n / 4) ^ (-1 / 5), n the number of known values.

    Known values of a key are cut into buckets of ``bucket`` values in their order, and a point meets a bucket as one
    row, not each value; the buckets' parts are then added as logarithms. A key without known values has none."""
    order = Window.partitionBy(*key).orderBy("x")
    numbered = known.where("x is not null").select(*key, "x", F.floor((F.row_number().over(order) - 1) / bucket).alias("bucket"))
    held = numbered.groupBy(*key, "bucket").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    n = numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    width = F.pow(F.col("n") * 0.75, F.lit(-0.2))
    placed = points.withColumn("row", F.monotonically_increasing_id()).join(n, key).join(held, key)
    part = placed.withColumn("part", log_sum(F.transform("xs", lambda v: -F.abs(F.col("x") - v) / width)))
    kept = [c for c in points.columns if c not in key]
    summed = part.groupBy(*key, "row", "n").agg(F.sort_array(F.collect_list("part")).alias("parts"), *[F.first(c).alias(c) for c in kept])
    return summed.select(*points.columns, (log_sum(F.col("parts")) - F.log(2 * F.col("n") * width)).alias("log_density"))


def density_aic(residuals: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, k, log_likelihood, aic, best): AIC of k factors, 2 (k - ``least`` - L), where L is the log-likelihood of their
    residuals ``e`` under the kernel density of those of ``least`` factors; ``best`` is the k of the least AIC (the lower
    of equal ones), the same in all rows of a key. A density of zero counts with a logarithm of 1e-20."""
    base = residuals.where(F.col("k") == least).select(*keys, F.col("e").alias("x"))
    scored = kernel_log_density(base, residuals.select(*keys, "k", F.col("e").alias("x")), keys)
    fit = F.when(F.col("log_density") == float("-inf"), 1e-20).otherwise(F.col("log_density"))
    curve = scored.groupBy(*keys, "k").agg(F.sum(fit).alias("log_likelihood"))
    curve = curve.withColumn("aic", 2 * ((F.col("k") - least) - F.col("log_likelihood")))
    whole = Window.partitionBy(*keys)
    return curve.withColumn("best", F.min_by("k", F.struct(F.round("aic", 9), "k")).over(whole))


def with_null_draws(returns: DataFrame, draws: int, seed: int = 17) -> DataFrame:
    """``returns`` (cv, asset, dt, r) as draw 0 and ``draws`` copies whose returns are uniform over each asset's own range, by
    a hash of draw, date and asset: a draw does not depend on how rows are dealt out."""
    whole = Window.partitionBy("cv", "asset")
    ranged = returns.select("cv", "asset", "dt", "r", F.min("r").over(whole).alias("low"), F.max("r").over(whole).alias("high"))
    rows = ranged.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    share = F.pmod(F.xxhash64(F.lit(seed), "draw", "cv", "dt", "asset"), F.lit(2**52)) / F.lit(float(2**52))
    drawn = F.col("low") + (F.col("high") - F.col("low")) * share
    return rows.select("cv", "draw", "asset", "dt", F.when(F.col("draw") == 0, F.col("r")).otherwise(drawn).alias("r"))


def cluster_inertias(distances: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inertia): logarithm of the sum over clusters of the mean distance between two members, each with itself
    included. ``distances`` (keys but k, a, b, d) has a < b, ``labels`` are (keys, asset, label)."""
    shared = [c for c in keys if c in distances.columns]
    a, b = labels.withColumnRenamed("asset", "a"), labels.withColumnRenamed("asset", "b")
    inside = distances.join(a, [*shared, "a"]).join(b, [*keys, "b", "label"]).groupBy(*keys, "label").agg((2 * F.sum("d")).alias("sum"))
    size = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    means = size.join(inside, [*keys, "label"], "left").withColumn("mean", F.coalesce("sum", F.lit(0.0)) / (F.col("n") * F.col("n")))
    return means.groupBy(*keys).agg(F.log(F.sum("mean")).alias("inertia"))


def gap_statistic(returns: DataFrame, ks: range = range(1, 9), draws: int = 10, seed: int = 17) -> DataFrame:
    """(cv, k, inertia, gap, error): how much less the clusters of k convex factors are spread than those of ``draws`` null
    draws, whose own factors are fitted too: mean log inertia of the draws less the returns' own, and the deviation
    of the draws' times sqrt(1 + 1 / draws).

    An asset belongs to the factor of its largest loading. Returns are standardised by asset first. A k at which all
    clusters are single assets has no finite inertia and is left out."""
    rows = materialize(with_null_draws(standardised(returns, ["cv"]), draws, seed), "null-draws")
    fits = factor_fits(rows, ["cv", "draw"], ks)
    labels = fits.groupBy("cv", "draw", "k", "asset").agg(F.max_by("factor", F.struct("loading", -F.col("factor"))).alias("label"))
    inertia = cluster_inertias(pair_distances(rows, ["cv", "draw"]), materialize(labels, "labels"), ["cv", "draw", "k"])
    own, null = F.when(F.col("draw") == 0, F.col("inertia")), F.when(F.col("draw") > 0, F.col("inertia"))
    curve = inertia.groupBy("cv", "k").agg(F.max(own).alias("inertia"), F.avg(null).alias("mean"), F.stddev_pop(null).alias("sd"))
    found = curve.where("inertia is not null and mean is not null")
    return found.select("cv", "k", "inertia", (F.col("mean") - F.col("inertia")).alias("gap"), (F.col("sd") * np.sqrt(1 + 1 / draws)).alias("error"))


def chosen_by_gap(curve: DataFrame) -> DataFrame:
    """(cv, first_gap, first_peak): the least k whose gap is above the next one's less its error, and the least k whose gap
    is above those of both neighbours, the first and the last k being neighbours too; null where there is none."""
    order, whole = Window.partitionBy("cv").orderBy("k"), Window.partitionBy("cv")
    ends = curve.withColumn("first", F.min_by("gap", "k").over(whole)).withColumn("last", F.max_by("gap", "k").over(whole))
    beside = ends.select("cv", "k", "gap", F.lead("gap").over(order).alias("next"), F.lead("error").over(order).alias("error"), F.coalesce(F.lead("gap").over(order), "first").alias("up"), F.coalesce(F.lag("gap").over(order), "last").alias("down"))
    first_gap = F.min(F.when(F.col("gap") > F.col("next") - F.col("error"), F.col("k")))
    peak = F.min(F.when((F.col("gap") > F.col("up")) & (F.col("gap") > F.col("down")), F.col("k")))
    return beside.groupBy("cv").agg(first_gap.alias("first_gap"), peak.alias("first_peak"))


def permuted_rows(returns: DataFrame, replicates: int, length: int, seed: int = 9) -> DataFrame:
    """(cv, replicate, asset, dt, r): the dates of each replicate that are left when blocks of ``length`` dates are put in a
    random order without replacement and the list is cut where all blocks would have to be whole: unless the last,
    shorter block comes last, some dates are lost. Their order does not matter to what is computed from them. The
    order of the blocks is that of a hash."""
    dates = returns.select("cv", "dt").distinct()
    order, whole = Window.partitionBy("cv").orderBy("dt"), Window.partitionBy("cv")
    numbered = dates.select("cv", "dt", (F.row_number().over(order) - 1).alias("rn"), F.count(F.lit(1)).over(whole).alias("n"))
    placed = numbered.withColumn("block", F.floor(F.col("rn") / length)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    turn = F.dense_rank().over(Window.partitionBy("cv", "replicate").orderBy(F.xxhash64(F.lit(seed), "cv", "replicate", "block"), "block")) - 1
    room = F.least(F.lit(length), F.col("n") - turn * length)
    kept = placed.withColumn("room", room).where(F.col("rn") - F.col("block") * length < F.col("room"))
    return returns.join(kept.select("cv", "replicate", "dt"), ["cv", "dt"]).select("cv", "replicate", "asset", "dt", "r")


def silhouettes(distances: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): mean silhouette of the assets. ``distances`` (some of the keys, a, b, d) has a < b, ``labels`` are (keys,
    asset, label). An asset alone in its cluster counts zero, and so do all where there is one cluster."""
    shared = [c for c in keys if c in distances.columns]
    ways = distances.unionByName(distances.select(*shared, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    mine = labels.select(*keys, F.col("asset").alias("a"), F.col("label").alias("own"))
    near = ways.join(labels.withColumnRenamed("asset", "b"), [*shared, "b"]).groupBy(*keys, "a", "label").agg(F.avg("d").alias("d"))
    sides = mine.join(near, [*keys, "a"], "left").groupBy(*keys, "a").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("x"), F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("y"))
    score = F.coalesce((F.col("y") - F.col("x")) / F.nullif(F.greatest("x", "y"), F.lit(0.0)), F.lit(0.0))
    both = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), score).otherwise(0.0)
    return sides.groupBy(*keys).agg(F.avg(both).alias("score"))


def pair_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, d): Euclidean distance of each two assets' returns, a < b."""
    x, y = (rows.select(*keys, "dt", F.col("asset").alias(n), F.col("r").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    gap = F.col("x") - F.col("y")
    return x.join(y, [*keys, "dt"]).where("a < b").groupBy(*keys, "a", "b").agg(F.sqrt(F.sum(gap * gap)).alias("d"))


def silhouette_curve(returns: DataFrame, ks: range = range(2, 16), replicates: int = 20, length: int = 12, alpha: float = 0.05, seed: int = 9) -> DataFrame:
    """(cv, k, mean, low, high): silhouette of the clusters of k convex factors by number k over block-permuted
    replicates of ``returns`` (cv, asset, dt, r), standardised anew in each, with the quantiles ``alpha`` and 1 - ``alpha``."""
    keys = ["cv", "replicate"]
    rows = materialize(standardised(permuted_rows(returns, replicates, length, seed), keys), "replicates")
    labels = factor_fits(rows, keys, ks).groupBy(*keys, "k", "asset").agg(F.max_by("factor", F.struct("loading", -F.col("factor"))).alias("label"))
    scores = silhouettes(pair_distances(rows, keys), materialize(labels, "labels"), [*keys, "k"])
    return scores.groupBy("cv", "k").agg(F.avg("score").alias("mean"), F.percentile("score", F.lit(alpha)).alias("low"), F.percentile("score", F.lit(1 - alpha)).alias("high"))


def chosen_by_band(curve: DataFrame, gain: float = 0.025) -> DataFrame:
    """(cv, rule, k) of a silhouette curve (cv, k, mean, low, high):

    ``max``: the best mean; ``first_max``: the least k whose mean reaches the lower band of the best; ``gap``: the least k whose
    mean reaches the lower band of the next; ``extrema``: of the k whose mean is above both neighbours (the ends being
    neighbours) and, but for the first, above the one of those before it by ``gain``, that with the largest mean to
    band width. A rule that nothing meets gives the least k. Equal values: the lower k."""
    order, whole = Window.partitionBy("cv").orderBy("k"), Window.partitionBy("cv")
    rows = curve.select("cv", "k", "mean", "low", "high", F.max_by("low", F.struct("mean", -F.col("k"))).over(whole).alias("best_low"), F.lead("low").over(order).alias("next_low"), F.coalesce(F.lead("mean").over(order), F.min_by("mean", "k").over(whole)).alias("up"), F.coalesce(F.lag("mean").over(order), F.max_by("mean", "k").over(whole)).alias("down"))
    peak = (F.col("mean") > F.col("up")) & (F.col("mean") > F.col("down"))
    marked = rows.withColumn("peak", peak).withColumn("before", F.last(F.when(F.col("peak"), F.col("mean")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    candidate = F.col("peak") & (F.col("before").isNull() | (F.col("mean") - F.col("before") > gain))
    weight = F.col("mean") / (F.col("high") - F.col("low") + 1e-12)
    least = F.min("k")
    first = lambda met: F.coalesce(F.min(F.when(met, F.col("k"))), least)
    rules = {
        "max": F.max_by("k", F.struct("mean", -F.col("k"))),
        "first_max": first(F.col("mean") >= F.col("best_low")),
        "gap": first(F.col("mean") >= F.col("next_low")),
        "extrema": F.coalesce(F.max_by(F.when(candidate, F.col("k")), F.when(candidate, F.struct(weight, -F.col("k")))), least),
    }
    picked = marked.groupBy("cv").agg(*[r.alias(n) for n, r in rules.items()])
    return picked.select("cv", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("k")) for n in rules])).alias("r")).select("cv", "r.rule", "r.k")


def run_loadings(returns: DataFrame, k: int, runs: int) -> DataFrame:
    """(cv, run, asset, factor, loading): ``runs`` fits of k convex factors to ``returns`` (cv, asset, dt, r), each from clusters of
    its own random start; the loadings of a factor have length one. A fold and run is a group, of a Gram matrix."""
    rows = grams(returns, ["cv"]).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, m = square(rows)
        scale, n = np.sqrt(np.maximum(np.diag(m), 1e-300)), min(k, len(names))
        g = K.convex_factors(m, K.nearest_groups(m / np.outer(scale, scale), n, int(key[1]), starts=1), n)[1]
        g = g / np.maximum(np.linalg.norm(g, axis=0), 1e-300)
        return pd.DataFrame({"cv": key[0], "run": key[1], "asset": np.repeat(names, n), "factor": np.tile(np.arange(n), len(names)), "loading": g.ravel()})

    types = f"cv {dict(returns.dtypes)['cv']}, run int, asset string, factor int, loading double"
    return dealt(rows, "cv", "run").groupBy("cv", "run").applyInPandas(solve, types)


def matched_factors(loadings: DataFrame) -> DataFrame:
    """(cv, run, factor, group): factors of all runs of a fold put in the order of the leaves of their single-linkage tree, by
    the distances of their loadings (cv, run, asset, factor, loading), and cut into groups of as many as there are
    runs. A group of the fold's factor rows goes to one task: runs times factors of them."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index=["run", "factor"], columns="asset", values="loading").sort_index().fillna(0.0)
        leaves = K.leaf_order(K.single_linkage(wide.to_numpy())) if len(wide) > 1 else [0]
        each = rows["run"].nunique()
        at = wide.index[leaves]
        return pd.DataFrame({"cv": rows["cv"].iat[0], "run": at.get_level_values("run"), "factor": at.get_level_values("factor"), "group": np.arange(len(leaves)) // each})

    return loadings.groupBy("cv").applyInPandas(order, f"cv {dict(loadings.dtypes)['cv']}, run int, factor int, group int")


def averaged_loadings(loadings: DataFrame, matched: DataFrame) -> DataFrame:
    """(cv, asset, factor, loading, spread): mean and deviation of each asset's loadings over the runs' matched factors."""
    rows = loadings.join(matched, ["cv", "run", "factor"]).groupBy("cv", "asset", F.col("group").alias("factor"))
    return rows.agg(F.avg("loading").alias("loading"), F.stddev_pop("loading").alias("spread"))
