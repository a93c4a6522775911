"""Weights down a tree of clusters by any risk measure, and weights brought inside bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .grouped import square
from .returns import drawdowns

MEASURES = ("equal", "vol", "es", "cdar")
#: Risks below this, as of a portfolio without losses, count as this.
LEAST_RISK = 1e-8


def cluster_nodes(covariances: DataFrame, k: int | None = None) -> DataFrame:
    """(cv, asset, node, sibling, last) from pair tables (cv, a, b, cov): for each split of the single-linkage tree down to
    its ``k`` clusters the side on which the asset is and the other side; ``last`` marks the asset's cluster. Without
    ``k``, the tree is cut where cohesion bends most. A tree that is not split has one row an asset, without sibling."""

    def nodes(rows: pd.DataFrame) -> pd.DataFrame:
        names, cov = square(rows)
        sides, clusters = K.tree_sides(K.positive(cov), k)
        out = [(names[i], node, sibling, node in clusters) for node, (sibling, members) in sides.items() for i in members]
        table = pd.DataFrame(out, columns=["asset", "node", "sibling", "last"])
        return table.assign(cv=rows["cv"].iat[0], sibling=table["sibling"].astype("Int32"))

    return covariances.groupBy("cv").applyInPandas(nodes, "cv int, asset string, node int, sibling int, last boolean")


def measured(series: DataFrame, *keys: str, alpha: float = 0.05) -> DataFrame:
    """(keys, measure, risk) of series (keys, dt, r): 1 (``equal``), standard deviation, and mean loss at or below the
    quantile ``alpha`` of the returns (``es``) and of the drawdowns (``cdar``); never below ``LEAST_RISK``."""
    rows = series.select(F.struct(*keys).alias("key"), "dt", "r")
    both = drawdowns(rows, "key").select("key", F.explode(F.create_map(F.lit("es"), "r", F.lit("cdar"), "drawdown")).alias("measure", "x"))
    cut = both.groupBy("key", "measure").agg(F.percentile("x", F.lit(alpha)).alias("q"))
    tails = both.join(cut, ["key", "measure"]).where("x <= q").groupBy("key", "measure").agg((-F.avg("x")).alias("risk"))
    plain = rows.groupBy("key").agg(F.create_map(F.lit("equal"), F.lit(1.0), F.lit("vol"), F.stddev_samp("r")).alias("m"))
    out = tails.unionByName(plain.select("key", F.explode("m").alias("measure", "risk")))
    return out.select("key.*", "measure", F.greatest("risk", F.lit(LEAST_RISK)).alias("risk"))


def hierarchical_weights(split: DataFrame, nodes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cv, strategy, asset, w): ``herc_equal``, ``herc_vol``, ``herc_es`` and ``herc_cdar`` of each fold's train returns (cv,
    split, asset, dt, r). At each split of the tree (``cluster_nodes``) the two sides get weight inverse to their risks,
    a side's risk being that of its assets weighted inversely to their own risks; inside a cluster weights are those.

    Risks are aggregates over all train dates, so no task gathers a fold's returns; an asset is in as many series as
    there are splits above its cluster. An asset without a return on a date counts as zero there."""
    train = split.where("split = 'train'").select("cv", "asset", "dt", "r")
    own = measured(train, "cv", "asset", alpha=alpha).withColumnRenamed("risk", "own")
    inside = Window.partitionBy("cv", "measure", "node")
    held = nodes.join(own, ["cv", "asset"]).withColumn("part", 1 / F.col("own") / F.sum(1 / F.col("own")).over(inside))
    series = train.join(held, ["cv", "asset"]).groupBy("cv", F.col("measure").alias("by"), "node", "dt").agg(F.sum(F.col("part") * F.col("r")).alias("r"))
    risks = measured(series, "cv", "by", "node", alpha=alpha).where("measure = by").select("cv", "measure", "node", "risk")
    other = risks.select("cv", "measure", F.col("node").alias("sibling"), F.col("risk").alias("against"))
    shares = held.join(risks, ["cv", "measure", "node"]).join(other, ["cv", "measure", "sibling"], "left")
    share = F.when(F.col("sibling").isNull(), 1.0).otherwise(F.col("against") / (F.col("risk") + F.col("against")))
    product = F.exp(F.sum(F.log(share))) * F.max(F.when(F.col("last"), F.col("part")))
    return shares.groupBy("cv", F.concat(F.lit("herc_"), "measure").alias("strategy"), "asset").agg(product.alias("w"))


def within_bounds(weights: DataFrame, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """``weights`` (cv, strategy, asset, w) with ``bounded``: each weight times one factor of its portfolio, but never below
    ``lower`` nor above ``upper``, where the factor is the one that keeps the portfolio's sum. What is cut off above or added
    below is thus shared among the others by their weights. Where the bounds leave no such portfolio, or a weight is
    missing or negative, the values are null."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(bounded=K.scaled_within(rows["w"].to_numpy(float), lower, upper))

    return weights.select("cv", "strategy", "asset", "w").groupBy("cv", "strategy").applyInPandas(fit, "cv int, strategy string, asset string, w double, bounded double")
