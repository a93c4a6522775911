"""Cluster labels, their agreement, and distances between points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def labels_from_loadings(loadings: DataFrame, least: float = 0.01, spare: int = 6) -> DataFrame:
    """(asset, label): factor of the largest loading, or ``spare`` where none reaches ``least``."""
    top = loadings.groupBy("asset").agg(F.max(F.struct("loading", (-F.col("factor")).alias("neg"))).alias("top"))
    return top.select("asset", F.when(F.col("top.loading") >= least, -F.col("top.neg")).otherwise(F.lit(spare)).alias("label"))


def consensus(runs: DataFrame) -> DataFrame:
    """(a, b, share): share of runs that put two assets under one label, for a <= b. Joined on run and label, so
    only pairs that meet are made."""
    n = runs.agg(F.countDistinct("run").alias("n_runs"))
    a, b = runs.select("run", "label", F.col("asset").alias("a")), runs.select("run", "label", F.col("asset").alias("b"))
    met = a.join(b, ["run", "label"]).where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return met.join(F.broadcast(n)).select("a", "b", (F.col("n") / F.col("n_runs")).alias("share"))


def assigned(shares: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """(asset, cluster, share): the asset of ``names`` (cluster) with which each asset shares most runs, by ``shares`` (a, b, share)
    for a <= b, if its shares with all of them come to more than ``least``, else none; ties: the first name."""
    ways = shares.unionByName(shares.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    assets = shares.select(F.col("a").alias("asset")).union(shares.select("b")).distinct()
    order = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("share", 12)), "b"))
    total = F.sum("share").over(Window.partitionBy("a"))
    met = ways.join(names.select(F.col("cluster").alias("b")), "b").select(F.col("a"), "b", "share", order.alias("turn"), total.alias("total"))
    best = met.where((F.col("turn") == 1) & (F.round("total", 12) > least)).select(F.col("a").alias("asset"), F.col("b").alias("cluster"), "share")
    return assets.join(best, "asset", "left")


def adjusted_rand(runs: DataFrame) -> DataFrame:
    """(i, j, ari) of every two runs i < j, from their contingency table."""
    a = runs.select(F.col("run").alias("i"), "asset", F.col("label").alias("li"))
    b = runs.select(F.col("run").alias("j"), "asset", F.col("label").alias("lj"))
    cells = a.join(b, "asset").where("i < j").groupBy("i", "j", "li", "lj").agg(F.count(F.lit(1)).alias("n"))
    choose = lambda x: x * (x - 1) / 2
    both = cells.groupBy("i", "j").agg(F.sum(choose(F.col("n"))).alias("idx"), F.sum("n").alias("total"))
    rows = cells.groupBy("i", "j", "li").agg(F.sum("n").alias("n")).groupBy("i", "j").agg(F.sum(choose(F.col("n"))).alias("p"))
    columns = cells.groupBy("i", "j", "lj").agg(F.sum("n").alias("n")).groupBy("i", "j").agg(F.sum(choose(F.col("n"))).alias("q"))
    joined = both.join(rows, ["i", "j"]).join(columns, ["i", "j"])
    expected, most = F.col("p") * F.col("q") / choose(F.col("total")), (F.col("p") + F.col("q")) / 2
    return joined.select("i", "j", F.when(most == expected, 1.0).otherwise(ratio(F.col("idx") - expected, most - expected)).alias("ari"))


def comembership(loadings: DataFrame, least: float = 0.05) -> DataFrame:
    """(a, b, n): factors on which two assets both have a squared loading of ``least`` or more."""
    strong = loadings.where(F.col("loading") * F.col("loading") >= least).select("factor", "asset")
    a, b = strong.withColumnRenamed("asset", "a"), strong.withColumnRenamed("asset", "b")
    return a.join(b, "factor").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def distances(panel: DataFrame, item: str = "asset", at: str = "dt", value: str = "r") -> DataFrame:
    """(a, b, d): Euclidean distance of items over common coordinates, for a < b."""
    x = panel.select(F.col(at).alias("at"), F.col(item).alias("a"), F.col(value).alias("x"))
    y = panel.select(F.col(at).alias("at"), F.col(item).alias("b"), F.col(value).alias("y"))
    square = F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    return x.join(y, "at").where("a < b").groupBy("a", "b").agg(F.sqrt(square).alias("d"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(asset, s): how much nearer an asset is to its own cluster than to the next; alone in a cluster: 0."""
    both = pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    mine, its = labels.select(F.col("asset").alias("a"), F.col("label").alias("la")), labels.select(F.col("asset").alias("b"), F.col("label").alias("lb"))
    means = both.join(F.broadcast(mine), "a").join(F.broadcast(its), "b").groupBy("a", "la", "lb").agg(F.avg("d").alias("d"))
    inner, outer = F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))), F.min(F.when(F.col("la") != F.col("lb"), F.col("d")))
    found = means.groupBy("a").agg(inner.alias("x"), outer.alias("y"))
    return found.select(F.col("a").alias("asset"), F.when(F.col("x").isNull(), 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y")).alias("s"))


def inertia(points: DataFrame) -> DataFrame:
    """(label, n, inertia): squared distances to the centroid, from sums alone."""
    square = F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v") / F.count("v")
    return points.groupBy("label", "i").agg(F.count("v").alias("n"), square.alias("ss")).groupBy("label").agg(F.max("n").alias("n"), F.sum("ss").alias("inertia"))


def match_factors(loadings: DataFrame, reference: DataFrame) -> DataFrame:
    """(factor, match, d): the reference factor at the least Euclidean distance; ties: the lowest. Both sides have
    a few factors over the same assets."""
    mine, its = loadings.select("asset", "factor", F.col("loading").alias("x")), reference.select("asset", F.col("factor").alias("match"), F.col("loading").alias("y"))
    square = F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    d = mine.join(its, "asset").groupBy("factor", "match").agg(F.round(F.sqrt(square), 12).alias("d"))
    best = Window.partitionBy("factor").orderBy("d", "match")
    return d.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("factor", "match", "d")


def cluster_predictions(split: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, cv, asset, dt, p): by each run's labels (run, asset, label), an asset's test return as the mean of its cluster's
    on that date."""
    held = split.where("split = 'test'").select("cv", "asset", "dt", "r").join(labels.select("run", "asset", "label"), "asset")
    means = held.groupBy("run", "cv", "label", "dt").agg(F.avg("r").alias("p"))
    return held.select("run", "cv", "asset", "label", "dt").join(means, ["run", "cv", "label", "dt"]).select("run", "cv", "asset", "dt", "p")
