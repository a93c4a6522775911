"""Canonical price, return, factor and probability tables built from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from ..operators.returns import simple_returns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(column: str, grain: str = "month") -> F.Column:
    return F.to_date(F.trunc(F.col(column), grain)).alias("dt")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation of their customer. Only the columns used reach the scans."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("asset"))
    owners = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return items.join(owners.select("o_orderkey", "asset"), F.col("l_orderkey") == F.col("o_orderkey"))


def prices(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """(asset, dt, price): volume-weighted price of each nation, by month or another ``grain`` of dates."""
    price = F.sum("l_extendedprice") / F.sum("l_quantity")
    return sales(spark, sf_dir).groupBy("asset", month("l_shipdate", grain)).agg(price.alias("price"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_returns(prices(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, market): the asset class of each asset."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("asset"), F.col("r_name").alias("market"))


def risk_free(spark: SparkSession, sf_dir: str, days: int = 365) -> DataFrame:
    """(dt, rf): an annual rate divided by days."""
    return table(spark, sf_dir, "lineitem").groupBy(month("l_shipdate")).agg((F.avg("l_discount") / days).alias("rf"))


def market_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(month("l_shipdate")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


def folds(spark: SparkSession, sf_dir: str, expanding: bool = True) -> DataFrame:
    """(cv, start, val_start, test_start, end): one walk-forward split for each year of the sales from the third
    on, the last one up to the last month there is. Only the two ends of the dates are read for it."""
    ends = table(spark, sf_dir, "lineitem").agg(F.year(F.min("l_shipdate")).alias("first"), F.max("l_shipdate").alias("last"))
    first, year, stop = ends.select("first", F.year("last"), F.add_months(F.trunc("last", "month"), 1)).first()
    if first is None:
        first, year, stop = 1, 0, None
    y, day = F.col("id"), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    start = day(F.lit(first)) if expanding else day(y - 2)
    end = F.least(day(y + 1), F.lit(stop).cast("date"))
    return spark.range(first + 2, max(first + 2, year + 1)).select((y - first - 2).cast("int").alias("cv"), start.alias("start"), day(y - 1).alias("val_start"), day(y).alias("test_start"), end.alias("end"))


def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, factor, loading): share of an asset's sales in six kinds of part, of unit length per factor."""
    sold = sales(spark, sf_dir).groupBy("asset", (F.col("l_partkey") % 6).cast("int").alias("factor")).agg(F.sum("l_extendedprice").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("asset"))
    shares = sold.select("asset", "factor", share.alias("s"))
    return shares.select("asset", "factor", (F.col("s") / F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("factor")))).alias("loading"))


def run_labels(spark: SparkSession, sf_dir: str, clusters: int = 5) -> DataFrame:
    """(run, asset, label): per year, assets in equal bands of mean return."""
    means = returns(spark, sf_dir).groupBy(F.year("dt").alias("run"), "asset").agg(F.round(F.avg("r"), 12).alias("m"))
    band = F.ntile(clusters).over(Window.partitionBy("run").orderBy("m", "asset"))
    return means.select("run", "asset", (band - 1).alias("label"))


def class_returns(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """(factor, dt, r): mean return of each class; ``known`` returns are not computed again."""
    return (returns(spark, sf_dir) if known is None else known).join(F.broadcast(classes(spark, sf_dir)), "asset").groupBy(F.col("market").alias("factor"), "dt").agg(F.avg("r").alias("r"))


def probabilities(spark: SparkSession, sf_dir: str, window: int = 12, known: DataFrame | None = None) -> DataFrame:
    """(factor, dt, r, p, y): normal tail probability from the last ``window`` returns (null before there are
    as many), and whether the return is a tail event."""
    w = Window.partitionBy("factor").orderBy("dt").rowsBetween(1 - window, 0)
    z = -F.avg("r").over(w) / F.stddev_samp("r").over(w)
    p = F.when(F.count("r").over(w) == window, F.round(normal_cdf(z), 6))
    return class_returns(spark, sf_dir, known).select("factor", "dt", "r", p.alias("p"), (F.col("r") <= 0).cast("int").alias("y"))


def var_forecasts(spark: SparkSession, sf_dir: str, window: int = 12) -> DataFrame:
    """(asset, dt, r, var_norm, var_hist): value at risk from the last ``window`` rows, two ways."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(1 - window, 0)
    full = F.count("r").over(w) == window
    norm = F.avg("r").over(w) - 1.645 * F.stddev_samp("r").over(w)
    hist = F.percentile("r", F.lit(0.05)).over(w)
    return returns(spark, sf_dir).select("asset", "dt", "r", F.when(full, norm).alias("var_norm"), F.when(full, hist).alias("var_hist")).where("var_norm is not null")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, v, label): vectors in long form."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode_outer("embedding").alias("i", "v")).select("vec_id", "i", F.col("v").cast("double").alias("v"), "label")
