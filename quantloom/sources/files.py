"""Price, rate and weight files: wide CSV with one column per asset, read into long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grouped import spline_filled
from ..operators.returns import fill_backward, fill_forward, simple_returns


def wide_to_long(wide: DataFrame, date: str, name: str = "asset", value: str = "price") -> DataFrame:
    """(dt, asset, price) from one row a date and one column an asset; NaN becomes null."""
    columns = [c for c in wide.columns if c != date]
    numbers = wide.select(F.to_date(date).alias("dt"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = numbers.unpivot("dt", columns, name, value)
    return long.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def read_wide_csv(spark: SparkSession, path: str, date: str | None = None, value: str = "price") -> DataFrame:
    wide = spark.read.csv(path, header=True)
    return wide_to_long(wide, date or wide.columns[0], value=value)


def complete_dates(panel: DataFrame, value: str = "price") -> DataFrame:
    """Rows of the dates on which no asset is missing."""
    whole = panel.groupBy("dt").agg(F.count_if(F.col(value).isNull()).alias("gaps")).where("gaps = 0").select("dt")
    return panel.join(whole, "dt", "left_semi")


def load_prices(spark: SparkSession, path: str, date: str | None = None, gaps: str = "drop") -> DataFrame:
    """(asset, dt, price) of a wide price file, inner gaps filled by a quadratic spline. Dates that then still miss
    an asset, at the ends, go; with ``gaps`` "refuse" they raise."""
    filled = spline_filled(read_wide_csv(spark, path, date))
    if gaps == "refuse":
        missing = filled.where(F.col("price").isNull() | F.isnan("price")).limit(1).collect()
        if missing:
            raise ValueError(f"no price of {missing[0]['asset']} at {missing[0]['dt']}")
        return filled
    return complete_dates(filled.withColumn("price", F.nanvl("price", F.lit(None).cast("double"))))


def load_rates(spark: SparkSession, bills: str, column: str, date: str | None = None, days: int = 365) -> DataFrame:
    """(dt, rf): a daily rate from an annual percentage in one column of a file."""
    raw = spark.read.csv(bills, header=True)
    rows = raw.select(F.to_date(date or raw.columns[0]).alias("dt"), F.col(f"`{column}`").cast("double").alias("annual"))
    return annual_percent_to_daily(rows.where("annual is not null"), "annual", days)


def without_gaps(rates: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, rf) on each of ``dates``: inner gaps by a quadratic spline, the ends by the nearest value."""
    panel = dates.select("dt").distinct().join(rates, "dt", "left").select(F.lit("rf").alias("asset"), "dt", F.col("rf").alias("price"))
    inner = spline_filled(panel).withColumn("price", F.nanvl("price", F.lit(None).cast("double")))
    return fill_backward(fill_forward(inner)).select("dt", F.col("price").alias("rf"))


def load_benchmark(spark: SparkSession, path: str, name: str, dates: DataFrame, volatility: float | None = None) -> DataFrame:
    """(dt, r): returns of one column of a price file on ``dates`` (null where it has none), scaled to a
    volatility if one is given."""
    own = simple_returns(read_wide_csv(spark, path).where(F.col("asset") == name).where("price is not null")).select("dt", "r")
    placed = dates.select("dt").distinct().join(own, "dt", "left")
    if volatility is None:
        return placed
    dev = placed.agg(F.stddev_samp("r").alias("dev"))
    return placed.join(F.broadcast(dev)).select("dt", (F.col("r") * volatility / F.nullif("dev", F.lit(0.0))).alias("r"))


def read_budget(spark: SparkSession, path: str, more: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(asset, market, rc) of a budget file whose first column names the asset, with rows appended."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.col(f"`{raw.columns[0]}`").alias("asset"), "market", F.col("rc").cast("int").alias("rc"))
    return rows.unionByName(spark.createDataFrame(list(more), "asset string, market string, rc int")) if more else rows


def last_dates(panel: DataFrame, start: str, end: str, window: int, key: str = "asset") -> DataFrame:
    """The last ``window`` rows of each key between two dates, both in."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("dt")))
    return panel.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("back", back).where(F.col("back") <= window).drop("back")


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, asset) of JSON files that hold {cluster: [asset, ...]}."""
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return texts.select(F.explode("m").alias("cluster", "assets")).select(F.col("cluster").cast("int").alias("cluster"), F.explode("assets").alias("asset"))


def write_assignment(labels: DataFrame, path: str) -> None:
    """{cluster: [asset, ...]} of labels (cluster, asset) as one line of JSON; there are a few clusters."""
    lists = labels.groupBy(F.col("cluster").cast("string").alias("cluster")).agg(F.sort_array(F.collect_list("asset")).alias("assets"))
    one = lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster", "assets")))).alias("m"))
    one.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def write_wide_csv(frame: DataFrame, path: str, columns: list[str], name: str = "strategy", value: str = "r") -> None:
    """A CSV folder with one row a date and one column for each of ``columns``."""
    frame.groupBy("dt").pivot(name, columns).agg(F.first(value)).orderBy("dt").write.mode("overwrite").csv(path, header=True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs and folds below a folder that ``write_by_fold`` wrote, with the keys in the folders' names."""
    return spark.read.parquet(path)


def first_fold_wins(frame: DataFrame, keys: tuple[str, ...] = ("dt", "factor")) -> DataFrame:
    """Tables of several folds as one: a row that more folds have is taken from the earliest."""
    rest = [c for c in frame.columns if c not in (*keys, "cv")]
    first = frame.groupBy(*keys).agg(F.min(F.struct("cv", *rest)).alias("row"))
    return first.select(*keys, "row.*").select(frame.columns)


def splice_rates(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dt, rf): ``old`` strictly before the first date of ``new``, then ``new``."""
    first = new.agg(F.min("dt").alias("first"))
    return old.join(F.broadcast(first), F.col("dt") < F.col("first")).select("dt", "rf").unionByName(new.select("dt", "rf"))


def annual_percent_to_daily(rates: DataFrame, column: str, days: int = 365) -> DataFrame:
    return rates.select("dt", (F.col(column) / 100 / days).alias("rf"))


def write_by_fold(frame: DataFrame, path: str, *keys: str) -> None:
    """One folder for each run and fold, so that reading a fold touches its own files only."""
    frame.write.mode("overwrite").partitionBy(*keys).parquet(path)
