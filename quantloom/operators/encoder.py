"""The encoder by fold, its linear activations and what it reconstructs, as joins with its coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoder import Encoder, intercepts, linear_part, train
from ..functions.stats import ratio
from ..sources.storage import dealt

COLUMNS = "cv int, run int, asset string, factor int, encoder double, decoder double, coefficient double, slope double, constant double, boundary double, intercept double, loss double, epochs int"


def fold_encoders(scaled: DataFrame, scaler: DataFrame, settings: Encoder | None = None, runs: int = 1, window: int = 2500) -> DataFrame:
    """(cv, run, asset, factor, encoder, decoder, coefficient, slope, constant, boundary, intercept, loss, epochs): encoders of each
    fold trained on its train rows and stopped by its validation rows, from ``runs`` random starts.

    ``scaled`` (cv, split, asset, dt, z) are standardised returns by the fold's train rows, ``scaler`` (cv, asset, m, s) what they
    were standardised with. ``coefficient``, ``constant`` and ``boundary`` are those of a unit's linear activation, which grows with the
    unit by ``slope``; ``intercept`` is in units of returns. Dates on which an asset of the fold is missing are left out; of the others the last ``window``
    train dates are used, so a fold and run is a group of a bounded size. A fold with fewer assets than units, or fewer
    than three train dates, has no encoder."""
    s = settings or Encoder()
    turn = F.dense_rank().over(Window.partitionBy("cv", "split").orderBy(F.desc("dt")))
    recent = scaled.where("split <> 'test'").withColumn("turn", turn).where(F.col("turn") <= window).drop("turn")
    rows = recent.join(scaler, ["cv", "asset"]).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index=["split", "dt"], columns="asset", values="z").sort_index().dropna()
        is_train = wide.index.get_level_values("split") == "train"
        x, check = wide[is_train].to_numpy(), wide[~is_train].to_numpy()
        names, n = list(wide.columns), wide.shape[1]
        if n < s.k or len(x) < 3:
            kinds = {"int": "int32", "double": "float64", "string": "object"}
            return pd.DataFrame({name: pd.Series([], dtype=kinds[kind]) for name, kind in map(str.split, COLUMNS.split(", "))})
        found = train(x, check, Encoder(**{**s.__dict__, "seed": s.seed + int(key[1])}))
        w, known = found.weights, rows.drop_duplicates("asset").set_index("asset").loc[names]
        coefficient, constant, boundary = linear_part(w, s.epsilon)
        loss = found.losses[found.best] if found.best >= 0 else np.nan
        out = {"cv": key[0], "run": key[1], "asset": np.repeat(names, s.k), "factor": np.tile(np.arange(s.k), n), "encoder": w["w1"].ravel(), "decoder": w["w2"].T.ravel(), "coefficient": coefficient.ravel()}
        out |= {"slope": np.tile(w["gamma"] / np.sqrt(w["var"] + s.epsilon), n), "constant": np.tile(constant, n), "boundary": np.tile(boundary, n), "intercept": np.repeat(intercepts(w, s.epsilon, known["m"].to_numpy(), known["s"].to_numpy()), s.k)}
        return pd.DataFrame(out | {"loss": pd.array([None if np.isnan(loss) else loss] * (n * s.k), dtype="Float64"), "epochs": len(found.losses)})

    return dealt(rows, "cv", "run").groupBy("cv", "run").applyInPandas(fit, COLUMNS)


def linear_activations(scaled: DataFrame, encoders: DataFrame) -> DataFrame:
    """(cv, run, split, dt, factor, activation, event): each unit's linear activation on each date of a fold, and whether it is a
    tail event, where the unit is cut: at its boundary or below, for a slope above zero. Dates on which an asset is missing are left out."""
    size = encoders.groupBy("cv", "run").agg(F.countDistinct("asset").alias("size"))
    rows = scaled.join(encoders, ["cv", "asset"]).groupBy("cv", "run", "split", "dt", "factor")
    summed = rows.agg(F.sum(F.col("z") * F.col("coefficient")).alias("s"), F.first("constant").alias("c"), F.first("boundary").alias("b"), F.signum(F.first("slope")).alias("side"), F.count(F.lit(1)).alias("n"))
    known = summed.join(size, ["cv", "run"]).where("n = size").withColumn("activation", F.col("s") + F.col("c"))
    return known.select("cv", "run", "split", "dt", "factor", "activation", ((F.col("activation") - F.col("b")) * F.col("side") <= 0).cast("int").alias("event"))


def predictions(activations: DataFrame, encoders: DataFrame, scaler: DataFrame) -> DataFrame:
    """(cv, run, split, dt, asset, fit): the returns that the decoder makes of the rectified activations."""
    boundary = encoders.select("cv", "run", "factor", "boundary", F.signum("slope").alias("side")).distinct()
    rest = F.col("side") * F.greatest(F.col("side") * (F.col("activation") - F.col("boundary")), F.lit(0.0))
    units = activations.join(boundary, ["cv", "run", "factor"]).select("cv", "run", "split", "dt", "factor", rest.alias("above"))
    parts = units.join(encoders.select("cv", "run", "asset", "factor", "decoder", "intercept"), ["cv", "run", "factor"])
    made = parts.groupBy("cv", "run", "split", "dt", "asset").agg(F.sum(F.col("above") * F.col("decoder")).alias("z"), F.first("intercept").alias("i"))
    return made.join(scaler, ["cv", "asset"]).select("cv", "run", "split", "dt", "asset", (F.col("z") * F.col("s") + F.col("i")).alias("fit"))


def averaged_predictions(fits: DataFrame, returns: DataFrame) -> DataFrame:
    """(cv, split, asset, dt, r, fit): the truth and the mean of the runs' predictions, by fold."""
    mean = fits.groupBy("cv", "split", "asset", "dt").agg(F.avg("fit").alias("fit"))
    return returns.join(mean, ["cv", "split", "asset", "dt"]).select("cv", "split", "asset", "dt", "r", "fit")


def prediction_quality(table: DataFrame) -> DataFrame:
    """(cv, split, n, r2, rmse): of a table of truths and predictions, squares not centred."""
    e = F.col("r") - F.col("fit")
    return table.groupBy("cv", "split").agg(F.count(F.lit(1)).alias("n"), (1 - ratio(F.sum(e * e), F.sum(F.col("r") * F.col("r")))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))
