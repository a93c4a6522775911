"""Chances of a loss on the next date from ARMA-GARCH models, chosen from a grid by fold and fitted again by date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.volatility import LAWS, Fit, Spec, fit, pareto_tails
from ..sources.storage import dealt

SPEC = ["law", "ar", "ma", "p", "q"]
SPEC_TYPES = "law string, ar int, ma int, p int, q int"


def past_returns(returns: DataFrame, key: str, window: int) -> DataFrame:
    """(key, dt, past): the last ``window`` returns of a series before each of its dates, in order. A row holds its own
    past, so fits are spread over tasks and none sees its date's return or a later one."""
    back = Window.partitionBy(key).orderBy("dt").rowsBetween(-window, -1)
    return returns.select(key, "dt", F.collect_list("r").over(back).alias("past"))


def _fitted(rows: DataFrame, mean: bool, columns: str, result: Callable[[Fit], dict]) -> DataFrame:
    """What ``result`` makes of the fits of ``rows`` (past and ``SPEC`` among other columns, which stay). ``columns`` are those
    that ``result`` adds. Rows are dealt out evenly, and those of a task are fitted together."""
    kept = [(c, t) for c, t in rows.dtypes if c != "past"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                specs = [Spec(int(s.ar), int(s.ma), int(s.p), int(s.q), s.law, mean) for s in some[SPEC].itertuples()]
                found = fit([np.asarray(x, float) for x in some["past"]], specs)
                yield pd.concat([some[[c for c, _ in kept]].reset_index(drop=True), pd.DataFrame(result(found))], axis=1)

    return dealt(rows, F.xxhash64(*[c for c, _ in kept])).mapInPandas(run, ", ".join([f"{c} {t}" for c, t in kept]) + ", " + columns)


def _finite(v: np.ndarray) -> pd.array:
    return pd.array([float(x) if np.isfinite(x) else None for x in v], dtype="Float64")


def model_grid(past: DataFrame, orders: int = 2, laws: tuple[str, ...] = LAWS, ps: tuple[int, ...] = (1, 2), qs: tuple[int, ...] = (0, 1, 2), mean: bool = True) -> DataFrame:
    """``past`` (past and other columns) with every model tried on it, its AIC by observation (null where the fit
    failed), the next value's mean and deviation, and the chance that it is not above zero.

    As in two steps by hand: the orders of the mean are those with the least AIC of constant-variance normal models
    up to ``orders`` (without ``mean``, returns are to be demeaned and there is none); then variances of ``ps`` by ``qs`` terms
    and all ``laws`` are tried with them. Each model of each series is a row."""
    spark, keys = past.sparkSession, [c for c in past.columns if c != "past"]
    grid = lambda rows, types: F.broadcast(spark.createDataFrame(rows, types))
    if mean:
        tried = [("norm", a, m, 0, 0) for a in range(orders + 1) for m in range(orders + 1)]
        means = _fitted(past.crossJoin(grid(tried, SPEC_TYPES)), True, "aic double", lambda f: {"aic": _finite(f.aic)})
        best = means.groupBy(*keys).agg(F.min_by(F.struct("ar", "ma"), F.struct(F.coalesce("aic", F.lit(float("inf"))), F.col("ar") + F.col("ma"), F.col("ar"))).alias("o"))
        known = past.join(best, [past[c].eqNullSafe(best[c]) for c in keys]).select(*[past[c] for c in past.columns], "o.ar", "o.ma")
    else:
        known = past.select("*", F.lit(0).alias("ar"), F.lit(0).alias("ma"))
    rows = known.crossJoin(grid([(law, p, q) for law in laws for p in ps for q in qs], "law string, p int, q int"))
    facts = lambda f: {"aic": _finite(f.aic), "mean": _finite(f.mean), "sd": _finite(f.sd), "chance": _finite(f.chance)}
    return _fitted(rows, mean, "aic double, mean double, sd double, chance double", facts)


def chosen_models(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The model with the least AIC of each key; of equal ones that with fewer terms, then by name. A key without any
    fit has none."""
    facts = [c for c in grid.columns if c not in keys]
    size = F.col("ar") + F.col("ma") + F.col("p") + F.col("q") + F.length("law")
    best = grid.where("aic is not null").groupBy(*keys).agg(F.min_by(F.struct(*facts), F.struct("aic", size, "law", "p", "q")).alias("best"))
    return best.select(*keys, "best.*")


def model_chances(returns: DataFrame, folds: DataFrame, key: str = "factor", window: int = 60, least: int = 20, threshold: float = 0.0, **grid) -> DataFrame:
    """(cv, key, dt, ``SPEC``, mean, sd, chance, exceedance): for each test date of each fold, the chance that the return is
    not above zero, by the model that is best on the returns before the test begins, fitted again to the last
    ``window`` returns before the date.

    ``exceedance`` is the chance that a standardised error exceeds the place of zero, -mean / sd, under the normal body
    with a generalised Pareto tail above ``threshold``, from the errors of the normal model with the same orders. Both
    are null where a fit fails; dates with fewer than ``least`` returns before them, and folds without a model, have no
    row. Missing returns count as no return."""
    past = past_returns(returns.where("r is not null"), key, window).where(F.size("past") >= least)
    tests = F.broadcast(folds.select("cv", "test_start", "end"))
    rows = past.join(tests, (F.col("dt") >= F.col("test_start")) & (F.col("dt") < F.col("end"))).select("cv", key, "dt", "past")
    first = rows.groupBy("cv", key).agg(F.min_by("past", "dt").alias("past"))
    models = chosen_models(model_grid(first, **grid), ["cv", key]).select("cv", key, *SPEC)
    again = rows.join(models, ["cv", key])
    mean = grid.get("mean", True)
    facts = lambda f: {"mean": _finite(f.mean), "sd": _finite(f.sd), "chance": _finite(f.chance)}
    law = _fitted(again, mean, "mean double, sd double, chance double", facts)

    def tails(f: Fit) -> dict:
        u = np.full(len(f.mean), threshold)
        shape, scale = pareto_tails(f.errors, u)
        return {"z": _finite(-f.mean / f.sd), "u": u, "shape": _finite(shape), "scale": _finite(scale)}

    tail = _fitted(again.withColumn("law", F.lit("norm")), mean, "z double, u double, shape double, scale double", tails)
    exceedance = stats.joined_exceedance(F.col("z"), F.col("u"), F.col("shape"), F.col("scale"))
    return law.join(tail.select("cv", key, "dt", exceedance.alias("exceedance")), ["cv", key, "dt"], "left")
