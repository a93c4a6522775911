"""Every query with SQL against DuckDB on the smallest tables; every other one runs and keeps its invariants."""

from pathlib import Path

import duckdb
import pytest

from quantloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def as_rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(frame[columns].astype(str).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert as_rows(QUERIES[name](spark, SF).toPandas()) == as_rows(duck.execute(ORACLES[name]).df())


def test_covariance_weights_are_portfolios(spark):
    rows = QUERIES["w_covariance"](spark, SF).toPandas()
    totals = rows.groupby(["cv", "strategy"])["w"].sum()
    assert len(totals) and abs(totals - 1).max() < 1e-4 and rows["w"].min() >= 0


def test_block_permutation_keeps_the_values(spark):
    moved, own = QUERIES["block_permutation"](spark, SF).toPandas(), QUERIES["return_panel"](spark, SF).toPandas()
    assert sorted(moved["r"]) == sorted(own["r"]) and len(moved) == len(own)


def test_probabilities_do_not_see_later_returns(spark):
    from pyspark.sql import functions as F

    from quantloom.operators.grouped import rolling_probabilities

    rows = spark.range(40).selectExpr("'a' AS factor", "date_add(date'2020-01-01', CAST(id AS INT)) AS dt", "sin(id * 1.7) / 10 AS r", "id")
    own = [r["p"] for r in rolling_probabilities(rows).orderBy("dt").collect()]
    later = [r["p"] for r in rolling_probabilities(rows.withColumn("r", F.when(F.col("id") >= 30, F.lit(0.9)).otherwise(F.col("r")))).orderBy("dt").collect()]
    assert own[:30] == later[:30] and own[30:] != later[30:] and own[:23] == [None] * 23 and all(0 <= p <= 1 for p in own[23:])


def test_tail_law_is_found_again(spark):
    import numpy as np

    from quantloom.functions import kernels as K
    from quantloom.operators.grouped import tail_fit

    rng = np.random.default_rng(3)
    for shape in (0.25, -0.2):
        x = 2 * ((1 - rng.random(4000)) ** -shape - 1) / shape
        got = tail_fit(spark.createDataFrame([("k", float(v)) for v in x], "key string, x double"), 0.5).collect()[0]
        over = x[x > got["u"]] - got["u"]
        s, c = K.pareto_fit(over)
        assert got["n"] == len(over) and abs(got["shape"] - s) < 1e-2 and abs(got["scale"] / c - 1) < 1e-2 and abs(got["shape"] - shape) < 0.1


def test_shuffled_signals_keep_their_number(spark):
    from quantloom.plans.queries import fold_signals

    on = {r["factor"]: r["on"] for r in fold_signals(spark, SF).groupBy("factor").agg({"signal": "sum"}).withColumnRenamed("sum(signal)", "on").collect()}
    runs = QUERIES["random_signals"](spark, SF).collect()
    assert len(runs) == 100 * len(on) and all(r["on"] == on[r["factor"]] for r in runs)


def test_folds_out_of_order_are_refused(spark):
    from quantloom.operators.shape import checked_folds
    from quantloom.sources import panel

    folds = panel.folds(spark, SF)
    assert checked_folds(folds).count() == 5
    with pytest.raises(ValueError, match="0, 1"):
        checked_folds(folds.selectExpr("cv", "start", "val_start", "if(cv < 2, start, test_start) AS test_start", "end"))


def test_choice_rules(spark):
    from quantloom.operators.grouped import chosen_clusters

    curve = spark.createDataFrame([(2, 0.3, 0.1, 0.5), (3, 0.6, 0.5, 0.7), (4, 0.58, 0.4, 0.7), (5, 0.2, 0.1, 0.3)], "k int, mean double, low double, high double")
    assert {r["rule"]: r["k"] for r in chosen_clusters(curve).collect()} == {"best": 3, "band": 2, "drop": 4}


def test_numeric_queries_keep_their_invariants(spark):
    got = {n: QUERIES[n](spark, SF).toPandas() for n in ("torsion_bets", "nmf_convex", "nmf_semi", "factor_risk", "efficient_frontier", "spline_impute", "garch_proba", "mc_study")}
    assert got["torsion_bets"]["bets"].between(1, 25.001).all()
    for n in ("nmf_convex", "nmf_semi"):
        g = got[n]
        assert (g["loading"] >= 0).all() and ((g["loading"] ** 2).groupby([g["cv"], g["factor"]]).sum().sub(1).abs() < 1e-4).all()
    assert (got["factor_risk"].groupby("cv")["share"].sum().sub(1).abs() < 1e-4).all() and got["factor_risk"]["bets"].between(1, 25.001).all()
    for _, one in got["efficient_frontier"].groupby("cv"):
        one = one.sort_values("point")
        assert (one["mean"].diff().dropna() >= -1e-6).all() and (one["sd"].diff().dropna() >= -1e-4).all()
    known, filled = QUERIES["price_panel"](spark, SF).toPandas(), got["spline_impute"].dropna(subset=["price"])
    both = known.merge(filled, on=["asset", "dt"])
    assert len(both) == len(known) and (both["price_x"] - both["price_y"]).abs().max() < 1e-5
    assert got["garch_proba"]["p"].dropna().between(0, 1).all() and (got["mc_study"]["vol"] > 0).all() and (got["mc_study"]["es"] >= got["mc_study"]["var"] - 1e-9).all() and got["mc_study"]["sspw"].between(0.03, 1.001).all()


@pytest.mark.parametrize("name", ["backtest_stats", "vol_target_backtest", "hedged_return", "spread_grid", "deflated_sharpe", "external_backtest"])
def test_sales_are_scanned_once_at_most(spark, name):
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") == 0 or sum("l_shipdate" in x and "Relation" in x for x in plan.splitlines()) <= 1
    assert "Join Cross" not in plan


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hierarchical_weights_are_portfolios(spark):
    rows = QUERIES["w_hierarchical"](spark, SF).toPandas()
    totals = rows.groupby(["cv", "strategy"])[["w", "bounded"]].sum()
    assert len(totals) and len(totals) % 4 == 0 and (abs(totals - 1) < 1e-4).all().all()
    assert rows["w"].min() >= 0 and rows["bounded"].between(0.01, 0.15).all()
