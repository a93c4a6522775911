"""Saved results of strategies: a round trip, names, and dates."""

import datetime

import pytest

from quantloom.sources.results import load_results, missing_dates, renamed, save_results, with_external

DAY = [datetime.date(2020, 1, i) for i in range(1, 6)]


def frames(spark):
    returns = spark.createDataFrame([(0, "ivp", DAY[0], 0.1), (0, "ivp", DAY[1], -0.1), (1, "ivp", DAY[2], 0.2), (1, "7", DAY[2], 0.3)], "cv int, strategy string, dt date, r double")
    weights = spark.createDataFrame([(0, "ivp", "a", 0.4), (0, "ivp", "b", 0.6), (1, "7", "a", 1.0)], "cv int, strategy string, asset string, w double")
    return returns, weights


def test_round_trip(spark, tmp_path):
    returns, weights = frames(spark)
    save_results(returns, weights, str(tmp_path))
    got, held = load_results(spark, str(tmp_path), {"ivp": "variance"})
    want = {(r["cv"], r["strategy"].replace("ivp", "variance"), r["dt"], r["r"]) for r in returns.collect()}
    assert {(r["cv"], r["strategy"], r["dt"], r["r"]) for r in got.collect()} == want
    assert {(r["strategy"], r["cv"], r["asset"], r["w"]) for r in held.collect()} == {("variance", 0, "a", 0.4), ("variance", 0, "b", 0.6), ("7", 1, "a", 1.0)}


def test_names_are_not_mixed(spark):
    returns, _ = frames(spark)
    assert {r["strategy"] for r in renamed(returns, {"ivp": "7", "7": "ivp"}).collect()} == {"7", "ivp"}
    assert renamed(returns, {}).count() == 4
    for names in ({"ivp": "7"}, {"ivp": "x", "7": "x"}):
        with pytest.raises(ValueError):
            renamed(returns, names)


def test_others_are_taken_on_the_results_dates(spark):
    returns, _ = frames(spark)
    other = spark.createDataFrame([("bench", d, 0.01) for d in DAY], "strategy string, dt date, r double")
    both = with_external(returns, other)
    assert sorted((r["cv"], r["dt"]) for r in both.where("strategy = 'bench'").collect()) == [(0, DAY[0]), (0, DAY[1]), (1, DAY[2])]
    assert {(r["strategy"], r["n"], r["missing"]) for r in missing_dates(both).collect()} == {("ivp", 3, 0), ("7", 1, 2), ("bench", 3, 0)}
    assert with_external(returns.where("false"), other).count() == 0
