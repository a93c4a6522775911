from datetime import date, datetime

from quantloom.operators.returns import fill_forward
from quantloom.sources import files
from quantloom.streaming.close import closing_prices


def test_wide_csv_to_long(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,A,B\n2020-01-01,1.5,NaN\n2020-01-02,2,3\n")
    rows = files.read_wide_csv(spark, str(tmp_path / "p.csv"))
    assert rows.count() == 4 and rows.where("price is null").count() == 1
    assert {r["dt"] for r in files.complete_dates(rows).collect()} == {date(2020, 1, 2)}


def test_splice_takes_the_old_series_before_the_new(spark):
    old = spark.createDataFrame([(date(2020, 1, d), 1.0) for d in (1, 2, 3)], "dt date, rf double")
    new = spark.createDataFrame([(date(2020, 1, 2), 9.0)], "dt date, rf double")
    assert sorted(tuple(r) for r in files.splice_rates(old, new).collect()) == [(date(2020, 1, 1), 1.0), (date(2020, 1, 2), 9.0)]


def test_prices_are_filled_inside_and_cut_at_the_ends(spark, tmp_path):
    import pytest

    days = [f"2020-01-0{d}" for d in range(1, 8)]
    b = ["", "4", "", "16", "25", "36", "49"]
    (tmp_path / "p.csv").write_text("date,A,B\n" + "".join(f"{d},{i + 1},{b[i]}\n" for i, d in enumerate(days)))
    rows = {(r["asset"], r["dt"].day): r["price"] for r in files.load_prices(spark, str(tmp_path / "p.csv")).collect()}
    assert len(rows) == 12 and abs(rows["B", 3] - 9) < 1e-6 and ("A", 1) not in rows
    with pytest.raises(ValueError, match="B"):
        files.load_prices(spark, str(tmp_path / "p.csv"), gaps="refuse")
    bench = {r["dt"].day: r["r"] for r in files.load_benchmark(spark, str(tmp_path / "p.csv"), "A", spark.sql("SELECT explode(sequence(date'2020-01-02', date'2020-01-09')) AS dt"), 2.0).collect()}
    assert len(bench) == 8 and bench[9] is None and abs(bench[2] / bench[3] - 2) < 1e-9
    assert sorted((r["asset"], r["dt"].day) for r in files.last_dates(files.read_wide_csv(spark, str(tmp_path / "p.csv")), "2020-01-01", "2020-01-05", 2).collect()) == [("A", 4), ("A", 5), ("B", 4), ("B", 5)]


def test_rates_without_gaps(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,x,4 WEEKS\n2020-01-02,1,36.5\n2020-01-03,1,\n2020-01-04,1,73\n2020-01-05,1,73\n")
    rates = files.load_rates(spark, str(tmp_path / "r.csv"), "4 WEEKS")
    assert sorted(round(r["rf"], 9) for r in rates.collect()) == [0.001, 0.002, 0.002]
    got = {r["dt"].day: r["rf"] for r in files.without_gaps(rates, spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-01-07')) AS dt")).collect()}
    assert len(got) == 7 and got[1] == got[2] == 0.001 and got[7] == got[5] == 0.002 and 0.001 < got[3] <= 0.0023


def test_assignments_runs_and_tables_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(0, "A"), (1, "B"), (0, "C")], "cluster int, asset string")
    files.write_assignment(labels, f"{tmp_path}/a")
    assert sorted(map(tuple, files.read_assignment(spark, f"{tmp_path}/a").collect())) == [(0, "A"), (0, "C"), (1, "B")]
    runs = spark.createDataFrame([(r, cv, date(2020, 1, d), "f", float(10 * cv + d)) for r in (0, 1) for cv in (0, 1) for d in (1 + cv, 2 + cv)], "run int, cv int, dt date, factor string, p double")
    files.write_by_fold(runs, f"{tmp_path}/runs", "run", "cv")
    back = files.read_runs(spark, f"{tmp_path}/runs")
    assert {(r["run"], r["cv"]) for r in back.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    one = files.first_fold_wins(back.where("run = 0").select("cv", "dt", "factor", "p"))
    assert {r["dt"].day: r["p"] for r in one.collect()} == {1: 1.0, 2: 2.0, 3: 13.0}
    files.write_wide_csv(spark.createDataFrame([("x", date(2020, 1, 1), 1.0), ("y", date(2020, 1, 1), 2.0), ("x", date(2020, 1, 2), 3.0)], "strategy string, dt date, r double"), f"{tmp_path}/w", ["x", "y"])
    assert files.read_wide_csv(spark, f"{tmp_path}/w", value="r").where("r is not null").count() == 3
    (tmp_path / "b.csv").write_text("asset,market,rc\nA,equity,1\n")
    assert sorted(map(tuple, files.read_budget(spark, str(tmp_path / "b.csv"), [("Z", "crypto", 1)]).collect())) == [("A", "equity", 1), ("Z", "crypto", 1)]


def test_fill_forward_keeps_leading_gaps(spark):
    rows = spark.createDataFrame([("a", date(2020, 1, d), p) for d, p in ((1, None), (2, 5.0), (3, None))], "asset string, dt date, price double")
    assert [r["price"] for r in fill_forward(rows).orderBy("dt").collect()] == [None, 5.0, 5.0]


def test_closing_prices_of_a_stream(spark, tmp_path):
    ticks = spark.createDataFrame([("a", datetime(2020, 1, 1, h), float(h)) for h in (9, 17, 12)], "asset string, ts timestamp, price double")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = closing_prices(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("closes").start()
    query.processAllAvailable()
    query.stop()
    assert [r["price"] for r in spark.sql("select price from closes").collect()] == [17.0]


def test_normal_quantile_and_cdf(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from quantloom.functions.stats import normal_cdf, normal_quantile

    ps = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.05, 0.3, 0.5, 0.95, 0.999)], "p double")
    for r in ps.select("p", normal_quantile(F.col("p")).alias("q"), normal_cdf(normal_quantile(F.col("p"))).alias("c")).collect():
        assert abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-7 and abs(r["c"] - r["p"]) < 1e-6
