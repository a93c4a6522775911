"""Named queries over the canonical tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import allocate, backtest, cluster, encoder, factors, grouped, hedge, hierarchy, inference, risk, selection, shape, spread, volatility
from ..functions import stats
from ..operators import budgets as budget_operators
from ..operators import returns as ret
from ..sources import panel, results
from ..sources.storage import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = """
WITH sales AS (SELECT l.*, n_name AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt FROM lineitem l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
prices AS (SELECT asset, dt, sum(l_extendedprice) / sum(l_quantity) AS price FROM sales GROUP BY ALL),
returns AS (SELECT * FROM (SELECT asset, dt, price / lag(price) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r FROM prices) WHERE r IS NOT NULL),
classes AS (SELECT n_name AS asset, r_name AS market FROM nation JOIN region ON n_regionkey = r_regionkey),
rates AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_discount) / 365 AS rf FROM lineitem GROUP BY 1),
market AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1),
span AS (SELECT CAST(year(min(l_shipdate)) AS INT) AS y0, CAST(year(max(l_shipdate)) AS INT) AS y1, CAST(date_trunc('month', max(l_shipdate)) + INTERVAL 1 MONTH AS DATE) AS stop FROM lineitem),
folds AS (SELECT CAST(y - y0 - 2 AS INT) AS cv, make_date(y0, 1, 1) AS s, make_date(CAST(y - 1 AS INT), 1, 1) AS vs, make_date(CAST(y AS INT), 1, 1) AS ts, least(make_date(CAST(y + 1 AS INT), 1, 1), stop) AS e FROM (SELECT y0, stop, unnest(generate_series(y0 + 2, y1)) AS y FROM span)),
split_prices AS (SELECT cv, asset, dt, price, CASE WHEN dt < vs THEN 'train' WHEN dt < ts THEN 'val' ELSE 'test' END AS split FROM prices JOIN folds ON dt >= s AND dt < e),
split_returns AS (SELECT * FROM (SELECT cv, split, asset, dt, price / lag(price) OVER (PARTITION BY cv, split, asset ORDER BY dt) - 1 AS r FROM split_prices) WHERE r IS NOT NULL),
vols AS (SELECT asset, stddev_samp(r) AS sd, stddev_pop(r) AS sdp, avg(r) AS mean, count(*) AS n FROM returns GROUP BY asset),
shares AS (SELECT asset, factor, v / sum(v) OVER (PARTITION BY asset) AS sh FROM (SELECT asset, CAST(l_partkey % 6 AS INT) AS factor, sum(l_extendedprice) AS v FROM sales GROUP BY ALL)),
loadings AS (SELECT asset, factor, sh / sqrt(sum(sh * sh) OVER (PARTITION BY factor)) AS loading FROM shares),
runs AS (SELECT run, asset, ntile(5) OVER (PARTITION BY run ORDER BY m, asset) - 1 AS label FROM (SELECT year(dt) AS run, asset, round(avg(r), 12) AS m FROM returns GROUP BY ALL)),
class_returns AS (SELECT market AS factor, dt, avg(r) AS r FROM returns JOIN classes USING (asset) GROUP BY ALL),
zs AS (SELECT factor, dt, r, CASE WHEN count(r) OVER w = 12 THEN -avg(r) OVER w / stddev_samp(r) OVER w END AS z FROM class_returns WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
zt AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zs),
zu AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM zt),
probs AS (SELECT factor, dt, r, round(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 6) AS p, CAST(r <= 0 AS INT) AS y FROM zu),
grid AS (SELECT factor, round(top * k / 49, 9) AS t FROM (SELECT factor, max(p) + 1e-6 AS top FROM probs GROUP BY factor), (SELECT unnest(generate_series(0, 49)) AS k)),
forecasts AS (SELECT * FROM (SELECT asset, dt, r, CASE WHEN count(r) OVER w = 12 THEN avg(r) OVER w - 1.645 * stddev_samp(r) OVER w END AS vn, CASE WHEN count(r) OVER w = 12 THEN quantile_cont(r, 0.05) OVER w END AS vh
  FROM returns WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE vn IS NOT NULL),
spreads AS (SELECT asset, dt, r, abs(vh) - abs(vn) AS spread, row_number() OVER (PARTITION BY asset ORDER BY dt) AS rn FROM forecasts),
points AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = BASE + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; a negative zero becomes zero."""
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def nudged(prices: DataFrame) -> DataFrame:
    """Prices are cents over whole numbers and may lie on a rounding tie; a nudge takes them off it."""
    return prices.withColumn("price", F.col("price") + 1e-9)


def R(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def kept_prices(spark: SparkSession, d: str) -> DataFrame:
    """The price panel written once, for queries that use it more than once: the sales are then read and joined once."""
    return materialize(panel.prices(spark, d), "prices")


def kept_returns(spark: SparkSession, d: str) -> DataFrame:
    return materialize(panel.returns(spark, d), "returns")


def kept_probabilities(spark: SparkSession, d: str, returns: DataFrame | None = None) -> DataFrame:
    return materialize(panel.probabilities(spark, d, known=returns), "probabilities")


# Prices and returns


@query("price_panel", f"SELECT asset, dt, {R('price + 1e-9', 'price')} FROM prices")
def price_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nudged(panel.prices(spark, d)))


@query("return_panel", f"SELECT asset, dt, {R('r', 'r')} FROM returns")
def return_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.returns(spark, d))


CALENDAR = ", days AS (SELECT DISTINCT dt FROM prices), cal AS (SELECT a.asset, days.dt, price FROM (SELECT DISTINCT asset FROM prices) a CROSS JOIN days LEFT JOIN prices p ON p.asset = a.asset AND p.dt = days.dt)"


@query("price_panel_ffill", CALENDAR + f" SELECT asset, dt, {R('last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) + 1e-9', 'price')} FROM cal")
def price_panel_ffill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nudged(ret.fill_forward(ret.on_calendar(kept_prices(spark, d)))))


@query("price_panel_bfill", CALENDAR + f" SELECT asset, dt, {R('first_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-9', 'price')} FROM cal")
def price_panel_bfill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nudged(ret.fill_backward(ret.on_calendar(kept_prices(spark, d)))))


@query("risk_free_daily", "SELECT dt, round(rf, 9) AS rf FROM rates")
def risk_free_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.risk_free(spark, d), 9)


@query("excess_returns", f"SELECT asset, dt, {R('r - coalesce(rf, 0)', 'r')} FROM returns LEFT JOIN rates USING (dt)")
def excess_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ret.excess_returns(panel.returns(spark, d), panel.risk_free(spark, d)).select("asset", "dt", "r"))


GROWN = ", grown AS (SELECT asset, dt, r, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS value FROM returns), peaks AS (SELECT *, max(value) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM grown)"


@query("cumulative_return", GROWN + f" SELECT asset, dt, {R('value', 'value')} FROM grown")
def cumulative_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ret.cumulative(panel.returns(spark, d)).select("asset", "dt", "value"))


@query("drawdown_curve", GROWN + f" SELECT asset, dt, {R('peak', 'peak')}, {R('value / peak - 1', 'drawdown')} FROM peaks")
def drawdown_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ret.drawdowns(panel.returns(spark, d)).select("asset", "dt", "peak", "drawdown"))


WORST = ", worst AS (SELECT asset, abs(min(value / peak - 1)) AS mdd, arg_max(value, dt) AS l, arg_min(value, dt) AS f FROM peaks GROUP BY asset)"


@query("max_drawdown", GROWN + WORST + f" SELECT asset, {R('mdd', 'mdd')}, {R('(l / f - 1) / nullif(mdd, 0)', 'calmar')} FROM worst")
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.worst_drawdown(panel.returns(spark, d)))


TAIL = ", cut AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM returns GROUP BY asset), tail AS (SELECT asset, -max(q) AS hist_var, -avg(CASE WHEN r <= q THEN r END) AS hist_es FROM returns JOIN cut USING (asset) GROUP BY asset)"


@query("tail_losses", TAIL + f" SELECT asset, {R('hist_var', 'hist_var')}, {R('hist_es', 'hist_es')} FROM tail")
def tail_losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.tail(kept_returns(spark, d)))


MOMENTS = ", mom AS (SELECT asset, n, mean, sd, sdp, avg(((r - mean) / sdp) ** 3) AS skew, avg(((r - mean) / sdp) ** 4) AS kurt FROM returns JOIN vols USING (asset) GROUP BY asset, n, mean, sd, sdp)"


@query("moments", MOMENTS + f" SELECT asset, n, {R('mean', 'mean')}, {R('sd', 'sd')}, {R('sdp', 'sd_pop')}, {R('skew', 'skew')}, {R('kurt', 'kurt')} FROM mom")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.moments(panel.returns(spark, d)))


@query(
    "backtest_stats",
    GROWN + WORST + TAIL + MOMENTS + f""", net AS (SELECT asset, avg(r - coalesce(rf, 0)) AS net FROM returns LEFT JOIN rates USING (dt) GROUP BY asset), sr AS (SELECT *, mean / sd * sqrt(12) AS sr FROM mom)
SELECT asset, n, {R('mean * 12', 'annual_return')}, {R('sd * sqrt(12)', 'annual_vol')}, {R('sr', 'sharpe')}, {R('sr * (1 + skew / 6 * sr - (kurt - 3) / 24 * sr * sr)', 'adjusted_sharpe')}, {R('net * 12 - 0.5 * sd * sd * 12', 'ceq')},
  {R('hist_var', 'hist_var')}, {R('hist_es', 'hist_es')}, {R('mdd', 'mdd')}, {R('(l / f - 1) / nullif(mdd, 0)', 'calmar')}, {R('skew', 'skew')}, {R('kurt - 3', 'excess_kurtosis')}
FROM sr JOIN net USING (asset) JOIN tail USING (asset) JOIN worst USING (asset)""",
)
def backtest_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.performance(kept_returns(spark, d), panel.risk_free(spark, d)))


PAIRS = ", pairs AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.r, y.r) AS cov, corr(x.r, y.r) AS corr FROM returns x JOIN returns y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY ALL)"


@query("pair_statistics", PAIRS + f" SELECT a, b, {R('cov', 'cov')}, {R('corr', 'corr')}, round(sqrt(greatest(0, round((1 - corr) / 2, 9))), 6) + 0.0 AS distance FROM pairs")
def pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    pairs = risk.pair_statistics(kept_returns(spark, d))
    return rounded(pairs.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), F.round((1 - F.col("corr")) / 2, 9)))))


@query("avg_offdiag_corr_by_fold", f""", fp AS (SELECT x.cv, x.asset AS a, y.asset AS b, corr(x.r, y.r) AS c FROM split_returns x JOIN split_returns y ON x.cv = y.cv AND x.dt = y.dt AND x.asset < y.asset AND x.split = 'train' AND y.split = 'train' GROUP BY ALL)
SELECT cv, {R('avg(c)', 'corr')} FROM fp GROUP BY cv""")  # fmt: skip
def avg_offdiag_corr_by_fold(spark: SparkSession, d: str) -> DataFrame:
    train = split(spark, d).where("split = 'train'")
    a, b = train.select("cv", "dt", F.col("asset").alias("a"), F.col("r").alias("x")), train.select("cv", "dt", F.col("asset").alias("b"), F.col("r").alias("y"))
    pairs = a.join(b, ["cv", "dt"]).where("a < b").groupBy("cv", "a", "b").agg(F.corr("x", "y").alias("c"))
    return rounded(pairs.groupBy("cv").agg(F.avg("c").alias("corr")))


# Weights


@query("w_equal", f", u AS (SELECT DISTINCT asset FROM returns) SELECT 'equal' AS strategy, asset, {R('1.0 / (SELECT count(*) FROM u)', 'w')} FROM u")
def w_equal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.equal(panel.returns(spark, d)))


@query("w_equal_class", f", u AS (SELECT asset, 1.0 / count(*) OVER (PARTITION BY market) AS v FROM classes) SELECT 'equal_class' AS strategy, asset, {R('v / (SELECT sum(v) FROM u)', 'w')} FROM u")
def w_equal_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.equal_class(panel.classes(spark, d)))


@query("w_ivp", f"SELECT 'ivp' AS strategy, asset, {R('1 / sd ** 2 / (SELECT sum(1 / sd ** 2) FROM vols)', 'w')} FROM vols")
def w_ivp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.inverse_risk(panel.returns(spark, d), 2))


@query("w_ivol", f"SELECT 'ivol' AS strategy, asset, {R('1 / sd / (SELECT sum(1 / sd) FROM vols)', 'w')} FROM vols")
def w_ivol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.inverse_risk(panel.returns(spark, d), 1))


@query("w_parity_cvar", TAIL + f" SELECT 'parity_cvar' AS strategy, asset, {R('1 / hist_es / (SELECT sum(1 / hist_es) FROM tail)', 'w')} FROM tail")
def w_parity_cvar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.parity_shortfall(kept_returns(spark, d)))


BUDGET = ", bud AS (SELECT asset, sd, 1.0 / count(*) OVER (PARTITION BY market) / 5 AS b FROM vols JOIN classes USING (asset))"


def budgets(spark: SparkSession, d: str) -> DataFrame:
    return panel.classes(spark, d).select("asset", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("market")) / 5).alias("budget"))


@query("w_rb_corr_0", BUDGET + f" SELECT 'rb_corr_0' AS strategy, asset, {R('sqrt(b) / sd / (SELECT sum(sqrt(b) / sd) FROM bud)', 'w')} FROM bud")
def w_rb_corr_0(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.budgeted(panel.returns(spark, d), budgets(spark, d), 0))


@query("w_rb_corr_1", BUDGET + f" SELECT 'rb_corr_1' AS strategy, asset, {R('b / sd / (SELECT sum(b / sd) FROM bud)', 'w')} FROM bud")
def w_rb_corr_1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.budgeted(panel.returns(spark, d), budgets(spark, d), 1))


BEST = ", best AS (SELECT asset, arg_max(factor, (loading, -factor)) AS factor, max(loading) AS loading FROM loadings WHERE loading >= 0.1 GROUP BY asset)"
FORM = """, gsize AS (SELECT g, count(*) AS size FROM inner_w GROUP BY g), gday AS (SELECT g, dt, sum(w * r) AS r, count(*) AS n FROM returns JOIN inner_w USING (asset) GROUP BY g, dt),
gvar AS (SELECT g, var_samp(r) AS v FROM gday JOIN gsize USING (g) WHERE n = size GROUP BY g)"""


@query("cluster_variance", ", inner_w AS (SELECT market AS g, asset, 1.0 / count(*) OVER (PARTITION BY market) AS w FROM classes)" + FORM + f' SELECT g AS "group", {R("v", "variance")} FROM gvar')
def cluster_variance(spark: SparkSession, d: str) -> DataFrame:
    even = panel.classes(spark, d).select(F.col("market").alias("group"), "asset", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("market"))).alias("w"))
    return rounded(allocate.quadratic_forms(panel.returns(spark, d), even))


@query("w_cluster_parity", ", lab AS (SELECT asset, arg_max(factor, (loading, -factor)) AS g FROM loadings WHERE loading >= 0.01 GROUP BY asset), inner_w AS (SELECT g, asset, 1 / sd / sum(1 / sd) OVER (PARTITION BY g) AS w FROM lab JOIN vols USING (asset))" + FORM + f", raw AS (SELECT asset, w / v AS x FROM inner_w JOIN gvar USING (g)) SELECT 'cluster_parity' AS strategy, asset, {R('x / (SELECT sum(x) FROM raw)', 'w')} FROM raw")
def w_cluster_parity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.cluster_parity(kept_returns(spark, d), allocate.best_factor(panel.loadings(spark, d))))


@query("w_factor_budget", BEST + ", bw AS (SELECT asset, factor AS g, loading * loading / sum(loading * loading) OVER (PARTITION BY factor) / sdp AS v FROM best JOIN vols USING (asset)), inner_w AS (SELECT g, asset, v / sum(v) OVER (PARTITION BY g) AS w FROM bw)" + FORM + f", raw AS (SELECT asset, w / sqrt(v) AS x FROM inner_w JOIN gvar USING (g)) SELECT 'factor_budget' AS strategy, asset, {R('x / (SELECT sum(x) FROM raw)', 'w')} FROM raw")
def w_factor_budget(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.factor_budget(kept_returns(spark, d), panel.loadings(spark, d)))


IVOL = ", wts AS (SELECT asset, 1 / sd / (SELECT sum(1 / sd) FROM vols) AS w FROM vols)"


@query("concentration", IVOL + f" SELECT 'ivol' AS strategy, {R('(count(*) * sum(w * w) - 1) / (count(*) - 1)', 'hhi')}, {R('exp(-sum(w * ln(w)))', 'bets')} FROM wts")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.concentration(allocate.inverse_risk(kept_returns(spark, d), 1)))


@query("portfolio_return", IVOL + f" SELECT 'ivol' AS strategy, dt, {R('sum(w * r)', 'r')} FROM returns JOIN wts USING (asset) GROUP BY dt")
def portfolio_return(spark: SparkSession, d: str) -> DataFrame:
    r = kept_returns(spark, d)
    return rounded(ret.portfolio_returns(r, allocate.inverse_risk(r, 1)))


@query("benchmark_levered", f", m AS (SELECT dt, price / lag(price) OVER (ORDER BY dt) - 1 AS r FROM market) SELECT dt, {R('r * 1.5 + coalesce(rf, 0) * -0.5', 'r')} FROM m LEFT JOIN rates USING (dt) WHERE r IS NOT NULL")
def benchmark_levered(spark: SparkSession, d: str) -> DataFrame:
    market = ret.simple_returns(panel.market_price(spark, d).withColumn("asset", F.lit("market")))
    return rounded(ret.levered(market, panel.risk_free(spark, d), 1.5).select("dt", "r"))


# Folds and the backtest


def split(spark: SparkSession, d: str, prices: DataFrame | None = None) -> DataFrame:
    """Returns by fold and split, written once as most queries use them twice or more."""
    known = panel.prices(spark, d) if prices is None else prices
    return materialize(backtest.split_returns(known, panel.folds(spark, d)), "split-returns")


@query("fold_assignment", "SELECT cv, split, asset, dt FROM split_prices")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return backtest.fold_rows(panel.prices(spark, d), panel.folds(spark, d)).select("cv", "split", "asset", "dt")


@query("fold_standardise", f", f AS (SELECT cv, asset, avg(r) AS m, stddev_pop(r) AS s FROM split_returns WHERE split = 'train' GROUP BY ALL) SELECT cv, split, asset, dt, {R('(r - m) / coalesce(nullif(s, 0), 1)', 'z')} FROM split_returns JOIN f USING (cv, asset)")
def fold_standardise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.standardised(split(spark, d)))


@query("fold_minmax", f", f AS (SELECT cv, asset, min(r) AS lo, max(r) AS hi FROM split_returns WHERE split = 'train' GROUP BY ALL) SELECT cv, split, asset, dt, {R('2 * (r - lo) / nullif(hi - lo, 0) - 1', 'z')} FROM split_returns JOIN f USING (cv, asset)")
def fold_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.min_max(split(spark, d)))


FOLDW = """, fw AS (SELECT cv, asset, v / sum(v) OVER (PARTITION BY cv) AS w FROM (SELECT cv, asset, 1 / stddev_samp(r) AS v FROM split_returns WHERE split = 'train' GROUP BY ALL)),
mv AS (SELECT fw.cv, fw.asset, w / p0.price * p1.price AS v FROM fw JOIN folds USING (cv) JOIN prices p0 ON p0.asset = fw.asset AND p0.dt = folds.ts JOIN prices p1 ON p1.asset = fw.asset AND p1.dt = folds.e - INTERVAL 1 MONTH),
drift AS (SELECT cv, asset, v / sum(v) OVER (PARTITION BY cv) AS w FROM mv),
moves AS (SELECT cv, asset, sum(w) AS own, sum(d) AS d FROM (SELECT cv, asset, w, w AS d FROM fw UNION ALL SELECT cv + 1, asset, 0, -w FROM drift WHERE cv < (SELECT max(cv) FROM fw)) GROUP BY ALL),
turn AS (SELECT cv, sum(abs(d)) AS turnover, sum(own * own) AS sspw FROM moves GROUP BY cv)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(cv, from, to): first and last month of each fold's test."""
    return panel.folds(spark, d).select("cv", F.col("test_start").alias("from"), F.add_months("end", -1).alias("to"))


@query("turnover", FOLDW + f" SELECT cv, {R('turnover', 'turnover')}, {R('sspw', 'sspw')} FROM turn")
def turnover(spark: SparkSession, d: str) -> DataFrame:
    prices = kept_prices(spark, d)
    weights = backtest.fold_weights(split(spark, d, prices))
    return rounded(backtest.turnover(weights, backtest.drifted(weights.join(F.broadcast(spans(spark, d)), "cv"), prices)))


@query("weight_drift", FOLDW + f" SELECT cv, asset, {R('w', 'w')} FROM drift")
def weight_drift(spark: SparkSession, d: str) -> DataFrame:
    prices = kept_prices(spark, d)
    return rounded(backtest.drifted(backtest.fold_weights(split(spark, d, prices)).join(F.broadcast(spans(spark, d)), "cv"), prices))


@query("vol_target_backtest", FOLDW + f""", gross AS (SELECT s.cv, split, dt, sum(w * r) AS gross FROM split_returns s JOIN fw USING (cv, asset) GROUP BY ALL),
recent AS (SELECT cv, gross, row_number() OVER (PARTITION BY cv ORDER BY dt DESC) AS k FROM gross WHERE split = 'train'),
lev AS (SELECT cv, 0.05 / (greatest(stddev_pop(gross) FILTER (k <= 20), stddev_pop(gross) FILTER (k <= 60)) * sqrt(12)) AS leverage FROM recent GROUP BY cv),
test AS (SELECT cv, dt, gross, row_number() OVER (PARTITION BY cv ORDER BY dt) = 1 AS first FROM gross WHERE split = 'test')
SELECT cv, dt, {R('leverage', 'leverage')}, {R('gross', 'gross')}, {R('leverage * gross - CASE WHEN first THEN 0.0002 * turnover * leverage ELSE 0 END - coalesce(rf, 0) * (leverage - 1)', 'r')} FROM test JOIN lev USING (cv) JOIN turn USING (cv) LEFT JOIN rates USING (dt)""")  # fmt: skip
def vol_target_backtest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.vol_target_backtest(kept_prices(spark, d), panel.folds(spark, d), panel.risk_free(spark, d)))


@query("asof_weights", FOLDW + f", rb AS (SELECT asset, ts AS dt, w FROM fw JOIN folds USING (cv)) SELECT g.asset, g.dt, {R('rb.w', 'w')} FROM (SELECT DISTINCT a.asset, p.dt FROM prices p, (SELECT DISTINCT asset FROM rb) a) g ASOF JOIN rb ON g.asset = rb.asset AND g.dt >= rb.dt")
def asof_weights(spark: SparkSession, d: str) -> DataFrame:
    prices = kept_prices(spark, d)
    weights = backtest.fold_weights(split(spark, d, prices)).join(F.broadcast(panel.folds(spark, d).select("cv", F.col("test_start").alias("dt"))), "cv")
    return rounded(ret.carried_weights(weights, prices))


# Clusters and factors


@query("cluster_labels", "SELECT asset, CAST(CASE WHEN max(loading) >= 0.01 THEN arg_max(factor, (loading, -factor)) ELSE 6 END AS INT) AS label FROM loadings GROUP BY asset")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.labels_from_loadings(panel.loadings(spark, d))


@query("consensus_matrix", f"SELECT x.asset AS a, y.asset AS b, {R('count(*) / (SELECT count(DISTINCT run) FROM runs)', 'share')} FROM runs x JOIN runs y ON x.run = y.run AND x.label = y.label AND x.asset <= y.asset GROUP BY ALL")
def consensus_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.consensus(panel.run_labels(spark, d)))


@query("adjusted_rand", f""", cells AS (SELECT x.run AS i, y.run AS j, x.label AS li, y.label AS lj, count(*) AS n FROM runs x JOIN runs y ON x.asset = y.asset AND x.run < y.run GROUP BY ALL),
t AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS idx, sum(n) AS total FROM cells GROUP BY ALL), p AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS p FROM (SELECT i, j, li, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY i, j), q AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS q FROM (SELECT i, j, lj, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY i, j)
SELECT i, j, {R('CASE WHEN (p + q) / 2 = p * q / (total * (total - 1) / 2.0) THEN 1 ELSE (idx - p * q / (total * (total - 1) / 2.0)) / ((p + q) / 2 - p * q / (total * (total - 1) / 2.0)) END', 'ari')} FROM t JOIN p USING (i, j) JOIN q USING (i, j)""")  # fmt: skip
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.adjusted_rand(panel.run_labels(spark, d)).withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long")))


@query("comembership", "SELECT x.asset AS a, y.asset AS b, count(*) AS n FROM loadings x JOIN loadings y ON x.factor = y.factor AND x.asset < y.asset AND x.loading ** 2 >= 0.03 AND y.loading ** 2 >= 0.03 GROUP BY ALL")
def comembership(spark: SparkSession, d: str) -> DataFrame:
    return cluster.comembership(panel.loadings(spark, d), 0.03)


DIST = ", dist AS (SELECT x.asset AS a, y.asset AS b, sqrt(sum((x.r - y.r) ** 2)) AS d FROM returns x JOIN returns y ON x.dt = y.dt AND x.asset < y.asset GROUP BY ALL)"


@query("pair_distance", DIST + f" SELECT a, b, {R('d', 'd')} FROM dist")
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.distances(kept_returns(spark, d)))


@query("silhouette", DIST + f""", lab AS (SELECT asset, arg_max(factor, (loading, -factor)) AS label FROM loadings GROUP BY asset), both_ways AS (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist),
m AS (SELECT a, x.label AS la, y.label AS lb, avg(d) AS d FROM both_ways JOIN lab x ON x.asset = a JOIN lab y ON y.asset = b GROUP BY ALL), s AS (SELECT a, max(d) FILTER (la = lb) AS x, min(d) FILTER (la <> lb) AS y FROM m GROUP BY a)
SELECT a AS asset, {R('CASE WHEN x IS NULL THEN 0 ELSE (y - x) / greatest(x, y) END', 's')} FROM s""")  # fmt: skip
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.silhouette(cluster.distances(kept_returns(spark, d)), cluster.labels_from_loadings(panel.loadings(spark, d))))


@query("cluster_inertia", "SELECT label, max(n) AS n, round(sum(ss), 4) AS inertia FROM (SELECT label, i, count(*) AS n, sum(v * v) - sum(v) * sum(v) / count(*) AS ss FROM points GROUP BY label, i) GROUP BY label")
def cluster_inertia(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.inertia(panel.points(spark, d)), 4)


SCORES = ", sc AS (SELECT dt, factor, sum(r * loading) AS score FROM returns JOIN loadings USING (asset) GROUP BY ALL), fit AS (SELECT dt, asset, sum(score * loading) AS fit FROM sc JOIN loadings USING (factor) GROUP BY ALL)"


@query("factor_scores", SCORES + f" SELECT dt, factor, {R('score', 'score')} FROM sc")
def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.scores(panel.returns(spark, d), panel.loadings(spark, d)))


@query("reconstruction", SCORES + f" SELECT dt, asset, {R('fit', 'fit')} FROM fit")
def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    loads = panel.loadings(spark, d)
    return rounded(factors.reconstruction(factors.scores(panel.returns(spark, d), loads), loads))


@query("total_r2", SCORES + f" SELECT asset, {R('1 - sum((r - fit) ** 2) / sum(r * r)', 'r2')}, {R('sqrt(avg((r - fit) ** 2))', 'rmse')} FROM returns JOIN fit USING (dt, asset) GROUP BY asset")
def total_r2(spark: SparkSession, d: str) -> DataFrame:
    r, loads = kept_returns(spark, d), panel.loadings(spark, d)
    return rounded(factors.fit_quality(r, factors.reconstruction(factors.scores(r, loads), loads)))


@query("factor_match", f""", ref AS (SELECT asset, CAST(5 - factor AS INT) AS factor, loading FROM loadings), d AS (SELECT l.factor, ref.factor AS match, round(sqrt(sum((l.loading - ref.loading) ** 2)), 12) AS d FROM loadings l JOIN ref USING (asset) GROUP BY ALL)
SELECT factor, match, {R('d', 'd')} FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY d, match) AS k FROM d) WHERE k = 1""")  # fmt: skip
def factor_match(spark: SparkSession, d: str) -> DataFrame:
    loads = panel.loadings(spark, d)
    return rounded(cluster.match_factors(loads, loads.withColumn("factor", (5 - F.col("factor")).cast("int"))))


# Hedging


@query("tail_probability", "SELECT factor, dt, p, y FROM probs")
def tail_probability(spark: SparkSession, d: str) -> DataFrame:
    return panel.probabilities(spark, d).select("factor", "dt", "p", "y")


CALIB = ", err AS (SELECT factor, t, round(abs(avg(y) - avg(CAST(p >= t AS DOUBLE))), 9) AS err FROM probs JOIN grid USING (factor) GROUP BY ALL), cal AS (SELECT factor, t, err FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY err, t) AS k FROM err) WHERE k = 1)"


@query("calibrated_threshold", CALIB + f" SELECT factor, {R('t', 't')}, {R('err', 'err')} FROM cal")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.calibrated(kept_probabilities(spark, d)))


@query("excess_threshold", f""", gain AS (SELECT factor, t, round(sum((CAST(coalesce(p < t, false) AS INT) - 1) * r), 9) AS gain FROM probs JOIN grid USING (factor) GROUP BY ALL)
SELECT factor, {R('t', 't')}, {R('gain', 'gain')} FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY gain DESC, t DESC) AS k FROM gain) WHERE k = 1""")  # fmt: skip
def excess_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.excess_gain(kept_probabilities(spark, d)))


ROC = ", cnt AS (SELECT factor, p, sum(y) AS pos, sum(1 - y) AS neg FROM probs WHERE p IS NOT NULL GROUP BY ALL), roc AS (SELECT factor, p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY factor) AS tpr, sum(neg) OVER w / sum(neg) OVER (PARTITION BY factor) AS fpr FROM cnt WINDOW w AS (PARTITION BY factor ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query("roc_points", ROC + f" SELECT factor, p, {R('tpr', 'tpr')}, {R('fpr', 'fpr')} FROM roc")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.roc(panel.probabilities(spark, d)))


@query("roc_auc", ROC + f", seg AS (SELECT factor, (fpr - lag(fpr, 1, 0) OVER w) * (tpr + lag(tpr, 1, 0) OVER w) / 2 AS a FROM roc WINDOW w AS (PARTITION BY factor ORDER BY p DESC)) SELECT factor, {R('sum(a)', 'auc')} FROM seg GROUP BY factor")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.auc(hedge.roc(panel.probabilities(spark, d))))


@query("roc_threshold", ROC + f", dd AS (SELECT factor, p, round(fpr ** 2 + (tpr - 1) ** 2, 9) AS d FROM roc) SELECT factor, p AS t, {R('d', 'd')} FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY d, p DESC) AS k FROM dd) WHERE k = 1")
def roc_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.roc_threshold(hedge.roc(panel.probabilities(spark, d))))


SIGNAL = ", sig AS (SELECT factor, dt, CAST(coalesce(p < t, false) AS INT) AS signal FROM probs JOIN cal USING (factor))"


@query("hedge_signal", CALIB + SIGNAL + " SELECT * FROM sig")
def hedge_signal(spark: SparkSession, d: str) -> DataFrame:
    probs = kept_probabilities(spark, d)
    return hedge.signals(probs, hedge.calibrated(probs))


@query("hedged_return", CALIB + SIGNAL + IVOL + f" SELECT returns.dt, {R('sum(w * r)', 'unhedged')}, {R('sum(w * coalesce(signal, 0) * returns.r)', 'hedged')} FROM returns JOIN wts USING (asset) LEFT JOIN classes USING (asset) LEFT JOIN sig ON sig.factor = market AND sig.dt = returns.dt GROUP BY returns.dt")
def hedged_return(spark: SparkSession, d: str) -> DataFrame:
    r = kept_returns(spark, d)
    probs = kept_probabilities(spark, d, r)
    groups = panel.classes(spark, d).select("asset", F.col("market").alias("factor"))
    return rounded(hedge.hedged_returns(r, allocate.inverse_risk(r, 1).drop("strategy"), groups, hedge.signals(probs, hedge.calibrated(probs))))


@query("mean_excess", f""", q AS (SELECT event_type AS key, quantile_cont(value, 0.9) AS a, quantile_cont(value, 0.999) AS b FROM events GROUP BY 1), g AS (SELECT key, k, round(a + (b - a) * k / 99, 9) AS u FROM q, (SELECT CAST(unnest(generate_series(0, 99)) AS INT) AS k))
SELECT key, k, {R('u', 'u')}, {R('avg(CASE WHEN value >= u THEN value - u END)', 'excess')}, {R('avg(CAST(value >= u AS DOUBLE))', 'share')} FROM events JOIN g ON event_type = key GROUP BY key, k, u""")  # fmt: skip
def mean_excess(spark: SparkSession, d: str) -> DataFrame:
    losses = panel.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("x"))
    return rounded(hedge.mean_excess(losses))


# Spread of value-at-risk forecasts


def spreads(spark: SparkSession, d: str) -> DataFrame:
    return panel.var_forecasts(spark, d).select("asset", "dt", "r", (F.abs("var_hist") - F.abs("var_norm")).alias("spread"))


TREND = ", tr AS (SELECT asset, dt, r, spread, CASE WHEN count(spread) OVER w = {p} THEN regr_slope(spread, rn) OVER w END AS beta, avg(spread) OVER w AS m FROM spreads WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING))"
LEVEL = ", lv AS (SELECT *, avg(greatest(beta, 0)) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS level FROM tr WHERE beta IS NOT NULL)"


@query("rolling_ols", TREND.format(p=5) + f" SELECT asset, dt, {R('beta', 'beta')}, {R('m - beta * 3', 'alpha')} FROM tr WHERE beta IS NOT NULL")
def rolling_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spread.rolling_trend(spreads(spark, d), 5).where("beta is not null").select("asset", "dt", "beta", "alpha"))


@query("spread_signal", TREND.format(p=5) + LEVEL + f" SELECT asset, dt, {R('level', 'level')}, CAST(round(beta, 12) >= round(level, 12) AS INT) AS label FROM lv")
def spread_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spread.spread_signal(spread.rolling_trend(spreads(spark, d), 5)).select("asset", "dt", "level", "label"))


@query("target_vol_optimality", f""", v AS (SELECT asset, dt, r, greatest(CASE WHEN count(r) OVER a = 22 THEN stddev_samp(r) OVER a ELSE 0 END, CASE WHEN count(r) OVER b = 60 THEN stddev_samp(r) OVER b ELSE 0 END) AS vol FROM returns
  WINDOW a AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 21 PRECEDING AND CURRENT ROW), b AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
l AS (SELECT asset, r, lag(vol) OVER (PARTITION BY asset ORDER BY dt) AS b FROM v WHERE vol > 0) SELECT asset, {R('covar_samp(r / b, b)', 'cov')} FROM l WHERE b IS NOT NULL GROUP BY asset""")  # fmt: skip
def target_vol_optimality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.volatility_timing(panel.returns(spark, d)))


WINDOWS, FACTORS = [3, 4, 5, 6, 8, 10, 12, 16, 20], [k / 20 for k in range(41)]
GRID_SQL = ", tr AS (" + " UNION ALL ".join(f'SELECT asset, dt, r, {p} AS "window", CASE WHEN count(spread) OVER w{p} = {p} THEN regr_slope(spread, rn) OVER w{p} END AS beta FROM spreads WINDOW w{p} AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING)' for p in WINDOWS) + f"""),
lv AS (SELECT *, avg(greatest(beta, 0)) OVER (PARTITION BY asset, "window" ORDER BY dt ROWS UNBOUNDED PRECEDING) AS level FROM tr WHERE beta IS NOT NULL),
gains AS (SELECT asset, "window", q, round(sum(CASE WHEN round(beta, 12) >= round(q * level, 12) THEN -r ELSE 0 END), 9) AS gain FROM lv, (SELECT unnest(generate_series(0, 40)) / 20 AS q) GROUP BY ALL)
SELECT asset, "window", {R('q', 'q')}, {R('gain', 'gain')} FROM gains QUALIFY row_number() OVER (PARTITION BY asset ORDER BY gain DESC, "window", q) = 1"""


@query("spread_grid", GRID_SQL)
def spread_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spread.best_parameters(spreads(spark, d), WINDOWS, FACTORS))


@query("sharpe_inference", MOMENTS + f""", s AS (SELECT *, mean / sd AS sr, 1 + 0.5 * (mean / sd) ** 2 - skew * mean / sd + (kurt - 3) / 4 * (mean / sd) ** 2 AS sp FROM mom), z AS (SELECT *, sqrt(sp / (n - 1)) AS sr_sd, sr / sqrt(sp / (n - 1)) AS z FROM s),
zz AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), zv AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM zz)
SELECT asset, {R('sr', 'sr')}, {R('sr_sd', 'sr_sd')}, {R('CASE WHEN z >= 0 THEN 1 - u ELSE u END', 'psr')}, {R('1 + sp * (1.6448536269514715 / sr) ** 2', 'min_trl')} FROM zv""")  # fmt: skip
def sharpe_inference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.sharpe_inference(panel.returns(spark, d)))


# Grouped numeric operators (no SQL form; tested on cases with known answers)


def filled_split(spark: SparkSession, d: str, grain: str = "month") -> DataFrame:
    """Returns by fold and split of prices without gaps, so that all pairs of assets have the same dates."""
    filled = ret.fill_backward(ret.fill_forward(ret.on_calendar(materialize(panel.prices(spark, d, grain), "prices"))))
    return materialize(backtest.split_returns(filled, panel.folds(spark, d)), "split-returns")


@query("w_covariance")
def w_covariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.covariance_weights(grouped.fold_covariances(filled_split(spark, d))))


@query("torsion_bets")
def torsion_bets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.torsion_bets(grouped.fold_covariances(filled_split(spark, d))))


@query("nmf_convex")
def nmf_convex(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.fold_factors(filled_split(spark, d)))


@query("nmf_semi")
def nmf_semi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.fold_factors(filled_split(spark, d), convex=False))


@query("spline_impute")
def spline_impute(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.spline_filled(ret.on_calendar(kept_prices(spark, d))))


@query("garch_proba")
def garch_proba(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.rolling_probabilities(panel.class_returns(spark, d)))


@query("evt_tail")
def evt_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.tail_fit(panel.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("x"))))


#: Returns of all nations on the same dates, and of the market as their benchmark, numbered by date.
SAME_DATES = CALENDAR + """, fl AS (SELECT asset, dt, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS f FROM cal),
fb AS (SELECT asset, dt, coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM fl UNION ALL SELECT 'market', dt, price FROM market),
fr AS (SELECT asset, dt, price / lag(price) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r FROM fb), nb AS (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY dt) - 1 AS rn FROM fr WHERE r IS NOT NULL),
cnt AS (SELECT count(*) AS n FROM nb WHERE asset = 'market'), par AS (SELECT n, greatest(5, ceil(sqrt(log10(n)))) AS run, least(n - 1, ceil(sqrt(n)) + greatest(5, ceil(sqrt(log10(n))))) AS lags, ceil(least(3 * sqrt(n), n / 3)) AS most, 2 * sqrt(log10(n) / n) AS noise FROM cnt),
ce AS (SELECT asset, rn, r - avg(r) OVER (PARTITION BY asset) AS e FROM nb), ac AS (SELECT x.asset, y.rn - x.rn AS k, sum(x.e * y.e) / max(n) AS cov FROM ce x JOIN ce y ON x.asset = y.asset AND y.rn >= x.rn JOIN par ON y.rn - x.rn <= lags GROUP BY ALL),
ld AS (SELECT asset, k, cov, k > 0 AND abs(cov / nullif(first_value(cov) OVER (PARTITION BY asset ORDER BY k), 0)) >= noise AS loud FROM ac, par),
qt AS (SELECT asset, k, loud, sum(CASE WHEN loud THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS quiet FROM ld),
ct AS (SELECT asset, greatest(1, coalesce(min(k) FILTER (quiet = run), max(k) FILTER (loud), 1)) AS cut FROM qt, par GROUP BY asset),
ws AS (SELECT asset, cut, CASE WHEN k > 0 THEN 2 ELSE 1 END * greatest(0, least(1, 2 * (1 - k / least(2 * cut, lags)))) * cov AS v, k FROM ac JOIN ct USING (asset), par),
bl AS (SELECT asset, cut, greatest(1, least(max(most), coalesce(cbrt((sum(v * k) / nullif(sum(v), 0)) ** 2 * max(n)), 1))) AS block FROM ws, par GROUP BY asset, cut)"""


def same_dates(spark: SparkSession, d: str) -> DataFrame:
    """(asset, dt, r) of all nations and of the market, on the dates that any nation has."""
    filled = ret.fill_backward(ret.fill_forward(ret.on_calendar(kept_prices(spark, d))))
    market = panel.market_price(spark, d).select(F.lit("market").alias("asset"), "dt", "price")
    return ret.simple_returns(filled.select("asset", "dt", "price").unionByName(market))


@query("block_lengths", SAME_DATES + f" SELECT asset, CAST(cut AS INT) AS cut, {R('block', 'block')} FROM bl")
def block_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(inference.numbered(same_dates(spark, d)), "numbered-returns")
    return rounded(inference.block_lengths(rows, rows.where("asset = 'market'").count()))


def draws_sql(replicates: int, seed: int = 5) -> str:
    """The dates that each replicate draws, in SQL."""
    u = lambda kind: f"(CAST('0x' || substr(md5('{seed},{kind},' || b || ',' || t), 1, 8) AS BIGINT) / 4294967296.0)"
    return f""", avgb AS (SELECT avg(block) AS block FROM bl), plc AS (SELECT b, t FROM (SELECT CAST(unnest(generate_series(0, {replicates - 1})) AS INT) AS b), (SELECT DISTINCT CAST(rn AS INT) AS t FROM nb)),
flg AS (SELECT b, t, CASE WHEN t = 0 OR {u('new')} < 1 / block THEN floor({u('start')} * n) - t END AS shift FROM plc, avgb, cnt),
idx AS (SELECT b, t, (last_value(shift IGNORE NULLS) OVER (PARTITION BY b ORDER BY t ROWS UNBOUNDED PRECEDING) + t) % n AS rn FROM flg, cnt), drawn AS (SELECT b, t, asset, r FROM idx JOIN nb USING (rn))"""


#: Statistics of a series by the rows that ``by`` tells apart, as in ``inference.statistics``.
VALUE_SQL = {
    "mean": "SELECT {by}, avg(r) AS v FROM {rows} GROUP BY {by}",
    "sharpe": "SELECT {by}, avg(r) / nullif(stddev_samp(r), 0) AS v FROM {rows} GROUP BY {by}",
    "drawdown": "SELECT {by}, min(exp(l - p) - 1) AS v FROM (SELECT *, max(l) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *, sum(ln(greatest(1 + r, 1e-300))) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS l FROM {rows})) GROUP BY {by}",
}


def test_sql(statistic: str, replicates: int = 1000) -> str:
    """The reality check against the market and Hansen's test in SQL."""
    value = VALUE_SQL[statistic]
    return SAME_DATES + draws_sql(replicates) + f""", one AS (SELECT asset, rn AS t, r FROM nb), v0 AS ({value.format(by='asset', rows='one')}), v1 AS ({value.format(by='b, asset', rows='drawn')}),
f0 AS (SELECT asset, coalesce(v, 0) - (SELECT coalesce(v, 0) FROM v0 WHERE asset = 'market') AS f FROM v0 WHERE asset <> 'market'),
f1 AS (SELECT x.b, x.asset, coalesce(x.v, 0) - coalesce(y.v, 0) AS g FROM v1 x JOIN v1 y ON x.b = y.b AND y.asset = 'market' AND x.asset <> 'market'),
dv AS (SELECT asset, sqrt(max(n)) * stddev_pop(g) AS dev FROM f1, cnt GROUP BY asset), kn AS (SELECT asset, f, dev, CASE WHEN sqrt(n) * f >= -dev * sqrt(2 * ln(ln(n))) THEN f ELSE 0 END AS c FROM f0 JOIN dv USING (asset), cnt),
bs AS (SELECT arg_max(asset, (f, asset)) AS strategy, sqrt(max(n)) * max(f) AS t, greatest(0, max(coalesce(sqrt(n) * f / nullif(dev, 0), 0))) AS ts FROM kn, cnt),
tp AS (SELECT b, sqrt(max(n)) * max(g - f) AS t1, greatest(0, max(coalesce(sqrt(n) * (g - c) / nullif(dev, 0), 0))) AS t2 FROM f1 JOIN kn USING (asset), cnt GROUP BY b)
SELECT strategy, {R('max(t)', 'statistic')}, {R('(SELECT block FROM avgb)', 'block')}, {R('avg(CAST(t1 > t AS DOUBLE))', 'p_value')}, {R('avg(CAST(t2 > ts AS DOUBLE))', 'p_spa')} FROM tp, bs GROUP BY strategy"""


@query("reality_check", test_sql("sharpe"))
def reality_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.superiority(same_dates(spark, d), benchmark="market"))


@query("reality_check_mean", test_sql("mean"))
def reality_check_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.superiority(same_dates(spark, d), benchmark="market", statistic="mean"))


@query("reality_check_drawdown", test_sql("drawdown"))
def reality_check_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.superiority(same_dates(spark, d), benchmark="market", statistic="drawdown"))


@query("mc_study")
def mc_study(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.monte_carlo(same_dates(spark, d).where("asset <> 'market'"), grouped.RULES))


@query("block_permutation")
def block_permutation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.permuted_blocks(panel.returns(spark, d)))


def cdf_sql(z: str) -> str:
    """The normal distribution of ``stats.normal_cdf`` in SQL."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    u = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {u} ELSE {u} END"


def quantile_sql(p: str) -> str:
    """The normal quantile of ``stats.normal_quantile`` in SQL."""

    def horner(x: str, coefficients: tuple[float, ...]) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    t, q = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))", f"(({p}) - 0.5)"
    tail, centre = f"{horner(t, stats.TAIL_TOP)} / {horner(t, stats.TAIL_BOTTOM)}", f"{q} * {horner(f'({q} * {q})', stats.CENTRE_TOP)} / {horner(f'({q} * {q})', stats.CENTRE_BOTTOM)}"
    return f"CASE WHEN least({p}, 1 - ({p})) >= 0.02425 THEN {centre} WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END"


DEFLATED = MOMENTS + PAIRS + f""", sr AS (SELECT asset, n, skew, kurt, mean / sd AS sr FROM mom), t AS (SELECT avg(sr) AS m, stddev_samp(sr) AS s, greatest(2, (SELECT avg(corr) FROM pairs WHERE a < b) + (1 - (SELECT avg(corr) FROM pairs WHERE a < b)) * count(*)) AS trials FROM sr),
q AS (SELECT m, s, trials, 1 - 1 / trials AS p1, 1 - 1 / (trials * 2.718281828459045) AS p2 FROM t), best AS (SELECT trials, m + s * ((1 - 0.5772156649015329) * ({quantile_sql('p1')}) + 0.5772156649015329 * ({quantile_sql('p2')})) AS expected_max FROM q),
z AS (SELECT asset, sr, trials, expected_max, (sr - expected_max) / sqrt((1 + 0.5 * sr * sr - skew * sr + (kurt - 3) / 4 * sr * sr) / (n - 1)) AS z FROM sr, best)
SELECT asset, {R('sr', 'sr')}, {R('trials', 'trials')}, {R('expected_max', 'expected_max')}, {R(cdf_sql('z'), 'dsr')} FROM z"""


@query("deflated_sharpe", DEFLATED)
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.deflated_sharpe(kept_returns(spark, d)))


@query("factor_risk")
def factor_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.factor_risk(grouped.fold_covariances(filled_split(spark, d)), panel.loadings(spark, d)))


@query("efficient_frontier")
def efficient_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = filled_split(spark, d)
    means = rows.where("split = 'train'").groupBy("cv", "asset").agg(F.avg("r").alias("m"))
    return rounded(grouped.frontier(grouped.fold_covariances(rows), means))


def whole_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = same_dates(spark, d).where("asset <> 'market'").select(F.lit(0).alias("cv"), "asset", "dt", "r")
    return selection.silhouette_curve(rows).drop("cv")


@query("cluster_selection")
def cluster_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole_curve(spark, d))


@query("cluster_choice")
def cluster_choice(spark: SparkSession, d: str) -> DataFrame:
    return grouped.chosen_clusters(materialize(whole_curve(spark, d), "silhouette-curve"))


# Filters, alignments and small transforms


@query("rolling_mean", f"SELECT asset, dt, {R('m', 'mean')} FROM (SELECT asset, dt, CASE WHEN count(r) OVER w = 3 THEN avg(r) OVER w END AS m FROM returns WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shape.rolling_mean(panel.returns(spark, d), 3).select("asset", "dt", "mean"))


@query("trimmed_returns", f", cut AS (SELECT asset, quantile_cont(r, 0.05) AS a, quantile_cont(r, 0.95) AS b FROM returns GROUP BY asset) SELECT asset, dt, {R('r', 'r')} FROM returns JOIN cut USING (asset) WHERE r BETWEEN a AND b")
def trimmed_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shape.trimmed(kept_returns(spark, d)))


@query("first_order", "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_order(spark: SparkSession, d: str) -> DataFrame:
    return shape.first_rows(panel.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("without_last_row", f"SELECT asset, dt, {R('price + 1e-9', 'price')} FROM prices QUALIFY row_number() OVER (PARTITION BY asset ORDER BY dt DESC) > 1")
def without_last_row(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nudged(shape.without_last(kept_prices(spark, d), "asset")))


@query("aligned_series", f", early AS (SELECT dt, price FROM market WHERE dt < DATE '2000-01-01'), late AS (SELECT dt, rf FROM rates WHERE dt >= DATE '1997-01-01') SELECT dt, {R('price + 1e-9', 'price')}, {R('rf', 'rf')} FROM early FULL JOIN late USING (dt)")
def aligned_series(spark: SparkSession, d: str) -> DataFrame:
    early, late = panel.market_price(spark, d).where("dt < date'2000-01-01'"), panel.risk_free(spark, d).where("dt >= date'1997-01-01'")
    return rounded(nudged(shape.aligned(early, late)))


@query("newer_rows", f", seen AS (SELECT asset, max(dt) AS last FROM prices WHERE dt < DATE '2000-01-01' AND asset <> 'FRANCE' GROUP BY asset) SELECT asset, dt, {R('price + 1e-9', 'price')} FROM prices LEFT JOIN seen USING (asset) WHERE last IS NULL OR dt > last")
def newer_rows(spark: SparkSession, d: str) -> DataFrame:
    prices = kept_prices(spark, d)
    return rounded(nudged(shape.newer(prices, prices.where("dt < date'2000-01-01' and asset <> 'FRANCE'"), "asset")))


DAYS = ", ordered AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders), shipped AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem)"


def days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return panel.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt")), panel.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt"))


@query("dates_of_either", DAYS + " SELECT dt FROM ordered UNION SELECT dt FROM shipped")
def dates_of_either(spark: SparkSession, d: str) -> DataFrame:
    return shape.dates_of_either(*days(spark, d))


@query("dates_of_first_only", DAYS + " SELECT dt FROM shipped EXCEPT SELECT dt FROM ordered")
def dates_of_first_only(spark: SparkSession, d: str) -> DataFrame:
    return shape.dates_of_first_only(*reversed(days(spark, d)))


@query("hour_in_week", "SELECT round(sin((24 * (isodow(ts) - 1) + hour(ts)) * (2 * 3.141592653589793 / 168)), 4) + 0.0 AS place, count(*) AS n FROM events GROUP BY 1")
def hour_in_week(spark: SparkSession, d: str) -> DataFrame:
    place = shape.hour_in_week(F.col("ts")) + F.lit(0.0)
    return panel.table(spark, d, "events").groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("value_columns", f"SELECT asset, dt, {R('vn', 'var_norm')}, {R('vh', 'var_hist')} FROM forecasts")
def value_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shape.columns_where(panel.var_forecasts(spark, d), lambda c: "var_" in c, ["asset", "dt"]))


@query("averaged_weights", f", y AS (SELECT year(dt) AS run, asset, 1 / stddev_samp(r) AS v FROM returns GROUP BY ALL), n AS (SELECT run, asset, v / sum(v) OVER (PARTITION BY run) AS w FROM y WHERE v IS NOT NULL) SELECT asset, {R('sum(w) / (SELECT count(DISTINCT run) FROM n)', 'w')} FROM n GROUP BY asset")
def averaged_weights(spark: SparkSession, d: str) -> DataFrame:
    sd = panel.returns(spark, d).groupBy(F.year("dt").alias("run"), "asset").agg((1 / F.stddev_samp("r")).alias("v")).where("v is not null")
    return rounded(shape.averaged(sd.select("run", "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("run"))).alias("w"))))


@query("balance", IVOL + f", pr AS (SELECT dt, sum(w * r) AS r FROM returns JOIN wts USING (asset) GROUP BY dt) SELECT 'ivol' AS strategy, dt, {R('ln(1000 * (1 - 0.0002)) + sum(ln(1 + r)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)', 'log_balance')} FROM pr")
def balance(spark: SparkSession, d: str) -> DataFrame:
    r = kept_returns(spark, d)
    kept = shape.balance(ret.portfolio_returns(r, allocate.inverse_risk(r, 1)))
    return rounded(kept.select("strategy", "dt", F.log("balance").alias("log_balance")))


@query("covariance_accuracy", f""", tp AS (SELECT x.cv, x.asset AS a, y.asset AS b, covar_samp(x.r, y.r) FILTER (x.split = 'train') AS c0, covar_samp(x.r, y.r) FILTER (x.split = 'test') AS c1 FROM split_returns x JOIN split_returns y ON x.cv = y.cv AND x.split = y.split AND x.dt = y.dt AND x.split <> 'val' GROUP BY ALL)
SELECT cv, {R('sum(abs(c1 - c0)) / sum(abs(c0))', 'l1')}, {R('avg(CAST(sign(c0) = sign(c1) AS INT))', 'sign')} FROM tp WHERE c0 IS NOT NULL AND c1 IS NOT NULL GROUP BY cv""")  # fmt: skip
def covariance_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shape.covariance_accuracy(split(spark, d)))


@query("fold_inverse", f"SELECT cv, split, asset, dt, {R('r', 'r')} FROM split_returns")
def fold_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = split(spark, d)
    return rounded(backtest.unscaled(backtest.standardised(rows), backtest.fitted_scaler(rows)))


@query("tail_counts", "SELECT dt, CAST(sum(y) AS BIGINT) AS n FROM probs GROUP BY dt")
def tail_counts(spark: SparkSession, d: str) -> DataFrame:
    return panel.probabilities(spark, d).groupBy("dt").agg(F.sum("y").alias("n"))


@query("w_cluster_equal", f", lab AS (SELECT asset, arg_max(factor, (loading, -factor)) AS g FROM loadings WHERE loading >= 0.01 GROUP BY asset), u AS (SELECT asset, 1.0 / count(*) OVER (PARTITION BY g) AS v FROM lab) SELECT 'cluster_equal' AS strategy, asset, {R('v / (SELECT sum(v) FROM u)', 'w')} FROM u")
def w_cluster_equal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocate.cluster_equal(allocate.best_factor(panel.loadings(spark, d))))


@query("rank_distance", f""", rk AS (SELECT asset, dt, rank() OVER (PARTITION BY asset ORDER BY r) AS k FROM returns), rp AS (SELECT x.asset AS a, y.asset AS b, corr(x.k, y.k) AS corr FROM rk x JOIN rk y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY ALL)
SELECT a, b, {R('corr', 'corr')}, round(sqrt(greatest(0, round((1 - corr) / 2, 9))), 6) + 0.0 AS distance FROM rp""")  # fmt: skip
def rank_distance(spark: SparkSession, d: str) -> DataFrame:
    pairs = risk.rank_statistics(kept_returns(spark, d))
    return rounded(pairs.select("a", "b", "corr", F.sqrt(F.greatest(F.lit(0.0), F.round((1 - F.col("corr")) / 2, 9))).alias("distance")))


# Hedging by fold: thresholds from train rows, signals on test rows

FOLD_PROBS = """, fp AS (SELECT cv, factor, dt, r, p, y, CASE WHEN dt < vs THEN 'train' WHEN dt < ts THEN 'val' ELSE 'test' END AS split FROM probs JOIN folds ON dt >= s AND dt < e),
fgrid AS (SELECT cv, factor, round(top * k / 49, 9) AS t FROM (SELECT cv, factor, max(p) + 1e-6 AS top FROM fp WHERE split = 'train' GROUP BY ALL), (SELECT unnest(generate_series(0, 49)) AS k)),
ferr AS (SELECT cv, factor, t, round(abs(avg(y) - avg(CAST(p >= t AS DOUBLE))), 9) AS err FROM fp JOIN fgrid USING (cv, factor) WHERE split = 'train' GROUP BY ALL),
fcal AS (SELECT cv, factor, t FROM ferr QUALIFY row_number() OVER (PARTITION BY cv, factor ORDER BY err, t) = 1),
fsig AS (SELECT cv, factor, dt, r, CAST(coalesce(p < t, false) AS INT) AS signal FROM fp JOIN fcal USING (cv, factor) WHERE split = 'test')"""


def fold_signals(spark: SparkSession, d: str) -> DataFrame:
    return hedge.fold_signals(backtest.fold_rows(kept_probabilities(spark, d), panel.folds(spark, d)))


@query("fold_signal", FOLD_PROBS + " SELECT cv, factor, dt, signal FROM fsig")
def fold_signal(spark: SparkSession, d: str) -> DataFrame:
    return fold_signals(spark, d).select("cv", "factor", "dt", "signal")


@query("fold_hedged", FOLD_PROBS + f" SELECT cv, dt, {R('avg(r)', 'unhedged')}, {R('avg(signal * r)', 'hedged')} FROM fsig GROUP BY cv, dt")
def fold_hedged(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fold_signals(spark, d).groupBy("cv", "dt").agg(F.avg("r").alias("unhedged"), F.avg(F.col("signal") * F.col("r")).alias("hedged")))


@query("random_signals")
def random_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hedge.shuffled_signals(fold_signals(spark, d), 100))


@query("rolling_ols_inclusive", ", tr AS (SELECT asset, dt, CASE WHEN count(spread) OVER w = 5 THEN regr_slope(spread, rn) OVER w END AS beta, avg(spread) OVER w AS m FROM spreads WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))" + f" SELECT asset, dt, {R('beta', 'beta')}, {R('m - beta * 3', 'alpha')} FROM tr WHERE beta IS NOT NULL")
def rolling_ols_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spread.rolling_trend(spreads(spark, d), 5, inclusive=True).where("beta is not null").select("asset", "dt", "beta", "alpha"))


# A portfolio held from outside, with the changes of its first fold counted from ones

OUTSIDE = FOLDW.replace("SELECT cv, asset, v / sum(v) OVER (PARTITION BY cv) AS w FROM (SELECT cv, asset, 1 / stddev_samp(r) AS v FROM split_returns WHERE split = 'train' GROUP BY ALL)", "SELECT cv, asset, 1.0 / count(*) OVER (PARTITION BY cv, market) / 5 AS w FROM folds, classes").replace("FROM drift WHERE cv < (SELECT max(cv) FROM fw)", "FROM drift WHERE cv < (SELECT max(cv) FROM fw) UNION ALL SELECT cv, asset, 0, -1.0 FROM fw WHERE cv = (SELECT min(cv) FROM fw)")
OUTSIDE_RUN = f""", gross AS (SELECT s.cv, split, dt, sum(w * r) AS gross FROM split_returns s JOIN fw USING (cv, asset) GROUP BY ALL),
recent AS (SELECT cv, gross, row_number() OVER (PARTITION BY cv ORDER BY dt DESC) AS k FROM gross WHERE split = 'train'),
lev AS (SELECT cv, 0.05 / (greatest(stddev_pop(gross) FILTER (k <= 20), stddev_pop(gross) FILTER (k <= 60)) * sqrt(12)) AS leverage FROM recent GROUP BY cv),
test AS (SELECT cv, dt, gross, row_number() OVER (PARTITION BY cv ORDER BY dt) = 1 AS first FROM gross WHERE split = 'test')
SELECT cv, dt, {R('leverage', 'leverage')}, {R('gross', 'gross')}, {R('leverage * gross - CASE WHEN first THEN 0.0002 * turnover * leverage ELSE 0 END - coalesce(rf, 0) * (leverage - 1)', 'r')} FROM test JOIN lev USING (cv) JOIN turn USING (cv) LEFT JOIN rates USING (dt)"""


@query("external_backtest", OUTSIDE + OUTSIDE_RUN)
def external_backtest(spark: SparkSession, d: str) -> DataFrame:
    folds = panel.folds(spark, d)
    held = folds.select("cv").join(F.broadcast(budgets(spark, d))).select("cv", "asset", F.col("budget").alias("w"))
    return rounded(backtest.vol_target_backtest(kept_prices(spark, d), folds, panel.risk_free(spark, d), weights=held, before_first=1.0))


# Models of the next date's return, and tails beyond a threshold


@query("arma_garch_models")
def arma_garch_models(spark: SparkSession, d: str) -> DataFrame:
    r = materialize(panel.class_returns(spark, d), "class-returns")
    before = volatility.past_returns(r, "factor", 60).join(F.broadcast(panel.folds(spark, d).select("cv", "test_start")), F.col("dt") == F.col("test_start"))
    grid = volatility.model_grid(before.where(F.size("past") >= 20).select("cv", "factor", "past"))
    return rounded(volatility.chosen_models(grid, ["cv", "factor"]))


@query("arma_garch_proba")
def arma_garch_proba(spark: SparkSession, d: str) -> DataFrame:
    r = materialize(panel.class_returns(spark, d), "class-returns")
    return rounded(volatility.model_chances(r, panel.folds(spark, d)))


def scaled_events(spark: SparkSession, d: str) -> DataFrame:
    """(key, day, z): each event's value, less the mean of its type and in units of its deviation."""
    rows = panel.table(spark, d, "events").select(F.col("event_type").alias("key"), F.to_date("ts").alias("day"), F.col("value").alias("x"))
    known = rows.groupBy("key").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return rows.join(known, "key").select("key", "day", ((F.col("x") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))


def largest_by_day(rows: DataFrame, tails: DataFrame) -> DataFrame:
    """(key, day, z, p): the largest value of each day and the chance to exceed it."""
    top = rows.groupBy("key", "day").agg(F.max("z").alias("z"))
    p = stats.joined_exceedance(F.col("z"), F.col("u"), F.col("shape"), F.col("scale"))
    return rounded(top.join(tails, "key").select("key", "day", "z", p.alias("p")))


@query("joined_tail")
def joined_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(scaled_events(spark, d), "scaled-events")
    return largest_by_day(rows, grouped.tail_fit(rows.select("key", F.col("z").alias("x"))))


MOMENT_TAIL = """, sc AS (SELECT event_type AS key, CAST(ts AS DATE) AS day, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM events WINDOW w AS (PARTITION BY event_type)),
cut AS (SELECT key, quantile_cont(z, 0.9) AS u FROM sc GROUP BY key), ex AS (SELECT key, u, avg(z - u) AS m, var_samp(z - u) AS v FROM sc JOIN cut USING (key) WHERE z > u GROUP BY key, u),
fit AS (SELECT key, u, 0.5 * (1 - m * m / v) AS shape, 0.5 * m * (1 + m * m / v) AS scale FROM ex), top AS (SELECT key, day, max(z) AS z FROM sc GROUP BY ALL)"""


@query(
    "joined_tail_moments",
    MOMENT_TAIL + f""" SELECT key, day, {R('z', 'z')}, {R(f"CASE WHEN z < u THEN 1 - ({cdf_sql('z')}) ELSE (1 - ({cdf_sql('u')})) * CASE WHEN z <= u THEN 1 WHEN abs(shape) < 1e-9 THEN exp(-(z - u) / scale) WHEN 1 + shape * (z - u) / scale > 0 THEN (1 + shape * (z - u) / scale) ** (-1 / shape) ELSE 0 END END", 'p')} FROM top JOIN fit USING (key)""",
)
def joined_tail_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(scaled_events(spark, d), "scaled-events")
    return largest_by_day(rows, grouped.tail_moments(rows.select("key", F.col("z").alias("x"))))


# Risk budgets on scenarios, corner portfolios


@query("w_scenario_budget")
def w_scenario_budget(spark: SparkSession, d: str) -> DataFrame:
    labels = allocate.best_factor(panel.loadings(spark, d).where("loading * loading >= 0.01"))
    return rounded(budget_operators.scenario_weights(filled_split(spark, d, "week"), labels))


@query("critical_line")
def critical_line(spark: SparkSession, d: str) -> DataFrame:
    rows = filled_split(spark, d)
    means = rows.where("split = 'train'").groupBy("cv", "asset").agg(F.avg("r").alias("m"))
    return rounded(budget_operators.corner_portfolios(grouped.fold_covariances(rows), means))


# How many factors


def train_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = filled_split(spark, d).where("split = 'train'").select("cv", "asset", "dt", "r")
    return materialize(rows, "train-returns")


@query("factor_count_aic")
def factor_count_aic(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(selection.standardised(train_returns(spark, d), ["cv"]), "standardised")
    fits = materialize(selection.factor_fits(rows, ["cv"], range(1, 13)), "factor-fits")
    return rounded(selection.density_aic(materialize(selection.mean_residuals(rows, fits, ["cv"]), "residuals"), ["cv"]))


GIVEN = SCORES + """, sc2 AS (SELECT dt, factor, sum(r * loading) AS score FROM returns JOIN loadings USING (asset) GROUP BY ALL), ml AS (SELECT factor, sum(loading) AS load FROM loadings GROUP BY factor),
tot AS (SELECT dt, sum(r) AS r, count(*) AS n FROM returns GROUP BY dt), kk AS (SELECT CAST(unnest(generate_series(1, 6)) AS INT) AS k),
res AS (SELECT k, dt, (tot.r - sum(score * load)) / n AS e FROM sc2 JOIN ml USING (factor) JOIN tot USING (dt) JOIN kk ON factor < k GROUP BY k, dt, tot.r, n),
nn AS (SELECT count(*) AS n, (count(*) * 0.75) ** (-0.2) AS h FROM res WHERE k = 1),
den AS (SELECT a.k, a.dt, ln(sum(exp(-abs(a.e - b.e) / h)) / (2 * max(n) * max(h))) AS f FROM res a, (SELECT e FROM res WHERE k = 1) b, nn GROUP BY a.k, a.dt),
cur AS (SELECT k, sum(f) AS ll, 2 * ((k - 1) - sum(f)) AS aic FROM den GROUP BY k)"""


@query("given_factor_aic", GIVEN + f" SELECT k, {R('ll', 'log_likelihood')}, {R('aic', 'aic')}, (SELECT k FROM cur ORDER BY round(aic, 9), k LIMIT 1) AS best FROM cur")
def given_factor_aic(spark: SparkSession, d: str) -> DataFrame:
    loads = panel.loadings(spark, d)
    fits = loads.crossJoin(F.broadcast(spark.range(1, 7).select(F.col("id").cast("int").alias("k")))).where("factor < k")
    fits = materialize(fits.select(F.lit(0).alias("cv"), "k", "asset", "factor", F.col("loading").alias("mix"), "loading"), "given-fits")
    rows = kept_returns(spark, d).select(F.lit(0).alias("cv"), "asset", "dt", "r")
    residuals = materialize(selection.mean_residuals(rows, fits, ["cv"]), "residuals")
    return rounded(selection.density_aic(residuals, ["cv"]).drop("cv"))


@query("gap_curve")
def gap_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.gap_statistic(train_returns(spark, d)))


@query("gap_choice")
def gap_choice(spark: SparkSession, d: str) -> DataFrame:
    return selection.chosen_by_gap(materialize(selection.gap_statistic(train_returns(spark, d)), "gap-curve"))


CLUSTERS = DIST + """, lab AS (SELECT asset, arg_max(factor, (loading, -factor)) AS label FROM loadings GROUP BY asset), size AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
ins AS (SELECT x.label, 2 * sum(d) AS s FROM dist JOIN lab x ON x.asset = a JOIN lab y ON y.asset = b AND x.label = y.label GROUP BY x.label)"""


@query("given_inertia", CLUSTERS + f" SELECT {R('ln(sum(coalesce(s, 0) / (n * n)))', 'inertia')} FROM size LEFT JOIN ins USING (label)")
def given_inertia(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(0).alias("k")
    labels = cluster.labels_from_loadings(panel.loadings(spark, d)).select(one, "asset", "label")
    return rounded(selection.cluster_inertias(cluster.distances(kept_returns(spark, d)), labels, ["k"]).drop("k"))


@query("w_diversified")
def w_diversified(spark: SparkSession, d: str) -> DataFrame:
    covariances = materialize(grouped.fold_covariances(filled_split(spark, d)), "covariances")
    return rounded(budget_operators.diversified(covariances, panel.loadings(spark, d)))


def market_returns(spark: SparkSession, d: str) -> DataFrame:
    market = panel.market_price(spark, d).withColumn("asset", F.lit("market"))
    return ret.simple_returns(market).select("dt", F.col("r").alias("y"))


@query("ridge_tracking")
def ridge_tracking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget_operators.tracking(filled_split(spark, d), market_returns(spark, d)))


@query("ridge_quality")
def ridge_quality(spark: SparkSession, d: str) -> DataFrame:
    rows, target = filled_split(spark, d), materialize(market_returns(spark, d), "market-returns")
    return rounded(budget_operators.tracking_quality(rows, target, materialize(budget_operators.tracking(rows, target), "coefficients")))


@query("silhouette_choice")
def silhouette_choice(spark: SparkSession, d: str) -> DataFrame:
    return selection.chosen_by_band(materialize(selection.silhouette_curve(train_returns(spark, d), range(2, 13)), "silhouette-curve"))


# Thresholds by method, and the spread of forecasts by fold and level

METHODS = FOLD_PROBS + IVOL + """, wr AS (SELECT market AS factor, dt, sum(w * r) AS wret FROM returns JOIN wts USING (asset) JOIN classes USING (asset) GROUP BY ALL), tr0 AS (SELECT fp.*, wret FROM fp JOIN wr USING (factor, dt) WHERE split = 'train'),
gn AS (SELECT cv, factor, t, round(sum((CAST(coalesce(p < t, false) AS INT) - 1) * wret), 9) AS gw, round(sum((CAST(coalesce(p < t, false) AS INT) - 1) * r), 9) AS ge FROM tr0 JOIN fgrid USING (cv, factor) GROUP BY ALL),
rc AS (SELECT cv, factor, p, sum(y) AS pos, sum(1 - y) AS neg FROM tr0 WHERE p IS NOT NULL GROUP BY ALL), rp AS (SELECT cv, factor, p, sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY cv, factor), 0) AS tpr, sum(neg) OVER w / nullif(sum(neg) OVER (PARTITION BY cv, factor), 0) AS fpr FROM rc WINDOW w AS (PARTITION BY cv, factor ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
rd AS (SELECT cv, factor, p, round(fpr * fpr + (tpr - 1) * (tpr - 1), 9) AS d FROM rp),
th AS (SELECT 'weighted' AS method, cv, factor, arg_max(t, (gw, t)) AS t FROM gn GROUP BY ALL UNION ALL SELECT 'equal', cv, factor, arg_max(t, (ge, t)) FROM gn GROUP BY ALL UNION ALL SELECT 'calibrated', cv, factor, t FROM fcal UNION ALL SELECT 'roc', cv, factor, arg_min(p, (d, -p)) FROM rd WHERE d IS NOT NULL GROUP BY ALL)"""


@query("fold_thresholds", METHODS + f" SELECT method, cv, factor, {R('t', 't')} FROM th")
def fold_thresholds(spark: SparkSession, d: str) -> DataFrame:
    r = kept_returns(spark, d)
    probs, weights = kept_probabilities(spark, d, r), allocate.inverse_risk(r, 1)
    weighted = r.join(weights, "asset").join(panel.classes(spark, d), "asset").groupBy(F.col("market").alias("factor"), "dt").agg(F.sum(F.col("w") * F.col("r")).alias("weighted"))
    rows = backtest.fold_rows(probs.join(weighted, ["factor", "dt"]), panel.folds(spark, d)).where("split = 'train'")
    return rounded(hedge.best_thresholds(materialize(rows, "train-probabilities")))


LEVELS = {a: NormalDist().inv_cdf(a) for a in (0.01, 0.025, 0.05)}
LAGS = list(range(3, 48))
FOLD_SPREADS = ", fcs AS (" + " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, factor, dt, r, CASE WHEN count(r) OVER w = 12 THEN abs(quantile_cont(r, {a}) OVER w) - abs(avg(r) OVER w + {z!r} * stddev_samp(r) OVER w) END AS spread FROM class_returns WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)" for a, z in LEVELS.items()) + """),
srn AS (SELECT *, row_number() OVER (PARTITION BY alpha, factor ORDER BY dt) AS rn FROM fcs WHERE spread IS NOT NULL), lgs AS (SELECT CAST(unnest(generate_series(3, 47)) AS INT) AS p),
bt AS (SELECT a.alpha, a.factor, a.dt, a.rn, a.r, p AS "window", regr_slope(b.spread, b.rn) AS beta FROM srn a JOIN lgs ON a.rn > p JOIN srn b ON b.alpha = a.alpha AND b.factor = a.factor AND b.rn < a.rn AND b.rn >= a.rn - p GROUP BY ALL),
ft AS (SELECT cv, alpha, factor, min(rn) AS first FROM (SELECT cv, alpha, factor, rn, row_number() OVER (PARTITION BY cv, alpha, factor ORDER BY dt DESC) AS turn FROM srn JOIN folds ON dt >= s AND dt < ts) WHERE turn <= 250 GROUP BY ALL),
tb AS (SELECT cv, bt.*, avg(greatest(beta, 0)) OVER (PARTITION BY cv, alpha, factor, "window" ORDER BY dt ROWS UNBOUNDED PRECEDING) AS level FROM bt JOIN folds ON dt >= s AND dt < ts JOIN ft USING (cv, alpha, factor) WHERE rn - first >= "window"),
gq AS (SELECT cv, alpha, factor, "window", k, round(sum(CASE WHEN round(beta, 12) >= round(k * 0.025 * level, 12) THEN -r ELSE 0 END), 9) AS gain FROM tb, (SELECT unnest(generate_series(0, 800)) AS k) GROUP BY ALL),
bq AS (SELECT cv, alpha, factor, "window", k * 0.025 AS q FROM gq QUALIFY row_number() OVER (PARTITION BY cv, alpha, factor ORDER BY gain DESC, "window", k) = 1),
ts0 AS (SELECT cv, alpha, factor, dt, "window", q, beta, avg(greatest(beta, 0)) OVER (PARTITION BY cv, alpha, factor ORDER BY dt ROWS UNBOUNDED PRECEDING) AS level FROM bt JOIN folds ON dt >= ts AND dt < e JOIN bq USING (cv, alpha, factor, "window"))"""


@query("spread_by_fold", FOLD_SPREADS + f' SELECT alpha, cv, factor, dt, "window", {R("q", "q")}, {R("beta", "beta")}, {R("level", "level")}, CAST(round(beta, 12) >= round(q * level, 12) AS INT) AS label FROM ts0')
def spread_by_fold(spark: SparkSession, d: str) -> DataFrame:
    series = spread.forecast_spreads(materialize(panel.class_returns(spark, d), "class-returns"), LEVELS)
    return rounded(spread.fold_spread_signals(series, panel.folds(spark, d), LAGS))


# Agreement of runs


@query("consensus_assignment", f""", nr AS (SELECT count(DISTINCT run) AS n FROM runs), sh AS (SELECT x.asset AS a, y.asset AS b, count(*) * 1.0 / max(n) AS share FROM runs x JOIN runs y ON x.run = y.run AND x.label = y.label, nr GROUP BY ALL),
nm AS (SELECT min(asset) AS b FROM classes GROUP BY market), mt AS (SELECT a, b, share, row_number() OVER (PARTITION BY a ORDER BY round(share, 12) DESC, b) AS k, sum(share) OVER (PARTITION BY a) AS total FROM sh JOIN nm USING (b)),
al AS (SELECT DISTINCT asset FROM runs) SELECT asset, b AS cluster, {R('share', 'share')} FROM al LEFT JOIN (SELECT * FROM mt WHERE k = 1 AND round(total, 12) > 0.9) ON a = asset""")  # fmt: skip
def consensus_assignment(spark: SparkSession, d: str) -> DataFrame:
    names = panel.classes(spark, d).groupBy("market").agg(F.min("asset").alias("cluster"))
    shares = materialize(cluster.consensus(panel.run_labels(spark, d)), "shares")
    return rounded(cluster.assigned(shares, names, 0.9))


@query("averaged_loadings")
def averaged_loadings(spark: SparkSession, d: str) -> DataFrame:
    loads = materialize(selection.run_loadings(train_returns(spark, d), 4, 10), "run-loadings")
    return rounded(selection.averaged_loadings(loads, selection.matched_factors(loads)))


# The encoder


def encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Weekly returns by fold, standardised ones, what they were standardised with, and the encoders of three runs."""
    rows = filled_split(spark, d, "week")
    scaled, scaler = materialize(backtest.standardised(rows), "standardised"), materialize(backtest.fitted_scaler(rows), "scaler")
    return rows, scaled, scaler, materialize(encoder.fold_encoders(scaled, scaler, runs=3), "encoders")


@query("encoder_loadings")
def encoder_loadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(encoded(spark, d)[3])


@query("linear_activation")
def linear_activation(spark: SparkSession, d: str) -> DataFrame:
    _, scaled, _, fitted = encoded(spark, d)
    return rounded(encoder.linear_activations(scaled, fitted))


@query("encoder_predictions")
def encoder_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows, scaled, scaler, fitted = encoded(spark, d)
    fits = encoder.predictions(encoder.linear_activations(scaled, fitted), fitted, scaler)
    return rounded(encoder.averaged_predictions(fits, rows))


@query("encoder_quality")
def encoder_quality(spark: SparkSession, d: str) -> DataFrame:
    rows, scaled, scaler, fitted = encoded(spark, d)
    fits = encoder.predictions(encoder.linear_activations(scaled, fitted), fitted, scaler)
    return rounded(encoder.prediction_quality(encoder.averaged_predictions(fits, rows)))


# Predictions over runs, and weights down a tree

PREDICTED = """, scaler AS (SELECT cv, asset, avg(r) AS m, coalesce(nullif(stddev_pop(r), 0), 1) AS s FROM split_returns WHERE split = 'train' GROUP BY ALL),
held AS (SELECT cv, run, asset, label, dt, r FROM split_returns JOIN runs USING (asset) WHERE split = 'test'),
guess AS (SELECT cv, asset, dt, avg(p) AS p FROM (SELECT cv, asset, dt, avg(r) OVER (PARTITION BY cv, run, label, dt) AS p FROM held) GROUP BY ALL),
tables AS (SELECT cv, asset, dt, r AS truth, p AS prediction, (r - m) / s AS scaled_truth, (p - m) / s AS scaled_prediction FROM split_returns JOIN guess USING (cv, asset, dt) JOIN scaler USING (cv, asset) WHERE split = 'test')
"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = split(spark, d)
    return backtest.prediction_tables(rows, cluster.cluster_predictions(rows, panel.run_labels(spark, d)))


@query("prediction_tables", PREDICTED + f" SELECT cv, asset, dt, {R('truth', 'truth')}, {R('prediction', 'prediction')}, {R('scaled_truth', 'scaled_truth')}, {R('scaled_prediction', 'scaled_prediction')} FROM tables")
def prediction_tables(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predicted(spark, d))


@query("prediction_errors", PREDICTED + f" SELECT cv, asset, count(*) AS n, round(avg((truth - prediction) ** 2), 9) + 0.0 AS mse, round(avg((scaled_truth - scaled_prediction) ** 2), 9) + 0.0 AS scaled_mse, round(1 - sum((truth - prediction) ** 2) / nullif(sum(truth * truth), 0), 9) + 0.0 AS r2 FROM tables GROUP BY cv, asset")
def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.prediction_errors(predicted(spark, d)), 9)


@query("w_hierarchical")
def w_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    rows = filled_split(spark, d)
    nodes = materialize(hierarchy.cluster_nodes(grouped.fold_covariances(rows)), "tree-nodes")
    return rounded(hierarchy.within_bounds(hierarchy.hierarchical_weights(rows, nodes), 0.01, 0.15))


# Saved results of strategies by fold

SAVED = """, deviations AS (SELECT cv, asset, stddev_samp(r) AS sd FROM split_returns WHERE split = 'train' GROUP BY ALL),
raw AS (SELECT cv, 'equal' AS strategy, asset, 1.0 AS v FROM deviations WHERE sd > 0 UNION ALL SELECT cv, 'ivol', asset, 1 / sd FROM deviations WHERE sd > 0 UNION ALL SELECT cv, 'inverse_variance', asset, 1 / sd / sd FROM deviations WHERE sd > 0),
saved AS (SELECT cv, strategy, dt, sum(w * r) AS r FROM split_returns JOIN (SELECT cv, strategy, asset, v / sum(v) OVER (PARTITION BY cv, strategy) AS w FROM raw) USING (cv, asset) WHERE split = 'test' GROUP BY ALL),
market_returns AS (SELECT dt, price / lag(price) OVER (ORDER BY dt) - 1 AS r FROM market),
together AS (SELECT cv, strategy, dt, r FROM saved UNION ALL SELECT cv, 'market', dt, r FROM market_returns JOIN (SELECT dt, min(cv) AS cv FROM saved GROUP BY dt) USING (dt) WHERE r IS NOT NULL)
"""


def saved(spark: SparkSession, d: str) -> DataFrame:
    """Three strategies' test returns, written and loaded again with one renamed, and the market's beside them."""
    rows, path = split(spark, d), fresh_path(spark, "results")
    weights = materialize(backtest.fold_strategies(rows), "strategies")
    results.save_results(backtest.fold_returns(rows, weights), weights, path)
    returns, _ = results.load_results(spark, path, {"ivp": "inverse_variance"})
    market = ret.simple_returns(panel.market_price(spark, d).withColumn("asset", F.lit("market"))).select(F.col("asset").alias("strategy"), "dt", "r")
    return results.with_external(returns, market)


@query("saved_results", SAVED + f" SELECT cv, strategy, dt, {R('r', 'r')} FROM together")
def saved_results(spark: SparkSession, d: str) -> DataFrame:
    return rounded(saved(spark, d).select("cv", "strategy", "dt", "r"))


@query("saved_statistics", SAVED + f""", grown AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS value FROM together),
falls AS (SELECT strategy, max(1 - value / peak) AS mdd FROM (SELECT *, max(value) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM grown) GROUP BY strategy),
cuts AS (SELECT strategy, quantile_cont(r, 0.05) AS q FROM together GROUP BY strategy),
tails AS (SELECT strategy, -max(q) AS hist_var, -avg(CASE WHEN r <= q THEN r END) AS hist_es FROM together JOIN cuts USING (strategy) GROUP BY strategy)
SELECT strategy, count(*) AS n, {R('avg(r) * 12', 'annual_return')}, {R('stddev_samp(r) * sqrt(12)', 'annual_vol')}, {R('avg(r) / stddev_samp(r) * sqrt(12)', 'sharpe')}, {R('any_value(hist_var)', 'hist_var')}, {R('any_value(hist_es)', 'hist_es')}, {R('any_value(mdd)', 'mdd')}
FROM together JOIN tails USING (strategy) JOIN falls USING (strategy) GROUP BY strategy""")  # fmt: skip
def saved_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats_ = risk.performance(materialize(saved(spark, d), "saved-returns"), panel.risk_free(spark, d), key="strategy")
    return rounded(stats_.select("strategy", "n", "annual_return", "annual_vol", "sharpe", "hist_var", "hist_es", "mdd"))


# Other measures of codependence

MOVES = """, marks AS (SELECT asset, dt, CASE WHEN r >= 0.5 * sd THEN 1 WHEN r <= -0.5 * sd THEN -1 ELSE 0 END AS move, rk <= places AS low, places
  FROM (SELECT asset, dt, r, stddev_samp(r) OVER (PARTITION BY asset) AS sd, rank() OVER (PARTITION BY asset ORDER BY r) AS rk, (count(*) OVER (PARTITION BY asset) * 5 + 99) // 100 AS places FROM returns)),
meetings AS (SELECT x.asset AS a, y.asset AS b, sum(x.move * y.move) AS net, sum(abs(x.move * y.move)) AS pairs, count(*) FILTER (x.move <> 0 OR y.move <> 0) AS moved, count(*) FILTER (x.low AND y.low) AS low, min(least(x.places, y.places)) AS places
  FROM marks x JOIN marks y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY ALL)
"""


@query("codependence", MOVES + f" SELECT a, b, {R('net / nullif(pairs, 0)', 'gerber')}, {R('net / nullif(moved, 0)', 'gerber_any')}, {R('low / nullif(places, 0)', 'tail')} FROM meetings")
def codependence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.codependence(kept_returns(spark, d)))
